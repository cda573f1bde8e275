"""Random forest: fit, apply, rank the inputs."""

from __future__ import annotations

from collections.abc import Sequence
from random import Random

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.staging import new_path
from tidemark.operators.forest import MOST_NODES, NodeForest, forest_nodes, importances_by_nodes


def fit_forest(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    before: Sequence[Transformer] = (),
    trees: int = 100,
    depth: int = 30,
    seed: int = 42,
    most_nodes: int = MOST_NODES,
) -> PipelineModel:
    """Fit on a prepared table, which is read several times. `before` are the fitted preparation stages to put in front, so
    that the returned model applies to raw feature rows and saves as one.

    Each row's node in each tree is kept from level to level. Otherwise every task of a level is sent all trees and walks them
    from the root again, which grows with the forest.

    Spark ML builds trees on the driver, and sends the whole model with every task that scores. A forest of more than
    `most_nodes` nodes, as a first tree tells, is therefore fitted some trees at a time, each group with a seed of its own, and
    ends the pipeline as a `NodeForest`.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    rows = assembler.transform(train)

    def fit(number: int, seed: int, subset: str = "auto") -> RandomForestClassificationModel:
        return RandomForestClassifier(
            labelCol=label, featuresCol="features", numTrees=number, maxDepth=depth, seed=seed, cacheNodeIds=True, featureSubsetStrategy=subset
        ).fit(rows)

    def whole() -> PipelineModel:
        return PipelineModel([*before, assembler, fit(trees, seed)])

    # A tree has fewer than two nodes for each row, so small tables need no look at a tree.
    if trees == 1 or trees * min(2 * train.count(), 2 ** (depth + 1)) <= most_nodes:
        return whole()
    # "auto" is the root of their number for several trees, and all for one.
    group = fit(1, seed, "sqrt")
    if trees * group.totalNumNodes <= most_nodes:
        return whole()
    spark, path, done, of_tree = train.sparkSession, new_path(train.sparkSession, "nodes"), 0, 0
    while True:
        nodes = forest_nodes(spark, PipelineModel([group])).withColumn("tree", F.col("tree") + F.lit(done))
        nodes.write.mode("append").parquet(path)
        done, of_tree = done + group.getNumTrees, max(of_tree, -(-group.totalNumNodes // group.getNumTrees))
        # Nothing of a group stays on the driver.
        del group
        if done >= trees:
            break
        group = fit(min(max(1, most_nodes // of_tree), trees - done), Random(f"{seed} {done}").getrandbits(31), "sqrt")
    return PipelineModel([*before, assembler, NodeForest(spark.read.parquet(path), most_nodes)])


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The kept columns with the probability of class 1 and the predicted class."""
    return model.transform(df).select(
        *keep,
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("bigint").alias("predicted"),
    )


def feature_importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(position, feature, importance), largest first; equal values in name order."""
    assembler, forest = model.stages[-2:]
    if isinstance(forest, NodeForest):
        return importances_by_nodes(forest.nodes, assembler.getInputCols())
    ranked = sorted(
        zip(assembler.getInputCols(), forest.featureImportances.toArray().tolist(), strict=True),
        key=lambda pair: (-pair[1], pair[0]),
    )
    rows = [(position, name, value) for position, (name, value) in enumerate(ranked, start=1)]
    return spark.createDataFrame(rows, "position long, feature string, importance double")
