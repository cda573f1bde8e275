"""A fitted forest as a table of nodes, from which scores and importances are computed again.

The table is what Spark ML saves of the model, so it needs no access to the fitted object and can be kept, queried and
compared between runs. Scores walk all trees for a batch of rows at a time; importances are one aggregation over nodes.
A forest too large for the driver is such a table from the start: `NodeForest`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.staging import new_path

# Nodes that the driver, or a task that scores, holds at a time. Trees are not cut: a larger one is held alone.
MOST_NODES = 200_000


def forest_nodes(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(tree, node, feature, threshold, below, above, gain, weight, shares) of the forest that ends the pipeline.

    A row goes to the node `below` if its feature is at most the threshold. Leaves have a null feature. `weight` is the
    training rows that reached a node and `shares` their classes. Only splits by thresholds are understood.
    """
    forest = model.stages[-1]
    if isinstance(forest, NodeForest):
        return forest.nodes
    path = new_path(spark, "forest")
    forest.write().save(path)
    data = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    inner = F.col("leftChild") >= 0
    weight = F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)
    by_threshold = F.when(inner & (F.col("split.numCategories") >= 0), F.raise_error(F.lit("a split by categories")).cast("double"))
    return data.select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.coalesce(by_threshold, F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0)))).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("below"),
        F.when(inner, F.col("rightChild")).alias("above"),
        F.when(inner, F.col("gain")).alias("gain"),
        weight.alias("weight"),
        F.transform("impurityStats", lambda count: F.try_divide(count, weight)).alias("shares"),
    )


def _passes(nodes: DataFrame, most_nodes: int) -> list[list[int]]:
    """Whole trees in groups of up to `most_nodes` nodes; a larger tree is a group of its own. One row for each tree is read."""
    groups: list[list[int]] = []
    held = 0
    for tree, count in sorted(tuple(r) for r in nodes.groupBy("tree").count().collect()):
        if not groups or held + count > most_nodes:
            groups.append([])
            held = 0
        groups[-1].append(tree)
        held += count
    return groups


def _sent(nodes: DataFrame, group: Sequence[int]) -> Broadcast:
    """The trees of a group as arrays, for all tasks."""
    table = nodes.filter(F.col("tree").isin(list(group))).orderBy("tree", "node").toArrow()
    inner = table["feature"].is_valid().to_numpy()
    tree = table["tree"].to_numpy()
    first, own = np.searchsorted(tree, tree), np.arange(len(tree))
    arrays = {
        "roots": np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]),
        "feature": np.where(inner, table["feature"].fill_null(0).to_numpy(), 0).astype(np.int32),
        "threshold": table["threshold"].fill_null(0.0).to_numpy(),
        # Places in the table; a leaf is its own child.
        "below": np.where(inner, first + table["below"].fill_null(0).to_numpy(), own).astype(np.int32),
        "above": np.where(inner, first + table["above"].fill_null(0).to_numpy(), own).astype(np.int32),
        "inner": inner,
        "shares": table["shares"].combine_chunks().flatten().to_numpy().reshape(len(tree), -1),
    }
    return nodes.sparkSession.sparkContext.broadcast(arrays)


def _walked(plain: DataFrame, nodes: DataFrame, most_nodes: int) -> DataFrame:
    """(row, x) with `shares`: the mean over the trees of the class shares of the leaf that x comes to.

    The driver gathers one group of trees after the other, and a task holds one group at a time.
    """
    groups = _passes(nodes, most_nodes)
    trees = sum(map(len, groups))
    sent = [_sent(nodes, group) for group in groups]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(size, -1 if size else 0)
            total = None
            for shared in sent:
                forest = shared.value
                if total is None:
                    total = np.zeros((size, forest["shares"].shape[1]))
                for root in forest["roots"]:
                    at = np.full(size, root)
                    open_rows = np.flatnonzero(forest["inner"][at])
                    while len(open_rows):
                        here = at[open_rows]
                        low = x[open_rows, forest["feature"][here]] <= forest["threshold"][here]
                        at[open_rows] = np.where(low, forest["below"][here], forest["above"][here])
                        open_rows = open_rows[forest["inner"][at[open_rows]]]
                    total += forest["shares"][at]
                if len(sent) > 1:
                    # A worker would keep every group it has read; it is read from its local copy again.
                    del forest
                    vars(shared).pop("_value", None)
            total = np.zeros((size, 0)) if total is None else total / trees
            offsets = pa.array(np.arange(size + 1) * total.shape[1], pa.int32())
            shares = pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), shares], names=["row", "x", "shares"])

    return plain.mapInArrow(walk, plain.withColumn("shares", F.lit(None).cast("array<double>")).schema)


def score_by_nodes(rows: DataFrame, nodes: DataFrame, features: Sequence[str], most_nodes: int = MOST_NODES) -> DataFrame:
    """`rows` with `shares`, the mean over the trees of the class shares of the leaf that a row comes to.

    Features are cast to double and must not be null. `nodes` is read several times: pass a staged table.
    """
    plain = rows.select(F.struct(*rows.columns).alias("row"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    return _walked(plain, nodes, most_nodes).select("row.*", "shares")


def importances_by_nodes(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """(position, feature, importance), largest first, equal ones by name: each tree's gains by feature, as shares, summed and made shares again."""
    gains = nodes.filter("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("gain"))
    of_tree = gains.withColumn("share", F.try_divide("gain", F.sum("gain").over(Window.partitionBy("tree"))))
    sums = of_tree.groupBy("feature").agg(F.sum("share").alias("share"))
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    # One row for each feature.
    every, order = Window.partitionBy(), Window.orderBy(F.desc("importance"), "feature")
    shares = names.join(F.broadcast(sums), "feature", "left").select(F.col("name").alias("feature"), F.coalesce("share", F.lit(0.0)).alias("share"))
    shares = shares.select("feature", F.coalesce(F.try_divide("share", F.sum("share").over(every)), F.lit(0.0)).alias("importance"))
    return shares.select(F.row_number().over(order).cast("bigint").alias("position"), "feature", "importance")


class NodeForest(Model, HasFeaturesCol, HasProbabilityCol, HasPredictionCol, MLReadable, MLWritable):
    """A forest as a pipeline stage that knows its trees as a written table of nodes only, so the driver never holds them all."""

    def __init__(self, nodes: DataFrame | None = None, most_nodes: int = MOST_NODES) -> None:
        super().__init__()
        self.nodes, self.most_nodes = nodes, most_nodes

    def _transform(self, df: DataFrame) -> DataFrame:
        vector = self.getFeaturesCol()
        others = [F.col(c) for c in df.columns if c != vector]
        plain = df.select(F.struct(*others, F.lit(0).alias("_row")).alias("row"), vector_to_array(vector).alias("x"))
        walked = _walked(plain, self.nodes, self.most_nodes)
        # The first of equal shares, as in Spark ML.
        likely = F.array_position("shares", F.array_max("shares")) - 1
        columns = [array_to_vector("x").alias(vector) if c == vector else F.col(f"row.`{c}`") for c in df.columns]
        return walked.select(*columns, array_to_vector("shares").alias(self.getProbabilityCol()), likely.cast("double").alias(self.getPredictionCol()))

    def write(self) -> MLWriter:
        return _NodeForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _NodeForestReader()


class _NodeForestWriter(MLWriter):
    def __init__(self, forest: NodeForest) -> None:
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.forest, path, self.sparkSession, {"most_nodes": self.forest.most_nodes})
        self.forest.nodes.write.parquet(f"{path}/nodes")


class _NodeForestReader(MLReader):
    def load(self, path: str) -> NodeForest:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        forest = NodeForest(self.sparkSession.read.parquet(f"{path}/nodes"), metadata["most_nodes"])
        forest._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(forest, metadata)
        return forest
