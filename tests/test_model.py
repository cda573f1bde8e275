"""Fit, save, load and apply on the test tables."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from tidemark.config import training_config
from tidemark.functions.staging import new_path, stage
from tidemark.operators import forest, metrics
from tidemark.operators.model import feature_importances, fit_forest, score
from tidemark.operators.prep import encode_ordinals, hash_split
from tidemark.plans.model_registry import LABEL, labelled_features
from tidemark.plans.model_run import ModelParams, evaluate, train_model

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    cfg = training_config()
    rows = labelled_features(spark, FOLDER, cfg)
    return rows, train_model(rows, cfg.words, ModelParams(label=LABEL, trees=10, depth=6))


def test_split_comes_before_resampling(fitted):
    """Test rows are real customers, each once, and none of them was trained on."""
    rows, trained = fitted
    assert trained.test.count() == trained.test.select("cust_id").distinct().count()
    assert trained.test.join(rows, "cust_id", "left_anti").isEmpty()


def test_saved_model_scores_alike(spark, fitted):
    rows, trained = fitted
    path = new_path(spark, "model")
    trained.model.write().save(path)
    later = encode_ordinals(rows, training_config().words)
    one, two = (score(m, later, ("cust_id",)).orderBy("cust_id").collect() for m in (trained.model, PipelineModel.load(path)))
    assert one == two and len(one) == rows.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in one)


def test_predicted_class_is_the_sweep_at_half(fitted):
    rows, trained = fitted
    scored = score(trained.model, encode_ordinals(rows, training_config().words), ("cust_id",))
    swept = metrics.threshold_sweep(scored.drop("predicted"), thresholds=[0.5]).select("cust_id", F.col("predicted").alias("p"))
    assert scored.join(swept, "cust_id").filter("predicted <> p").isEmpty()


def test_importances(spark, fitted):
    _, trained = fitted
    ranked = feature_importances(spark, trained.model).collect()
    assert [r["position"] for r in ranked] == list(range(1, len(trained.prep.features) + 1))
    assert sorted((r["importance"] for r in ranked), reverse=True) == [r["importance"] for r in ranked]
    assert abs(sum(r["importance"] for r in ranked) - 1) < 1e-9


def test_forest_learns_a_rule_and_auc_agrees_with_the_evaluator(spark):
    rows = spark.range(600).select(
        "id", (F.col("id") % 10).cast("double").alias("a"), (F.xxhash64("id") % 7).cast("double").alias("b")
    )
    rows = rows.withColumn("label", F.when(F.col("a") > 6, 1).otherwise(0))
    model = fit_forest(rows, ["a", "b"], "label", trees=20, depth=4)
    scored = score(model, rows, ("id", "label"))
    assert scored.filter("label <> predicted").count() == 0
    noisy = rows.select("label", (F.col("a") + F.col("b")).alias("score"))
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(noisy)
    assert abs(metrics.auc_rank(noisy, "label").first()["auc"] - theirs) < 1e-9


@pytest.mark.parametrize("most_nodes", [1_000_000, 40])
def test_scores_from_nodes_are_the_model_s(spark, fitted, most_nodes):
    rows, trained = fitted
    nodes = stage(forest.forest_nodes(spark, trained.model), "nodes")
    later = encode_ordinals(rows, training_config().words)
    prepared = trained.model.stages[0].transform(later)
    inputs = trained.model.stages[-2].getInputCols()
    want = {r["cust_id"]: r["p"] for r in trained.model.transform(later).select("cust_id", vector_to_array("probability").alias("p")).collect()}
    got = {r["cust_id"]: r["shares"] for r in forest.score_by_nodes(prepared, nodes, inputs, most_nodes=most_nodes).select("cust_id", "shares").collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-12 for i in want for a, b in zip(got[i], want[i]))


def test_importances_from_nodes_are_the_model_s(spark, fitted):
    _, trained = fitted
    nodes = forest.forest_nodes(spark, trained.model)
    inputs = trained.model.stages[-2].getInputCols()
    got = forest.importances_by_nodes(nodes, inputs).orderBy("position").collect()
    want = feature_importances(spark, trained.model).collect()
    assert {r["feature"]: round(r["importance"], 12) for r in got} == {r["feature"]: round(r["importance"], 12) for r in want}
    assert [r["position"] for r in got] == list(range(1, len(inputs) + 1))


def test_held_out_quality_of_a_noisy_rule(spark):
    """A forest of noise would be near 0.5."""
    rows = spark.range(4000).select("id", (F.col("id") % 10).cast("double").alias("a"), (F.xxhash64("id") % 7).cast("double").alias("b"))
    rows = rows.withColumn("label", F.when((F.col("a") > 6) != (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) == 0), 1).otherwise(0))
    split = hash_split(rows, "id")
    model = fit_forest(split.filter("is_test = 0"), ["a", "b"], "label", trees=20, depth=5)
    scored = score(model, split.filter("is_test = 1"), ("label",))
    assert metrics.auc_rank(scored, "label").first()["auc"] > 0.8


def test_deep_forest_is_fitted_on_kept_nodes(spark):
    """No level sends the trees to its tasks, and the trees are those of a fit that does."""
    rows = spark.range(3000).select(*[(F.xxhash64("id", F.lit(i)) % 50).cast("double").alias(f"x{i}") for i in range(4)], F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("label"))
    rows = stage(rows, "noise")
    inputs = [f"x{i}" for i in range(4)]
    kept = fit_forest(rows, inputs, "label", trees=5, depth=20).stages[-1]
    assembled = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows)
    sent = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=5, maxDepth=20, seed=42).fit(assembled)
    assert kept.getCacheNodeIds() and max(tree.depth for tree in kept.trees) > 10

    def splits(model):
        return [tree.toDebugString.split("\n", 1)[1] for tree in model.trees]

    assert splits(kept) == splits(sent)


@pytest.fixture(scope="module")
def noise(spark):
    """Rows that no shallow tree tells apart, and a forest of them that is fitted some trees at a time."""
    rows = spark.range(3000).select("id", *[(F.xxhash64("id", F.lit(i)) % 50).cast("double").alias(f"x{i}") for i in range(4)], F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("label"))
    rows = stage(rows, "noise")
    return rows, fit_forest(rows, [f"x{i}" for i in range(4)], "label", trees=7, depth=20, most_nodes=4000)


def test_large_forest_is_not_held_by_the_driver(spark, noise):
    """Its trees are written in groups, all of them, no two alike; and it learns as a forest does."""
    rows, model = noise
    assert isinstance(model.stages[-1], forest.NodeForest)
    nodes = model.stages[-1].nodes
    of_trees = nodes.groupBy("tree").agg(F.count("*").alias("n"), F.sum("threshold").alias("t")).collect()
    assert sorted(r["tree"] for r in of_trees) == list(range(7)) and len({(r["n"], r["t"]) for r in of_trees}) == 7
    assert sum(r["n"] for r in of_trees) > 4000
    # Each group is a written model of at most 4000 nodes, two trees here.
    assert nodes.groupBy(F.input_file_name()).agg(F.count_distinct("tree").alias("n")).agg(F.max("n")).first()[0] <= 2
    scored = score(model, rows, ("id", "label"))
    assert scored.count() == 3000 and scored.filter("label = predicted").count() > 2700
    assert scored.filter("not score between 0 and 1 or predicted <> cast(score > 0.5 as int)").isEmpty()


def test_large_forest_saves_and_ranks(spark, noise):
    rows, model = noise
    path = new_path(spark, "model")
    model.write().save(path)
    one, two = (score(m, rows, ("id",)).orderBy("id").collect() for m in (model, PipelineModel.load(path)))
    assert one == two and len(one) == 3000
    ranked = feature_importances(spark, PipelineModel.load(path)).collect()
    assert {r["feature"] for r in ranked} == {"x0", "x1", "x2", "x3"} and abs(sum(r["importance"] for r in ranked) - 1) < 1e-9


@pytest.mark.parametrize("most_nodes", [1_000_000, 4000])
def test_stage_of_nodes_scores_as_the_model(spark, noise, most_nodes):
    rows, _ = noise
    whole = fit_forest(rows, [f"x{i}" for i in range(4)], "label", trees=5, depth=20)
    assert not isinstance(whole.stages[-1], forest.NodeForest)
    staged = stage(forest.forest_nodes(spark, whole), "nodes")
    walked = PipelineModel([*whole.stages[:-1], forest.NodeForest(staged, most_nodes)])
    want = {r["id"]: r for r in score(whole, rows, ("id",)).collect()}
    got = {r["id"]: r for r in score(walked, rows, ("id",)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i]["score"] - want[i]["score"]) < 1e-12 and got[i]["predicted"] == want[i]["predicted"] for i in want)
    assert walked.transform(rows).select(whole.transform(rows).drop("rawPrediction").columns).count() == 3000
    assert score(walked, rows.filter("id < 0"), ("id",)).isEmpty()


def test_later_day_is_measured_on_a_large_forest(spark, fitted):
    """All measures of a forest of nodes are those of the model it was read from."""
    rows, trained = fitted
    staged = stage(forest.forest_nodes(spark, trained.model), "nodes")
    walked = PipelineModel([*trained.model.stages[:-1], forest.NodeForest(staged, 40)])
    words = training_config().words
    want, got = (evaluate(m, rows, words, LABEL) for m in (trained.model, walked))
    assert sorted(map(repr, want.confusion.collect())) == sorted(map(repr, got.confusion.collect()))
    assert sorted(map(repr, want.auc_hard.collect())) == sorted(map(repr, got.auc_hard.collect()))
