"""Published confusion matrices and the metrics printed for them."""

import pytest
from pyspark.sql import functions as F
from tidemark.operators import metrics

# Fixed values: (tn, fp, fn, tp), AUC of hard labels, accuracy, precision, recall, f1.
PUBLISHED = {
    "split": ((64521, 74, 244, 38315), 0.9963, 1.00, 1.00, 0.99, 1.00),
    "0.5": ((47754, 45910, 579, 812), 0.5468, 0.51, 0.02, 0.58, 0.03),
    "0.4": ((19598, 74066, 243, 1148), 0.5173, 0.22, 0.02, 0.83, 0.03),
    "0.3": ((6659, 87005, 82, 1309), 0.5061, 0.08, 0.01, 0.94, 0.03),
}


@pytest.fixture(scope="module")
def predictions(spark):
    cells = []
    for name, (counts, *_) in PUBLISHED.items():
        for (label, predicted), n in zip(((0, 0), (0, 1), (1, 0), (1, 1)), counts):
            cells.append((name, label, predicted, n))
    rows = spark.createDataFrame(cells, "case string, label long, predicted long, n long")
    return rows.withColumn("i", F.explode(F.sequence(F.lit(1), "n"))).drop("n", "i")


def test_published_metrics(predictions):
    matrix = metrics.confusion_matrix(predictions, "label", by=["case"])
    found = {(r["case"], r["actual"]): (r["predicted_0"], r["predicted_1"]) for r in matrix.collect()}
    report = {(r["case"], r["class"]): r for r in metrics.classification_report(matrix, ["case"]).collect()}
    aucs = {r["case"]: r["auc"] for r in metrics.auc_hard(predictions, "label", by=["case"]).collect()}
    for name, ((tn, fp, fn, tp), auc, accuracy, precision, recall, f1) in PUBLISHED.items():
        assert found[name, 0] == (tn, fp) and found[name, 1] == (fn, tp)
        assert round(aucs[name], 4) == auc
        assert round(report[name, "accuracy"]["f1_score"], 2) == accuracy
        positive = report[name, "1"]
        assert [round(positive[c], 2) for c in ("precision", "recall", "f1_score")] == [precision, recall, f1]
        assert positive["support"] == fn + tp


def test_zero_cells_and_undefined_ratios(spark):
    rows = spark.createDataFrame([(0, 0)] * 3, "label long, predicted long")
    matrix = metrics.confusion_matrix(rows, "label")
    assert sorted(tuple(r) for r in matrix.collect()) == [(0, 3, 0), (1, 0, 0)]
    report = {r["class"]: r for r in metrics.classification_report(matrix).collect()}
    assert report["1"]["precision"] == report["1"]["recall"] == report["1"]["f1_score"] == 0
    assert metrics.auc_hard(rows, "label").first()["auc"] is None


@pytest.mark.parametrize("buckets", [2, 7, 256])
@pytest.mark.parametrize("digits", [1, 2, 6])
def test_rank_auc(spark, buckets, digits):
    import random

    random.seed(digits)
    rows = [(int(random.random() < 0.3), round(random.random(), digits)) for _ in range(800)]
    positives, negatives = ([s for y, s in rows if y == c] for c in (1, 0))
    won = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives)
    df = spark.createDataFrame(rows, "label long, score double")
    found = metrics.auc_rank(df, "label", buckets=buckets).first()["auc"]
    assert abs(found - won / len(positives) / len(negatives)) < 1e-12


def test_rank_auc_of_one_score_and_of_hard_labels(spark, predictions):
    flat = spark.createDataFrame([(0, 0.4), (1, 0.4), (1, 0.4)], "label long, score double")
    assert metrics.auc_rank(flat, "label").first()["auc"] == 0.5
    case = predictions.filter("case = '0.5'").withColumn("score", F.col("predicted").cast("double"))
    assert round(metrics.auc_rank(case, "label").first()["auc"], 4) == 0.5468


def test_thresholds_are_strict(spark):
    scored = spark.createDataFrame([(1, 0.5), (2, 0.45), (3, 0.3)], "id long, score double")
    found = {(r["id"], r["threshold"]): r["predicted"] for r in metrics.threshold_sweep(scored).collect()}
    assert found[1, 0.5] == 0 and found[1, 0.4] == 1 and found[2, 0.4] == 1 and found[3, 0.3] == 0
