"""Quality of predicted classes and scores, computed where the rows are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import or_zero


def threshold_sweep(scored: DataFrame, score: str = "score", thresholds: Sequence[float] = (0.5, 0.4, 0.3)) -> DataFrame:
    """One row per input row and threshold with `predicted`: 1 above the threshold."""
    repeated = scored.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return repeated.withColumn("predicted", F.when(F.col(score) > F.col("threshold"), 1).otherwise(0))


def _cells(df: DataFrame, label: str, predicted: str, by: Sequence[str]) -> DataFrame:
    def cell(actual: int, said: int) -> Column:
        return F.count(F.when((F.col(label) == actual) & (F.col(predicted) == said), 1))

    names = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    counts = [cell(*pair).alias(name) for name, pair in names.items()]
    return df.groupBy(*by).agg(*counts)


def confusion_matrix(df: DataFrame, label: str, predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Two rows per group, (actual, predicted_0, predicted_1); absent cells are 0."""
    row = F.explode(
        F.array(
            F.struct(F.lit(0).alias("actual"), F.col("tn").alias("predicted_0"), F.col("fp").alias("predicted_1")),
            F.struct(F.lit(1).alias("actual"), F.col("fn").alias("predicted_0"), F.col("tp").alias("predicted_1")),
        )
    )
    return _cells(df, label, predicted, by).select(*by, row.alias("r")).select(*by, "r.*")


def _divide(a: Column, b: Column) -> Column:
    return or_zero(F.try_divide(a.cast("double"), b.cast("double")))


def classification_report(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, f1 and support per class, with accuracy, macro and weighted averages.

    `matrix` comes from `confusion_matrix`. An undefined ratio is 0.
    """

    def pick(actual: int, said: int) -> Column:
        return F.sum(F.when(F.col("actual") == actual, F.col(f"predicted_{said}")))

    wide = matrix.groupBy(*by).agg(
        pick(0, 0).alias("tn"), pick(0, 1).alias("fp"), pick(1, 0).alias("fn"), pick(1, 1).alias("tp")
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def scores(hit: Column, wrong: Column, missed: Column) -> tuple[Column, Column, Column]:
        return _divide(hit, hit + wrong), _divide(hit, hit + missed), _divide(2 * hit, 2 * hit + wrong + missed)

    classes = {"0": (scores(tn, fn, fp), tn + fp), "1": (scores(tp, fp, fn), tp + fn)}
    total = tn + fp + fn + tp
    accuracy = _divide(tn + tp, total)
    pairs = list(zip(classes["0"][0], classes["1"][0], strict=True))
    (n0, n1) = (classes[c][1] for c in ("0", "1"))
    lines = {name: (*values, support) for name, (values, support) in classes.items()}
    lines["accuracy"] = (accuracy, accuracy, accuracy, total)
    lines["macro avg"] = (*[(a + b) / 2 for a, b in pairs], total)
    lines["weighted avg"] = (*[_divide(a * n0 + b * n1, total) for a, b in pairs], total)
    names = ("precision", "recall", "f1_score", "support")
    structs = [
        F.struct(F.lit(name).alias("class"), *[value.alias(n) for n, value in zip(names, values, strict=True)])
        for name, values in lines.items()
    ]
    return wide.select(*by, F.explode(F.array(*structs)).alias("r")).select(*by, "r.*")


def auc_hard(df: DataFrame, label: str, predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve of 0/1 predictions: the mean of both classes' recalls."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    hit_rates = F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)
    return _cells(df, label, predicted, by).select(*by, (hit_rates / 2).alias("auc"))


def auc_rank(df: DataFrame, label: str, score: str = "score", buckets: int | None = None) -> DataFrame:
    """Area under the curve of a score: the chance that a positive outranks a negative, ties half.

    Rows collapse to one per score. Score quantiles cut these into buckets of similar size, so running
    totals need one small window over the buckets and one window inside each of them. There are as many buckets
    as shuffle partitions, unless told otherwise.
    """
    buckets = max(2, buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) == 0, 1)).alias("neg")
    )
    cuts = sorted(set(counts.approxQuantile("score", [i / buckets for i in range(1, buckets)], 0.25 / buckets)))
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="score", outputCol="bucket").transform(counts)

    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("bucket").agg(F.sum("neg").alias("neg"))
    before = totals.select("bucket", or_zero(F.sum("neg").over(earlier)).alias("before"))
    inside = Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("inside", or_zero(F.sum("neg").over(inside))).join(F.broadcast(before), "bucket")

    # Twice the number of won pairs, exact in decimals: products of counts outgrow a bigint.
    wide = "decimal(19,0)"
    below = (F.col("before") + F.col("inside")) * 2 + F.col("neg")
    won = F.sum(F.col("pos").cast(wide) * below.cast(wide)).cast("double")
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(F.try_divide(won, 2 * pairs).alias("auc"))
