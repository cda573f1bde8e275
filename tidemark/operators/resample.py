"""Rebalancing: synthetic minority rows, then a random but reproducible part of the majority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import hash_number, or_zero, row_hash
from tidemark.functions.staging import Stage, stage
from tidemark.operators.neighbors import nearest_neighbors

HASH_CELL_DIGITS = 4


def class_sizes(df: DataFrame, label: str) -> tuple[int, int]:
    """(majority, minority) row counts: labels 0 and 1."""
    row = df.agg(F.count(F.when(F.col(label) == 0, 1)), F.count(F.when(F.col(label) == 1, 1))).first()
    return row[0], row[1]


def first_by_hash(df: DataFrame, id_column: str, count: int, seed: int) -> DataFrame:
    """The `count` rows with the smallest (hash, id), without a global sort.

    A histogram over the leading hash digits, at most 65,536 rows, tells which cells are kept whole.
    Only the one cell that the limit cuts through is ranked. Ids are expected to be unique.
    """
    hashed = df.withColumn("_hash", row_hash(seed, F.col(id_column)))
    cell = F.substring("_hash", 1, HASH_CELL_DIGITS)
    histogram = hashed.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = histogram.withColumn("_before", or_zero(F.sum("_rows").over(earlier))).filter(F.col("_before") < count)
    placed = hashed.withColumn("_cell", cell).join(F.broadcast(before), "_cell")
    whole = placed.filter(F.col("_before") + F.col("_rows") <= count)
    cut = placed.filter(F.col("_before") + F.col("_rows") > count)
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_hash", id_column))
    partial = cut.withColumn("_rank", rank).filter(F.col("_rank") <= F.lit(count) - F.col("_before"))
    return whole.select(*df.columns).unionByName(partial.select(*df.columns))


def undersample(df: DataFrame, label: str, id_column: str, ratio: float = 0.6, seed: int = 42, lenient: bool = False) -> DataFrame:
    """Keep all of class 1 and as much of class 0 as makes class 1 / class 0 equal `ratio`.

    If class 0 is too small for the ratio this is an error, or with `lenient` the table stays as it is.
    """
    majority, minority = class_sizes(df, label)
    kept = int(minority / ratio)
    if kept > majority and not lenient:
        raise ValueError(f"a ratio of {ratio} is out of reach with {minority} rows of class 1 and {majority} of class 0")
    if kept >= majority:
        return df
    negatives = first_by_hash(df.filter(F.col(label) == 0), id_column, kept, seed)
    return df.filter(F.col(label) == 1).unionByName(negatives)


def smote(
    df: DataFrame,
    label: str,
    id_column: str,
    features: Sequence[str],
    ratio: float = 0.2,
    k: int = 5,
    seed: int = 42,
    keep: Stage = stage,
    lenient: bool = False,
) -> DataFrame:
    """Add synthetic class-1 rows x + u * (neighbour - x) until class 1 is `ratio` of class 0.

    Every minority row serves equally often as a base, and the rest of the count goes to the rows of
    the smallest hash; neighbour and u come from a hash of (id, copy). Nothing depends on partitioning.
    Indicator columns become fractional, as in plain interpolation. Rows keep the id of their base and
    carry `is_synthetic`. A ratio that is exceeded already, and fewer than k other rows of class 1, are errors;
    with `lenient` nothing is added in the first case, and all other rows are neighbours in the second.
    """
    majority, minority = class_sizes(df, label)
    wanted = int(ratio * majority) - minority
    original = df.select(id_column, label, *features).withColumn("is_synthetic", F.lit(0))
    if wanted < 0 and not lenient:
        raise ValueError(f"class 1 already exceeds {ratio} of class 0")
    if wanted <= 0:
        return original
    if k > minority - 1 and not lenient:
        raise ValueError(f"{k} neighbours are asked for among {minority} rows of class 1")
    if minority < 2:
        raise ValueError("interpolation needs at least two rows of class 1")
    x = F.array(*[F.col(f).cast("double") for f in features])
    points = keep(df.filter(F.col(label) == 1).select(F.col(id_column).cast("bigint").alias("id"), x.alias("x")), "points")
    neighbors = nearest_neighbors(points, min(k, minority - 1), keep=keep)

    every, rest = divmod(wanted, minority)
    base = points.withColumn("copies", F.lit(every))
    if rest:
        extra = first_by_hash(points.select("id"), "id", rest, seed).withColumn("extra", F.lit(1))
        base = base.join(extra, "id", "left").withColumn("copies", F.col("copies") + or_zero(F.col("extra"))).drop("extra")
    draws = base.filter(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))

    digest = row_hash(seed, F.col("id"), F.col("copy"))
    pick = F.pmod(hash_number(digest, 1), F.size("neighbors")).cast("int") + 1
    drawn = draws.join(neighbors, "id").select(
        "id",
        "x",
        F.element_at("neighbors", pick).alias("other"),
        (hash_number(digest, 9) / F.lit(4294967296.0)).alias("u"),
    )
    targets = points.select(F.col("id").alias("other"), F.col("x").alias("y"))
    mixed = drawn.join(targets, "other").select(
        "id", F.zip_with("x", "y", lambda a, b: a + F.col("u") * (b - a)).alias("z")
    )
    synthetic = mixed.select(
        F.col("id").cast(df.schema[id_column].dataType).alias(id_column),
        F.lit(1).cast(df.schema[label].dataType).alias(label),
        *[F.col("z")[i].alias(f) for i, f in enumerate(features)],
        F.lit(1).alias("is_synthetic"),
    )
    doubles = [F.col(f).cast("double").alias(f) for f in features]
    return original.select(id_column, label, *doubles, "is_synthetic").unionByName(synthetic)
