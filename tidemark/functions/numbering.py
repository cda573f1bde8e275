"""Consecutive numbers for rows in a global order, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.staging import Stage, stage

# monotonically_increasing_id holds the partition above these bits and the position in it below.
_POSITION_BITS = 33


def number_rows(df: DataFrame, order: Sequence[str], made: str = "number", partitions: int | None = None, keep: Stage = stage) -> DataFrame:
    """`df` with `made`, 0 to n - 1 in the order of the columns `order`, nulls first; rows equal in them in any order.

    Rows are dealt by ranges and sorted there; a row's number is its position plus the rows of the ranges before,
    one small row for each range.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in (*order, "_tie")]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).drop("_tie")
    place = F.monotonically_increasing_id()
    dealt = dealt.withColumns({"_range": F.shiftright(place, _POSITION_BITS), "_place": place.bitwiseAND((1 << _POSITION_BITS) - 1)})
    # Borders of ranges come from a sample, so the dealing is written down.
    dealt = keep(dealt, "ranges")
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    ranges = ranges.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    # As many rows as there are ranges.
    return dealt.join(F.broadcast(ranges), "_range").withColumn(made, F.col("_before") + F.col("_place")).select(*df.columns, made)
