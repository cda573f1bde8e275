"""Balanced contiguous shards by byte size.

Rows are put in one global order, and a prefix sum of their sizes decides their shard. The prefix sum is
made of two parts that both scale: totals per range partition (one small row each), and running sums
inside a partition. Targets are equal, so shards are contiguous in the order and their sizes differ by
about one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.staging import stage

# Added to the bytes of a text: what a record costs besides its text.
RECORD_BYTES = 8
_FIRST, _BEFORE = Window.unboundedPreceding, -1


def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes of the text plus `RECORD_BYTES`; a null text has no bytes, and their checksum is 0."""
    text = F.col(text_column)
    return docs.select(
        F.col(id_column).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + RECORD_BYTES).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("bigint")).alias("text_crc32"),
    )


def balanced_shards(rows: DataFrame, shards: int, partitions: int | None = None) -> DataFrame:
    """Adds `shard` (0 to shards - 1) and `slot` (0, 1, ... in each shard) to (doc_id, size, text_crc32).

    The order is by id, then checksum and size; rows equal in all of them are interchangeable, and still
    are dealt to different ranges, so one id may hold any share of the rows. Null ids come first. A row
    belongs to the shard in which the middle of its bytes falls: no shard is more than half a row at
    either end away from its target, unless one row is larger than a target. With fewer rows than shards
    some shards are empty; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_crc32", "size", "tie"]
    # Range borders are sampled in a pass of their own: the short rows are written first, so that texts are read once.
    dealt = (
        stage(rows, "sized")
        .withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(partitions, *[F.col(c) for c in order])
        .withColumn("part", F.spark_partition_id())
    )
    # Range borders come from a sample, so the dealing is written down before anything is derived from it.
    dealt = stage(dealt, "dealt")

    ahead = Window.orderBy("part").rowsBetween(_FIRST, _BEFORE)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_ahead"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_ahead"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(_FIRST, Window.unboundedFollowing)).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    # One row for each range partition: a bound that does not depend on the number of rows.
    placed = (
        dealt.withColumn("bytes_inside", F.sum("size").over(inside.rowsBetween(_FIRST, 0)) - F.col("size"))
        .withColumn("rows_inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("bytes_ahead") + F.col("bytes_inside"))
        .withColumn("position", F.col("rows_ahead") + F.col("rows_inside"))
        .withColumn(
            "shard",
            F.expr(f"cast((cast(2 * start + size as decimal(38, 0)) * {shards}) div (cast(2 as decimal(38, 0)) * all_bytes) as int)"),
        )
        .select("doc_id", "size", "text_crc32", "shard", "position")
    )
    # Shards are contiguous, so the counts of the shards before one give the position of its first row.
    counts = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    firsts = counts.select("shard", F.coalesce(F.sum("rows").over(Window.orderBy("shard").rowsBetween(_FIRST, _BEFORE)), F.lit(0)).alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot")
    )
