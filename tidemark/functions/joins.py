"""Join helpers for keys that are often missing and for small filter sides."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_broadcast(side: DataFrame) -> DataFrame:
    """`side` for joins in which it grows with the input: both sides are dealt by the key.

    Left to itself the optimizer goes by the size of files. Keys in a row shrink to next to nothing there, so millions of
    them would be sent through the driver.
    """
    return side.hint("merge")


def dealt_distinct(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct rows of a table in which nearly all rows differ, dealt by `keys` before they are gathered.

    `distinct` alone gathers the different rows of every scan task first. That saves nothing here, and a file of few small
    columns puts very many rows into one task. The number of parts is given, or adaptive execution would merge them by their
    bytes, which shrink to next to nothing as well.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *[F.col(key) for key in keys]).distinct()


def left_join_sparse_key(left: DataFrame, right: DataFrame, keys: str | Sequence[str], slots: int | None = None) -> DataFrame:
    """Left join in which rows with a null key are spread over `slots` slots, by default 16 for each shuffle partition.

    They match nothing, yet a plain left join would hash them all to one task.
    """
    slots = slots or 16 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [keys] if isinstance(keys, str) else list(keys)
    missing = reduce(or_, [F.col(key).isNull() for key in keys])
    rest = [c for c in left.columns if c not in keys]
    spread = F.pmod(F.xxhash64(*rest), F.lit(slots)) + 1
    slotted = left.withColumn("_slot", F.when(missing, spread).otherwise(F.lit(0).cast("bigint")))
    # Always 0, but computed: a constant would be folded out of the join keys, and with it the spread.
    target = right.filter(~missing).withColumn("_slot", F.pmod(F.xxhash64(*keys), F.lit(1)))
    return slotted.join(not_broadcast(target), [*keys, "_slot"], "left").drop("_slot")


# A comparison that every key meets. The optimizer builds its runtime Bloom filter only from a side that has one.
_LOWEST = {"bigint": -(2**63), "int": -(2**31), "string": ""}


def keep_members(rows: DataFrame, members: DataFrame, key: str, spread: Sequence[str] = ()) -> DataFrame:
    """Rows whose key is in `members`, which are not broadcast.

    Spark's own runtime filter drops most other rows before the shuffle, within the sizes that `spark.sql.optimizer.runtime.bloomFilter.*` allow.
    `spread` names the columns by which the rows are dealt anew. A following aggregation on these keeps to them
    and not to the join's own partitioning, so that a key with very many rows can be split in the join.
    """
    side = members.select(F.col(members.columns[0]).alias(key))
    lowest = _LOWEST.get(side.schema[key].dataType.simpleString())
    if lowest is not None:
        side = side.filter(F.col(key) >= F.lit(lowest))
    kept = rows.join(not_broadcast(side), key, "left_semi")
    return kept.repartition(*[F.col(c) for c in spread]) if spread else kept


def keep_member_groups(groups: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows of an aggregate whose key is in `members`, joined after the aggregation.

    The optimizer moves a semi join below an aggregation and below the expressions it gathers, so the rows would be dealt with
    all that these read, whole texts for a flag or two. An inner join stays where it is.
    """
    side = members.select(F.col(members.columns[0]).alias(key)).distinct()
    return groups.join(not_broadcast(side), key)
