"""Column expressions shared by the operators. All of them stay inside code generation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def phone_tail(number: Column, digits: int = 11) -> Column:
    """Drop a country prefix: keep the last `digits` characters of a longer number."""
    return F.when(F.length(number) > digits, F.substring(number, -digits, digits)).otherwise(number)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when the text contains at least one of the words."""
    return reduce(lambda left, right: left | right, [F.contains(text, F.lit(word)) for word in words])


def search_intent(key: Column, single: Column) -> Column:
    """0 for a search of which `single` says that it is for a single resource, null for no search, 1 for anything else."""
    return (
        F.when(single, F.lit(0))
        .when(key.isNull() | (F.lower(key) == "null"), F.lit(None).cast("int"))
        .otherwise(F.lit(1))
    )


def recency_flag(day: Column, anchor: Column, lookback_days: int) -> Column:
    """1 inside the trailing window that ends at the anchor, 2 before it, 0 for later or no day."""
    first = F.date_sub(anchor, lookback_days - 1)
    return F.when(day.between(first, anchor), 1).when(day < first, 2).otherwise(0)


def ratio(total: Column, count: Column, scale: int = 1, digits: int = 4) -> Column:
    """`scale` * total / count, rounded half up, as a double; null when the count is zero.

    The division is done in decimals: a quotient such as 905.22125 has no exact double, and rounding the
    nearest one may go down. `total` is a whole number, an amount or a duration with up to six decimals.
    """
    exact = F.try_divide((total * scale).cast("decimal(30,6)"), count.cast("decimal(20,0)"))
    return F.round(exact, digits).cast("double")


def mean_of(total: Column, count: Column) -> Column:
    """Unrounded quotient of an exact sum and a count."""
    return F.try_divide(total.cast("double"), count.cast("double"))


def sum_if(condition: Column) -> Column:
    """Number of rows that meet the condition; 0 rather than null on an all-null group."""
    return F.sum(F.when(condition, 1).otherwise(0))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def row_hash(seed: int, *keys: Column) -> Column:
    """Portable 32-digit hexadecimal hash of the keys, the same for any partitioning."""
    return F.md5(F.concat_ws("|", *[key.cast("string") for key in keys], F.lit(str(seed))))


def hash_number(digest: Column, first: int = 1, digits: int = 8) -> Column:
    """Whole number read from `digits` hexadecimal digits of a digest."""
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("bigint")
