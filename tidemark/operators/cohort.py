"""Who was active in the window, and on which date each customer is anchored."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig
from tidemark.functions.expr import phone_tail
from tidemark.functions.joins import left_join_sparse_key, not_broadcast
from tidemark.sources.model import Sources


def phones(eav: DataFrame, phone_name: str) -> DataFrame:
    """(user_id, tel_num) of every user with a phone attribute."""
    return eav.filter((F.col("three_class_name") == phone_name) & F.col("feature_value").isNotNull()).select(
        "user_id", F.col("feature_value").alias("tel_num")
    )


def attribute_by_phone(calls: DataFrame, phone_book: DataFrame, digits: int = 11) -> DataFrame:
    """Calls with `tel_num` and the `user_id` who owns it; null when nobody does.

    A number shared by several users yields one row for each of them.
    """
    numbered = calls.withColumn("tel_num", phone_tail(F.col("cust_tel_no"), digits))
    return left_join_sparse_key(numbered, phone_book, "tel_num")


def _call_days(src: Sources, cfg: FeatureConfig) -> DataFrame:
    """Distinct (tel_num, create_date) of connected calls, so the phone join sees no raw calls."""
    window = F.col("call_date").between(cfg.activity_start, cfg.activity_end)
    return (
        src.calls.filter((F.col("status") == cfg.words.connected) & window)
        .select(
            phone_tail(F.col("cust_tel_no"), cfg.phone_digits).alias("tel_num"), F.col("call_date").alias("create_date")
        )
        .distinct()
    )


def activity_branches(src: Sources, cfg: FeatureConfig, how_phone: str = "left") -> list[DataFrame]:
    """(cust_id, create_date) per channel, not yet distinct."""

    def branch(rows: DataFrame, key: Column | str, day: str) -> DataFrame:
        inside = rows.filter(F.col(day).between(cfg.activity_start, cfg.activity_end))
        return inside.select(F.col(key).alias("cust_id"), F.col(day).alias("create_date"))

    book = phones(src.feature_eav, cfg.words.phone_name)
    called = _call_days(src, cfg).join(not_broadcast(book), "tel_num", how_phone)
    return [
        branch(src.app_traffic, "vt_mapuid", "op_date"),
        branch(src.web_traffic, "vt_mapuid", "op_date"),
        called.select(F.col("user_id").alias("cust_id"), "create_date"),
        branch(src.robot_calls.filter(F.col("answer_flag") == 1), "cust_id", "call_date"),
        branch(src.wecom_chat, "cust_id", "msg_date"),
        branch(src.service_chat, "cust_id", "chat_date"),
    ]


def channel_union(branches: list[DataFrame]) -> DataFrame:
    """Distinct union of the channels: one shuffle, combined before it."""
    return reduce(DataFrame.unionByName, branches).distinct()


def eligible_customers(attributes: DataFrame) -> DataFrame:
    """Customers who are not staff, distributors or scalpers."""
    return (
        attributes.filter((F.col("is_inside_staff") == 0) & (F.col("is_distribution") == 0) & (F.col("is_scalper") == 0))
        .select("cust_id")
        .distinct()
    )


def last_activity(
    branches: list[DataFrame], eligible: DataFrame, id_range: tuple[int, int], anchor: date | None = None
) -> DataFrame:
    """Eligible customers with their last activity date, or with a constant anchor.

    The maximum needs no distinct rows, so the channels go into one aggregate as they are.
    """
    rows = reduce(DataFrame.unionByName, branches).filter(F.col("cust_id").between(*id_range))
    if anchor is None:
        seen = rows.groupBy("cust_id").agg(F.max("create_date").alias("create_date"))
    else:
        seen = rows.select("cust_id").distinct().withColumn("create_date", F.lit(anchor))
    return seen.join(not_broadcast(eligible), "cust_id", "left_semi")


def cohort(src: Sources, cfg: FeatureConfig) -> DataFrame:
    """(cust_id, create_date), one row per customer, under the run's parameters."""
    branches = activity_branches(src, cfg, how_phone="inner")
    return last_activity(branches, eligible_customers(src.cust_attribute), cfg.id_range, cfg.anchor)
