"""Calls, robot calls and chats per customer and day."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig
from tidemark.functions.expr import phone_tail, recency_flag, sum_if
from tidemark.functions.joins import keep_member_groups, keep_members, left_join_sparse_key, not_broadcast
from tidemark.functions.words import mentions
from tidemark.operators.cohort import phones
from tidemark.operators.orders import PLACE, class_weights, product_classes
from tidemark.sources.model import Sources

MEASURES = ("comm_duration", "day_calls", "comm_num", "active_comm_num", "vac_mention_num", "single_mention_num")


def order_mentions(orders: DataFrame, wanted: DataFrame, classes: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """One row per order id in `wanted`: the rows it joins to, and how many of them are vacation or single."""
    lines = orders.select("order_id", "create_time", *PLACE)
    if cfg.call_orders_since is not None:
        lines = lines.filter(F.col("create_time") >= F.lit(cfg.call_orders_since))
    lines = keep_members(lines, wanted, "order_id")
    weighted = left_join_sparse_key(lines, class_weights(classes, cfg.words), PLACE)
    return weighted.groupBy("order_id").agg(
        F.sum(F.coalesce(F.col("n_classes"), F.lit(1))).alias("order_rows"),
        F.sum(F.coalesce(F.col("n_vacation"), F.lit(0))).alias("vacation_rows"),
        F.sum(F.coalesce(F.col("n_single"), F.lit(0))).alias("single_rows"),
    )


def call_daily(
    calls: DataFrame, phone_book: DataFrame, orders: DataFrame, classes: DataFrame, cfg: FeatureConfig
) -> DataFrame:
    """Calls per customer and day. `phone_book` is (cust_id, tel_num) of the cohort, with every phone of a customer.

    Calls of other numbers drop out first. The rest shrinks to (number, day, order), then to (number, day), before
    it meets the customers; order lines of other calls are not read further than their id.
    """
    talk = F.col("status") == cfg.words.connected
    inbound = talk & (F.col("calldir") == cfg.words.inbound)
    window = F.col("call_date").between(cfg.behavior_start, cfg.behavior_end) & F.col("tel_order_type").isin(0, 1)
    numbered = calls.filter(window & F.col("cust_tel_no").isNotNull()).select(
        phone_tail(F.col("cust_tel_no"), cfg.phone_digits).alias("tel_num"),
        F.col("call_date").alias("comm_date"),
        "order_id",
        "status_time",
        talk.alias("talk"),
        inbound.alias("inbound"),
    )
    own = keep_members(numbered, phone_book.select("tel_num"), "tel_num", ["tel_num", "comm_date", "order_id"])
    per_order = own.groupBy("tel_num", "comm_date", "order_id").agg(
        F.sum("status_time").alias("time"),
        F.count(F.lit(1)).alias("calls"),
        sum_if(F.col("talk")).alias("talks"),
        sum_if(F.col("inbound")).alias("inbounds"),
    )
    wanted = per_order.select("order_id").filter(F.col("order_id").isNotNull())
    joined = left_join_sparse_key(per_order, order_mentions(orders, wanted, classes, cfg), "order_id")
    rows = F.coalesce(F.col("order_rows"), F.lit(1))
    per_number = joined.groupBy("tel_num", "comm_date").agg(
        F.sum(F.col("time") * rows).alias("comm_duration"),
        F.sum(F.col("calls") * rows).alias("day_calls"),
        F.sum(F.col("talks") * rows).alias("comm_num"),
        F.sum(F.col("inbounds") * rows).alias("active_comm_num"),
        F.sum(F.col("calls") * F.coalesce(F.col("vacation_rows"), F.lit(0))).alias("vac_mention_num"),
        F.sum(F.col("calls") * F.coalesce(F.col("single_rows"), F.lit(0))).alias("single_mention_num"),
    )
    owned = per_number.join(not_broadcast(phone_book), "tel_num")
    return owned.groupBy("cust_id", "comm_date").agg(*[F.sum(m).alias(m) for m in MEASURES])


def robot_call_daily(robot_calls: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Robot calls per customer and day; the active ones are answered, tasked and of an intent label."""
    hit = (
        (F.col("answer_flag") == 1)
        & (F.col("generate_task_is") == 1)
        & F.lower("label").isin(*cfg.intent_labels)
    )
    window = F.col("call_date").between(cfg.behavior_start, cfg.behavior_end)
    return (
        robot_calls.filter(window)
        .groupBy("cust_id", F.col("call_date").alias("comm_date"))
        .agg(
            F.sum("call_time").alias("comm_duration"),
            F.count(F.lit(1)).alias("day_calls"),
            F.sum("answer_flag").alias("comm_num"),
            sum_if(hit).alias("active_comm_num"),
            F.lit(0).cast("bigint").alias("vac_mention_num"),
            F.lit(0).cast("bigint").alias("single_mention_num"),
        )
    )


def keyword_daily(
    chats: DataFrame, day: str, text: str, active: Column, cfg: FeatureConfig
) -> DataFrame:
    """Messages per customer and day: all, customer-sent, and those that mention each word list."""
    window = F.col(day).between(cfg.behavior_start, cfg.behavior_end)
    vacation, single = mentions(F.col(text), [cfg.words.vacation_words, cfg.words.single_words])
    flagged = chats.filter(window).select(
        "cust_id",
        F.col(day).alias("comm_date"),
        active.alias("active"),
        vacation.alias("vacation"),
        single.alias("single"),
    )
    return flagged.groupBy("cust_id", "comm_date").agg(
        F.lit(None).cast("bigint").alias("comm_duration"),
        F.lit(0).cast("bigint").alias("day_calls"),
        F.count(F.lit(1)).alias("comm_num"),
        sum_if(F.col("active")).alias("active_comm_num"),
        sum_if(F.col("vacation")).alias("vac_mention_num"),
        sum_if(F.col("single")).alias("single_mention_num"),
    )


def wecom_chat_daily(chats: DataFrame, cfg: FeatureConfig) -> DataFrame:
    return keyword_daily(chats, "msg_date", "contact", F.col("type") == 1, cfg)


def service_chat_daily(chats: DataFrame, cfg: FeatureConfig) -> DataFrame:
    active = F.contains(F.col("content"), F.lit(cfg.words.active_service_word))
    return keyword_daily(chats, "chat_date", "content", active, cfg)


def cohort_phones(cohort: DataFrame, src: Sources, cfg: FeatureConfig) -> DataFrame:
    """(cust_id, tel_num) of every phone of the cohort customers."""
    owned = phones(src.feature_eav, cfg.words.phone_name).withColumnRenamed("user_id", "cust_id")
    return keep_members(owned, cohort, "cust_id")


def channel_days(cohort: DataFrame, src: Sources, cfg: FeatureConfig) -> list[DataFrame]:
    """The four daily tables of the cohort, in the order of `words.channels`.

    Chats are reduced to (customer, day) where they are read, so that no text is dealt to another task.
    """
    classes = product_classes(src.route_dim, cfg.words)

    def own(rows: DataFrame, day: str) -> DataFrame:
        inside = rows.filter(F.col(day).between(cfg.behavior_start, cfg.behavior_end))
        return keep_members(inside, cohort, "cust_id", ["cust_id", day])

    return [
        call_daily(src.calls, cohort_phones(cohort, src, cfg), src.history_orders, classes, cfg),
        robot_call_daily(own(src.robot_calls, "call_date"), cfg),
        keep_member_groups(wecom_chat_daily(src.wecom_chat, cfg), cohort, "cust_id"),
        keep_member_groups(service_chat_daily(src.service_chat, cfg), cohort, "cust_id"),
    ]


def stack_channels(days: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """UNION ALL of the daily tables with channel name and number."""
    tagged = [
        rows.select(
            "cust_id",
            "comm_date",
            F.lit(name).alias("channel"),
            F.lit(number).alias("channel_id"),
            *[F.col(m).cast("bigint").alias(m) for m in MEASURES],
        )
        for number, (name, rows) in enumerate(zip(names, days, strict=True), start=1)
    ]
    return reduce(DataFrame.unionByName, tagged)


def communication_days(cohort: DataFrame, src: Sources, cfg: FeatureConfig) -> DataFrame:
    """Customer x day x channel of the cohort with `comm_flag`; customers without contact are absent."""
    stacked = stack_channels(channel_days(cohort, src, cfg), cfg.words.channels)
    flag = recency_flag(F.col("comm_date"), F.col("create_date"), cfg.lookback_days)
    return stacked.join(cohort, "cust_id").select(
        "cust_id", "create_date", "comm_date", flag.alias("comm_flag"), "channel", "channel_id", *MEASURES
    )


def communication_facts(cohort: DataFrame, src: Sources, cfg: FeatureConfig) -> DataFrame:
    """As `communication_days`, with one row of nulls for each customer without contact."""
    stacked = stack_channels(channel_days(cohort, src, cfg), cfg.words.channels)
    flag = recency_flag(F.col("comm_date"), F.col("create_date"), cfg.lookback_days)
    return cohort.join(stacked, "cust_id", "left").select(
        "cust_id", "create_date", "comm_date", flag.alias("comm_flag"), "channel", "channel_id", *MEASURES
    )
