"""Decision time, browsing and communication features of the trailing window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import or_zero, ratio, sum_if
from tidemark.functions.joins import left_join_sparse_key, not_broadcast
from tidemark.operators.browsing import AMOUNTS


def _touches(facts: DataFrame, day: str, flag: str, prefix: str) -> DataFrame:
    """One row per customer: earliest day and highest recency flag."""
    return facts.groupBy("cust_id").agg(F.min(day).alias(f"{prefix}_first"), F.max(flag).alias(f"{prefix}_flag"))


def decision_time(cohort: DataFrame, browsing: DataFrame, communication: DataFrame, cap: int = 16) -> DataFrame:
    """Days from the earliest touch to the anchor, `cap` for touches before the window, 0 for none.

    Each side shrinks to one row per customer before the join: the maximum over all pairs of
    view and contact of the day difference is reached at the two minima.
    """
    joined = cohort.join(_touches(browsing, "operate_date", "browsing_flag", "b"), "cust_id", "left").join(
        _touches(communication, "comm_date", "comm_flag", "c"), "cust_id", "left"
    )
    anchor = F.col("create_date")
    first = F.least(F.coalesce(F.col("b_first"), anchor), F.coalesce(F.col("c_first"), anchor))
    highest = F.greatest(or_zero(F.col("b_flag")), or_zero(F.col("c_flag")))
    # A flag of 1 on one side and 2 on the other still means the cap, so the greater one decides.
    days = F.when(highest == 2, cap).when(highest == 1, F.datediff(anchor, first) + 1).otherwise(0)
    return joined.select("cust_id", days.alias("decision_time"))


# The columns in the order of the feature table.
BROWSING = (
    "browsing_days",
    "pv",
    "pv_daily_avg",
    "browsing_time",
    "browsing_time_max",
    "browsing_time_daily_avg",
    "browsing_products_cnt",
    "browsing_products_cnt_daily_avg",
    "to_booking_pages_cnt",
    "search_times",
    "vac_search_times",
    "lowest_price_avg",
    "vac_lowest_price_avg",
    "browsing_vac_prd_cnt",
    "browsing_single_prd_cnt",
    "collect_coupons_cnt",
    "prd_satisfaction",
    "prd_comp_grade_level",
    "prd_remark_amount",
    "prd_essence_amount",
    "prd_coupon_amount",
    "prd_money_amount",
    "prd_photo_amount",
)


def browsing_features(product_days: DataFrame, weights: DataFrame, coupons: DataFrame) -> DataFrame:
    """23 measures per customer over views inside the window.

    `product_days` comes from `product_day_views`, `weights` from `product_weights` and `coupons` from
    `coupon_days`. Distinct products and distinct days are counted by aggregating to them first.
    """
    inside = product_days.filter(F.col("browsing_flag") == 1)
    described = left_join_sparse_key(inside, weights, "product_id")
    rows = F.coalesce(F.col("weight"), F.lit(1))

    def weighed(name: str) -> Column:
        return F.sum(F.col(name) * rows).alias(name)

    def over_rows(name: str) -> Column:
        return F.sum(F.col("rows") * F.col(name)).alias(name)

    ratings = [f"{c}_{s}" for c in ("f_satisfaction", *AMOUNTS) for s in ("sum", "n")]
    per_product = described.groupBy("cust_id", "product_id").agg(
        F.count(F.lit(1)).alias("days"),
        F.max("is_vacation").alias("is_vacation"),
        F.max("is_single").alias("is_single"),
        *[weighed(c) for c in ("traces", "bookings", "searches", "vacation_searches", "time")],
        F.max("time_max").alias("time_max"),
        F.max("grade").alias("grade"),
        *[over_rows(c) for c in ("price_sum", "price_n", "vac_price_sum", "vac_price_n", *ratings)],
    )
    known = F.col("product_id").isNotNull()
    sums = ("traces", "bookings", "searches", "vacation_searches", "time")
    per_customer = per_product.groupBy("cust_id").agg(
        sum_if(known).alias("products"),
        sum_if(known & F.col("is_vacation")).alias("vacation_products"),
        sum_if(known & F.col("is_single")).alias("single_products"),
        *[F.sum(c).alias(c) for c in sums],
        F.max("time_max").alias("time_max"),
        F.max("grade").alias("grade"),
        *[F.sum(c).alias(c) for c in ("price_sum", "price_n", "vac_price_sum", "vac_price_n", *ratings)],
    )
    days = (
        inside.select("cust_id", "operate_date")
        .distinct()
        .join(not_broadcast(coupons.withColumn("coupon", F.lit(1))), ["cust_id", "operate_date"], "left")
        .groupBy("cust_id")
        .agg(F.count(F.lit(1)).alias("days"), F.count("coupon").alias("coupon_days"))
    )
    return per_customer.join(days, "cust_id").select("cust_id", *_browsing_columns())


def _browsing_columns() -> list[Column]:
    c = F.col
    values = [
        c("days"),
        c("traces"),
        ratio(c("traces"), c("days")),
        c("time"),
        c("time_max"),
        ratio(c("time"), c("days")),
        c("products"),
        ratio(c("products"), c("days")),
        c("bookings"),
        c("searches"),
        c("vacation_searches"),
        ratio(c("price_sum"), c("price_n")),
        ratio(c("vac_price_sum"), c("vac_price_n")),
        c("vacation_products"),
        c("single_products"),
        c("coupon_days"),
        ratio(c("f_satisfaction_sum"), c("f_satisfaction_n") * 1000000),
        c("grade"),
        *[ratio(c(f"{a}_sum"), c(f"{a}_n")) for a in AMOUNTS],
    ]
    return [value.alias(name) for name, value in zip(BROWSING, values, strict=True)]


# The columns in the order of the feature table.
COMMUNICATION = (
    "comm_days",
    "comm_freq",
    "comm_freq_daily_avg",
    "call_pct",
    "robot_pct",
    "officewx_pct",
    "chat_pct",
    "channels_cnt",
    "comm_time",
    "comm_time_daily_avg",
    "call_completing_rate",
    "calls_freq",
    "calls_freq_daily_avg",
    "active_calls_freq",
    "active_calls_pct",
    "chats_freq",
    "chats_freq_daily_avg",
    "active_chats_freq",
    "active_chats_pct",
    "vac_mention_num",
    "single_mention_num",
)


def communication_features(contact_days: DataFrame) -> DataFrame:
    """21 measures per customer over contacts inside the window.

    `contact_days` holds at most one row per customer, day and channel, so folding a day's channels
    into one row first gives all day counts and channel counts without distinct aggregates.
    """
    channel = F.col("channel_id")
    spoken, written = channel.isin(1, 2), channel.isin(3, 4)
    daily = (
        contact_days.filter(F.col("comm_flag") == 1)
        .groupBy("cust_id", "comm_date")
        .agg(
            *[sum_if(channel == n).alias(f"ch{n}") for n in (1, 2, 3, 4)],
            F.sum("comm_duration").alias("time"),
            F.sum("day_calls").alias("day_calls"),
            F.sum(F.when(spoken, F.col("comm_num")).otherwise(0)).alias("calls"),
            F.sum(F.when(spoken, F.col("active_comm_num")).otherwise(0)).alias("active_calls"),
            F.sum(F.when(written, F.col("comm_num")).otherwise(0)).alias("chats"),
            F.sum(F.when(written, F.col("active_comm_num")).otherwise(0)).alias("active_chats"),
            F.sum("vac_mention_num").alias("vac"),
            F.sum("single_mention_num").alias("single"),
        )
    )
    c = F.col
    summed = ("ch1", "ch2", "ch3", "ch4", "time", "day_calls", "calls", "active_calls", "chats", "active_chats", "vac", "single")
    per_customer = daily.groupBy("cust_id").agg(
        F.count(F.lit(1)).alias("days"),
        sum_if(c("ch1") + c("ch2") > 0).alias("call_days"),
        sum_if(c("ch3") + c("ch4") > 0).alias("chat_days"),
        *[F.sum(name).alias(name) for name in summed],
    )
    contacts = c("ch1") + c("ch2") + c("ch3") + c("ch4")
    channels = [F.when(c(f"ch{n}") > 0, 1).otherwise(0) for n in (1, 2, 3, 4)]
    completing = F.when(c("day_calls") != 0, ratio(c("calls"), c("day_calls"), 100)).otherwise(0.0)
    values = [
        c("days"),
        contacts,
        ratio(contacts, c("days")),
        *[ratio(c(f"ch{n}"), contacts, 100) for n in (1, 2, 3, 4)],
        channels[0] + channels[1] + channels[2] + channels[3],
        c("time"),
        ratio(c("time"), c("days")),
        completing,
        c("calls"),
        ratio(c("calls"), c("call_days")),
        c("active_calls"),
        ratio(c("active_calls"), c("calls"), 100),
        c("chats"),
        ratio(c("chats"), c("chat_days")),
        c("active_chats"),
        ratio(c("active_chats"), c("chats"), 100),
        c("vac"),
        c("single"),
    ]
    return per_customer.select(
        "cust_id", *[value.alias(name) for name, value in zip(COMMUNICATION, values, strict=True)]
    )


# Measures that stay null for customers without any priced or rated product.
KEPT_NULL = ("lowest_price_avg", "vac_lowest_price_avg", "prd_satisfaction", "prd_comp_grade_level")


def behavior_features(
    cohort: DataFrame, decision: DataFrame, browsing: DataFrame, communication: DataFrame
) -> DataFrame:
    """Every cohort customer with all behaviour measures; absent counts and shares become 0."""
    joined = (
        cohort.select("cust_id")
        .join(not_broadcast(decision), "cust_id", "left")
        .join(not_broadcast(browsing), "cust_id", "left")
        .join(not_broadcast(communication), "cust_id", "left")
    )
    measures = [
        F.col(name) if name in KEPT_NULL else or_zero(F.col(name)).alias(name)
        for name in (*BROWSING, *COMMUNICATION)
    ]
    return joined.select("cust_id", "decision_time", *measures)
