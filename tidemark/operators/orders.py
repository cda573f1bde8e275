"""Orders around the anchor: future labels, trailing history and the mean interval.

A product with two classes makes the source's joins count an order line twice. That is kept, but as
a weight on one row per (route, city), so no join here multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig, Vocabulary
from tidemark.functions.expr import mean_of, or_zero
from tidemark.functions.joins import dealt_distinct, left_join_sparse_key, not_broadcast

PLACE = ["route_id", "book_city"]
CLASS = "producttype_class_name"
# The history measures in the order of the feature table.
HISTORY = (
    "executed_orders_cnt",
    "complaint_orders_cnt",
    "cp_avg",
    "cp_min",
    "cp_max",
    "satisfaction_avg",
    "vac_executed_cnt",
    "vac_cp_avg",
    "vac_satisfaction_avg",
)


def effective_orders(orders: DataFrame, since: date | None, distribution_flags: Sequence[int]) -> DataFrame:
    """Valid main order lines of the allowed sales channels, with `executed_date`."""
    kept = orders.filter(
        (F.col("valid_flag") == 1) & (F.col("is_sub") == 0) & F.col("distribution_flag").isin(*distribution_flags)
    )
    if since is not None:
        kept = kept.filter(F.col("create_time") >= F.lit(since))
    executed = (F.col("cancel_flag") == 0) & (F.col("sign_flag") == 1) & (F.col("cancel_sign_flag") == 0)
    return kept.withColumn("executed_date", F.when(executed, F.col("sign_date")))


def lines_in_reach(orders: DataFrame, cfg: FeatureConfig, horizons: Sequence[int] | None = None) -> DataFrame:
    """The order lines, as they are, that `future_purchases` for the horizons or `trailing_orders` can use."""
    bounds = (cfg.label_orders_since, cfg.history_orders_since)
    kept = effective_orders(orders, None if None in bounds else min(bounds), cfg.distribution_flags)
    first = cfg.anchors[0] - timedelta(days=cfg.history_days - 1)
    last = cfg.anchors[1] + timedelta(days=max(horizons or cfg.label_horizons))
    days = ("executed_date", "create_time", "complaint_time", "return_visit_date")
    return kept.filter(reduce(or_, [F.col(day).between(first, last) for day in days])).select(*orders.columns)


def product_classes(route_dim: DataFrame, words: Vocabulary, by_city: bool = True) -> DataFrame:
    """Distinct class per route (and city); ticket products count as single-resource."""
    keys = PLACE if by_city else PLACE[:1]
    klass = F.when(F.col("one_producttype_name") == words.ticket_product, words.single).otherwise(F.col(CLASS))
    rows = route_dim.select(*keys, klass.alias(CLASS))
    # Without the city, rows become fewer where they are read.
    return dealt_distinct(rows, keys) if by_city else rows.distinct()


def class_weights(classes: DataFrame, words: Vocabulary, keys: Sequence[str] = tuple(PLACE)) -> DataFrame:
    """One row per key: how many classes it has, and how many of them are vacation or single."""
    return classes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.count(F.when(F.col(CLASS) == words.vacation, 1)).alias("n_vacation"),
        F.count(F.when(F.col(CLASS) == words.single, 1)).alias("n_single"),
    )


def _in_days(day: Column, anchor: Column, first: int, last: int) -> Column:
    return day.between(F.date_add(anchor, first), F.date_add(anchor, last))


def future_purchases(
    cohort: DataFrame, orders: DataFrame, classes: DataFrame, cfg: FeatureConfig, horizons: Sequence[int] | None = None
) -> DataFrame:
    """Flags of the cohort customers who order a vacation product after the anchor; others are absent.

    Order lines shrink to distinct (customer, event, day) before they meet the cohort: a customer with
    very many lines brings at most two rows per calendar day to the join.
    """
    horizons = tuple(horizons or cfg.label_horizons)
    first, last = cfg.anchors[0] + timedelta(days=1), cfg.anchors[1] + timedelta(days=max(horizons))
    executed, ordered = F.col("executed_date"), F.col("create_time")
    vacation = classes.filter(F.col(CLASS) == cfg.words.vacation).select(*PLACE).distinct()
    # Constant bounds around all possible anchors prune the lines first.
    near = orders.filter(executed.between(first, last) | ordered.between(first, last)).select(
        "cust_id", *PLACE, "executed_date", "create_time"
    )
    events = F.array(
        F.struct(F.lit("executed").alias("event"), executed.alias("day")),
        F.struct(F.lit("ordered").alias("event"), ordered.alias("day")),
    )
    days = (
        near.join(not_broadcast(vacation), PLACE, "left_semi")
        .select("cust_id", F.explode(events).alias("e"))
        .select("cust_id", "e.event", "e.day")
        .filter(F.col("day").between(first, last))
        .distinct()
    )
    flags = [
        F.max(
            F.when((F.col("event") == event) & _in_days(F.col("day"), F.col("create_date"), 1, span), 1).otherwise(0)
        ).alias(f"{event}_flag_{span}")
        for event in ("executed", "ordered")
        for span in horizons
    ]
    return days.join(cohort, "cust_id").groupBy("cust_id").agg(*flags)


def future_window_flags(
    cohort: DataFrame, orders: DataFrame, classes: DataFrame, cfg: FeatureConfig, horizons: Sequence[int] | None = None
) -> DataFrame:
    """Every cohort customer with its labels; 0 for customers without such an order."""
    found = future_purchases(cohort, orders, classes, cfg, horizons)
    names = [c for c in found.columns if c != "cust_id"]
    return cohort.join(found, "cust_id", "left").select(
        "cust_id", "create_date", *[or_zero(F.col(name)).alias(name) for name in names]
    )


def trailing_orders(cohort: DataFrame, orders: DataFrame, classes: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Nine measures over the days before the anchor, for customers with orders in reach."""
    back = cfg.history_days - 1
    first, last = cfg.anchors[0] - timedelta(days=back), cfg.anchors[1]
    days = ("executed_date", "complaint_time", "return_visit_date")
    reach = [F.col(day).between(first, last) for day in days]
    near = orders.filter(reach[0] | reach[1] | reach[2]).select(
        "cust_id", "order_id", *PLACE, "travel_sign_amount", "satisfaction", *days
    )
    weighted = left_join_sparse_key(near.join(cohort, "cust_id"), class_weights(classes, cfg.words), PLACE)

    anchor = F.col("create_date")
    rows = F.coalesce(F.col("n_classes"), F.lit(1))
    vacation_rows = or_zero(F.col("n_vacation"))
    executed, complained, visited = [_in_days(F.col(day), anchor, -back, 0) for day in days]
    amount, score = F.col("travel_sign_amount"), F.col("satisfaction")

    def any_row(when: Column) -> Column:
        return F.max(F.when(when, 1).otherwise(0))

    def total(value: Column, when: Column, weight: Column) -> Column:
        return F.sum(F.when(when, value * weight))

    def count(value: Column, when: Column, weight: Column) -> Column:
        return F.sum(F.when(when & value.isNotNull(), weight))

    means = {
        "cp_avg": (amount, executed, rows),
        "satisfaction_avg": (score, visited, rows),
        "vac_cp_avg": (amount, executed, vacation_rows),
        "vac_satisfaction_avg": (score, visited, vacation_rows),
    }
    # One row per order first: distinct orders become plain sums, with no expanded rows in the shuffle.
    per_order = weighted.groupBy("cust_id", "order_id").agg(
        any_row(executed).alias("executed"),
        any_row(complained).alias("complained"),
        any_row(executed & (vacation_rows > 0)).alias("executed_vacation"),
        F.min(F.when(executed, amount)).alias("cp_min"),
        F.max(F.when(executed, amount)).alias("cp_max"),
        *[total(*parts).alias(f"{name}_sum") for name, parts in means.items()],
        *[count(*parts).alias(f"{name}_n") for name, parts in means.items()],
    )
    counted = F.col("order_id").isNotNull()
    return per_order.groupBy("cust_id").agg(
        F.sum(F.when(counted, F.col("executed"))).alias("executed_orders_cnt"),
        F.sum(F.when(counted, F.col("complained"))).alias("complaint_orders_cnt"),
        F.min("cp_min").alias("cp_min"),
        F.max("cp_max").alias("cp_max"),
        F.sum(F.when(counted, F.col("executed_vacation"))).alias("vac_executed_cnt"),
        *[mean_of(F.sum(f"{name}_sum"), F.sum(f"{name}_n")).alias(name) for name in means],
    )


def trailing_order_features(cohort: DataFrame, orders: DataFrame, classes: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Every cohort customer with the nine measures; counts and amounts default to 0, scores stay null."""
    found = trailing_orders(cohort, orders, classes, cfg)
    scores = ("satisfaction_avg", "vac_satisfaction_avg")
    columns = [F.col(c) if c in scores else or_zero(F.col(c)).alias(c) for c in HISTORY]
    return cohort.join(found, "cust_id", "left").select("cust_id", *columns)


def customer_intervals(orders: DataFrame, cohort: DataFrame) -> DataFrame:
    """Mean gap in days over all pairs of executed orders with different dates, per cohort customer.

    Order lines collapse to one row per (customer, day) first, which bounds each window partition by
    the calendar. A day with n lines pairs with every earlier line, so its gaps sum to
    n * (day * earlier_lines - earlier_day_total).
    """
    epoch = F.lit(date(1970, 1, 1))
    daily = (
        orders.filter(F.col("executed_date").isNotNull())
        .select("cust_id", F.datediff("executed_date", epoch).cast("bigint").alias("day"))
        .groupBy("cust_id", "day")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(cohort, "cust_id", "left_semi")
    )
    earlier = Window.partitionBy("cust_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    n, day = F.col("n"), F.col("day")
    paired = daily.select(
        "cust_id",
        "n",
        "day",
        or_zero(F.sum(n).over(earlier)).alias("lines"),
        or_zero(F.sum(n * day).over(earlier)).alias("days"),
    )
    gaps = F.sum(n * (day * F.col("lines") - F.col("days")))
    pairs = F.sum(n * F.col("lines"))
    return (
        paired.groupBy("cust_id")
        .agg(gaps.alias("gaps"), pairs.alias("pairs"))
        .filter(F.col("pairs") > 0)
        .select("cust_id", mean_of(F.col("gaps"), F.col("pairs")).alias("avg_time_interval"))
    )


def pairwise_interval(orders: DataFrame, cohort: DataFrame) -> DataFrame:
    """One row: the mean over customers of their mean pairwise order interval."""
    return customer_intervals(orders, cohort).agg(F.avg("avg_time_interval").alias("all_avg_time_interval"))
