"""The whole feature run: from raw sources to one 70-column row per cohort customer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig
from tidemark.functions.joins import not_broadcast
from tidemark.functions.staging import Stage, stage, stage_by, stage_together
from tidemark.operators import behavior, browsing, communication, orders, profile
from tidemark.operators.cohort import cohort as build_cohort
from tidemark.schema import COLUMNS, FEATURE_SCHEMA
from tidemark.sources.model import Sources
from tidemark.sources.sink import read_table, write_table

# The partition of a written feature table: the last day of the run's activity window.
RUN_DAY = "run_day"


def staged_cohort(src: Sources, cfg: FeatureConfig, keep: Stage = stage) -> DataFrame:
    return not_broadcast(keep(build_cohort(src, cfg), "cohort"))


def staged_orders(src: Sources, cfg: FeatureConfig, horizons: Sequence[int] | None = None, keep: Stage = stage) -> Sources:
    """The sources with the order lines in reach of labels and history written once, where both read the same snapshot.

    A snapshot may be a join of large tables, of which few lines are in reach. For labels and history only: calls count any line.
    """
    if src.label_orders is not src.history_orders:
        return src
    lines = keep(orders.lines_in_reach(src.history_orders, cfg, horizons), "orders")
    return src.with_tables(label_orders=lambda: lines, history_orders=lambda: lines)


def label_table(cohort: DataFrame, src: Sources, cfg: FeatureConfig, horizons: Sequence[int] | None = None) -> DataFrame:
    kept = orders.effective_orders(src.label_orders, cfg.label_orders_since, cfg.distribution_flags)
    return orders.future_window_flags(cohort, kept, orders.product_classes(src.route_dim, cfg.words), cfg, horizons)


def history_table(cohort: DataFrame, src: Sources, cfg: FeatureConfig) -> DataFrame:
    kept = orders.effective_orders(src.history_orders, cfg.history_orders_since, cfg.distribution_flags)
    return orders.trailing_order_features(cohort, kept, orders.product_classes(src.route_dim, cfg.words), cfg)


def behavior_table(cohort: DataFrame, src: Sources, cfg: FeatureConfig, keep: Stage = stage) -> DataFrame:
    """Both fact tables are read by two steps each, so they are staged."""
    views, contacts = stage_together(
        cohort.sparkSession,
        keep,
        product_days=browsing.product_day_views(cohort, src, cfg),
        contact_days=communication.communication_days(cohort, src, cfg),
    )
    coupons = browsing.coupon_days(src.coupons, cfg.behavior_start, cfg.behavior_end)
    return behavior.behavior_features(
        cohort,
        behavior.decision_time(cohort, views, contacts, cfg.decision_cap),
        behavior.browsing_features(views, browsing.product_weights(src, cfg), coupons),
        behavior.communication_features(contacts),
    )


def _assembled(labels: DataFrame, *sides: DataFrame) -> DataFrame:
    for side in sides:
        labels = labels.join(not_broadcast(side), "cust_id", "left")
    return labels


def feature_table(
    src: Sources, cfg: FeatureConfig, keep: Stage = stage, cohort: DataFrame | None = None, horizon: int | None = None
) -> DataFrame:
    """One row per cohort customer, columns and types as in `FEATURE_SCHEMA`. `cohort` may be one that is staged already;
    `horizon` adds the label `executed_flag_` of so many days as a last column.

    The cohort and the four sides, one row per customer each, are staged in buckets of the customer: the sides are made
    at the same time, and meet without an exchange.
    """
    by_customer = stage_by("cust_id")
    horizons = cfg.label_horizons if horizon is None else (*cfg.label_horizons, horizon)
    cohort, ordered = stage_together(
        src.cust_attribute.sparkSession,
        lambda made, _: made,
        cohort=lambda: staged_cohort(src, cfg, by_customer) if cohort is None else cohort,
        orders=lambda: staged_orders(src, cfg, horizons, keep),
    )
    joined = _assembled(
        *stage_together(
            cohort.sparkSession,
            by_customer,
            labels=lambda: label_table(cohort, ordered, cfg, horizons),
            profile=lambda: profile.customer_profile(cohort, src, cfg).drop("create_date"),
            history=lambda: history_table(cohort, ordered, cfg),
            behavior=lambda: behavior_table(cohort, src, cfg, keep),
        )
    )
    columns = [
        (F.col(c).try_cast(FEATURE_SCHEMA[c].dataType) if c == "age" else F.col(c).cast(FEATURE_SCHEMA[c].dataType)).alias(c)
        for c in COLUMNS
    ]
    return joined.select(*columns, *([] if horizon is None else [F.col(f"executed_flag_{horizon}").cast("bigint")]))


def write_feature_table(src: Sources, cfg: FeatureConfig, table: str, keep: Stage = stage) -> None:
    """Puts the run's rows in place as the day of `table` on which its activity ends; other days are not touched.

    That there is one row for each customer of the cohort is checked before. A day without customers is not written.
    """
    cohort = staged_cohort(src, cfg, stage_by("cust_id"))
    rows = feature_table(src, cfg, keep, cohort).withColumn(RUN_DAY, F.lit(cfg.activity_end))
    write_table(rows, table, day=RUN_DAY, keys=["cust_id"], rows=cohort.count())


def read_feature_table(spark: SparkSession, table: str, cfg: FeatureConfig) -> DataFrame:
    """The run's rows of a table of `write_feature_table`."""
    return read_table(spark, table).filter(F.col(RUN_DAY) == F.lit(cfg.activity_end)).select(*COLUMNS)
