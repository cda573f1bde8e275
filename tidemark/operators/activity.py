"""The cohort from daily partials: each day of the sources is read once.

A partial is what one source day says about who was active when: different (customer or phone number, activity date)
rows. Maxima and distinct unions merge, so a window's cohort is the maximum over the partials of its source days, and a
source day that comes late or anew replaces its own partial only. Calls stay under their phone number, since who owns
it is known when a cohort is made.

The store is partitioned by `source_day`. A row's own date can lie outside its source day, so both are filtered, as when
the sources are read directly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig
from tidemark.functions.expr import phone_tail
from tidemark.functions.joins import not_broadcast
from tidemark.operators.cohort import eligible_customers, last_activity, phones
from tidemark.sources.model import Sources
from tidemark.sources.sink import write_table

DAY = "source_day"


def activity_partial(src: Sources, cfg: FeatureConfig, source_day: date | Column | None = None) -> DataFrame:
    """(cust_id, tel_num, create_date, source_day): the different active (customer, date) and (number, date) of `src`.

    `src` holds one source day, or several if `source_day` is null: then a row's own date counts as its source day.
    Rows without a customer or number, or without a date, are not activity.
    """
    nobody, no_number = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def of(rows: DataFrame, day: str, customer: str | None = None) -> DataFrame:
        tel = phone_tail(F.col("cust_tel_no"), cfg.phone_digits) if customer is None else no_number
        return rows.select((F.col(customer) if customer else nobody).alias("cust_id"), tel.alias("tel_num"), F.col(day).alias("create_date"))

    branches = [
        of(src.app_traffic, "op_date", "vt_mapuid"),
        of(src.web_traffic, "op_date", "vt_mapuid"),
        of(src.calls.filter(F.col("status") == cfg.words.connected), "call_date"),
        of(src.robot_calls.filter(F.col("answer_flag") == 1), "call_date", "cust_id"),
        of(src.wecom_chat, "msg_date", "cust_id"),
        of(src.service_chat, "chat_date", "cust_id"),
    ]
    rows = reduce(DataFrame.unionByName, branches)
    known = rows.filter("create_date is not null and (cust_id is not null or tel_num is not null)")
    day = F.col("create_date") if source_day is None else F.lit(source_day)
    return known.withColumn(DAY, day).distinct()


def store_days(store: str, days: Iterable[date], sources_of: Callable[[date], Sources], cfg: FeatureConfig, root: str | None = None) -> None:
    """Writes the partials of source days, new or again; the other days of the store are not touched.

    A day without any activity leaves what the store has of it.
    """
    for day in days:
        write_table(activity_partial(sources_of(day), cfg, day), store, day=DAY, root=root)


def cohort_from_store(store: DataFrame, src: Sources, cfg: FeatureConfig) -> DataFrame:
    """(cust_id, create_date) as `cohort` gives it, from the partials of the window's days; no activity source is read."""
    window = F.col(DAY).between(cfg.activity_start, cfg.activity_end) & F.col("create_date").between(cfg.activity_start, cfg.activity_end)
    inside = store.filter(window)
    customers = inside.filter("cust_id is not null").select("cust_id", "create_date")
    called = inside.filter("tel_num is not null").select("tel_num", "create_date").distinct()
    owners = called.join(not_broadcast(phones(src.feature_eav, cfg.words.phone_name)), "tel_num").select(F.col("user_id").alias("cust_id"), "create_date")
    return last_activity([customers, owners], eligible_customers(src.cust_attribute), cfg.id_range, cfg.anchor)


def missing_days(spark: SparkSession, store: DataFrame, cfg: FeatureConfig) -> list[date]:
    """Days of the activity window that the store has no partial of."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(cfg.activity_start), F.lit(cfg.activity_end))).alias(DAY))
    return [r[0] for r in days.join(store.select(DAY).distinct(), DAY, "left_anti").orderBy(DAY).collect()]
