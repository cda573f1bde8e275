"""The cohort from daily partials against the cohort from the sources."""

from dataclasses import replace
from datetime import date, timedelta

import micro
import pytest
from pyspark.sql import functions as F
from tidemark.config import training_config
from tidemark.operators import activity, cohort
from tidemark.sources.sink import read_table
from tidemark.sources.standin import standin_sources
from tidemark.sources.warehouse import warehouse_sources

CFG = micro.CONFIG


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return micro.tables(spark, str(tmp_path_factory.mktemp("raw")))


def of_day(spark, tables, day):
    """Sources of one source day only."""
    cfg = replace(CFG, activity_start=day, activity_end=day, behavior_start=day, behavior_end=day)
    return warehouse_sources(spark, tables, cfg, micro.LABEL_SNAPSHOT, micro.HISTORY_SNAPSHOT)


def shown(df):
    return sorted((r["cust_id"], r["create_date"]) for r in df.collect())


def test_each_next_day_reads_one_day_and_equals_the_full_run(spark, tables, tmp_path):
    """Rows whose own date is outside their source day, shared and foreign phones are in the hand-written tables."""
    store = f"{tmp_path}/store"
    last = micro.ANCHOR + timedelta(days=2)
    days = [micro.ANCHOR + timedelta(days=i) for i in range(-20, 3)]
    read = []

    def sources_of(day):
        read.append(day)
        return of_day(spark, tables, day)

    activity.store_days(store, days[:-3], sources_of, CFG)
    for day in days[-3:]:
        read.clear()
        activity.store_days(store, [day], sources_of, CFG)
        assert read == [day]
        cfg = replace(CFG, activity_start=days[0], activity_end=day)
        src = warehouse_sources(spark, tables, replace(cfg, behavior_start=days[0], behavior_end=day), micro.LABEL_SNAPSHOT, micro.HISTORY_SNAPSHOT)
        found = activity.cohort_from_store(read_table(spark, store), src, cfg)
        assert shown(found) == shown(cohort.cohort(src, cfg))
    assert shown(found) and day == last
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_day" in plan and "operate_time" not in plan
    anchored = replace(cfg, anchor=day)
    assert shown(activity.cohort_from_store(read_table(spark, store), src, anchored)) == shown(cohort.cohort(src, anchored))


def test_a_late_day_is_merged_again(spark, tables, tmp_path):
    store, day = f"{tmp_path}/store", micro.ANCHOR - timedelta(days=2)
    src = of_day(spark, tables, day)
    activity.store_days(store, [day, micro.ANCHOR], lambda d: of_day(spark, tables, d), CFG)
    before = {r[0]: r[1] for r in read_table(spark, store).select(activity.DAY, F.input_file_name()).distinct().collect()}
    partial = activity.activity_partial(src, CFG, day).unionByName(spark.createDataFrame([(3, None, day, day)], "cust_id long, tel_num string, create_date date, source_day date"))
    activity.write_table(partial, store, day=activity.DAY)
    after = {r[0]: r[1] for r in read_table(spark, store).select(activity.DAY, F.input_file_name()).distinct().collect()}
    assert before[micro.ANCHOR] == after[micro.ANCHOR] and before[day] != after[day]
    window = replace(CFG, activity_start=day, activity_end=day)
    assert (3, day) in shown(activity.cohort_from_store(read_table(spark, store), src, window))


def test_whole_window_of_the_stand_in_tables(spark, tmp_path):
    cfg = training_config()
    src = standin_sources(spark, "/root/testdata/sf0.001", cfg)
    store = activity.activity_partial(src, cfg)
    assert shown(activity.cohort_from_store(store, src, cfg)) == shown(cohort.cohort(src, cfg))


def test_missing_days(spark):
    cfg = replace(CFG, activity_start=date(2023, 7, 1), activity_end=date(2023, 7, 4))
    store = spark.createDataFrame([(date(2023, 7, 2),), (date(2023, 7, 9),)], f"{activity.DAY} date")
    assert activity.missing_days(spark, store, cfg) == [date(2023, 7, 1), date(2023, 7, 3), date(2023, 7, 4)]
