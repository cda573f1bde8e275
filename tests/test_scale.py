"""Hot and missing keys: results stay whole, and no plan sends such a group to one task."""

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from tidemark.config import training_config
from tidemark.functions.joins import dealt_distinct, keep_member_groups, keep_members, left_join_sparse_key
from tidemark.functions.staging import new_path, shared_folder, stage, stage_by, stage_together
from tidemark.operators import browsing, communication, orders, profile
from tidemark.plans.feature_table import feature_table, history_table, label_table, staged_orders
from tidemark.plans.registry import Run
from tidemark.sources.model import Sources

FOLDER = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sides_that_grow_are_not_broadcast(spark):
    """However small its files: rows of a broadcast side pass through the driver."""
    run = Run(spark, FOLDER, training_config())
    kept = orders.effective_orders(run.src.label_orders, None, run.cfg.distribution_flags)
    made = [
        keep_members(run.src.access_channel, run.cohort, "user_id"),
        left_join_sparse_key(kept, run.src.prd_route, "route_id"),
        browsing.coupon_match(run.page_views(), run.coupons),
        orders.effective_orders(run.src.label_orders, None, run.cfg.distribution_flags).join(run.cohort, "cust_id"),
    ]
    for df in made:
        assert "SortMergeJoin" in plan_of(df) and "BroadcastHashJoin" not in plan_of(df)


def test_dimension_rows_are_dealt_before_they_are_gathered(spark):
    """A scan task that gathered them would hold as many rows as its file has, and the files are small for their rows."""
    run = Run(spark, FOLDER, training_config())
    for df in (run.classes, orders.class_weights(run.classes, run.cfg.words)):
        read = [part.split("FileScan")[0] for part in plan_of(df).split("Exchange")[1:] if re.search(r"FileScan.*part\.parquet", part)]
        assert read and not any("Aggregate" in steps for steps in read)


def test_dealt_rows_are_distinct(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, None), (1, None), (None, "a"), (None, "a"), (None, None)], "k int, v string")
    assert sorted(map(repr, dealt_distinct(rows, ["k"]).collect())) == sorted(map(repr, rows.distinct().collect()))


def test_chats_are_reduced_where_they_are_read(spark):
    """Between the scan of the texts and the first exchange they become counts, however small the cohort's files are."""
    run = Run(spark, FOLDER, training_config())
    days = communication.channel_days(run.cohort, run.src, run.cfg)
    for df, name in ((days[2], "conversations"), (days[3], "documents")):
        read = [part.split("FileScan")[0] for part in plan_of(df).split("Exchange")[1:] if re.search(rf"FileScan.*{name}\.parquet", part)]
        assert read and all("Aggregate" in steps for steps in read)


def test_groups_of_members(spark):
    """Repeated members do not repeat a group, and missing keys match nothing."""
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "e")], "k long, v string")
    members = spark.createDataFrame([(1,), (1,), (4,), (None,), (9,)], "id long")
    found = keep_member_groups(rows.groupBy("k").agg(F.count("v").alias("n")), members, "k")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2), (4, 1)] and found.columns == ["k", "n"]


def test_order_lines_in_reach_give_the_same_rows(spark):
    """Days at and beyond every edge of the windows, missing days, and lines that do not count."""
    cfg = training_config()
    run = Run(spark, FOLDER, cfg)
    edges = [cfg.anchors[0], cfg.anchors[1], *(cfg.anchors[1] + timedelta(days=n) for n in (7, 8, 15, 16, 90, 91)), cfg.anchors[0] - timedelta(days=59)]
    days = [None, *(day + timedelta(days=n) for day in edges for n in (-1, 0, 1))]
    cust = [r["cust_id"] for r in run.cohort.orderBy("cust_id").limit(5).collect()]
    rows = [
        (cust[i % 5], i, created, 0, 1, 0, signed, 10 + i, 1 + i % 3, 0, i % 7, visited, None, int(i % 11 != 0), int(i % 13 == 0), i % 6)
        for i, (created, signed, visited) in enumerate((a, b, c) for a in days for b in days[::3] for c in days[::7])
    ]
    names = (
        "cust_id long, order_id long, create_time date, cancel_flag int, sign_flag int, cancel_sign_flag int, sign_date date, "
        "travel_sign_amount int, route_id long, book_city int, satisfaction long, return_visit_date date, complaint_time date, "
        "valid_flag int, is_sub int, distribution_flag int"
    )
    lines = spark.createDataFrame(rows, names)
    src = run.src.with_tables(label_orders=lambda: lines, history_orders=lambda: lines)
    horizons = (7, 15, 90)
    staged = staged_orders(src, cfg, horizons)
    assert staged.label_orders is staged.history_orders and 0 < staged.label_orders.count() < lines.count()
    assert staged.label_orders.exceptAll(lines).isEmpty() and staged.service_chat is src.service_chat
    for of in (lambda s: label_table(run.cohort, s, cfg, horizons), lambda s: history_table(run.cohort, s, cfg)):
        want = sorted(map(str, of(src).collect()))
        assert sorted(map(str, of(staged).collect())) == want
    # Two snapshots are read as they are.
    other = src.with_tables(history_orders=lambda: lines.limit(3))
    assert staged_orders(other, cfg) is other


def test_label_of_another_horizon(spark):
    run = Run(spark, FOLDER, training_config())
    made = feature_table(run.src, run.cfg, horizon=90)
    kept = orders.effective_orders(run.src.label_orders, run.cfg.label_orders_since, run.cfg.distribution_flags)
    want = orders.future_window_flags(run.cohort, kept, run.classes, run.cfg, (90,)).select("cust_id", F.col("executed_flag_90").cast("bigint"))
    assert made.columns == [*feature_table(run.src, run.cfg).columns, "executed_flag_90"]
    assert sorted(made.select("cust_id", "executed_flag_90").collect()) == sorted(want.collect())


def test_attributes_are_exploded_in_compiled_code(spark):
    """No entry is missing in the rows, and no function is interpreted row by row to drop it."""
    eav = Run(spark, FOLDER, training_config()).src.feature_eav
    assert "lambda" not in plan_of(eav)
    assert eav.filter("three_class_name is null").isEmpty() and eav.filter("three_class_name = 'PHONE'").count() == spark.read.parquet(f"{FOLDER}/customer.parquet").count()


def test_missing_keys_are_spread(spark, no_broadcast):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 50).alias("k"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = left_join_sparse_key(left, right, "k")
    want = left.join(right, "k", "left").select("k", "id", "v")
    assert joined.select("k", "id", "v").exceptAll(want).isEmpty() and joined.count() == 3000
    assert "hashpartitioning(k, _slot" in plan_of(joined)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = joined.filter("k is null").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(per_task) == 4 and max(r["count"] for r in per_task) < 500


def test_composite_missing_keys(spark, no_broadcast):
    left = spark.createDataFrame([(1, 1, "a"), (1, None, "b"), (None, 1, "c"), (2, 2, "d")], "r long, c int, name string")
    right = spark.createDataFrame([(1, 1, 5), (None, 1, 6), (1, None, 7)], "r long, c int, v long")
    found = {row["name"]: row["v"] for row in left_join_sparse_key(left, right, ["r", "c"]).collect()}
    assert found == {"a": 5, "b": None, "c": None, "d": None}


def test_plans_keep_the_spread(spark, no_broadcast):
    run = Run(spark, FOLDER, training_config())
    book = communication.cohort_phones(run.cohort, run.src, run.cfg)
    calls = communication.call_daily(run.src.calls, book, run.src.history_orders, run.classes, run.cfg)
    assert "hashpartitioning(order_id, _slot" in plan_of(calls)
    assert "hashpartitioning(route_id, book_city, _slot" in plan_of(calls)


def test_windows_are_partitioned(spark):
    """The interval's window sees one row per customer and day, and no window gathers all rows."""
    run = Run(spark, FOLDER, training_config())
    kept = orders.effective_orders(run.src.history_orders, None, run.cfg.distribution_flags)
    plan = plan_of(orders.customer_intervals(kept, run.cohort))
    assert "SinglePartition" not in plan
    assert "HashAggregate(keys=[cust_id, day]" in plan


def test_members_filter_before_the_first_exchange(spark, no_broadcast):
    run = Run(spark, FOLDER, training_config())
    rows, members = spark.range(10).withColumnRenamed("id", "cust_id"), spark.range(5).withColumnRenamed("id", "cust_id")
    assert keep_members(rows, members, "cust_id", ["cust_id"]).count() == 5
    plan = profile.customer_profile(run.cohort, run.src, run.cfg)._jdf.queryExecution().optimizedPlan().toString()
    # The attribute, city and channel tables are cut to the cohort below any aggregation.
    assert plan.count("Join LeftSemi") >= 3
    book = communication.cohort_phones(run.cohort, run.src, run.cfg)
    calls = communication.call_daily(run.src.calls, book, run.src.history_orders, run.classes, run.cfg)
    assert calls._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") >= 3


def test_hot_customer_and_product(spark):
    """A third of all views by one customer on one product, and copies of one view row count once."""
    run = Run(spark, FOLDER, training_config())
    day = F.lit(run.cfg.activity_end)
    hot = spark.range(2000).select(
        F.lit(1).cast("bigint").alias("vt_mapuid"), day.alias("op_date"), F.col("id").alias("visitor_trace"),
        F.lit(1).cast("bigint").alias("residence_time"), F.lit(7).cast("bigint").alias("product_id"),
        F.lit(None).cast("bigint").alias("book_id"), F.lit(None).cast("string").alias("search_key"),
    )
    tables = {name: (lambda name=name: getattr(run.src, name)) for name in Sources.NAMES}
    tables["app_traffic"] = lambda: run.src.app_traffic.unionByName(hot).unionByName(hot)
    src = Sources(**tables)
    views = browsing.product_day_views(run.cohort, src, run.cfg)
    found = views.filter((F.col("cust_id") == 1) & (F.col("product_id") == 7) & (F.col("operate_date") == day)).first()
    before = browsing.product_day_views(run.cohort, run.src, run.cfg).agg(F.sum("traces")).first()[0]
    assert found["traces"] >= 2000 and views.agg(F.sum("traces")).first()[0] == before + 2000


def test_staged_tables_live_in_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert shared_folder(spark) == folder
    assert new_path(spark, "a").startswith(folder) and new_path(spark, "a") != new_path(spark, "a")
    staged = stage(spark.range(5), "five")
    assert staged.inputFiles()[0].startswith("file:") and folder in staged.inputFiles()[0]
    assert staged.count() == 5


def test_sources_open_on_demand(spark):
    opened = []
    tables = {name: (lambda name=name: opened.append(name) or spark.range(1)) for name in Sources.NAMES}
    src = Sources(**tables)
    assert opened == []
    assert src.calls is src.calls and opened == ["calls"]
    with pytest.raises(AttributeError):
        src.unknown
    with pytest.raises(ValueError, match="missing"):
        Sources(calls=tables["calls"])


def test_runtime_filter_before_the_shuffle_of_views_calls_and_attributes(spark, no_broadcast):
    """With a cohort too large to broadcast, a Bloom filter of it stands below the exchange of the large side."""
    size = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    run = Run(spark, FOLDER, training_config())
    rows = {
        "views": (lambda: stage(browsing._window_views(run.src, run.cfg), "views"), "cust_id"),
        "phones": (lambda: stage(run.src.feature_eav, "eav"), "user_id"),
        "calls": (lambda: stage(run.src.calls.withColumn("tel_num", F.col("cust_tel_no")), "calls"), "tel_num"),
    }
    book = stage(communication.cohort_phones(run.cohort, run.src, run.cfg).select("tel_num"), "book")
    for name, (make, key) in rows.items():
        table, members = make(), book if name == "calls" else run.cohort
        want = keep_members(table, members, key)
        assert "might_contain" not in plan_of(want)
        spark.conf.set(size, "0")
        try:
            found = keep_members(table, members, key)
            plan = plan_of(found)
            assert "might_contain" in plan and plan.index("Exchange hashpartitioning") < plan.index("might_contain"), name
            assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
        finally:
            spark.conf.unset(size)


def test_keys_of_any_kind_are_kept(spark):
    for values, kind in (([-(2**63), 0, 2**63 - 1, None], "bigint"), (["", "a", None], "string"), ([1.5, -1.0], "double")):
        table = spark.createDataFrame([(v,) for v in values], f"k {kind}")
        assert sorted(r[0] for r in keep_members(table, table, "k").collect()) == sorted(v for v in values if v is not None)


def test_sides_of_the_feature_table_meet_without_an_exchange(spark, no_broadcast):
    run = Run(spark, FOLDER, training_config())
    before = spark.catalog.listTables()
    table = feature_table(run.src, run.cfg)
    plan = plan_of(table)
    assert plan.count("SortMergeJoin [cust_id]") == 3 and plan.count("Bucketed: true") == 4
    assert "Exchange" not in plan
    assert table.count() == run.cohort.count() and spark.catalog.listTables() == before


def test_staged_by_key(spark, no_broadcast):
    """Repeated, missing and hot keys stay whole; a table without rows is a table; a lost write leaves no name."""
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "b"), (7, "c")], "k long, v string")
    for table in (rows, rows.filter("false"), rows.select("v", "k")):
        copy = stage_by("k", 3)(table, "rows")
        assert copy.schema == table.schema and sorted(map(str, copy.collect())) == sorted(map(str, table.collect()))
    left, right = stage_together(spark, stage_by("k"), left=rows, right=lambda: spark.range(9).withColumnRenamed("id", "k"))
    joined = left.join(right, "k").groupBy("k").count()
    assert "Exchange" not in plan_of(joined)
    assert sorted(tuple(r) for r in joined.collect()) == [(1, 3), (7, 1)]
    names = spark.catalog.listTables()
    with pytest.raises(Exception, match="executor lost"):
        stage_by("k")(rows.withColumn("v", F.raise_error(F.lit("executor lost")).cast("string")), "broken")
    assert spark.catalog.listTables() == names
