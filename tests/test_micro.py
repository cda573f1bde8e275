"""Window edges, nulls, ties and dirty rows on hand-written warehouse tables."""

from dataclasses import replace
from datetime import date, timedelta

import micro
import pytest
from pyspark.sql import functions as F
from tidemark.operators import behavior, browsing, cohort, communication, orders, profile
from tidemark.plans.feature_table import feature_table
from tidemark.schema import COLUMNS, FEATURE_SCHEMA
from tidemark.sources.model import Sources
from tidemark.sources.sink import write_table
from tidemark.sources.warehouse import warehouse_sources

A = micro.ANCHOR
CFG = micro.CONFIG


@pytest.fixture(scope="module")
def src(spark, tmp_path_factory):
    tables = micro.tables(spark, str(tmp_path_factory.mktemp("raw")))
    return warehouse_sources(spark, tables, CFG, micro.LABEL_SNAPSHOT, micro.HISTORY_SNAPSHOT)


@pytest.fixture(scope="module")
def members(src):
    return cohort.cohort(src, CFG).persist()


@pytest.fixture(scope="module")
def table(src):
    return {r["cust_id"]: r for r in feature_table(src, CFG).collect()}


def test_cohort(members, table):
    """Staff, unreadable ids, and rows whose partition or own date lies outside are dropped."""
    assert {r["cust_id"]: r["create_date"] for r in members.collect()} == {1: A, 3: A, 4: A, 5: A}
    assert set(table) == {1, 3, 4, 5}


def test_partition_is_pruned(src):
    plan = src.app_traffic._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    snapshot = src.label_orders._jdf.queryExecution().executedPlan().toString()
    assert "20230815" in snapshot


def test_shared_and_foreign_phones(src):
    calls = cohort.attribute_by_phone(src.calls, cohort.phones(src.feature_eav, "手机号"))
    owners = sorted((r["tel_num"] or "", r["user_id"] or 0) for r in calls.collect())
    assert owners == [
        ("", 0), ("13900000001", 1), ("13900000001", 1), ("13900000001", 1),
        ("13900000045", 4), ("13900000045", 5), ("13999999999", 0),
    ]


def test_labels(table):
    """Days +1..+7 and +1..+15; single products, cancelled, invalid, sub and foreign-channel orders do not count."""
    names = ("executed_flag_7", "executed_flag_15", "ordered_flag_7", "ordered_flag_15")
    flags = {c: tuple(r[n] for n in names) for c, r in table.items()}
    assert flags == {1: (1, 1, 1, 1), 4: (0, 1, 0, 1), 5: (0, 0, 0, 0), 3: (0, 0, 1, 1)}


def test_history(src, table):
    """Days -59..0; route 100 has two classes in its city, so averages weigh its lines twice."""
    row = table[1]
    # Orders 11, 12 and 13 were executed in reach; 13 was created before the lower bound.
    assert (row["executed_orders_cnt"], row["complaint_orders_cnt"], row["vac_executed_cnt"]) == (2, 1, 2)
    assert (row["cp_avg"], row["vac_cp_avg"], float(row["cp_min"]), float(row["cp_max"])) == (200.0, 200.0, 100.0, 300.0)
    assert (row["satisfaction_avg"], row["vac_satisfaction_avg"]) == (4.0, 4.0)
    assert (table[3]["cp_avg"], table[3]["satisfaction_avg"]) == (0.0, None)


def test_history_without_a_bound(src, members):
    kept = orders.effective_orders(src.history_orders, None, CFG.distribution_flags)
    row = orders.trailing_order_features(members, kept, orders.product_classes(src.route_dim, CFG.words), CFG)
    found = row.filter("cust_id = 1").first()
    # Order 13 lies on the first day of the window, order 14 one day before it.
    assert (found["executed_orders_cnt"], found["complaint_orders_cnt"]) == (3, 2)
    assert found["cp_avg"] == (100 + 100 + 300 + 300 + 50) / 5
    assert found["satisfaction_avg"] == (4 + 4 + 2) / 3
    interval = orders.customer_intervals(kept, members).filter("cust_id = 1").first()["avg_time_interval"]
    days = [-20, 0, -59, -60, 7]
    gaps = [x - y for x in days for y in days if x > y]
    assert abs(interval - sum(gaps) / len(gaps)) < 1e-12


def test_equal_days_make_no_pair(spark, members):
    rows = [(1, date(2023, 7, 1)), (1, date(2023, 7, 1)), (1, date(2023, 7, 4)), (3, date(2023, 7, 1)), (3, date(2023, 7, 1)), (4, None)]
    kept = spark.createDataFrame(rows, "cust_id long, executed_date date")
    assert [tuple(r) for r in orders.customer_intervals(kept, members).collect()] == [(1, 3.0)]


def test_profile(src, members):
    rows = {r["cust_id"]: r for r in profile.customer_profile(members, src, CFG).collect()}
    one, three, four = rows[1], rows[3], rows[4]
    assert (one["sex"], one["age"], one["age_group"], one["tel_num"]) == ("男", "31", "26~35岁", "13900000001")
    assert (one["rg_time"], one["office_weixin_time"], three["rg_time"], three["office_weixin_time"]) == (101, 11, 0, 0)
    assert (one["user_city"], one["user_province"]) == ("Nanjing", "Jiangsu")
    assert (four["user_city"], four["user_province"]) == ("Nowhere", None)
    assert (one["access_channel_cnt"], one["access_channels"]) == (2, "push,短信")
    assert (three["access_channel_cnt"], three["access_channels"]) == (0, None)


def test_unreadable_age_is_null(table):
    assert table[1]["age"] == 31 and table[3]["age"] is None


def test_repeated_attributes_are_reported(spark, src):
    assert profile.repeated_attributes(src.feature_eav).isEmpty()
    twice = src.feature_eav.unionByName(src.feature_eav.filter("three_class_name = '性别'"))
    assert [tuple(r) for r in profile.repeated_attributes(twice).collect()] == [(1, "性别", 2)]


def test_browsing_facts(src, members):
    facts = browsing.browsing_facts(members, src, CFG)
    rows = facts.filter("cust_id = 1").collect()
    # Trace a is one view seen on both sites; product 100 has two classes and two tied ratings.
    assert sorted((r["visitor_trace"], r["browsing_flag"]) for r in rows) == sorted(
        [("a", 1)] * 4 + [("b", 1)] * 4 + [("c", 2), ("d", 1)]
    )
    intents = {r["visitor_trace"]: r["search_key_type"] for r in rows}
    assert intents == {"a": 0, "b": 1, "c": None, "d": None}
    assert {r["visitor_trace"] for r in rows if r["collect_coupons_status"] == 1} == {"a"}
    empty = facts.filter("cust_id = 3").collect()
    assert len(empty) == 1 and empty[0]["browsing_flag"] == 0 and empty[0]["operate_date"] is None


def test_browsing_features(table):
    row = table[1]
    assert (row["browsing_days"], row["pv"], row["browsing_products_cnt"], row["to_booking_pages_cnt"]) == (3, 9, 1, 4)
    assert (row["browsing_time"], row["browsing_time_max"]) == (4 * 10 + 4 * 20 + 5, 20)
    assert (row["search_times"], row["vac_search_times"], row["collect_coupons_cnt"]) == (8, 4, 1)
    assert (row["lowest_price_avg"], row["vac_lowest_price_avg"]) == (80.0, 80.0)
    assert (row["browsing_vac_prd_cnt"], row["browsing_single_prd_cnt"]) == (1, 1)
    assert (row["prd_satisfaction"], row["prd_comp_grade_level"], row["prd_remark_amount"]) == (4.5, 3, 15.0)
    assert (table[3]["pv"], table[3]["lowest_price_avg"], table[3]["prd_satisfaction"]) == (0, None, None)
    # A product that no dimension knows still counts as a page view; the word 'null' counts as a search.
    assert (table[4]["pv"], table[4]["search_times"], table[4]["vac_search_times"]) == (1, 1, 0)


def test_one_class_per_route(src, members):
    facts = browsing.browsing_facts(members, src, replace(CFG, one_class_per_route=True, rating_ties=False))
    assert facts.filter("cust_id = 1 and visitor_trace = 'a'").count() == 1


def test_communication(src, members, table):
    days = {(r["cust_id"], str(r["comm_date"]), r["channel_id"]): r for r in communication.communication_days(members, src, CFG).collect()}
    call = days[1, "2023-07-20", 1]
    # Order 11 joins two class rows, so that call counts twice.
    assert (call["comm_duration"], call["day_calls"], call["comm_num"], call["active_comm_num"]) == (120, 3, 2, 2)
    assert (call["vac_mention_num"], call["single_mention_num"]) == (1, 1)
    assert (1, "2023-07-18", 1) not in days
    assert days[4, "2023-07-19", 1]["comm_num"] == days[5, "2023-07-19", 1]["comm_num"] == 1
    robot = days[3, "2023-07-20", 2]
    assert (robot["day_calls"], robot["comm_num"], robot["active_comm_num"]) == (2, 2, 1)
    chat = days[1, "2023-07-15", 3]
    assert (chat["comm_num"], chat["active_comm_num"], chat["vac_mention_num"], chat["single_mention_num"]) == (2, 1, 1, 1)
    service = days[1, "2023-07-15", 4]
    assert (service["active_comm_num"], service["vac_mention_num"], service["single_mention_num"]) == (1, 1, 1)
    assert days[1, "2023-06-30", 3]["comm_flag"] == 2 and days[4, "2023-07-21", 2]["comm_flag"] == 0
    row = table[1]
    assert (row["comm_days"], row["comm_freq"], row["channels_cnt"]) == (4, 5, 4)
    assert (row["call_pct"], row["robot_pct"], row["officewx_pct"], row["chat_pct"]) == (20.0, 20.0, 20.0, 40.0)
    assert (row["calls_freq"], row["call_completing_rate"], row["active_calls_pct"]) == (2, 50.0, 100.0)
    assert (row["chats_freq"], row["active_chats_freq"]) == (4, 2)
    assert (row["chats_freq_daily_avg"], row["active_chats_pct"]) == (2.0, 50.0)


def test_decision_time(table):
    """16 for a touch before the window, days from the first touch otherwise, 1 for the same day."""
    assert {c: r["decision_time"] for c, r in table.items()} == {1: 16, 3: 1, 4: 2, 5: 2}


def test_no_touch_at_all(spark, members):
    nothing = spark.createDataFrame([], "cust_id long, day date, flag int")
    views = nothing.withColumnsRenamed({"day": "operate_date", "flag": "browsing_flag"})
    contacts = nothing.withColumnsRenamed({"day": "comm_date", "flag": "comm_flag"})
    found = behavior.decision_time(members, views, contacts)
    assert {r["decision_time"] for r in found.collect()} == {0}


@pytest.mark.parametrize(("offset", "flag"), [(1, 0), (0, 1), (-14, 1), (-15, 2), (None, 0)])
def test_recency_edges(spark, offset, flag):
    from tidemark.functions.expr import recency_flag

    day = F.lit(None if offset is None else A + timedelta(days=offset)).cast("date")
    assert spark.range(1).select(recency_flag(day, F.lit(A), 15)).first()[0] == flag


def test_table_layout(src, table):
    frame = feature_table(src, CFG)
    assert frame.columns == list(COLUMNS) and len(COLUMNS) == 70
    assert [f.dataType for f in frame.schema] == [f.dataType for f in FEATURE_SCHEMA]
    for row in table.values():
        shares = [row[c] for c in ("call_pct", "robot_pct", "officewx_pct", "chat_pct")]
        assert sum(shares) == pytest.approx(100 if row["comm_freq"] else 0, abs=0.001)


def with_table(src, **changed):
    tables = {name: (lambda name=name: getattr(src, name)) for name in Sources.NAMES}
    return Sources(**tables | {name: (lambda df=df: df) for name, df in changed.items()})


def test_every_phone_of_a_customer_counts(spark, src, members):
    """A second number adds its calls, a number shared with another customer credits both."""
    more = spark.createDataFrame([(1, "手机号", "p", "13999999999"), (3, "手机号", "p", "13900000001")], "user_id long, three_class_name string, feature_name string, feature_value string")
    both = with_table(src, feature_eav=src.feature_eav.select(more.columns).unionByName(more))

    def daily(source):
        book = communication.cohort_phones(members, source, CFG)
        classes = orders.product_classes(source.route_dim, CFG.words)
        rows = communication.call_daily(source.calls, book, source.history_orders, classes, CFG).collect()
        return {(r["cust_id"], r["comm_date"]): (r["comm_duration"], r["day_calls"]) for r in rows}

    before, after = daily(src), daily(both)
    seconds, calls = before[1, A]
    assert after[1, A] == (seconds + 99, calls + 1)
    assert after[3, A] == before[1, A] and (3, A) not in before


def test_anchor_outside_the_activity_window(spark, src, members):
    """Bounds of labels and history follow the anchor, wherever it lies."""
    early = replace(CFG, activity_start=date(2023, 5, 1), activity_end=date(2023, 5, 2), anchor=A)
    classes = orders.product_classes(src.route_dim, CFG.words)

    def found(cfg):
        labels = orders.effective_orders(src.label_orders, cfg.label_orders_since, cfg.distribution_flags)
        history = orders.effective_orders(src.history_orders, None, cfg.distribution_flags)
        tables = orders.future_window_flags(members, labels, classes, cfg), orders.trailing_order_features(members, history, classes, cfg)
        return [sorted(map(str, t.collect())) for t in tables]

    assert found(early) == found(CFG)


def test_one_of_tied_ratings_in_facts_and_features(src, members):
    single = replace(CFG, rating_ties=False)
    ratings = [browsing.latest_product_rating(src.product_rating, c.rating_ties).groupBy("f_product_id").count() for c in (CFG, single)]
    assert ratings[1].filter("count > 1").isEmpty()
    for cfg, counts in zip((CFG, single), ratings):
        kept = {r["f_product_id"]: r["count"] for r in counts.collect()}
        weights = browsing._rating_weights(src.product_rating, cfg.rating_ties).collect()
        assert {r["product_id"]: r["n_ratings"] for r in weights} == kept


def test_write_table_replaces(spark, tmp_path, table):
    path = str(tmp_path / "result")
    write_table(spark.range(5), path)
    write_table(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="already exists"):
        write_table(spark.range(3), path, overwrite=False)


def test_every_attribute_value(spark, src, members):
    """A second phone and a second age: one row for the largest values, or a row for each combination."""
    more = [(1, CFG.words.phone_name, None, "13900000999"), (1, CFG.words.age_name, None, "77"), (99, CFG.words.phone_name, None, "1")]
    eav = src.feature_eav.unionByName(spark.createDataFrame(more, "user_id long, three_class_name string, feature_name string, feature_value string"))
    sources = Sources(**{n: (lambda n=n: getattr(src, n)) for n in Sources.NAMES} | {"feature_eav": lambda: eav})
    one = profile.customer_profile(members, sources, CFG).collect()
    every = profile.customer_profile(members, sources, replace(CFG, every_attribute_value=True)).collect()
    assert len(one) == members.count() and len(every) == len(one) + 3
    stored = {n: {r["feature_value"] for r in eav.filter((F.col("user_id") == 1) & (F.col("three_class_name") == n)).collect()} for n in (CFG.words.phone_name, CFG.words.age_name)}
    assert {(r["tel_num"], r["age"]) for r in every if r["cust_id"] == 1} == {(p, a) for p in stored[CFG.words.phone_name] for a in stored[CFG.words.age_name]}
    rest = [tuple(r) for r in every if r["cust_id"] != 1]
    assert sorted(rest, key=str) == sorted((tuple(r) for r in one if r["cust_id"] != 1), key=str)
    assert {(r["user_id"], r["n"]) for r in profile.repeated_attributes(eav).collect()} >= {(1, 2)}
