"""Stand-ins for the sixteen source tables, derived from the TPC-H-like test tables."""

from __future__ import annotations

from datetime import date, timedelta
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig
from tidemark.functions.joins import not_broadcast
from tidemark.sources.model import Sources

EVENT_SHIFT_DAYS = 9315
CHAT_EPOCH = date(1998, 7, 1)


def _events(events: DataFrame, event_type: str, days: tuple[date, date] | None = None) -> DataFrame:
    """Events of one type. `days` repeats the run's window on the raw time, where the scan can use it."""
    kept = events.filter(F.col("event_type") == event_type)
    if days is not None:
        first, last = (day + timedelta(days=EVENT_SHIFT_DAYS) for day in days)
        kept = kept.filter(F.col("ts").cast("date").between(first, last))
    return kept.select(
        "event_id",
        "user_id",
        F.date_sub(F.col("ts").cast("date"), EVENT_SHIFT_DAYS).alias("op_date"),
        F.round("value").cast("bigint").alias("val"),
        F.regexp_extract("props", "([0-9]+)", 1).try_cast("int").alias("k"),
    )


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _traffic(events: DataFrame) -> DataFrame:
    k = F.col("k")
    search = (
        F.when(k % 7 == 0, "null")
        .when(k % 4 == 0, F.lit(None).cast("string"))
        .when(k % 4 == 1, "hotel deal")
        .when(k % 4 == 2, "train ticket")
        .otherwise("beach tour")
    )
    return events.select(
        F.col("user_id").alias("vt_mapuid"),
        "op_date",
        F.col("event_id").alias("visitor_trace"),
        F.col("val").alias("residence_time"),
        k.cast("bigint").alias("product_id"),
        F.when(k % 5 == 0, k).cast("bigint").alias("book_id"),
        search.alias("search_key"),
    )


def _calls(events: DataFrame) -> DataFrame:
    k = F.col("k")
    number = F.concat(F.lit("139"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    return events.select(
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("86"), number)).otherwise(number).alias("cust_tel_no"),
        F.col("op_date").alias("call_date"),
        F.col("val").alias("status_time"),
        F.when(k % 4 == 0, "MISSED").otherwise("TALK").alias("status"),
        F.when(k % 2 == 0, "IN").otherwise("OUT").alias("calldir"),
        F.col("event_id").alias("order_id"),
        (k % 3).alias("tel_order_type"),
    )


def _robot_calls(events: DataFrame) -> DataFrame:
    k = F.col("k")
    return events.select(
        F.col("user_id").alias("cust_id"),
        F.col("op_date").alias("call_date"),
        F.col("val").alias("call_time"),
        F.when(k % 3 == 0, 0).otherwise(1).alias("answer_flag"),
        (k % 2).alias("generate_task_is"),
        F.upper(F.substring(F.lit("abqcpsxyz"), k % 9 + 1, F.lit(1))).alias("label"),
    )


def _wecom_chat(conversations: DataFrame) -> DataFrame:
    day = F.date_add(F.lit(CHAT_EPOCH), ((F.col("conv_id") * 7 + F.col("turn")) % 24).cast("int"))
    return conversations.select(
        F.col("conv_id").alias("cust_id"),
        day.alias("msg_date"),
        F.when(F.col("role") == "user", 1).otherwise(2).alias("type"),
        F.col("text").alias("contact"),
    )


def _service_chat(documents: DataFrame) -> DataFrame:
    return documents.select(
        (F.col("doc_id") % 150).alias("cust_id"),
        F.date_add(F.lit(CHAT_EPOCH), (F.col("doc_id") % 24).cast("int")).alias("chat_date"),
        F.col("text").alias("content"),
    )


def _product_rating(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("k").cast("bigint").alias("f_product_id"),
        F.col("op_date").alias("f_update_time"),
        (F.col("val") * 1000000).alias("f_satisfaction"),
        (F.col("k") % 4).cast("bigint").alias("f_comp_grade_level"),
        (F.col("event_id") % 50).alias("f_remark_amount"),
        (F.col("event_id") % 11).alias("f_essence_amount"),
        (F.col("event_id") % 13).alias("f_coupon_amount"),
        (F.col("event_id") % 17).alias("f_money_amount"),
        (F.col("event_id") % 19).alias("f_photo_amount"),
    )


def _coupons(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("cust_id"), "op_date", _flag(F.col("k") % 2 == 0).alias("collect_coupons_status")
    )


def _prd_route(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("route_id"), F.col("p_retailprice").cast("decimal(18,2)").alias("lowest_price")
    )


def _route_dim(part: DataFrame) -> DataFrame:
    kind = F.col("p_type")
    return part.select(
        F.col("p_partkey").alias("route_id"),
        F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("book_city"),
        F.when(kind == "MEDIUM", "TICKET").otherwise(kind).alias("one_producttype_name"),
        F.when(kind.isin("PROMO", "ECONOMY", "LARGE", "MEDIUM"), "VACATION")
        .otherwise("SINGLE")
        .alias("producttype_class_name"),
    )


def _order_detail(orders: DataFrame, lines: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    ordered = F.col("o_orderdate").cast("date")
    return orders.join(not_broadcast(lines), F.col("l_orderkey") == key).select(
        F.col("o_custkey").alias("cust_id"),
        key.alias("order_id"),
        ordered.alias("create_time"),
        _flag(F.col("l_returnflag") == "R").alias("cancel_flag"),
        _flag((F.col("l_linestatus") == "F") | (F.col("o_orderstatus") == "F")).alias("sign_flag"),
        F.lit(0).alias("cancel_sign_flag"),
        F.date_add(ordered, F.col("l_linenumber")).alias("sign_date"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("travel_sign_amount"),
        F.col("l_partkey").alias("route_id"),
        (F.col("l_suppkey") % 3).cast("int").alias("book_city"),
        (key % 101).alias("satisfaction"),
        F.when(key % 2 == 0, F.date_add(ordered, 10)).alias("return_visit_date"),
        F.when(key % 5 == 0, F.date_add(ordered, 2)).alias("complaint_time"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), 0)
        .otherwise(1)
        .alias("valid_flag"),
        _flag(F.col("l_linenumber") == 7).alias("is_sub"),
        (key % 6).cast("int").alias("distribution_flag"),
    )


def _cust_attribute(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        key.alias("cust_id"),
        _flag(F.col("c_acctbal") < 0).alias("is_inside_staff"),
        _flag(key % 37 == 5).alias("is_distribution"),
        _flag(key % 41 == 7).alias("is_scalper"),
        (key % 8).alias("cust_level"),
        F.when(key % 5 == 0, F.lit(-1).cast("bigint")).otherwise(key % 5).alias("cust_type"),
        (key % 4).alias("cust_group_type"),
        (key % 2).alias("is_office_weixin"),
        F.date_add(F.lit(date(1997, 1, 1)), (key % 700).cast("int")).alias("rg_time"),
        F.when(key % 2 == 1, F.date_add(F.lit(date(1998, 1, 1)), (key % 240).cast("int"))).alias("office_weixin_time"),
    )


def _feature_eav(customer: DataFrame, second_phones: bool = False) -> DataFrame:
    """Personal attributes of a customer in one pass, as an exploded array of entries.

    With `second_phones` every sixth customer also has the phone of the next one, so phones are repeated and shared.
    """
    key = F.col("c_custkey")
    band = (
        F.when(key % 60 < 8, "16-25").when(key % 60 < 18, "26-35").when(key % 60 < 28, "36-45").otherwise("46+")
    )
    phone, next_phone = (F.concat(F.lit("139"), F.lpad(owner.cast("string"), 8, "0")) for owner in (key, key + 1))

    def entry(when: Column, attribute: str, name: Column, value: Column) -> Column:
        fields = F.struct(
            F.lit(attribute).alias("three_class_name"), name.alias("feature_name"), value.alias("feature_value")
        )
        return F.when(when, fields)

    entries = F.array(
        entry(key % 10 != 3, "SEX", F.when(key % 2 == 0, "M").otherwise("F"), (key % 2).cast("string")),
        entry(key % 9 != 4, "AGE", F.lit("age"), (key % 60 + 18).cast("string")),
        entry(key % 9 != 4, "AGE_GROUP", band, F.lit("g")),
        entry(key.isNotNull(), "PHONE", F.lit("phone"), phone),
        entry((key % 6 == 1) & F.lit(second_phones), "PHONE", F.lit("phone"), next_phone),
    )
    # Missing entries drop out after the explosion: compacting the array first is not compiled.
    rows = customer.select(key.alias("user_id"), F.explode(entries).alias("e")).filter(F.col("e").isNotNull())
    return rows.select("user_id", "e.three_class_name", "e.feature_name", "e.feature_value")


def _city_eav(customer: DataFrame, nation: DataFrame) -> DataFrame:
    homes = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return homes.select(
        F.col("c_custkey").alias("user_id"),
        F.lit("CITY").alias("three_class_name"),
        F.col("n_name").alias("feature_name"),
        F.col("c_nationkey").cast("string").alias("feature_value"),
    )


def _city_key(nation: DataFrame, region: DataFrame) -> DataFrame:
    return nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("city_key"), F.col("r_name").alias("parent_province_name")
    )


def _access_channel(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    channels = F.create_map(F.lit("push"), key % 2, F.lit("wecom"), key % 3, F.lit("sms"), key % 5)
    return customer.select(
        key.alias("user_id"), F.explode(channels).alias("three_class_name", "feature_value")
    )


def standin_sources(spark: SparkSession, folder: str, cfg: FeatureConfig | None = None, second_phones: bool = False) -> Sources:
    """All sources of a folder; with a config, the event channels are read for its windows only."""
    days = cfg and (min(cfg.activity_start, cfg.behavior_start), max(cfg.activity_end, cfg.behavior_end))

    @cache
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    def events(event_type: str) -> DataFrame:
        return _events(table("events"), event_type, days)

    @cache
    def order_detail() -> DataFrame:
        return _order_detail(table("orders"), table("lineitem"))

    return Sources(
        app_traffic=lambda: _traffic(events("click")),
        web_traffic=lambda: _traffic(events("view")),
        calls=lambda: _calls(events("error")),
        robot_calls=lambda: _robot_calls(events("signup")),
        wecom_chat=lambda: _wecom_chat(table("conversations")),
        service_chat=lambda: _service_chat(table("documents")),
        coupons=lambda: _coupons(events("purchase")),
        product_rating=lambda: _product_rating(_events(table("events"), "purchase")),
        prd_route=lambda: _prd_route(table("part")),
        route_dim=lambda: _route_dim(table("part")),
        label_orders=order_detail,
        history_orders=order_detail,
        cust_attribute=lambda: _cust_attribute(table("customer")),
        feature_eav=lambda: _feature_eav(table("customer"), second_phones),
        city_eav=lambda: _city_eav(table("customer"), table("nation")),
        city_key=lambda: _city_key(table("nation"), table("region")),
        access_channel=lambda: _access_channel(table("customer")),
    )
