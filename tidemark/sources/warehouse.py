"""The sixteen warehouse tables, partitioned by day, under the operators' column names.

Daily tables are filtered twice: by partition, which prunes the scan, and later by the row's own date,
which drops late and wrong rows. Order tables hold the whole history in every partition, so exactly one
snapshot is read.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import FeatureConfig
from tidemark.sources.model import Sources

# Raw tables `tables` must name, with the columns each needs.
RAW_COLUMNS = {
    "app_traffic": "vt_mapuid operate_time visitor_trace residence_time product_id book_id search_key dt",
    "web_traffic": "vt_mapuid operate_time visitor_trace residence_time product_id book_id search_key dt",
    "calls": "cust_tel_no status_start_time status status_time calldir order_id tel_order_type dt",
    "robot_calls": "cust_id start_time call_time answer_flag generate_task_is label dt",
    "wecom_chat": "cust_id msg_time type contact dt",
    "service_chat": "cust_id create_start_time content dt",
    "cust_attribute": "cust_id is_inside_staff is_distribution is_scalper cust_type cust_level rg_time "
    "cust_group_type is_office_weixin office_weixin_time",
    "feature_eav": "user_id three_class_name feature_name feature_value",
    "city_eav": "user_id three_class_name feature_name feature_value",
    "access_channel": "user_id three_class_name feature_value",
    "city_key": "city_key parent_province_name",
    "orders": "cust_id order_id route_id book_city create_time cancel_flag sign_flag cancel_sign_flag sign_date "
    "complaint_time travel_sign_amount satisfaction return_visit_date valid_flag is_sub distribution_flag dt",
    "route_dim": "route_id book_city one_producttype_name producttype_class_name",
    "prd_route": "route_id lowest_price",
    "coupons": "cust_id collect_coupons_status operate_time",
    "product_rating": "f_product_id f_update_time f_satisfaction f_comp_grade_level f_remark_amount "
    "f_essence_amount f_coupon_amount f_money_amount f_photo_amount",
}


def _partition(df: DataFrame, day: date) -> str | int:
    """A partition value in the type the table stores: a day as yyyyMMdd, text or number."""
    text = day.strftime("%Y%m%d")
    return int(text) if isinstance(df.schema["dt"].dataType, T.IntegralType) else text


def _day(name: str) -> Column:
    """The date of a timestamp or of its text form; null when it is not one."""
    return F.col(name).try_cast("date")


def warehouse_sources(
    spark: SparkSession,
    tables: Mapping[str, str | DataFrame],
    cfg: FeatureConfig,
    label_snapshot: date,
    history_snapshot: date,
) -> Sources:
    """`tables` gives a catalog name or a DataFrame for each key of `RAW_COLUMNS`."""
    first = min(cfg.activity_start, cfg.behavior_start)
    last = max(cfg.activity_end, cfg.behavior_end)

    def raw(name: str) -> DataFrame:
        table = tables[name]
        df = spark.read.table(table) if isinstance(table, str) else table
        return df.select(*RAW_COLUMNS[name].split())

    def daily(name: str) -> DataFrame:
        df = raw(name)
        return df.filter(F.col("dt").between(_partition(df, first), _partition(df, last))).drop("dt")

    def traffic(name: str) -> DataFrame:
        return daily(name).select(
            F.col("vt_mapuid").try_cast("bigint").alias("vt_mapuid"),
            _day("operate_time").alias("op_date"),
            "visitor_trace",
            "residence_time",
            "product_id",
            "book_id",
            "search_key",
        )

    def dated(df: DataFrame, time: str, day: str) -> DataFrame:
        return df.withColumn(day, _day(time)).drop(time)

    def snapshot(day: date) -> DataFrame:
        df = raw("orders")
        taken = df.filter(F.col("dt") == _partition(df, day)).drop("dt")
        days = ("create_time", "sign_date", "complaint_time", "return_visit_date")
        return taken.withColumns({name: _day(name) for name in days})

    def attributes() -> DataFrame:
        return raw("cust_attribute").withColumns({name: _day(name) for name in ("rg_time", "office_weixin_time")})

    return Sources(
        app_traffic=lambda: traffic("app_traffic"),
        web_traffic=lambda: traffic("web_traffic"),
        calls=lambda: dated(daily("calls"), "status_start_time", "call_date"),
        robot_calls=lambda: dated(daily("robot_calls"), "start_time", "call_date"),
        wecom_chat=lambda: dated(daily("wecom_chat"), "msg_time", "msg_date"),
        service_chat=lambda: dated(daily("service_chat"), "create_start_time", "chat_date"),
        coupons=lambda: dated(raw("coupons"), "operate_time", "op_date"),
        product_rating=lambda: raw("product_rating"),
        prd_route=lambda: raw("prd_route").withColumn("lowest_price", F.col("lowest_price").cast("decimal(18,2)")),
        route_dim=lambda: raw("route_dim"),
        label_orders=lambda: snapshot(label_snapshot),
        history_orders=lambda: snapshot(history_snapshot),
        cust_attribute=attributes,
        feature_eav=lambda: raw("feature_eav"),
        city_eav=lambda: raw("city_eav"),
        city_key=lambda: raw("city_key"),
        access_channel=lambda: raw("access_channel"),
    )
