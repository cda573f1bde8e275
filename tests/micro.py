"""A few hand-written rows in every raw warehouse table, partitioned by day.

Customers (all active last on 2023-07-20 unless noted):
1  views, chats and calls in all windows   2  staff, dropped           3  only an answered robot call
4  shares a phone with 5                    5  shares a phone with 4     6  only activity outside the window
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F
from tidemark.config import WAREHOUSE_WORDS, FeatureConfig

ANCHOR = date(2023, 7, 20)
WORDS = WAREHOUSE_WORDS
CONFIG = FeatureConfig(
    words=WORDS,
    activity_start=date(2023, 7, 1),
    activity_end=date(2023, 7, 31),
    behavior_start=date(2023, 6, 15),
    behavior_end=date(2023, 7, 31),
    label_orders_since=date(2023, 7, 1),
    history_orders_since=date(2023, 6, 1),
    call_orders_since=date(2023, 6, 1),
)
LABEL_SNAPSHOT, HISTORY_SNAPSHOT = date(2023, 8, 15), date(2023, 7, 31)


def at(offset: int, hour: int = 10) -> datetime:
    return datetime.combine(ANCHOR + timedelta(days=offset), datetime.min.time()).replace(hour=hour)


def dt(offset: int) -> str:
    return (ANCHOR + timedelta(days=offset)).strftime("%Y%m%d")


def views(spark, rows):
    """rows: (customer text, offset of the time, offset of the partition, trace, seconds, product, booking, search)"""
    data = [(c, at(o), str(t), s, p, b, k, dt(d)) for c, o, d, t, s, p, b, k in rows]
    return spark.createDataFrame(
        data,
        "vt_mapuid string, operate_time timestamp_ntz, visitor_trace string, residence_time long, product_id long, "
        "book_id long, search_key string, dt string",
    )


APP = [
    ("1", 0, 0, "a", 10, 100, None, "海南机票"),
    ("1", 0, 0, "a", 10, 100, None, "海南机票"),
    ("1", -14, -14, "b", 20, 100, 7, "海南"),
    ("1", -15, -15, "c", 40, 200, None, "NULL"),
    ("1", -3, -3, "d", 5, None, None, None),
    ("2", 0, 0, "e", 1, 100, None, None),
    ("4", 0, 0, "f", 1, 300, None, "null"),
    ("not a number", 0, 0, "g", 1, 100, None, None),
    # The row's own date is outside the window although its partition is inside, and the other way round.
    ("6", -40, 0, "h", 1, 100, None, None),
    ("6", -1, 40, "i", 1, 100, None, None),
]
WEB = [("1", 0, 0, "a", 10, 100, None, "海南机票"), ("5", 0, 0, "w", 3, 100, None, "酒店")]

CALLS = [
    # number, offset, status, seconds, direction, order, type
    ("8613900000001", 0, "通话", 60, "呼入", 11, 0),
    ("13900000001", 0, "未接", 0, "呼出", None, 1),
    ("13900000001", -2, "通话", 30, "呼出", 12, 2),
    ("13900000045", -1, "通话", 15, "呼入", None, 1),
    (None, 0, "通话", 99, "呼入", None, 0),
    ("13999999999", 0, "通话", 99, "呼入", None, 0),
]

ORDERS = [
    # customer, order, route, city, created offset, signed offset, amount, complaint, visit, score, cancelled, valid, sub, channel
    (1, 11, 100, 1, -30, -20, "100.00", None, -1, 4.0, 0, 1, 0, 0),
    (1, 12, 100, 1, -19, 0, "300.00", 0, None, None, 0, 1, 0, 3),
    (1, 13, 200, 1, -60, -59, "50.00", -59, -59, 2.0, 0, 1, 0, 4),
    (1, 14, 100, 1, -70, -60, "999.00", -60, -60, 1.0, 0, 1, 0, 5),
    (1, 15, 100, 1, 1, 7, "10.00", None, None, None, 0, 1, 0, 0),
    (4, 16, 100, 1, 8, 15, "10.00", None, None, None, 0, 1, 0, 0),
    (5, 17, 100, 1, 0, 16, "10.00", None, None, None, 0, 1, 0, 0),
    (3, 18, 200, 1, 2, 3, "10.00", None, None, None, 0, 1, 0, 0),
    (3, 19, 100, 1, 2, 3, "10.00", None, None, None, 1, 1, 0, 0),
    (3, 20, 100, 1, 2, 3, "10.00", None, None, None, 0, 0, 0, 0),
    (3, 21, 100, 1, 2, 3, "10.00", None, None, None, 0, 1, 1, 0),
    (3, 22, 100, 1, 2, 3, "10.00", None, None, None, 0, 1, 0, 1),
]


def tables(spark, folder: str) -> dict:
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    def day(offset):
        return None if offset is None else ANCHOR + timedelta(days=offset)

    order_rows = []
    for c, o, r, city, created, signed, amount, complaint, visit, score, cancelled, valid, sub, channel in ORDERS:
        for taken in (LABEL_SNAPSHOT, HISTORY_SNAPSHOT):
            if day(created) <= taken:
                order_rows.append(
                    (c, o, r, city, at(created), cancelled, 1, 0, day(signed), None if complaint is None else at(complaint),
                     amount, score, day(visit), valid, sub, channel, taken.strftime("%Y%m%d"))
                )
    orders = frame(
        order_rows,
        "cust_id long, order_id long, route_id long, book_city int, create_time timestamp_ntz, cancel_flag int, "
        "sign_flag int, cancel_sign_flag int, sign_date date, complaint_time timestamp_ntz, travel_sign_amount string, "
        "satisfaction double, return_visit_date date, valid_flag int, is_sub int, distribution_flag int, dt string",
    ).withColumn("travel_sign_amount", F.col("travel_sign_amount").cast("decimal(18,2)"))

    stored = {"app_traffic": views(spark, APP), "orders": orders}
    for name, df in stored.items():
        df.write.mode("overwrite").partitionBy("dt").parquet(f"{folder}/{name}")
    eav = "user_id long, three_class_name string, feature_name string, feature_value string"
    people = [(1, "性别", "男", "1"), (1, "年龄", "岁", "31"), (1, "年龄段", "26~35岁", "g"), (3, "年龄", "岁", "unknown")]
    people += [(1, "手机号", "p", "13900000001"), (4, "手机号", "p", "13900000045"), (5, "手机号", "p", "13900000045")]
    attribute = [
        (c, int(c == 2), 0, 0, 4, c % 8, at(-100 if c != 3 else 0), 1, c % 2, at(-10) if c == 1 else None)
        for c in (1, 2, 3, 4, 5, 6)
    ]
    return {
        **{name: spark.read.parquet(f"{folder}/{name}") for name in stored},
        "web_traffic": views(spark, WEB),
        "calls": frame(
            [(n, at(o), s, t, d, i, k, dt(o)) for n, o, s, t, d, i, k in CALLS],
            "cust_tel_no string, status_start_time timestamp_ntz, status string, status_time long, calldir string, "
            "order_id long, tel_order_type int, dt string",
        ),
        "robot_calls": frame(
            [(3, at(0), 9, 1, 1, "A", dt(0)), (3, at(0), 9, 1, 0, "a", dt(0)), (1, at(-1), 0, 0, 1, "a", dt(-1)), (4, at(1), 5, 0, 0, "z", dt(1))],
            "cust_id long, start_time timestamp_ntz, call_time long, answer_flag int, generate_task_is int, label string, dt string",
        ),
        "wecom_chat": frame(
            [(1, at(-5), 1, "想跟团去旅游", dt(-5)), (1, at(-5, 11), 2, "有高铁票", dt(-5)), (1, at(-20), 1, "好", dt(-20))],
            "cust_id long, msg_time timestamp_ntz, type int, contact string, dt string",
        ),
        "service_chat": frame(
            [(1, at(-5), "客人发送消息：酒店和签证", dt(-5)), (1, at(-4), None, dt(-4))],
            "cust_id long, create_start_time timestamp_ntz, content string, dt string",
        ),
        "cust_attribute": frame(
            attribute,
            "cust_id long, is_inside_staff int, is_distribution int, is_scalper int, cust_type int, cust_level int, "
            "rg_time timestamp_ntz, cust_group_type int, is_office_weixin int, office_weixin_time timestamp_ntz",
        ),
        "feature_eav": frame(people, eav),
        "city_eav": frame([(1, "所在城市", "Nanjing", "32"), (4, "所在城市", "Nowhere", "99")], eav),
        "access_channel": frame(
            [(1, "短信", 1), (1, "push", 1), (1, "企业微信", 0)], "user_id long, three_class_name string, feature_value int"
        ),
        "city_key": frame([("32", "Jiangsu")], "city_key string, parent_province_name string"),
        "route_dim": frame(
            [(100, 1, "跟团游", "度假产品"), (100, 1, "门票", "度假产品"), (200, 1, "门票", "度假产品"), (100, 2, "跟团游", "度假产品")],
            "route_id long, book_city int, one_producttype_name string, producttype_class_name string",
        ),
        "prd_route": frame([(100, 80.0), (100, 80.0), (200, 20.0)], "route_id long, lowest_price double"),
        "coupons": frame(
            [(1, 1, at(0)), (1, 1, at(0, 12)), (1, 0, at(-14))], "cust_id long, collect_coupons_status int, operate_time timestamp_ntz"
        ),
        "product_rating": frame(
            [(100, at(-9), 1000000, 1, 1, 1, 1, 1, 1), (100, at(-2), 4000000, 2, 10, 0, 0, 0, 0), (100, at(-2), 5000000, 3, 20, 0, 0, 0, 0), (200, None, 9000000, 9, 9, 9, 9, 9, 9)],
            "f_product_id long, f_update_time timestamp_ntz, f_satisfaction long, f_comp_grade_level int, f_remark_amount long, "
            "f_essence_amount long, f_coupon_amount long, f_money_amount long, f_photo_amount long",
        ),
    }
