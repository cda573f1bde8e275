"""The logical tables every feature run reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Sources:
    """Raw tables under the column names the operators use.

    app_traffic, web_traffic  vt_mapuid, op_date, visitor_trace, residence_time, product_id, book_id, search_key
    calls           cust_tel_no, call_date, status_time, status, calldir, order_id, tel_order_type
    robot_calls     cust_id, call_date, call_time, answer_flag, generate_task_is, label
    wecom_chat      cust_id, msg_date, type, contact
    service_chat    cust_id, chat_date, content
    coupons         cust_id, op_date, collect_coupons_status
    product_rating  f_product_id, f_update_time, f_satisfaction, f_comp_grade_level, five amounts
    prd_route       route_id, lowest_price
    route_dim       route_id, book_city, one_producttype_name, producttype_class_name
    label_orders, history_orders  one snapshot each of the order lines
    cust_attribute  flags, levels and dates per customer
    feature_eav, city_eav  user_id, three_class_name, feature_name, feature_value
    city_key        city_key, parent_province_name
    access_channel  user_id, three_class_name, feature_value

    A table is opened when first read, so a job only touches the tables it needs.
    """

    NAMES = (
        "app_traffic",
        "web_traffic",
        "calls",
        "robot_calls",
        "wecom_chat",
        "service_chat",
        "coupons",
        "product_rating",
        "prd_route",
        "route_dim",
        "label_orders",
        "history_orders",
        "cust_attribute",
        "feature_eav",
        "city_eav",
        "city_key",
        "access_channel",
    )

    def __init__(self, **tables: Callable[[], DataFrame]):
        unknown, missing = set(tables) - set(self.NAMES), set(self.NAMES) - set(tables)
        if unknown or missing:
            raise ValueError(f"unknown tables {sorted(unknown)}, missing tables {sorted(missing)}")
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name not in type(self).NAMES:
            raise AttributeError(name)
        table = self._tables[name]()
        setattr(self, name, table)
        return table

    def with_tables(self, **tables: Callable[[], DataFrame]) -> Sources:
        """The same sources but for the tables given."""
        kept = {name: lambda name=name: getattr(self, name) for name in self.NAMES}
        return Sources(**kept | tables)
