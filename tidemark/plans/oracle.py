"""The SQL each registered job is checked against."""

from __future__ import annotations

from dataclasses import replace

from tidemark.config import scoring_config, training_config
from tidemark.operators.behavior import BROWSING, COMMUNICATION
from tidemark.operators.communication import MEASURES
from tidemark.plans.check_sql import SECOND_PHONES, compose, typed
from tidemark.schema import COLUMNS

_DAILY = ", ".join(f"cast({m} as bigint) as {m}" for m in MEASURES)
_RATING = (
    "f_satisfaction, f_comp_grade_level, f_remark_amount, f_essence_amount, f_coupon_amount, f_money_amount, f_photo_amount"
)
_VIEW = (
    "cust_id, operate_date, visitor_trace, residence_time, product_id, book_id, search_key, "
    "cast(search_key_type as bigint) as search_key_type"
)
_LABELS = ", ".join(f"cast({n}_flag_{d} as bigint) as {n}_flag_{d}" for n in ("executed", "ordered") for d in (7, 15))


def _daily(table: str) -> str:
    return f"select cust_id, comm_date, {_DAILY} from {table} semi join cohort using (cust_id)"


def _typed(names: tuple[str, ...]) -> str:
    return ", ".join(typed(name) for name in names)


# The age of a 70-column row is already typed in `features`.
_FEATURES = f"select {', '.join(COLUMNS)} from features"

_TRAINING = {
    "activity_union": "select cust_id, create_date from activity",
    "last_activity_cohort": "select cust_id, create_date from cohort",
    "incremental_cohort": "select cust_id, create_date from cohort",
    "phone_attribution": """
        select tel_num, cust_tel_no, call_date, status_time, status, calldir, order_id,
               cast(tel_order_type as bigint) as tel_order_type, user_id from attributed_calls""",
    "effective_orders": """
        select cust_id, order_id, route_id, cast(book_city as bigint) as book_city, create_time, executed_date,
               travel_sign_amount from executed_lines where create_time >= {label_orders_since}""",
    "product_class_dim": """
        select route_id, cast(book_city as bigint) as book_city, class as producttype_class_name from city_class""",
    "future_window_labels": f"select cust_id, create_date, {_LABELS} from labels_all",
    "history_features": f"""
        select cust_id, {_typed(('executed_orders_cnt', 'complaint_orders_cnt', 'cp_avg', 'cp_min', 'cp_max',
        'satisfaction_avg', 'vac_executed_cnt', 'vac_cp_avg', 'vac_satisfaction_avg'))} from history""",
    "pairwise_order_interval": "select round(avg(gap), 6) as all_avg_time_interval from interval_pairs",
    "eav_pivot": "select user_id, sex, age, age_group, tel_num from personal",
    "tenure_days": f"select cust_id, create_date, {_typed(('rg_time', 'office_weixin_time'))} from tenure",
    "geo_lookup": "select user_id, user_city, user_province from geo",
    "reachable_channels": """
        select cust_id, cast(coalesce(access_channel_cnt, 0) as bigint) as access_channel_cnt, access_channels
        from cohort left join reachable on user_id = cust_id""",
    "customer_profile": f"""
        select cust_id, create_date, cust_level, cust_type, cust_group_type, is_office_weixin,
               {_typed(('rg_time', 'office_weixin_time'))}, sex, age, age_group, tel_num, user_city, user_province,
               cast(access_channel_cnt as bigint) as access_channel_cnt, access_channels from profile""",
    "search_intent": """
        select visitor_trace, search_key,
               cast(case when regexp_matches(search_key, 'ticket|hotel') then 0
                         when coalesce(lower(search_key), 'null') = 'null' then null else 1 end as bigint) as search_key_type
        from s_traffic""",
    "traffic_union": f"select {_VIEW} from page_views",
    "latest_product_rating": f"select f_product_id, {_RATING} from newest_rating",
    "coupon_day_match": f"""
        select {_VIEW}, cast((cust_id, operate_date) in (select (cust_id, operate_date) from coupon_days) as bigint)
               as collect_coupons_status from page_views""",
    "browsing_facts": f"""
        select {_VIEW}, create_date, cast(browsing_flag as bigint) as browsing_flag, lowest_price,
               producttype_class_name, cast(collect_coupons_status as bigint) as collect_coupons_status, {_RATING}
        from browse_rows""",
    "call_daily": f"select cust_id, comm_date, {_DAILY} from calls_by_day",
    "robot_call_daily": _daily("robot_by_day"),
    "wecom_chat_daily": _daily("wecom_by_day"),
    "service_chat_daily": _daily("service_by_day"),
    "communication_facts": f"""
        select cust_id, create_date, comm_date, cast(comm_flag as bigint) as comm_flag, channel,
               cast(channel_id as bigint) as channel_id, {_DAILY} from comm_rows""",
    "decision_time": f"select cust_id, {typed('decision_time')} from decision",
    "decision_time_long": f"select cust_id, {typed('decision_time')} from decision",
    "browsing_features": f"select cust_id, {_typed(BROWSING)} from browsing",
    "communication_features": f"select cust_id, {_typed(COMMUNICATION)} from communication",
    "behavior_features": "select * from behavior",
    "training_table": _FEATURES,
    "feature_text_roundtrip": _FEATURES,
}

_SCORING = {
    "snapshot_day_cohort": "select cust_id, create_date from cohort",
    "scoring_table": _FEATURES,
}


def feature_sql() -> dict[str, str]:
    training, scoring = training_config(), scoring_config()
    long = replace(training, lookback_days=30, decision_cap=31)
    sql = {name: compose(text, long if name == "decision_time_long" else training) for name, text in _TRAINING.items()}
    for name in ("last_activity_cohort", "customer_profile", "call_daily"):
        sql[f"{name}_second_phones"] = compose(_TRAINING[name], training, SECOND_PHONES)
    return sql | {name: compose(text, scoring) for name, text in _SCORING.items()}
