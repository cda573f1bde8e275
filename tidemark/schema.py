"""The 70 columns of the feature table, in file order, and their modelling roles."""

from __future__ import annotations

from pyspark.sql import types as T

from tidemark.operators.behavior import BROWSING, COMMUNICATION
from tidemark.operators.orders import HISTORY

# The names and the order of the columns.
LABELS = ("executed_flag_7", "executed_flag_15", "ordered_flag_7", "ordered_flag_15")
PROFILE = (
    "cust_level",
    "cust_type",
    "cust_group_type",
    "is_office_weixin",
    "rg_time",
    "office_weixin_time",
    "sex",
    "age",
    "age_group",
    "access_channel_cnt",
)
COLUMNS = ("cust_id", "create_date", *LABELS, *PROFILE, *HISTORY, "decision_time", *BROWSING, *COMMUNICATION)

_MONEY = T.DecimalType(18, 2)
_EXACT = {
    "create_date": T.DateType(),
    "sex": T.StringType(),
    "age_group": T.StringType(),
    "cp_min": _MONEY,
    "cp_max": _MONEY,
}
_DOUBLES = (
    "cp_avg",
    "satisfaction_avg",
    "vac_cp_avg",
    "vac_satisfaction_avg",
    "lowest_price_avg",
    "vac_lowest_price_avg",
    "prd_satisfaction",
    "prd_remark_amount",
    "prd_essence_amount",
    "prd_coupon_amount",
    "prd_money_amount",
    "prd_photo_amount",
    "call_completing_rate",
)


def column_type(name: str) -> T.DataType:
    if name in _EXACT:
        return _EXACT[name]
    if name in _DOUBLES or name.endswith(("_daily_avg", "_pct")):
        return T.DoubleType()
    return T.LongType()


FEATURE_SCHEMA = T.StructType([T.StructField(name, column_type(name)) for name in COLUMNS])

CATEGORICAL = (
    "cust_level",
    "cust_type",
    "cust_group_type",
    "is_office_weixin",
    "sex",
    "age_group",
    "prd_comp_grade_level",
)
IMPUTED = ("age", "satisfaction_avg", "vac_satisfaction_avg", "lowest_price_avg", "vac_lowest_price_avg", "prd_satisfaction")
NUMERIC = tuple(c for c in COLUMNS[6:] if c not in CATEGORICAL)
KEYS = COLUMNS[:6]
