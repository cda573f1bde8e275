"""Customer attributes as of the anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig, Vocabulary
from tidemark.functions.expr import or_zero
from tidemark.functions.joins import keep_members, not_broadcast
from tidemark.sources.model import Sources

ATTRIBUTES = ("cust_level", "cust_type", "cust_group_type", "is_office_weixin")


def eav_pivot(eav: DataFrame, attributes: dict[str, tuple[str, str]]) -> DataFrame:
    """Attributes as columns, in one scan: {attribute: (value column, output column)}.

    Of several values of one (user, attribute) the largest is shown, so that a user stays one row;
    `repeated_attributes` lists these users. Calls are joined by every phone a user has, not by this column.
    """
    picked = [
        F.max(F.when(F.col("three_class_name") == name, F.col(value))).alias(out)
        for name, (value, out) in attributes.items()
    ]
    return eav.filter(F.col("three_class_name").isin(*attributes)).groupBy("user_id").agg(*picked)


def repeated_attributes(eav: DataFrame) -> DataFrame:
    """(user_id, three_class_name, n) stored more than once: where one row per user and every value differ."""
    counts = eav.groupBy("user_id", "three_class_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > 1)


def personal_attributes(eav: DataFrame, words: Vocabulary) -> DataFrame:
    """user_id, sex, age, age_group, tel_num."""
    return eav_pivot(
        eav,
        {
            words.sex_name: ("feature_name", "sex"),
            words.age_name: ("feature_value", "age"),
            words.age_group_name: ("feature_name", "age_group"),
            words.phone_name: ("feature_value", "tel_num"),
        },
    )


def personal_attribute_rows(users: DataFrame, eav: DataFrame, words: Vocabulary) -> DataFrame:
    """user_id, sex, age, age_group, tel_num with every stored value: a user with several values has a row for each combination.

    `users` (user_id) all have a row; an attribute that is not stored is null.
    """
    rows = users
    for name, value, out in (
        (words.sex_name, "feature_name", "sex"),
        (words.age_name, "feature_value", "age"),
        (words.age_group_name, "feature_name", "age_group"),
        (words.phone_name, "feature_value", "tel_num"),
    ):
        rows = rows.join(eav.filter(F.col("three_class_name") == name).select("user_id", F.col(value).alias(out)), "user_id", "left")
    return rows


def _days_since(day: Column, anchor: Column) -> Column:
    return F.when(anchor > day, F.datediff(anchor, day) + 1).otherwise(0)


def tenure(cohort: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attribute columns, days since registration and days since the contact-app link."""
    anchor = F.col("create_date")
    return cohort.join(attributes, "cust_id", "left").select(
        "cust_id",
        "create_date",
        *ATTRIBUTES,
        _days_since(F.col("rg_time"), anchor).alias("rg_time"),
        _days_since(F.col("office_weixin_time"), anchor).alias("office_weixin_time"),
    )


def geography(city_eav: DataFrame, city_key: DataFrame, words: Vocabulary) -> DataFrame:
    """user_id, user_city, user_province; the province is null for an unknown city."""
    homes = city_eav.filter(F.col("three_class_name") == words.city_name).select(
        "user_id", F.col("feature_name").alias("user_city"), F.col("feature_value").alias("city_key")
    )
    provinces = city_key.select("city_key", F.col("parent_province_name").alias("user_province"))
    return homes.join(provinces, "city_key", "left").select("user_id", "user_city", "user_province")


def reachable_channels(access: DataFrame) -> DataFrame:
    """Number and sorted names of the channels a user can be reached by."""
    return (
        access.filter(F.col("feature_value") == 1)
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("access_channel_cnt"),
            F.concat_ws(",", F.sort_array(F.collect_set("three_class_name"))).alias("access_channels"),
        )
    )


def customer_profile(cohort: DataFrame, src: Sources, cfg: FeatureConfig) -> DataFrame:
    """The cohort with all profile columns. Other users are dropped before any aggregation.

    One row per customer; with `cfg.every_attribute_value` one for each combination of the values that are stored
    of the personal attributes and the city, as joins of the attribute table give them.
    """

    def own(rows: DataFrame) -> DataFrame:
        return keep_members(rows, cohort, "user_id")

    def by_customer(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("user_id", "cust_id")

    if cfg.every_attribute_value:
        users = cohort.select(F.col("cust_id").alias("user_id"))
        personal = personal_attribute_rows(users, own(src.feature_eav), cfg.words)
    else:
        personal = personal_attributes(own(src.feature_eav), cfg.words)
    joined = (
        tenure(cohort, src.cust_attribute)
        .join(not_broadcast(by_customer(personal)), "cust_id", "left")
        .join(not_broadcast(by_customer(geography(own(src.city_eav), src.city_key, cfg.words))), "cust_id", "left")
        .join(not_broadcast(by_customer(reachable_channels(own(src.access_channel)))), "cust_id", "left")
    )
    return joined.select(
        "cust_id",
        "create_date",
        *ATTRIBUTES,
        "rg_time",
        "office_weixin_time",
        "sex",
        "age",
        "age_group",
        "tel_num",
        "user_city",
        "user_province",
        or_zero(F.col("access_channel_cnt")).alias("access_channel_cnt"),
        "access_channels",
    )
