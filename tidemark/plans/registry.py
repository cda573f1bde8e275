"""One callable per job, each over the whole test tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig, scoring_config, training_config
from tidemark.functions.expr import or_zero, search_intent
from tidemark.functions.joins import keep_member_groups, keep_members
from tidemark.functions.staging import new_path
from tidemark.functions.words import mentions
from tidemark.operators import activity, behavior, browsing, cohort, communication, orders, profile
from tidemark.plans import feature_table as features
from tidemark.schema import FEATURE_SCHEMA
from tidemark.sources.model import Sources
from tidemark.sources.sink import read_table, write_table
from tidemark.sources.standin import standin_sources
from tidemark.sources.textfile import read_text, write_text

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Run:
    """Sources and cohort of one configuration on one folder."""

    spark: SparkSession
    folder: str
    cfg: FeatureConfig
    second_phones: bool = False

    @cached_property
    def src(self) -> Sources:
        return standin_sources(self.spark, self.folder, self.cfg, self.second_phones)

    @cached_property
    def whole(self) -> Sources:
        """The sources without the run's windows."""
        return standin_sources(self.spark, self.folder)

    @cached_property
    def cohort(self) -> DataFrame:
        """Written once: its six channels are not scanned again by each step that uses it."""
        return features.staged_cohort(self.src, self.cfg)

    @property
    def classes(self) -> DataFrame:
        return orders.product_classes(self.src.route_dim, self.cfg.words)

    @cached_property
    def product_days(self) -> DataFrame:
        return browsing.product_day_views(self.cohort, self.src, self.cfg)

    @cached_property
    def contact_days(self) -> DataFrame:
        return communication.communication_days(self.cohort, self.src, self.cfg)

    @property
    def coupons(self) -> DataFrame:
        return browsing.coupon_days(self.src.coupons, self.cfg.behavior_start, self.cfg.behavior_end)

    def page_views(self) -> DataFrame:
        return browsing.traffic_union(self.cohort, self.src, self.cfg)


def _integers(df: DataFrame) -> DataFrame:
    """All whole-number columns as bigint, the type the checks compare."""
    short = [f.name for f in df.schema if f.dataType.simpleString() in ("int", "smallint", "tinyint")]
    return df.withColumns({name: F.col(name).cast("bigint") for name in short}) if short else df


def _training(build: Callable[[Run], DataFrame]) -> Query:
    return lambda spark, folder: _integers(build(Run(spark, folder, training_config())))


def _scoring(build: Callable[[Run], DataFrame]) -> Query:
    return lambda spark, folder: _integers(build(Run(spark, folder, scoring_config())))


def activity_union(run: Run) -> DataFrame:
    return cohort.channel_union(cohort.activity_branches(run.src, run.cfg))


def phone_attribution(run: Run) -> DataFrame:
    return cohort.attribute_by_phone(run.whole.calls, cohort.phones(run.whole.feature_eav, run.cfg.words.phone_name))


def effective_orders(run: Run) -> DataFrame:
    kept = orders.effective_orders(run.src.label_orders, run.cfg.label_orders_since, run.cfg.distribution_flags)
    return kept.select(
        "cust_id", "order_id", "route_id", "book_city", "create_time", "executed_date", "travel_sign_amount"
    )


def history_features(run: Run) -> DataFrame:
    table = features.history_table(run.cohort, run.src, run.cfg)
    return table.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("cp_min", "cp_max")})


def pairwise_order_interval(run: Run) -> DataFrame:
    executed = orders.effective_orders(run.src.history_orders, run.cfg.interval_orders_since, run.cfg.distribution_flags)
    mean = orders.pairwise_interval(executed, run.cohort)
    return mean.select(F.round("all_avg_time_interval", 6).alias("all_avg_time_interval"))


def tenure_days(run: Run) -> DataFrame:
    return profile.tenure(run.cohort, run.src.cust_attribute).select(
        "cust_id", "create_date", "rg_time", "office_weixin_time"
    )


def reachable_channels(run: Run) -> DataFrame:
    own = keep_members(run.src.access_channel, run.cohort, "user_id")
    found = profile.reachable_channels(own).withColumnRenamed("user_id", "cust_id")
    return run.cohort.join(found, "cust_id", "left").select(
        "cust_id", or_zero(F.col("access_channel_cnt")).alias("access_channel_cnt"), "access_channels"
    )


def searches(run: Run) -> DataFrame:
    (single,) = mentions(F.col("search_key"), [run.cfg.words.single_search_words])
    intent = search_intent(F.col("search_key"), single)
    views = run.whole.app_traffic.unionByName(run.whole.web_traffic)
    return views.select("visitor_trace", "search_key", intent.alias("search_key_type"))


def latest_product_rating(run: Run) -> DataFrame:
    return browsing.latest_product_rating(run.src.product_rating, run.cfg.rating_ties)


def coupon_day_match(run: Run) -> DataFrame:
    return browsing.coupon_match(run.page_views(), run.coupons)


def call_daily(run: Run) -> DataFrame:
    book = communication.cohort_phones(run.cohort, run.src, run.cfg)
    return communication.call_daily(run.src.calls, book, run.src.history_orders, run.classes, run.cfg)


def with_second_phones(run: Run) -> Run:
    """The same run on tables in which a customer may have two phones and a phone two customers; every value counts."""
    return replace(run, cfg=replace(run.cfg, every_attribute_value=True), second_phones=True)


def profile_every_value(run: Run) -> DataFrame:
    return profile.customer_profile(run.cohort, run.src, run.cfg)


def of_cohort(run: Run, daily: DataFrame) -> DataFrame:
    return keep_member_groups(daily, run.cohort, "cust_id")


def decision_time(run: Run) -> DataFrame:
    return behavior.decision_time(run.cohort, run.product_days, run.contact_days, run.cfg.decision_cap)


def decision_time_long(run: Run) -> DataFrame:
    """The same with a lookback of 30 days, where the cap is not reached by everyone."""
    return decision_time(replace(run, cfg=replace(run.cfg, lookback_days=30, decision_cap=31)))


def browsing_features(run: Run) -> DataFrame:
    return behavior.browsing_features(run.product_days, browsing.product_weights(run.src, run.cfg), run.coupons)


def behavior_features(run: Run) -> DataFrame:
    return features.behavior_table(run.cohort, run.src, run.cfg)


def incremental_cohort(run: Run) -> DataFrame:
    """All days but the last are in the store; the last one is merged, and the cohort read from the partials."""
    store, last = new_path(run.spark, "activity"), run.cfg.activity_end
    write_table(activity.activity_partial(run.src, run.cfg).filter(F.col(activity.DAY) < last), store, day=activity.DAY)
    newest = standin_sources(run.spark, run.folder, replace(run.cfg, activity_start=last, behavior_start=last))
    activity.store_days(store, [last], lambda day: newest, run.cfg)
    return activity.cohort_from_store(read_table(run.spark, store), run.src, run.cfg)


def feature_table(run: Run) -> DataFrame:
    """The table as it is put in place for its day."""
    table = new_path(run.spark, "features")
    features.write_feature_table(run.src, run.cfg, table)
    return features.read_feature_table(run.spark, table, run.cfg)


def feature_text_roundtrip(run: Run) -> DataFrame:
    path = new_path(run.spark, "feature_text")
    write_text(feature_table(run), path)
    return read_text(run.spark, path, FEATURE_SCHEMA)


FEATURE_QUERIES: dict[str, Query] = {
    "activity_union": _training(activity_union),
    "last_activity_cohort": _training(lambda run: run.cohort),
    "phone_attribution": _training(phone_attribution),
    "incremental_cohort": _training(incremental_cohort),
    "snapshot_day_cohort": _scoring(lambda run: run.cohort),
    "effective_orders": _training(effective_orders),
    "product_class_dim": _training(lambda run: run.classes),
    "future_window_labels": _training(lambda run: features.label_table(run.cohort, run.src, run.cfg)),
    "history_features": _training(history_features),
    "pairwise_order_interval": _training(pairwise_order_interval),
    "eav_pivot": _training(lambda run: profile.personal_attributes(run.src.feature_eav, run.cfg.words)),
    "tenure_days": _training(tenure_days),
    "geo_lookup": _training(lambda run: profile.geography(run.src.city_eav, run.src.city_key, run.cfg.words)),
    "reachable_channels": _training(reachable_channels),
    "customer_profile": _training(lambda run: profile.customer_profile(run.cohort, run.src, run.cfg)),
    "last_activity_cohort_second_phones": _training(lambda run: with_second_phones(run).cohort),
    "customer_profile_second_phones": _training(lambda run: profile_every_value(with_second_phones(run))),
    "call_daily_second_phones": _training(lambda run: call_daily(with_second_phones(run))),
    "search_intent": _training(searches),
    "traffic_union": _training(lambda run: run.page_views()),
    "latest_product_rating": _training(latest_product_rating),
    "coupon_day_match": _training(coupon_day_match),
    "browsing_facts": _training(lambda run: browsing.browsing_facts(run.cohort, run.src, run.cfg)),
    "call_daily": _training(call_daily),
    "robot_call_daily": _training(lambda run: of_cohort(run, communication.robot_call_daily(run.src.robot_calls, run.cfg))),
    "wecom_chat_daily": _training(lambda run: of_cohort(run, communication.wecom_chat_daily(run.src.wecom_chat, run.cfg))),
    "service_chat_daily": _training(
        lambda run: of_cohort(run, communication.service_chat_daily(run.src.service_chat, run.cfg))
    ),
    "communication_facts": _training(lambda run: communication.communication_facts(run.cohort, run.src, run.cfg)),
    "decision_time": _training(decision_time),
    "decision_time_long": _training(decision_time_long),
    "browsing_features": _training(browsing_features),
    "communication_features": _training(lambda run: behavior.communication_features(run.contact_days)),
    "behavior_features": _training(behavior_features),
    "training_table": _training(feature_table),
    "scoring_table": _scoring(feature_table),
    "feature_text_roundtrip": _training(feature_text_roundtrip),
}
