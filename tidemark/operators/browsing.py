"""Page views of the cohort, with prices, classes, coupons and ratings.

`browsing_facts` is the row-level table. The features do not need it: `product_day_views` reduces the
views to (customer, day, product) before any join, and `product_weights` turns each product's price,
class and rating rows into one row whose weights carry the row counts the joins would have made.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig
from tidemark.functions.expr import or_zero, recency_flag, search_intent
from tidemark.functions.joins import keep_members, left_join_sparse_key, not_broadcast
from tidemark.functions.staging import Stage, stage
from tidemark.functions.words import mentions
from tidemark.operators.orders import CLASS, class_weights, product_classes
from tidemark.sources.model import Sources

VIEW = ["visitor_trace", "residence_time", "product_id", "book_id", "search_key"]
AMOUNTS = ("f_remark_amount", "f_essence_amount", "f_coupon_amount", "f_money_amount", "f_photo_amount")
RATING = ("f_satisfaction", "f_comp_grade_level", *AMOUNTS)


def _window_views(src: Sources, cfg: FeatureConfig) -> DataFrame:
    rows = src.app_traffic.unionByName(src.web_traffic)
    inside = rows.filter(F.col("op_date").between(cfg.behavior_start, cfg.behavior_end))
    return inside.select(F.col("vt_mapuid").alias("cust_id"), F.col("op_date").alias("operate_date"), *VIEW)


def _distinct_views(cohort: DataFrame, src: Sources, cfg: FeatureConfig) -> DataFrame:
    """Distinct page views of both sites by cohort customers in the window, with `search_key_type`.

    Views of other customers are dropped first; the rest is dealt by its columns and not by customer, so that a
    heavy customer is not one task.
    """
    spread = ["cust_id", "operate_date", *VIEW]
    views = keep_members(_window_views(src, cfg), cohort, "cust_id", spread).distinct()
    (single,) = mentions(F.col("search_key"), [cfg.words.single_search_words])
    return views.withColumn("search_key_type", search_intent(F.col("search_key"), single))


def traffic_union(cohort: DataFrame, src: Sources, cfg: FeatureConfig) -> DataFrame:
    """Distinct page views of the cohort, as a table of its own."""
    return _distinct_views(cohort, src, cfg)


def latest_product_rating(rating: DataFrame, ties: bool = True) -> DataFrame:
    """The rows of each product with its newest update time; ties are kept unless asked otherwise.

    The newest time is a combinable aggregate and the rows join back on (product, time), so a product
    with very many updates is never sorted in one task.
    """
    key, time = "f_product_id", "f_update_time"
    dated = rating.filter(F.col(time).isNotNull())
    if ties:
        newest = dated.groupBy(key).agg(F.max(time).alias(time))
        rows = dated.join(newest, [key, time])
    else:
        rest = [c for c in rating.columns if c not in (key, time)]
        best = dated.groupBy(key).agg(F.max(F.struct(time, *rest)).alias("r"))
        rows = best.select(key, f"r.{time}", *[f"r.{c}" for c in rest])
    scaled = (F.col("f_satisfaction") / F.lit(1000000.0)).alias("f_satisfaction")
    return rows.select(key, scaled, *RATING[1:])


def coupon_days(coupons: DataFrame, start: date, end: date) -> DataFrame:
    """Distinct (cust_id, operate_date) with a successfully collected coupon."""
    taken = coupons.filter((F.col("collect_coupons_status") == 1) & F.col("op_date").between(start, end))
    return taken.select("cust_id", F.col("op_date").alias("operate_date")).distinct()


def coupon_match(views: DataFrame, days: DataFrame) -> DataFrame:
    """Views with `collect_coupons_status`: 1 when the customer took a coupon that day."""
    flagged = days.withColumn("collect_coupons_status", F.lit(1))
    joined = views.join(not_broadcast(flagged), ["cust_id", "operate_date"], "left")
    return joined.withColumn("collect_coupons_status", or_zero(F.col("collect_coupons_status")))


def browsing_facts(cohort: DataFrame, src: Sources, cfg: FeatureConfig, keep: Stage = stage) -> DataFrame:
    """Cohort x page views x price x class x coupon x rating; customers without views keep one row.

    Classes join by route only, so a route with two classes doubles its views, unless
    `cfg.one_class_per_route` asks for one row per route; so do tied ratings, unless `cfg.rating_ties` is False.
    """
    # Views are the large side: an inner join lets a heavy customer be split, the others are added after. They are
    # written once, so that each site is scanned once.
    views = keep(_distinct_views(cohort, src, cfg).join(cohort, "cust_id"), "views")
    flagged = coupon_match(views, coupon_days(src.coupons, cfg.behavior_start, cfg.behavior_end))
    prices = src.prd_route.select(F.col("route_id").alias("product_id"), "lowest_price").distinct()
    ratings = latest_product_rating(src.product_rating, cfg.rating_ties).withColumnRenamed("f_product_id", "product_id")
    klass = _route_classes(src, cfg).withColumnRenamed("route_id", "product_id")
    # The sides join each other first, so the views move once. A side without the product adds nulls.
    products = prices.join(klass, "product_id", "full").join(ratings, "product_id", "full")
    described = left_join_sparse_key(flagged, products, "product_id")
    anchor, day = F.col("create_date"), F.col("operate_date")
    viewers = views.select("cust_id").distinct()
    rows = described.unionByName(cohort.join(viewers, "cust_id", "left_anti"), allowMissingColumns=True)
    return rows.select(
        "cust_id",
        "create_date",
        "operate_date",
        recency_flag(day, anchor, cfg.lookback_days).alias("browsing_flag"),
        *VIEW,
        "search_key_type",
        "lowest_price",
        CLASS,
        or_zero(F.col("collect_coupons_status")).alias("collect_coupons_status"),
        *RATING,
    )


def _route_classes(src: Sources, cfg: FeatureConfig) -> DataFrame:
    """(route_id, class); one class per route when the config asks for it."""
    classes = product_classes(src.route_dim, cfg.words, by_city=False)
    if cfg.one_class_per_route:
        return classes.groupBy("route_id").agg(F.max(CLASS).alias(CLASS))
    return classes


def product_day_views(cohort: DataFrame, src: Sources, cfg: FeatureConfig) -> DataFrame:
    """Views per (customer, day, product) with the anchor and `browsing_flag`."""
    daily = _distinct_views(cohort, src, cfg).groupBy("cust_id", "operate_date", "product_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("visitor_trace").alias("traces"),
        F.count("book_id").alias("bookings"),
        F.count("search_key").alias("searches"),
        F.sum("search_key_type").alias("vacation_searches"),
        F.sum("residence_time").alias("time"),
        F.max("residence_time").alias("time_max"),
    )
    flag = recency_flag(F.col("operate_date"), F.col("create_date"), cfg.lookback_days)
    return daily.join(cohort, "cust_id").withColumn("browsing_flag", flag)


def _at_least_one(count: Column) -> Column:
    return F.greatest(F.coalesce(count, F.lit(0)), F.lit(1))


def _rating_weights(rating: DataFrame, ties: bool = True) -> DataFrame:
    """One row per product: counts and sums over the rows with the newest time (or one of them), without a join."""
    if not ties:
        rest = [c for c in rating.columns if c not in ("f_product_id", "f_update_time")]
        dated = rating.filter(F.col("f_update_time").isNotNull()).groupBy("f_product_id")
        rating = dated.agg(F.max(F.struct("f_update_time", *rest)).alias("r")).select("f_product_id", "r.*")
    per_time = [F.count(F.lit(1)).alias("n_ratings"), F.max("f_comp_grade_level").alias("grade")]
    for column in ("f_satisfaction", *AMOUNTS):
        per_time += [F.sum(column).alias(f"{column}_sum"), F.count(column).alias(f"{column}_n")]
    grouped = (
        rating.filter(F.col("f_update_time").isNotNull()).groupBy("f_product_id", "f_update_time").agg(*per_time)
    )
    measures = [c for c in grouped.columns if c not in ("f_product_id", "f_update_time")]
    newest = grouped.groupBy("f_product_id").agg(F.max_by(F.struct(*measures), "f_update_time").alias("r"))
    return newest.select(F.col("f_product_id").alias("product_id"), *[f"r.{c}" for c in measures])


def product_weights(src: Sources, cfg: FeatureConfig) -> DataFrame:
    """One row per product: how many joined rows a view of it becomes, and the sums over those rows."""
    prices = (
        src.prd_route.select(F.col("route_id").alias("product_id"), "lowest_price")
        .distinct()
        .groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("n_prices"),
            F.sum("lowest_price").alias("price_sum"),
            F.count("lowest_price").alias("price_n"),
        )
    )
    classes = class_weights(_route_classes(src, cfg), cfg.words, ["route_id"]).withColumnRenamed(
        "route_id", "product_id"
    )
    ratings = _rating_weights(src.product_rating, cfg.rating_ties)
    # Route ids that are null in a dimension can match no view.
    sides = [side.filter(F.col("product_id").isNotNull()) for side in (prices, classes, ratings)]
    joined = sides[0].join(sides[1], "product_id", "full").join(sides[2], "product_id", "full")

    by_price, by_class, by_rating = (_at_least_one(F.col(c)) for c in ("n_prices", "n_classes", "n_ratings"))
    sums = []
    for column in ("f_satisfaction", *AMOUNTS):
        for suffix in ("sum", "n"):
            name = f"{column}_{suffix}"
            sums.append((or_zero(F.col(name)) * by_price * by_class).alias(name))
    return joined.select(
        "product_id",
        (by_price * by_class * by_rating).alias("weight"),
        (F.col("price_sum") * by_class * by_rating).alias("price_sum"),
        (or_zero(F.col("price_n")) * by_class * by_rating).alias("price_n"),
        (F.col("price_sum") * or_zero(F.col("n_vacation")) * by_rating).alias("vac_price_sum"),
        (or_zero(F.col("price_n")) * or_zero(F.col("n_vacation")) * by_rating).alias("vac_price_n"),
        (or_zero(F.col("n_vacation")) > 0).alias("is_vacation"),
        (or_zero(F.col("n_single")) > 0).alias("is_single"),
        "grade",
        *sums,
    )
