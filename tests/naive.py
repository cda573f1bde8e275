"""Direct join-then-aggregate forms, to compare the rewritten operators with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairwise_interval(orders: DataFrame, cohort: DataFrame) -> DataFrame:
    """Every pair of executed order lines of a customer with different dates."""
    executed = orders.filter("executed_date is not null").join(cohort, "cust_id", "left_semi").select("cust_id", "executed_date")
    earlier = executed.withColumnRenamed("executed_date", "before")
    pairs = executed.join(earlier, "cust_id").filter("before < executed_date")
    means = pairs.groupBy("cust_id").agg(F.avg(F.datediff("executed_date", "before")).alias("m"))
    return means.agg(F.avg("m").alias("all_avg_time_interval"))


def decision_time(browsing: DataFrame, communication: DataFrame, cap: int = 16) -> DataFrame:
    """Every view of a customer against every contact."""
    views = browsing.select("cust_id", "create_date", "operate_date", "browsing_flag")
    pairs = views.join(communication.select("cust_id", "comm_date", "comm_flag"), "cust_id", "left")
    first = F.least(F.coalesce("operate_date", "create_date"), F.coalesce("comm_date", "create_date"))
    highest = F.greatest(F.max("browsing_flag"), F.max("comm_flag"))
    days = F.max(F.datediff("create_date", first)) + 1
    return pairs.groupBy("cust_id").agg(F.when(highest == 2, cap).when(highest == 1, days).otherwise(0).alias("decision_time"))


def browsing_counts(facts: DataFrame, vacation: str) -> DataFrame:
    """Some of the browsing measures from the row-level facts."""
    is_vacation = F.col("producttype_class_name") == vacation
    return (
        facts.filter("browsing_flag = 1")
        .groupBy("cust_id")
        .agg(
            F.count_distinct("operate_date").alias("browsing_days"),
            F.count("visitor_trace").alias("pv"),
            F.sum("residence_time").alias("browsing_time"),
            F.count_distinct("product_id").alias("browsing_products_cnt"),
            F.count_distinct(F.when(is_vacation, F.col("product_id"))).alias("browsing_vac_prd_cnt"),
            F.count_distinct(F.when(F.col("collect_coupons_status") == 1, F.col("operate_date"))).alias("collect_coupons_cnt"),
            F.round(F.avg(F.when(is_vacation, F.col("lowest_price"))), 3).alias("vac_price"),
            F.round(F.avg("f_satisfaction"), 3).alias("satisfaction"),
            F.max("f_comp_grade_level").alias("grade"),
        )
    )
