"""The reduced forms give what the plain joins give."""

from dataclasses import replace

import naive
import pytest
from pyspark.sql import functions as F
from tidemark.config import training_config
from tidemark.operators import behavior, browsing, communication, orders
from tidemark.plans.registry import Run

FOLDER = "/root/testdata/sf0.01"


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    assert left.select(columns).exceptAll(right.select(columns)).isEmpty()
    assert right.select(columns).exceptAll(left.select(columns)).isEmpty()


@pytest.fixture(scope="module")
def run(spark):
    return Run(spark, FOLDER, training_config())


def test_interval(run):
    kept = orders.effective_orders(run.src.history_orders, None, run.cfg.distribution_flags)
    fast, slow = (f(kept, run.cohort).first()[0] for f in (orders.pairwise_interval, naive.pairwise_interval))
    assert abs(fast - slow) < 1e-9


@pytest.mark.parametrize(("lookback", "cap"), [(15, 16), (30, 31)])
def test_decision_time(run, lookback, cap):
    cfg = replace(run.cfg, lookback_days=lookback, decision_cap=cap)
    facts = browsing.browsing_facts(run.cohort, run.src, cfg)
    contacts = communication.communication_facts(run.cohort, run.src, cfg)
    fast = behavior.decision_time(
        run.cohort,
        browsing.product_day_views(run.cohort, run.src, cfg),
        communication.communication_days(run.cohort, run.src, cfg),
        cap,
    )
    same(fast, naive.decision_time(facts, contacts, cap))


def test_browsing_measures(run):
    facts = browsing.browsing_facts(run.cohort, run.src, run.cfg)
    slow = naive.browsing_counts(facts, run.cfg.words.vacation)
    table = behavior.browsing_features(run.product_days, browsing.product_weights(run.src, run.cfg), run.coupons)
    fast = table.select(
        "cust_id", "browsing_days", "pv", "browsing_time", "browsing_products_cnt", "browsing_vac_prd_cnt",
        "collect_coupons_cnt", F.round("vac_lowest_price_avg", 3).alias("vac_price"),
        F.round("prd_satisfaction", 3).alias("satisfaction"), F.col("prd_comp_grade_level").alias("grade"),
    )
    joined = fast.alias("f").join(slow.alias("s"), "cust_id", "full")
    exact = [c for c in slow.columns if c not in ("cust_id", "vac_price", "satisfaction")]
    for name in exact:
        assert joined.filter(~F.col(f"f.{name}").eqNullSafe(F.col(f"s.{name}"))).isEmpty(), name
    for name in ("vac_price", "satisfaction"):
        assert joined.filter(F.abs(F.col(f"f.{name}") - F.col(f"s.{name}")) > 0.0011).isEmpty(), name
