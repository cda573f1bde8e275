"""Row counts and sums recorded for the test tables before anything was built."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from tidemark.config import training_config
from tidemark.operators import orders
from tidemark.plans.registry import FEATURE_QUERIES, Run

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("folder", "query", "rows"),
    [
        (SMALL, "activity_union", 492),
        (MIDDLE, "activity_union", 3026),
        (SMALL, "last_activity_cohort", 130),
        (MIDDLE, "last_activity_cohort", 127),
        (SMALL, "snapshot_day_cohort", 9),
        (MIDDLE, "snapshot_day_cohort", 95),
    ],
)
def test_rows(spark, folder, query, rows):
    assert FEATURE_QUERIES[query](spark, folder).count() == rows


@pytest.mark.parametrize(
    ("folder", "sums", "later", "orders_executed", "interval"),
    [(SMALL, (1, 3, 3, 5), (9, 11, 26), 21, 689.0498), (MIDDLE, (1, 2, 1, 1), (3, 7, 17), 15, 681.3685)],
)
def test_order_measures(spark, folder, sums, later, orders_executed, interval):
    run = Run(spark, folder, replace(training_config(), label_orders_since=None))
    cohort = run.cohort.persist()
    kept = orders.effective_orders(run.src.label_orders, None, run.cfg.distribution_flags)
    flags = orders.future_window_flags(cohort, kept, run.classes, run.cfg)
    assert tuple(flags.agg(*[F.sum(c) for c in flags.columns[2:]]).first()) == sums
    far = orders.future_window_flags(cohort, kept, run.classes, run.cfg, horizons=(60, 90, 180))
    assert tuple(far.agg(*[F.sum(f"executed_flag_{d}") for d in (60, 90, 180)]).first()) == later
    history = orders.trailing_order_features(cohort, kept, run.classes, run.cfg)
    assert history.agg(F.sum("executed_orders_cnt")).first()[0] == orders_executed
    assert round(orders.pairwise_interval(kept, cohort).first()[0], 4) == interval
    cohort.unpersist()
