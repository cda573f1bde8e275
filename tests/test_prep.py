"""Fitted preparation on hand-made rows."""

import pytest
from pyspark.sql import functions as F
from tidemark.config import WAREHOUSE_WORDS
from tidemark.operators.prep import encode_ordinals, fit_prep, label_distribution

SCHEMA = "cust_id long, label long, level long, grade long, age long, flat double, empty double, size double"
ROWS = [
    (1, 0, 0, None, 20, 0.1, None, 1.0),
    (2, 0, 2, 3, None, 0.1, None, 2.0),
    (3, 1, 1, None, 40, 0.1, None, 3.0),
    (4, 0, 2, 1, 30, 0.1, None, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def prep(rows):
    return fit_prep(rows, ["age", "flat", "empty", "size"], ["age", "empty"], ["level", "grade"], ["cust_id", "label"])


def test_smallest_category_is_the_baseline(prep, rows):
    table = {r["cust_id"]: r for r in prep.one_hot(rows).collect()}
    assert list(prep.dummies) == ["level_1", "level_2", "grade_3"]
    assert [tuple(table[i][d] for d in prep.dummies) for i in (1, 2, 3, 4)] == [(0, 0, 0), (0, 1, 1), (1, 0, 0), (0, 1, 0)]


def test_unseen_category_is_all_zero(prep, spark):
    later = spark.createDataFrame([(9, 0, 7, 9, 1, 0.1, None, 1.0)], SCHEMA)
    assert set(prep.one_hot(later).drop("cust_id", "label").first()) == {0}


def test_declared_categories(rows):
    prep = fit_prep(rows, ["size"], [], ["level"], ["cust_id"], declared={"level": (0, 1, 2, 3)})
    assert list(prep.dummies) == ["level_1", "level_2", "level_3"]


def test_scaling(prep, rows):
    table = {r["cust_id"]: r for r in prep.standardize(rows).collect()}
    # age becomes 20, 30, 40, 30: mean 30, population deviation sqrt(50)
    assert [round(table[i]["age"], 6) for i in (1, 2, 3, 4)] == [-1.414214, 0, 1.414214, 0]
    assert {table[i]["flat"] for i in table} == {0.0}
    assert {table[i]["empty"] for i in table} == {None}
    assert table[4]["size"] is None and round(table[1]["size"], 6) == -1.224745


def test_matrix_has_no_nulls_and_equals_the_stage(prep, rows):
    matrix = prep.transform_matrix(rows)
    staged = prep.as_stage(["cust_id", "label"]).transform(rows)
    assert matrix.columns == staged.columns
    assert matrix.exceptAll(staged).isEmpty()
    assert matrix.filter(" or ".join(f"`{c}` is null" for c in matrix.columns)).isEmpty()


def test_any_number_of_categories(spark):
    many = spark.range(5000).select("id", F.col("id").alias("level"), F.col("id").cast("double").alias("size"))
    assert len(fit_prep(many, ["size"], [], ["level"], ["id"]).dummies) == 4999
    with pytest.raises(ValueError, match="categories"):
        fit_prep(many, ["size"], [], ["level"], ["id"], max_categories=1000)


def test_ordinals_and_distribution(spark, rows):
    people = spark.createDataFrame([("男", "26~35岁"), ("女", "大于46岁"), ("x", None)], "sex string, age_group string")
    assert [tuple(r) for r in encode_ordinals(people, WAREHOUSE_WORDS).collect()] == [(1, 3), (0, 5), (None, None)]
    assert tuple(label_distribution(rows, "label").first()) == (3, 1, 3.0)
