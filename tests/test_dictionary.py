"""Sparse vectors of many categories against plain dictionaries, and against the indicator columns."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F
from tidemark.functions.numbering import number_rows
from tidemark.operators.dictionary import fit_dictionary
from tidemark.operators.prep import fit_prep


@pytest.mark.parametrize("rows", [0, 1, 1000])
def test_numbers_are_consecutive_in_order(spark, rows):
    df = spark.range(rows).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b"))
    found = sorted((r["number"], r["a"], r["b"] is not None, r["b"] or 0) for r in number_rows(df, ["a", "b"], partitions=5).collect())
    assert [f[0] for f in found] == list(range(rows))
    assert [f[1:] for f in found] == sorted(f[1:] for f in found)


def test_a_hundred_thousand_categories(spark):
    """One value holds a third of the rows, a tenth has none."""
    n = 150_000
    value = F.when(F.col("id") % 3 == 0, "c7").when(F.col("id") % 10 != 1, F.concat(F.lit("c"), F.col("id")))
    rows = spark.range(n).select("id", value.alias("many"), (F.col("id") % 4).alias("few"), (F.col("id") / 2).alias("size"))
    names = {i: ("c7" if i % 3 == 0 else f"c{i}" if i % 10 != 1 else None, i % 4) for i in range(n)}
    dictionary = fit_dictionary(rows, ["few", "many"])
    many = sorted({m for m, _ in names.values() if m is not None})
    place = {m: 2 + i for i, m in enumerate(many)}
    assert dictionary.size == 3 + len(many) - 1 and len(many) > 85_000
    later = rows.filter("id % 1001 = 0").unionByName(spark.createDataFrame([(-1, "unseen", 9, 1.0)], rows.schema))
    found = {r["id"]: r["features"] for r in dictionary.vectors(later, ["size"], ["id"]).collect()}
    assert len(found) == later.count()
    for i, vector in found.items():
        m, few = names.get(i, (None, 0))
        want = {few - 1: 1.0} if few else {}
        want |= {place[m]: 1.0} if m is not None and m != many[0] else {}
        assert dict(zip(vector.indices.tolist(), vector.values.tolist())) == want | {dictionary.size: i / 2 if i >= 0 else 1.0}
        assert vector.size == dictionary.size + 1


def test_the_same_as_indicator_columns(spark):
    rows = spark.createDataFrame([(1, 0, None, 2), (2, 2, 3, 10), (3, 1, None, 9), (4, 2, 1, None)], "cust_id long, level long, grade long, city long")
    prep = fit_prep(rows, [], [], ["level", "grade", "city"], ["cust_id"])
    dense = {r["cust_id"]: [r[d] for d in prep.dummies] for r in prep.one_hot(rows).collect()}
    dictionary = fit_dictionary(rows, ["level", "grade", "city"])
    assert [f"{r['name']}_{r['value']}" for r in dictionary.table.orderBy("place").collect()] == list(prep.dummies)
    assert {r["cust_id"]: r["features"].toArray().tolist() for r in dictionary.vectors(rows, keys=["cust_id"]).collect()} == dense


def test_nothing_to_learn(spark):
    rows = spark.createDataFrame([(1, None)], "id long, c string")
    dictionary = fit_dictionary(rows, ["c"])
    assert dictionary.size == 0 and dictionary.vectors(rows, ["id"], ["id"]).first()["features"].toArray().tolist() == [1.0]
    assert dictionary.vectors(rows.filter("false"), ["id"], ["id"]).collect() == []


def test_vectors_fit_a_model(spark):
    rows = spark.range(400).select("id", F.concat(F.lit("c"), F.col("id") % 50).alias("c"), (F.col("id") % 50 < 20).cast("double").alias("label"))
    dictionary = fit_dictionary(rows, ["c"])
    table = dictionary.vectors(rows, keys=["id", "label"])
    model = LogisticRegression(maxIter=20).fit(table)
    assert model.transform(table).filter("label = prediction").count() >= 390
