"""Replacing tables: what is lost on the way leaves the old rows, and a day leaves the others alone."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F
from tidemark.config import training_config
from tidemark.plans import feature_table as features
from tidemark.sources.sink import WriteCheckError, places, read_table, unused_writes, write_table
from tidemark.sources.standin import standin_sources

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def name(spark):
    made = "default.sink_test"
    yield made
    spark.sql(f"drop table if exists {made}")


def days(spark, *rows):
    return spark.createDataFrame([(k, v, date(2023, 7, d)) for k, v, d in rows], "k long, v string, day date")


def rows(spark, target):
    return sorted((r["k"], r["v"], r["day"].day) for r in read_table(spark, target).collect())


def broken(df):
    """Rows of which the last one fails while it is written."""
    return df.withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("executor lost")).cast("string")).otherwise(F.col("v")))


@pytest.mark.parametrize("kind", ["table", "folder"])
def test_a_day_is_replaced_alone(spark, tmp_path, name, kind):
    target = name if kind == "table" else f"{tmp_path}/folder"
    write_table(days(spark, (1, "a", 1), (2, "b", 1), (1, "c", 2)), target, day="day", keys=["k"], root=str(tmp_path))
    files = {r[0]: r[1] for r in read_table(spark, target).select("day", F.input_file_name()).distinct().collect()}
    write_table(days(spark, (5, "new", 2), (6, "new", 3)), target, day="day", keys=["k"], root=str(tmp_path))
    assert rows(spark, target) == [(1, "a", 1), (2, "b", 1), (5, "new", 2), (6, "new", 3)]
    after = {r[0]: r[1] for r in read_table(spark, target).select("day", F.input_file_name()).distinct().collect()}
    assert after[date(2023, 7, 1)] == files[date(2023, 7, 1)] and after[date(2023, 7, 2)] != files[date(2023, 7, 2)]


@pytest.mark.parametrize("kind", ["table", "folder"])
def test_a_lost_or_bad_write_leaves_the_old_rows(spark, tmp_path, name, kind):
    target = name if kind == "table" else f"{tmp_path}/folder"
    write_table(days(spark, (1, "a", 1), (2, "b", 2)), target, day="day", keys=["k"], root=str(tmp_path))
    good = days(spark, (3, "x", 1), (4, "y", 2))
    bad = [
        ("executor lost", broken(good)),
        ("k of a row is repeated", good.unionByName(good)),
        ("k of a row is missing", good.withColumn("k", F.when(F.col("k") == 3, F.col("k")))),
        ("day of a row is missing", good.withColumn("day", F.when(F.col("k") == 3, F.col("day")))),
    ]
    for reason, df in bad:
        with pytest.raises(Exception, match=reason):
            write_table(df, target, day="day", keys=["k"], root=str(tmp_path))
        assert rows(spark, target) == [(1, "a", 1), (2, "b", 2)]


def test_lost_rows_are_noticed(spark, tmp_path, name):
    write_table(spark.range(5), name, root=str(tmp_path), rows=5)
    with pytest.raises(WriteCheckError, match="5 rows were written of 6"):
        write_table(spark.range(5).select((F.col("id") + 1).alias("id")), name, root=str(tmp_path), rows=6)
    assert [r[0] for r in read_table(spark, name).orderBy("id").collect()] == [0, 1, 2, 3, 4]


def test_a_table_points_at_its_last_write(spark, tmp_path, name):
    for n in (5, 3):
        write_table(spark.range(n), name, keys=["id"], root=str(tmp_path))
        assert read_table(spark, name).count() == n
    # A result may be made of the table it replaces.
    write_table(read_table(spark, name).filter("id > 0"), name, root=str(tmp_path))
    assert sorted(r[0] for r in read_table(spark, name).collect()) == [1, 2]
    (now,) = places(spark, name)
    written = sorted(str(p) for p in (tmp_path / "default" / "sink_test").glob("write-*"))
    assert len(written) == 3 and len(unused_writes(spark, name, written)) == 2
    assert now.removeprefix("file:").rstrip("/") not in unused_writes(spark, name, written)


def test_nothing_to_write(spark, tmp_path, name):
    write_table(days(spark, (1, "a", 1)), name, day="day", root=str(tmp_path))
    write_table(days(spark, (1, "a", 1)).filter("false"), name, day="day", root=str(tmp_path))
    assert rows(spark, name) == [(1, "a", 1)]
    with pytest.raises(ValueError, match="already exists"):
        write_table(spark.range(3), name, overwrite=False)


def test_feature_tables_of_two_days(spark, tmp_path, name):
    """A rerun of one day touches one partition; each run reads its own rows."""
    first = training_config()
    second = replace(first, activity_end=date(1998, 7, 20), behavior_end=date(1998, 7, 20))
    monthly = {}
    for cfg in (first, second, second):
        before = set(places(spark, name)) if spark.catalog.tableExists(name) else set()
        write = features.write_table
        features.write_table = lambda df, table, **more: write(df, table, root=str(tmp_path), **more)
        try:
            features.write_feature_table(standin_sources(spark, FOLDER, cfg), cfg, name)
        finally:
            features.write_table = write
        monthly[cfg.activity_end] = features.read_feature_table(spark, name, cfg).count()
        assert len(before - set(places(spark, name))) == (1 if len(before) == 2 else 0)
    assert all(monthly.values()) and len(places(spark, name)) == 2
    assert features.read_feature_table(spark, name, first).columns == list(features.COLUMNS)
