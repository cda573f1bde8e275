"""Neighbours, synthetic rows and undersampling against direct computation."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.functions.staging import stage
from tidemark.operators.balltree import BallTree, pair_distances
from tidemark.operators.neighbors import chunk_size, nearest_neighbors
from tidemark.operators.prep import hash_split
from tidemark.operators.resample import first_by_hash, smote, undersample


def brute_force(points: dict[int, list[float]], k: int) -> dict[int, list[int]]:
    found = {}
    for i, x in points.items():
        others = sorted((float(np.sqrt(np.sum((np.array(x) - np.array(y)) ** 2))), j) for j, y in points.items() if j != i)
        found[i] = [j for _, j in others[:k]]
    return found


@pytest.mark.parametrize(("chunk", "pivots"), [(20000, None), (25, 1), (10, 6), (70, 3)])
def test_neighbors_are_exact(spark, chunk, pivots):
    generator = np.random.default_rng(7)
    clusters = generator.normal(0, 20, (5, 3))
    points = {i: np.round(clusters[i % 5] + generator.normal(0, 1, 3), 2).tolist() for i in range(100)}
    # A third of all points are copies of one.
    points |= {i: [1.0, 1.0, 1.0] for i in range(100, 150)}
    df = stage(spark.createDataFrame(list(points.items()), "id long, x array<double>"), "points")
    found = {r["id"]: r["neighbors"] for r in nearest_neighbors(df, 5, chunk, pivots).collect()}
    assert found == brute_force(points, 5)


def test_neighbors_when_only_counted(spark):
    points = stage(spark.range(60).select("id", F.array(F.col("id").cast("double")).alias("x")), "points")
    assert nearest_neighbors(points, 3, 20).count() == 60


def test_distance_function_travels_by_value():
    """Workers need not have this package installed."""
    from pyspark import cloudpickle
    from tidemark.operators.neighbors import distance_function

    text = cloudpickle.dumps(distance_function())
    assert b"distance_function" in text and b"_make_function" in text


def test_neighbors_of_few(spark):
    df = stage(spark.createDataFrame([(1, [0.0]), (2, [5.0])], "id long, x array<double>"), "points")
    assert {r["id"]: r["neighbors"] for r in nearest_neighbors(df, 5).collect()} == {1: [2], 2: [1]}


@pytest.mark.parametrize("count", [0, 1, 17, 499, 500, 900])
def test_first_by_hash(spark, count):
    ids = spark.range(500)
    order = sorted(range(500), key=lambda i: (hashlib.md5(f"{i}|3".encode()).hexdigest(), i))
    found = sorted(r[0] for r in first_by_hash(ids, "id", count, 3).collect())
    assert found == sorted(order[:count])


@pytest.fixture(scope="module")
def unbalanced(spark):
    generator = np.random.default_rng(1)
    rows = [(i, int(i < 12), *map(float, generator.normal(0, 1, 3))) for i in range(200)]
    return spark.createDataFrame(rows, "cust_id long, label long, a double, b double, c double")


def test_smote_counts_and_segments(unbalanced):
    grown = smote(unbalanced, "label", "cust_id", ["a", "b", "c"], ratio=0.2, k=5, seed=9).toPandas()
    minority = unbalanced.filter("label = 1").toPandas().set_index("cust_id")[["a", "b", "c"]]
    near = brute_force({i: row.tolist() for i, row in minority.iterrows()}, 5)
    made = grown[grown.is_synthetic == 1]
    assert len(grown[grown.label == 1]) == int(0.2 * 188) and len(grown[grown.label == 0]) == 188
    per_base = made.groupby("cust_id").size()
    assert per_base.max() - per_base.reindex(minority.index, fill_value=0).min() <= 1
    for row in made.itertuples():
        base, z = minority.loc[row.cust_id].to_numpy(), np.array([row.a, row.b, row.c])
        on_segment = []
        for other in near[row.cust_id]:
            step = minority.loc[other].to_numpy() - base
            u = float(np.dot(z - base, step) / np.dot(step, step))
            on_segment.append(0 <= u < 1 and np.allclose(base + u * step, z))
        assert any(on_segment)


def test_smote_does_not_depend_on_partitioning(unbalanced):
    one, many = (
        sorted(map(tuple, smote(df, "label", "cust_id", ["a", "b", "c"]).collect()))
        for df in (unbalanced.coalesce(1), unbalanced.repartition(7))
    )
    assert one == many


def test_a_reached_ratio_is_an_error_unless_lenient(unbalanced):
    with pytest.raises(ValueError, match="exceeds"):
        smote(unbalanced, "label", "cust_id", ["a", "b", "c"], ratio=0.01)
    assert smote(unbalanced, "label", "cust_id", ["a", "b", "c"], ratio=0.01, lenient=True).count() == 200


def test_fewer_rows_than_neighbours_are_an_error_unless_lenient(unbalanced):
    few = unbalanced.filter("label = 0 or cust_id < 3")
    with pytest.raises(ValueError, match="neighbours"):
        smote(few, "label", "cust_id", ["a", "b", "c"])
    assert smote(few, "label", "cust_id", ["a", "b", "c"], lenient=True).filter("label = 1").count() == int(0.2 * 188)


def test_all_cores_get_blocks(spark):
    """The published minority of 2,319 rows is cut into at least as many pairs of chunks as there are cores."""
    for cores in (4, 8, 64):
        assert math.ceil(2319 / chunk_size(2319, cores)) ** 2 >= cores
    assert chunk_size(10**9, 1000) == 20000 and chunk_size(1, 1000) == 1


def test_published_class_counts():
    """967,067 and 2,319 rows become 322,355 and 193,413."""
    minority = 2319 + (int(0.2 * 967067) - 2319)
    assert (int(minority / 0.6), minority) == (322355, 193413)


def test_undersample(unbalanced):
    kept = undersample(unbalanced, "label", "cust_id", ratio=0.6, seed=4)
    assert {r["label"]: r["count"] for r in kept.groupBy("label").count().collect()} == {1: 12, 0: 20}
    again = undersample(unbalanced.repartition(5), "label", "cust_id", ratio=0.6, seed=4)
    assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in again.collect())
    with pytest.raises(ValueError, match="out of reach"):
        undersample(unbalanced, "label", "cust_id", ratio=0.01)
    assert undersample(unbalanced, "label", "cust_id", ratio=0.01, lenient=True).count() == 200


def test_split_share(spark):
    share = hash_split(spark.range(20000), "id").agg(F.avg("is_test")).first()[0]
    assert 0.19 < share < 0.21


def curled(rows, columns, seed):
    """Rows of many columns that hang on a few, as customer features do; every tenth is a copy."""
    generator = np.random.default_rng(seed)
    x = np.tanh(generator.normal(size=(rows, 4)) @ generator.normal(size=(4, columns))) + 0.001 * generator.normal(size=(rows, columns))
    x[::10] = x[0]
    return x


def test_ball_tree_finds_the_nearest_with_few_distances():
    x = np.unique(curled(8000, 77, 3), axis=0)
    ids = np.arange(len(x)) * 3
    tree = BallTree(ids, x)
    row, other, apart = tree.nearest(ids, x, 5, np.full(len(x), np.inf))
    assert np.bincount(row, minlength=len(x)).tolist() == [5] * len(x)
    assert tree.distances_made < len(x) ** 2 / 3
    for i in range(0, len(x), 97):
        far = pair_distances(np.broadcast_to(x[i], x.shape), x)
        want = sorted((d, j) for d, j in zip(far, ids) if j != ids[i])[:5]
        assert sorted(zip(apart[row == i], other[row == i])) == want


@pytest.mark.parametrize("bound", [0.0, 1.0, 2.5])
def test_ball_tree_keeps_to_the_bound(bound):
    x = np.arange(500, dtype=float)[:, None]
    row, other, apart = BallTree(np.arange(500), x).nearest(np.array([7, 900]), np.array([[7.0], [7.0]]), 10, np.array([bound, bound]))
    inside = [j for j in range(500) if abs(j - 7) <= bound]
    assert sorted(other[row == 1].tolist()) == inside and sorted(other[row == 0].tolist()) == [j for j in inside if j != 7]
    assert [len(a) for a in BallTree(np.arange(0), np.zeros((0, 3))).nearest(np.arange(2), np.zeros((2, 3)), 2, np.ones(2))] == [0, 0, 0]


def test_neighbors_of_many_columns_with_copies(spark):
    x = curled(2000, 30, 8)
    df = stage(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>"), "points")
    work = spark.sparkContext.accumulator(0)
    found = {r["id"]: r["neighbors"] for r in nearest_neighbors(df, 4, chunk_rows=300, pivots=8, work=work).collect()}
    assert len(found) == 2000 and work.value < 2000**2 / 2
    for i in [0, 10, *range(1, 2000, 41)]:
        far = pair_distances(np.broadcast_to(x[i], x.shape), x)
        assert found[i] == [j for _, j in sorted((d, j) for j, d in enumerate(far) if j != i)[:4]]


def test_neighbors_of_nothing(spark):
    df = spark.createDataFrame([(1, [0.0])], "id long, x array<double>")
    assert nearest_neighbors(df, 5).collect() == [] and nearest_neighbors(df.filter("false"), 5).collect() == []
