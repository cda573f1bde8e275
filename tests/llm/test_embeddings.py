import math

import numpy as np
import pytest

from tidemark.llm import embeddings
from tidemark.llm.embeddings import near_duplicate_vectors, table_shape


def plain(rows, threshold=0.95):
    usable = [
        bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows
    ]
    unit = [np.array(v) / np.linalg.norm(v) if u else None for (_, v), u in zip(rows, usable)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and len(unit[i]) == len(unit[j]) and (rows[i][1] == rows[j][1] or unit[i] @ unit[j] >= threshold):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return [(key, links[i], least.get(root(i))) for i, (key, _) in enumerate(rows)]


def cluster(rng, size, width, noise):
    centre = rng.standard_normal(width)
    return [(centre + noise * rng.standard_normal(width)).tolist() for _ in range(size)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vectors = [rng.standard_normal(32).tolist() for _ in range(150)]
    vectors += cluster(rng, 120, 32, 0.05) + cluster(rng, 10, 32, 0.15) + cluster(rng, 5, 8, 0.01)
    vectors += [vectors[200]] * 30
    odd = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] * 32, [1.0]]
    rows = [(1000 - i, v) for i, v in enumerate(vectors)] + [(5000 + i, v) for i, v in enumerate(odd)]
    return [*rows, (None, vectors[3]), (None, None), (990, vectors[10])]


def found(spark, rows):
    table = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, vector string")
    got = near_duplicate_vectors(spark, table).collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    return [(r["vec_id"], r["n_links"], r["component_id"]) for r in got]


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_against_all_pairs(spark, rows, block_rows, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(embeddings, "STRIP_ROWS", 7)
    want, got = plain(rows), found(spark, rows)
    assert len(got) == len(rows)
    # No link is invented, and recall is at least nine in ten.
    assert sum(n for _, n, _ in got) >= 0.9 * sum(n for _, n, _ in want)
    by_id = {}
    for key, n, _ in want:
        by_id.setdefault(key, []).append(n)
    assert all(n <= max(by_id[key]) for key, n, _ in got)
    close = [r for r in want if r[0] is not None and 651 <= r[0] <= 850 and r[1] > 50]
    assert close and set(close) <= set(got)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        a = rng.standard_normal(32)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(32)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.952 * a + math.sqrt(1 - 0.952**2) * b).tolist())]
    assert sum(n for _, n, _ in found(spark, rows)) >= 0.9 * 600


def test_more_vectors_give_longer_codes():
    small, large = table_shape(10_000), table_shape(1_000_000_000)
    assert small[0] < large[0] and small[1] < large[1]
    assert 1_000_000_000 / 2 ** large[0] <= embeddings.BUCKET_ROWS


def test_single_precision_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(200)
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    got = near_duplicate_vectors(spark, vectors).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(plain(rows))


def test_nothing_to_link(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert near_duplicate_vectors(spark, empty).collect() == []
    assert found(spark, [(1, None), (2, [])]) == [(1, 0, 1), (2, 0, 2)]
    assert sorted(found(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0])])) == [(1, 1, 1), (2, 1, 1)]


def cone(rng, size, width, cosine):
    """Vectors that share a direction: two of them have this cosine in the mean."""
    vectors = math.sqrt((1 - cosine) / width) * rng.standard_normal((size, width))
    vectors[:, 0] += math.sqrt(cosine)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def moved(rng, vectors, cosine):
    moves = rng.standard_normal(vectors.shape)
    moves -= (moves * vectors).sum(axis=1, keepdims=True) * vectors
    return cosine * vectors + math.sqrt(1 - cosine**2) * moves / np.linalg.norm(moves, axis=1, keepdims=True)


def test_recall_of_vectors_with_a_common_direction(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BUCKET_ROWS", 4)
    rng = np.random.default_rng(9)
    a = cone(rng, 1000, 64, 0.8)
    b = moved(rng, a, 0.952)
    rows = list(enumerate(np.vstack([a, b]).tolist()))
    want = int((a @ a.T >= 0.95).sum() + (b @ b.T >= 0.95).sum() + 2 * (a @ b.T >= 0.95).sum()) - 2000
    assert want >= 2000 and sum(n for _, n, _ in found(spark, rows)) >= 0.9 * want


@pytest.mark.parametrize("vectors", [50_000, 1_500_000, 15_000_000])
@pytest.mark.parametrize("cosine", [0, 0.5, 0.8])
def test_recall_at_several_sizes(vectors, cosine):
    rng = np.random.default_rng(10)
    mean, projection, bits = embeddings.fit_codes(cone(rng, 5000, 64, cosine), vectors)
    a = cone(rng, 3000, 64, cosine)
    codes = [embeddings.substrings(x, mean, projection, bits) for x in (a, moved(rng, a, 0.95))]
    assert bits and (codes[0] == codes[1]).any(axis=1).mean() >= 0.94


def test_one_bucket_if_no_table_would_do():
    rng = np.random.default_rng(11)
    mean, projection, bits = embeddings.fit_codes(cone(rng, 500, 64, 0.9999), 10**9)
    a = cone(rng, 500, 64, 0.9999)
    codes = [embeddings.substrings(x, mean, projection, bits) for x in (a, moved(rng, a, 0.95))]
    assert (codes[0] == codes[1]).any(axis=1).mean() >= 0.94


def test_hamming_limit_keeps_pairs_at_the_threshold_and_not_others():
    rng = np.random.default_rng(4)
    sample = cone(rng, 3000, 64, 0.3)
    mean, projection, bits = embeddings.fit_codes(sample, 1_000_000)
    limit = embeddings.hamming_limit(sample, mean, projection)
    a, others = cone(rng, 3000, 64, 0.3), cone(rng, 3000, 64, 0.3)
    codes = [embeddings.packed_codes(x, mean, projection) for x in (a, moved(rng, a, 0.95), others)]
    near, far = (np.bitwise_count(codes[0] ^ c).sum(axis=1) for c in codes[1:])
    assert (near <= limit).mean() > 0.99 and (far <= limit).mean() < 0.02
