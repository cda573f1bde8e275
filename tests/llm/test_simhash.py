import collections
import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.common import read

FOLDER = "/root/testdata/sf0.01"


def plain_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    k = min(width, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(codes, radius):
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(codes))]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one TWO", "É é ß 中文 words here", "a b c d e f g a b c " * 40, "x\x00y z\x1fw v\x85u t"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_text_in_parts(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_A_TIME", 64)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def clustered_codes(seed, centres, members, spread):
    rng = random.Random(seed)
    codes = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(members):
            code = centre
            for _ in range(rng.randint(0, spread)):
                code ^= 1 << rng.randrange(64)
            codes.add(code)
    return sorted(codes)


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_forest_finds_all_pairs(radius, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 500)
    codes = np.array(clustered_codes(radius, 6, 30, 6), dtype=np.uint64)
    rng = np.random.default_rng(0)
    shard = np.sort(rng.integers(0, 3, len(codes)))
    codes = rng.permutation(codes)
    found = {frozenset((int(a), int(b))) for x, y in simhash.Forest(codes, shard).links(radius) for a, b in zip(x, y)}
    want = {
        frozenset((i, j))
        for i in range(len(codes))
        for j in range(i)
        if shard[i] == shard[j] and int(codes[i] ^ codes[j]).bit_count() <= radius
    }
    assert found == want


@pytest.mark.parametrize("shard_size", [4096, 8, 1])
def test_links_connect_as_all_pairs_do(spark, shard_size):
    codes = clustered_codes(9, 12, 25, 5)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.code_links(spark.createDataFrame([(c,) for c in signed], "code long"), 2, shard_size)
    place = {c: i for i, c in enumerate(signed)}
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links.collect():
        u, v = place[r["u"]], place[r["v"]]
        parent[root(u)] = root(v)
    assert same_partition([root(i) for i in range(len(codes))], plain_groups(codes, 2))


def test_last_level_bounds_a_shard():
    masks = simhash.band_masks(simhash.RADIUS, simhash.LEVELS)
    assert max(64 - m.bit_count() for m in masks[-1]) <= 14


def grouped(spark, docs):
    marked = simhash.fingerprints(docs, keep=["doc_id"])
    return simhash.near_duplicate_groups(marked).collect()


def test_documents(spark):
    docs = read(spark, FOLDER, "documents")
    rows = {r["doc_id"]: r for r in grouped(spark, docs)}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    codes = [plain_fingerprint(texts[i]) for i in ids]
    assert [rows[i]["fingerprint"] % 2**64 for i in ids] == codes
    groups = plain_groups(codes, 2)
    least = collections.defaultdict(lambda: 1 << 62)
    for i, g in zip(ids, groups):
        least[g] = min(least[g], i)
    assert [rows[i]["component_id"] for i in ids] == [least[g] for g in groups]
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_odd_rows(spark, odd, nothing):
    rows = grouped(spark, odd)
    assert len(rows) == odd.count()
    # Null, empty and blank texts have fingerprint 0 and are linked; so are the repeated rows.
    assert {r["component_id"] for r in rows if r["fingerprint"] == 0} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] == 8} == {7}
    kept = [(r["doc_id"], (r["text"] or "")[:10]) for r in simhash.one_of_each_group(odd).collect()]
    want = [(1, ""), (4, "12 34 --"), (5, "..."), (6, "alpha beta"), (7, "same words"), (9, "é ß 中文 \U0001f600 \x00")]
    want += [(None, "a row with"), (10, "one"), (10, "another te")]
    assert sorted(map(str, kept)) == sorted(map(str, want))
    assert grouped(spark, nothing) == [] and simhash.one_of_each_group(nothing).collect() == []
