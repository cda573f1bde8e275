import zlib

import pytest

from tidemark.llm.sharding import balanced_shards, sized


def plain(rows, shards):
    """Prefix sums over the sorted rows in one loop."""
    rows = sorted(
        ((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows), key=lambda r: (r[0] is not None, r)
    )
    total, start, found, slots = sum(r[2] for r in rows), 0, [], {}
    for i, crc, size in rows:
        shard = (2 * start + size) * shards // (2 * total)
        slots[shard] = slots.get(shard, -1) + 1
        found.append((i, size, crc, shard, slots[shard]))
        start += size
    return sorted(found, key=str)


@pytest.mark.parametrize("shards", [1, 4, 24])
def test_matches_one_loop(spark, odd, shards):
    got = [tuple(r) for r in balanced_shards(sized(odd), shards).collect()]
    assert sorted(got, key=str) == plain([(r["doc_id"], r["text"]) for r in odd.collect()], shards)


def test_one_id_for_a_third_of_all_rows(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 5, id) doc_id", "repeat('x', cast(id % 50 as int)) text")
    shards = balanced_shards(sized(rows), 24, partitions=12)
    found = shards.groupBy("shard").agg({"size": "sum", "slot": "max", "*": "count"}).collect()
    sizes = [r["sum(size)"] for r in found]
    assert len(found) == 24 and max(sizes) - min(sizes) <= 2 * 58
    assert all(r["max(slot)"] + 1 == r["count(1)"] for r in found)


def test_empty_table(spark, nothing):
    assert balanced_shards(sized(nothing), 24).collect() == []
