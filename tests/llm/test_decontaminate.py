import random
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate
from tidemark.llm.common import read
from tidemark.llm.decontaminate import find_contamination, without_contaminated

FOLDER = "/root/testdata/sf0.01"
PASSAGE = "the quick brown fox jumps over the lazy dog and then it sleeps for hours"
ITEMS = [
    (1, PASSAGE), (2, PASSAGE), (30, "Quick brown FOX"), (4, ""), (5, None), (None, "unlisted words here"), (6, "x " + PASSAGE[4:]), (30, "zebra"),
]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items, window):
    doc, hit, ids, matches = words(text), set(), set(), set()
    for item, wording in items:
        w = words(wording)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            for p in range(len(doc) - n + 1):
                if doc[p : p + n] == w[j : j + n]:
                    hit |= set(range(p, p + n))
                    ids.add(item)
                    if not (j and p and doc[p - 1] == w[j - 1]):
                        m = n
                        while j + m < len(w) and p + m < len(doc) and doc[p + m] == w[j + m]:
                            m += 1
                        matches.add((item, j, p, m))
    return len(doc), hit, ids - {None}, matches


TEXTS = [
    (1, f"Before it. {PASSAGE.upper()}! After; {PASSAGE}"), (2, "quick brown fox"), (3, "quick, brown... zebra fox"), (4, None), (5, ""),
    (6, "nothing at all"), (7, PASSAGE[:40]), (7, "quick brown fox quick brown fox"), (None, "these unlisted words here"), (8, "zebra " * 5000),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in TEXTS], "doc_id long, text string, n_words string, _hits array<int>")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [8_000_000, 60])
def test_against_brute_force(spark, tables, block_bytes):
    docs, items = tables
    rows = find_contamination(spark, docs, items, block_bytes=block_bytes).collect()
    assert len(rows) == len(TEXTS)
    assert all(r["_hits"] == [1] for r in rows)
    # A class of equal items is named by its smallest id where its items are in one block.
    for r in rows:
        count, hit, ids, matches = plain(r["text"], ITEMS, 10)
        assert r["n_words"] == count
        assert [(s["start"], s["length"]) for s in r["hits"]] == spans(hit)
        assert set(r["item_ids"]) == ids and len(r["item_ids"]) == len(ids)
        named = {(m["item_id"], m["item_start"], m["doc_start"], m["length"]) for m in r["matches"]}
        assert named == {m for m in matches if m[0] != 2} or block_bytes == 60 and named - {m for m in matches} == set()


def spans(hit):
    found = []
    for p in sorted(hit):
        if found and found[-1][0] + found[-1][1] == p:
            found[-1] = (found[-1][0], found[-1][1] + 1)
        else:
            found.append((p, 1))
    return found


def test_many_blocks_give_the_same(spark):
    docs, items = read(spark, FOLDER, "documents"), read(spark, FOLDER, "benchmark")
    one, many = (
        find_contamination(spark, docs, items, keep=["doc_id"], block_bytes=b).select("doc_id", "n_words", "hits", F.array_sort("item_ids"))
        for b in (8_000_000, 2500)
    )
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_affected_documents_go(spark, tables):
    docs, items = tables
    left = without_contaminated(spark, docs, items)
    assert left.columns == docs.columns
    clean = [t for _, t in TEXTS if not plain(t, ITEMS, 10)[1]]
    assert sorted(map(str, (r["text"] for r in left.collect()))) == sorted(map(str, clean))


def test_empty_tables(spark, tables, nothing):
    docs, items = tables
    assert find_contamination(spark, nothing, items).collect() == []
    none = find_contamination(spark, docs, items.filter("false")).collect()
    assert len(none) == len(TEXTS) and all(r["hits"] == [] and r["matches"] == [] for r in none)


@pytest.mark.parametrize("block_bytes", [8_000_000, 80])
def test_an_item_with_two_texts_is_listed_once(spark, block_bytes):
    first, second = "one two three four five six seven eight nine ten", "red orange yellow green blue indigo violet black white grey"
    docs = spark.createDataFrame([(1, f"{first} and {second}"), (2, second)], "doc_id long, text string")
    items = spark.createDataFrame([(7, first), (7, second), (8, second)], "item_id long, text string")
    rows = find_contamination(spark, docs, items, block_bytes=block_bytes).collect()
    assert {r["doc_id"]: sorted(r["item_ids"]) for r in rows} == {1: [7, 8], 2: [7, 8]}


def test_repeated_words_take_memory_in_proportion():
    """An item of 400 equal words against a text of 50,000, and against the same with other words between."""
    block = decontaminate.test_block([(1, "again " * 400)], 10)
    for text, hits in (("again " * 50_000, [(0, 50_000)]), (("again " * 25 + "other ") * 2000, [(26 * i, 25) for i in range(2000)])):
        tracemalloc.start()
        n_words, spans, ids, matches = (a.to_pylist()[0] for a in decontaminate.match_texts([text], block))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 400e6
        assert [(s["start"], s["length"]) for s in spans] == hits and ids == [1]
        assert max(m["length"] for m in matches) == min(400, hits[0][1])


def test_matches_across_stretches(monkeypatch):
    draw = random.Random(2)
    items = [(i, " ".join(draw.choices("ab", k=draw.randint(4, 40)))) for i in range(6)]
    text = " ".join(draw.choices("ab", k=600))
    block = decontaminate.test_block(items, 4)
    whole = decontaminate.match_texts([text, text[::-1]], block)
    monkeypatch.setattr(decontaminate, "PLACES_AT_A_TIME", 50)
    assert decontaminate.match_texts([text, text[::-1]], block) == whole
