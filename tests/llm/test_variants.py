"""Near words against comparing all pairs; forms and roots against following them one by one."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import variants
from tidemark.llm.common import read
from tidemark.llm.queries import op13_spelling

FOLDER = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts, times=10):
    words = sorted(counts)
    beside = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(beside[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    rows = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (form[w], root, counts[w], len(beside[w]), counts[form[w]] if form[w] else None)
    return rows


def plain_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n > 1}


def shown(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_registered_query(spark):
    docs = [tuple(r) for r in read(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    assert shown(op13_spelling(spark, FOLDER)) == plain(plain_words(docs))


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", max_size=6), max_size=60))
def test_composition(words):
    found = variants.one_edit_pairs(sorted(words))
    assert found == {(a, b) for a in words for b in words if (len(a), a) > (len(b), b) and near(a, b)}


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abc", max_size=7), max_size=80))
def test_acceptor_is_minimal_and_accepts_its_words(words):
    a = variants.Acceptor(sorted(words))
    found, todo = set(), [(a.start, "")]
    while todo:
        state, prefix = todo.pop()
        if a.final[state]:
            found.add(prefix)
        todo += [(t, prefix + c) for c, t in a.arcs[state].items()]
    assert found == words
    languages = {w: frozenset(v[len(w) :] for v in words if v.startswith(w)) for v in words for w in (v[:i] for i in range(len(v) + 1))}
    assert len(a.arcs) == max(1, len(set(languages.values())))


def crowd(seed, size):
    """Words with many near ones, and a third of all that begin and end alike."""
    draw = random.Random(seed)
    words = {"".join(draw.choices("abé", k=draw.randint(7, 9))) for _ in range(size)}
    return words | {"aaaa" + "".join(draw.choices("ab", k=draw.randint(0, 3))) + "bbbb" for _ in range(size)}


@pytest.mark.parametrize("most_words", [20_000, 7])
def test_pairs_with_whole_and_with_cut_states(spark, most_words):
    words = sorted(crowd(3, 150))
    found = variants.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), most_words).collect()
    pairs = [tuple(sorted((r["longer"], r["shorter"]))) for r in found]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_forms_and_chains(spark):
    draw = random.Random(9)
    counts = {w: draw.choice([1, 2, 9, 10, 19, 20, 100, 1000, 10_000, 100_000]) for w in crowd(4, 120)}
    chain = ["chainaaa", "chainaab", "chainabb", "chainbbb", "chaibbbb", "chabbbbb", "chbbbbbb"]
    counts |= {w: 10**i for i, w in enumerate(chain)}
    # Ties: the first in code-point order, which is not that of UTF-16.
    counts |= {"tieword": 1, "tiewordz": 50, "tieword￿": 50, "tieword\U0001f600": 50, "tiewords": 50}
    table = spark.createDataFrame([(w, n, "x", "y") for w, n in counts.items()], "word string, n long, near string, root string")
    got = shown(variants.spelling_variants(table))
    assert got == plain(counts)
    assert got[chain[0]][1] == chain[-1] and got["tieword"][0] == "tiewords"


def test_odd_rows_and_nothing(spark, odd, nothing):
    counts = plain_words([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])
    got = shown(variants.spelling_variants(variants.vocabulary(variants.spelled(odd))))
    assert got == plain(counts) and len(got) == 1
    assert variants.spelling_variants(variants.vocabulary(variants.spelled(nothing))).collect() == []


def test_words_at_the_border(spark):
    rows = [(1, "sixsix"), (2, "ÀBCDEFÿ x×÷"), (3, "aaaaaaa aaaaaaa bbbbbbb1bbbbbbb2ccccccc"), (None, "Éabcdef éABCDEF"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in variants.vocabulary(variants.spelled(docs), 1).collect()}
    want = Counter()
    for i, t in rows:
        for w, n in plain_words([(i, t)] * 2).items():
            want[w] += n // 2
    assert got == dict(want)
    assert variants.spelled(docs, every=1, least_length=6).filter(F.char_length("word") >= 7).count() == 0
