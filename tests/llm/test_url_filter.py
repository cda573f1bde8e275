import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm.queries import URL_RULES
from tidemark.llm import url_filter
from tidemark.llm.url_filter import BEGIN, END, grams, host_and_path, judge, ratio_model


@pytest.mark.parametrize(
    "url, host, path",
    [
        (None, "", ""),
        ("", "", ""),
        ("no scheme/x", "", ""),
        ("http://A.Example.NET", "a.example.net", ""),
        ("http://a.b/c/D?e=/f#g", "a.b", "/c/D"),
        ("x://h?q://z/", "h", ""),
        ("://h#/p", "h", ""),
        ("ftp://u@h:8/p://q", "u@h:8", "/p://q"),
        ("http://ÄB.de/ü", "Äb.de", "/ü"),
    ],
)
def test_parts(spark, url, host, path):
    row = spark.createDataFrame([(url,)], "url string").select(*[c.alias(n) for n, c in zip("hp", host_and_path(F.col("url")))]).first()
    assert (row["h"], row["p"]) == (host, path)


def test_rules(spark):
    urls = ["http://x.net/a", "http://net/", "http://knet/", "http://x.net", "http://example.net/en/", "http://a.example.net/en/1", "http://a.example.net/EN/1"]
    urls += ["http://example.com/de/", "http://org/fr/x", "http://a.org/fr", None]
    rows = judge(spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, score string"), URL_RULES).collect()
    rules = {r["page_id"]: r["rule"] for r in rows}
    assert [rules[i] for i in range(len(urls))] == [
        "net/", "net/", None, None, "example.net/en/", "example.net/en/", "net/", "example.com/de/", "org/fr/", None, None
    ]
    assert {r["verdict"] for r in rows if r["rule"] in ("net/", "example.com/de/")} == {"block"}
    assert {r["verdict"] for r in rows} <= {"allow", "block"}


def test_model_against_plain_recursion(spark):
    seen = {"accepted": Counter({"^^^a": 3, "^^ab": 2, "^abc": 2, "bcda": 1}), "rejected": Counter({"^^^a": 1, "^^ax": 4, "xabc": 2})}
    grams = sorted(set(seen["accepted"]) | set(seen["rejected"]) | {"zzzz"})
    table = spark.createDataFrame([(g, seen["accepted"][g], seen["rejected"][g]) for g in grams], "gram string, accepted long, rejected long")

    def probability(counts, gram):
        value = 1 / len({g[3] for g in grams})
        for order in range(4):
            part = gram[3 - order :]
            parts = Counter()
            for g, n in counts.items():
                parts[g[3 - order :]] += n
            inside = {g: n for g, n in parts.items() if g[:-1] == part[:-1]}
            if inside:
                value = (parts[part] + len(inside) * value) / (sum(inside.values()) + len(inside))
        return value

    got = {r["gram"]: r["ratio"] for r in ratio_model(table).collect()}
    want = {g: round(1e6 * math.log(probability(seen["accepted"], g) / probability(seen["rejected"], g))) for g in grams}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) <= 1 for g in grams)


def test_method_separates_what_rules_have_labelled(spark):
    good = [f"http://site{i}.org/fr/garden-{i}" for i in range(60)]
    bad = [f"http://casino{i}.net/win-money-{i}" for i in range(60)]
    new = [("http://site7.com/garden-9", "allow"), ("http://casino-win.com/money", "block")]
    rows = [*good, *bad, *[u for u, _ in new], *[bad[0]] * 500]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    got = judge(table, URL_RULES).collect()
    assert len(got) == len(rows)
    verdicts = {r["page_id"]: r["verdict"] for r in got if r["rule"] is None}
    assert [verdicts[120], verdicts[121]] == [v for _, v in new]


def test_without_labels_and_without_rows(spark):
    table = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert {r["verdict"] for r in judge(table, URL_RULES).collect()} == {"allow"}
    assert judge(table, URL_RULES).count() == 3
    assert judge(table.filter("false"), URL_RULES).collect() == []
    assert judge(table.withColumn("url", F.repeat(F.lit("http://x.org/y"), 20000)), URL_RULES).count() == 3
    assert {r["verdict"] for r in judge(table.withColumn("url", F.lit(None).cast("string")), URL_RULES).collect()} == {"allow"}


def test_a_url_of_a_megabyte(spark):
    table = spark.createDataFrame([(1, "http://a.b/c"), (2, "http://x.org/fr/1")], "page_id long, url string")
    long = table.withColumn("url", F.concat("url", F.repeat(F.lit("/äy9"), 250_000)))
    assert {r["page_id"]: len(r["path"]) for r in judge(table.unionByName(long), URL_RULES).collect() if len(r["path"]) > 10} == {1: 1_000_002, 2: 1_000_005}


def test_grams_keep_every_character(spark):
    row = spark.createDataFrame([("é.x", "/A\U0001f600?9")], "h string, p string").select(grams(F.col("h"), F.col("p"))).first()[0]
    spelled = BEGIN * 3 + "é.x/A\U0001f600?9" + END
    assert row == [spelled[i : i + 4] for i in range(len(spelled) - 3)]


def test_scripts_and_digits_are_told_apart(spark):
    """URLs that differ only in their script or in digits have verdicts of their own."""
    good = [f"http://site{i}.org/fr/сад-{i % 7}" for i in range(60)] + [f"http://s{i}.org/fr/2" for i in range(40)]
    bad = [f"http://site{i}.net/赌场-{i % 7}" for i in range(60)] + [f"http://s{i}.net/7" for i in range(40)]
    new = [("http://x.com/сад", "allow"), ("http://x.com/赌场", "block"), ("http://s.com/2", "allow"), ("http://s.com/7", "block")]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + [u for u, _ in new])], "page_id long, url string")
    scores = {r["page_id"]: (r["verdict"], r["score"]) for r in judge(table, URL_RULES).collect() if r["page_id"] >= 200}
    assert [scores[200 + i][0] for i in range(2)] == ["allow", "block"]
    assert scores[202][1] > scores[203][1]


def test_rare_grams_score_like_heavy_ones(spark, monkeypatch):
    rows = [(i, f"http://h{i % 5}.{'org/fr' if i % 2 else 'net'}/{i * 37 % 11}") for i in range(80)] + [(100 + i, f"http://q{i}.com/{i}") for i in range(20)]
    table = spark.createDataFrame(rows, "page_id long, url string")
    want = sorted(map(tuple, judge(table, URL_RULES).collect()), key=str)
    monkeypatch.setattr(url_filter, "HEAVY", 20)
    assert sorted(map(tuple, judge(table, URL_RULES).collect()), key=str) == want
