import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.common import read, remainder
from tidemark.llm.language import DIMENSIONS, Bundler, identify, learn_profiles

FOLDER = "/root/testdata/sf0.01"


def plain_bundle(text, bundler):
    """One n-gram after the other."""
    letters = [int(bundler.folded[ord(c)]) for c in f" {text} "]
    spelled = [c for i, c in enumerate(letters) if c != 32 or not i or letters[i - 1] != 32]
    total = np.zeros(DIMENSIONS)
    for a, b, c in zip(spelled, spelled[1:], spelled[2:]):
        total += np.roll(bundler.letter(a), 2) * np.roll(bundler.letter(b), 1) * bundler.letter(c).astype(float)
    return total


def test_bundles():
    bundler = Bundler()
    texts = ["A.", "Avec les mots", "", None, "...", "a  b\n\nc", "ÀÉ 中文 straße", "x" * 3000, "no 1 yes"]
    made, lettered = bundler(texts)
    assert np.array_equal(made, np.array([plain_bundle(t or "", bundler) for t in texts]))
    assert lettered.tolist() == [True, True, False, False, False, True, True, True, True]
    together, _ = bundler(texts, np.array([0, 1, 0, 1, 0, 1, 0, 1, 0]), 2)
    assert np.array_equal(together[0], made[::2].sum(axis=0)) and np.array_equal(together[1], made[1::2].sum(axis=0))


def test_held_out_rows(spark):
    docs = read(spark, FOLDER, "documents")
    profiles = learn_profiles(docs.filter(remainder("doc_id", 3) != 1))
    assert sorted(profiles) == ["de", "en", "es", "fr"]
    found = identify(spark, docs.filter(remainder("doc_id", 3) == 1), profiles)
    rows = found.select((F.col("lang") == F.col("lang_pred")).alias("right"), "score").collect()
    assert sum(r["right"] for r in rows) / len(rows) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_learning_does_not_depend_on_partitions(spark):
    docs = read(spark, FOLDER, "documents").limit(200)
    a, b = learn_profiles(docs), learn_profiles(docs.repartition(7))
    assert all(np.array_equal(a[k], b[k]) for k in a) and a.keys() == b.keys()


def test_odd_rows(spark, odd, nothing):
    profiles = learn_profiles(read(spark, FOLDER, "documents"))
    rows = identify(spark, odd, profiles).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if any(c.isalpha() for c in r["text"] or ""):
            assert r["lang_pred"] in profiles
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert identify(spark, nothing, profiles).collect() == []
    assert learn_profiles(nothing.withColumn("lang", F.lit("en"))) == {}
    assert learn_profiles(odd.withColumn("lang", F.lit(None).cast("string"))) == {}
    assert {r["lang_pred"] for r in identify(spark, odd, {}).collect()} == {"und"}
