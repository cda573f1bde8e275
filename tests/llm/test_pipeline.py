"""Every stage against a plain version, on what its predecessor kept."""

import random
import re
import tracemalloc

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from test_decontaminate import words

from tidemark.functions.staging import stage
from tidemark.llm import similar
from tidemark.llm.common import read

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    tables = [read(spark, FOLDER, "documents")]
    for name, function in corpus_pipeline.STAGES:
        tables.append(stage(function(spark, tables[-1], FOLDER), name))
    return tables


def by_id(table):
    return {r["doc_id"]: r["text"] for r in table.collect()}


def test_columns_and_order(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "pieces"]
    for table in kept[1:-1]:
        assert table.columns == kept[0].columns
    for before, after in zip(kept, kept[1:-1]):
        assert set(by_id(after).items()) <= set(by_id(before).items())


def test_toxic_rows_go_and_clean_ones_stay(spark, kept):
    left = by_id(kept[1])
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, FOLDER, "labels").collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in left for i in clean) >= 0.95 * len(clean)
    assert sum(i in left for i, t in labels.items() if t == 1) <= 0.2 * sum(labels.values())


def test_language(kept):
    before, left = by_id(kept[1]), by_id(kept[2])
    assert all(any(c.isalpha() for c in t) for t in left.values())
    assert len(left) >= 0.98 * len(before)


def shingle_set(text):
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def links(texts):
    """Pairs of different texts with a similarity of 0.8 or more, and the similarity."""
    sets = [shingle_set(t) for t in texts]
    found = {}
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 0.8 * max(len(a), len(b)) <= min(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) and a | b:
                found[i, j] = len(a & b) / len(a | b)
    return found


def test_near_duplicates(kept):
    before = by_id(kept[2])
    ids = sorted(before)
    group = {i: min(j for j in ids if before[j] == before[i]) for i in ids}
    heads = sorted(set(group.values()))
    for i, j in links([before[h] for h in heads]):
        one, other = sorted((group[heads[i]], group[heads[j]]))
        group = {k: one if g == other else g for k, g in group.items()}
    assert sorted(by_id(kept[3])) == sorted(set(group.values()))


def changed(words, share, draw):
    """A copy in which a word here and there is another one."""
    return " ".join("".join(draw.choices("bcdfgaeiou", k=6)) if draw.random() < share else w for w in words)


def test_near_duplicates_of_every_similarity_are_found(spark):
    """Planted pairs in bands of similarity: at least nine in ten are found, and no pair below 0.8 by itself."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("bcdfgaeiou", k=draw.randint(2, 8))) for _ in range(3000)]
    pairs = []
    for _ in range(500):
        words = draw.choices(vocabulary, k=draw.randint(60, 400))
        pairs.append((" ".join(words), changed(words, draw.choice([0.002, 0.005, 0.01, 0.018, 0.023, 0.04, 0.08]), draw)))
    rows = [(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    left = {r[0] for r in similar.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert all(2 * i in left for i in range(500))
    bands = {}
    for i, (a, b) in enumerate(pairs):
        a, b = shingle_set(a), shingle_set(b)
        bands.setdefault(min(19, int(20 * len(a & b) / len(a | b))), []).append(2 * i + 1 not in left)
    for band in (16, 17, 18, 19):
        assert len(bands[band]) >= 20 and sum(bands[band]) >= 0.9 * len(bands[band]), (band, bands[band])
    assert not any(any(v) for b, v in bands.items() if b < 16)


def test_a_large_group_of_near_copies(spark):
    draw = random.Random(6)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = [(i, " ".join([*words[: i % 300], f"n{i}", *words[i % 300 :]])) for i in range(600)] + [(1000, " ".join(words))] * 50
    texts = spark.createDataFrame([(t, i, "x", "y") for i, t in rows], "text string, doc_id long, _id string, _digest string")
    assert [r["doc_id"] for r in similar.one_of_each_group(texts).collect()] == [0]


def test_a_link_that_does_not_hold_hides_no_other(spark):
    """Chains of texts, one word changed at each step: neighbours are similar, others are near in the codes only."""
    draw = random.Random(8)
    rows = []
    for chain in range(60):
        words = ["".join(draw.choices("bcdfgaeiou", k=6)) for _ in range(60)]
        ids = draw.sample(range(10 * chain, 10 * chain + 10), 7)
        for step, i in enumerate(ids):
            words[8 * step + 2] = f"n{chain}x{step}"
            rows.append((i, " ".join(words)))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    # Codes miss one pair in a hundred or so, and with it cut a chain.
    nodes = [(i, np.array(similar.codes(t), dtype=np.uint64)) for i, t in rows]

    def near(a, b):
        apart = np.bitwise_count(a ^ b)
        return apart[: similar.PROBES].min() <= similar.RADIUS and apart[similar.PROBES :].sum() <= similar.LONG_RADIUS

    sets, label = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}
    for n, (i, a) in enumerate(nodes):
        for j, b in nodes[:n]:
            if i // 10 == j // 10 and label[i] != label[j] and near(a, b) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                one, other = sorted((label[i], label[j]))
                label = {k: one if g == other else g for k, g in label.items()}
    assert len(set(label.values())) < 90
    assert sorted(r["doc_id"] for r in similar.one_of_each_group(texts).collect()) == sorted(set(label.values()))


def test_blocks_of_a_large_component(spark):
    """Groups of near copies that no pair joins but one, in blocks of two texts."""
    draw = random.Random(9)
    words = ["".join(draw.choices("bcdfgaeiou", k=6)) for _ in range(60)]
    texts = [" ".join([*words[:k], f"n{k}", *words[k + 1 :]]) for k in range(5, 55, 4)]
    sets = [similar.shingles(similar.word_hashes(t), 5).view(np.int64).tolist() for t in [" ".join(words), *texts]]
    codes = [np.array(similar.codes(t), dtype=np.uint64).view(np.int64).tolist() for t in [" ".join(words), *texts]]
    n = len(sets)
    # The only candidates: a path that leaves the first text, to which all are similar, to its end.
    candidates = spark.createDataFrame([(i + 1, i) for i in range(1, n - 1)] + [(n - 1, 0)], "u long, v long")
    nodes = spark.createDataFrame(list(enumerate(codes)), "node long, codes array<long>")
    shingles = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    near = [i for i in range(1, n) if min(bin((a ^ b) % 2**64).count("1") for a, b in zip(codes[0][:3], codes[i][:3])) <= similar.RADIUS]
    for block in (2, 256):
        stars = similar.components(similar.similar_links(candidates, shingles))
        links = similar.missed_links(candidates, stars, nodes, shingles, candidates, block=block)
        joined = similar.components(links.unionByName(stars.selectExpr("node as u", "component as v")))
        assert {r["node"] for r in joined.collect() if r["component"] == 0} >= {0, *near} and len(near) > 8


def test_shards_that_are_cut_lose_no_pair(spark):
    draw = random.Random(7)
    base = [draw.choices([f"w{i}" for i in range(400)], k=80) for _ in range(60)]
    rows = [(i, " ".join(words)) for i, words in enumerate(base)] + [(100 + i, changed(words, 0.01, draw)) for i, words in enumerate(base)]
    nodes = spark.createDataFrame([(i, np.array(similar.codes(t), dtype=np.uint64).view(np.int64).tolist()) for i, t in rows], "node long, codes array<long>")
    whole, cut = ({tuple(r) for r in similar.candidate_links(nodes, size).collect()} for size in (10_000, 2))
    assert whole == cut and len(whole) > 40


def test_random_letters_and_other_languages_go(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    draw = random.Random(3)
    letters = [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(n)) for n in [10] * 40 + [50] * 40 + [300] * 40]
    foreign = [
        "A gyors barna róka átugorja a lusta kutyát, és a kutya nem csinál semmit, mert nagyon álmos volt egész nap",
        "Быстрая коричневая лиса прыгает через ленивую собаку и убегает в лес",
        "Szybki brązowy lis przeskakuje leniwego psa, a pies nic nie robi, bo jest bardzo śpiący",
    ]
    odd = spark.createDataFrame([(10**9 + i, t, None, "odd", len(t)) for i, t in enumerate(letters + foreign)], docs.schema)
    left = [r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, docs.unionByName(odd), FOLDER).select("doc_id", "lang").collect()]
    assert sum(i >= 10**9 for i in left) <= 0.03 * len(letters)
    assert not any(i >= 10**9 + len(letters) for i in left)
    of = {r["doc_id"]: r["lang"] for r in docs.collect()}
    for lang in ("de", "en", "es", "fr"):
        assert sum(of.get(i) == lang for i in left) >= 0.98 * sum(x == lang for x in of.values())


def test_decontamination(spark, kept):
    items = [tuple(r) for r in read(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    before = by_id(kept[3])
    want = {i for i, t in before.items() if not contaminated(t, items)}
    assert set(by_id(kept[4])) == want


def contaminated(text, items):
    doc = words(text)
    for _, wording in items:
        w = words(wording)
        n = min(10, len(w))
        windows = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
        if any(tuple(doc[p : p + n]) in windows for p in range(len(doc) - n + 1)):
            return True
    return False


def test_pieces(kept):
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = by_id(kept[4])
    rows = kept[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        assert r["ids"] == model.encode(texts[r["doc_id"]], add_eos=True) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]


def test_run(spark, kept):
    assert sorted(map(str, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(str, kept[5].collect()))


def test_odd_rows_in_every_stage(spark, odd):
    """Odd rows with columns of names that operators use: each stage alone, and one after the other."""
    docs = odd.withColumn("lang", F.when(F.col("doc_id") > 5, "en")).withColumn("_id", F.lit("x")).withColumn("_row", F.lit("y"))
    rows = [r["doc_id"] for r in docs.select("doc_id").collect()]
    for name, function in corpus_pipeline.STAGES:
        after = function(spark, docs, FOLDER)
        got = after.collect()
        if name in ("toxicity", "decontamination"):
            assert after.columns == docs.columns and sorted(r["doc_id"] or 0 for r in got) == sorted(i or 0 for i in rows)
        elif name == "language":
            assert after.columns == docs.columns and got and all(any(c.isalpha() for c in r["text"] or "") for r in got)
        elif name == "near_duplicates":
            assert after.columns == docs.columns and len(got) == len({r["text"] for r in got}) == len({r["text"] for r in docs.collect()})
            assert {r["doc_id"] for r in got} >= {1, 2, 3, 4, 5, 6, 7, 9, 10}
        else:
            assert len(got) == len(rows)


def test_empty_tables(spark, tmp_path):
    empty = read(spark, FOLDER, "documents").filter("false")
    for name in ("labels", "benchmark"):
        read(spark, FOLDER, name).filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = read(spark, FOLDER, "documents")
    for folder in (FOLDER, str(tmp_path)):
        for _, function in corpus_pipeline.STAGES:
            assert function(spark, empty, folder).collect() == []
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == docs.count()


def test_a_task_holds_few_texts_and_little_else(spark, monkeypatch):
    """Texts reach a task once, and what is made of 2.4 MB of them takes little memory beside them."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("etaoinshrdlu ", k=1000 + rng.randrange(2000))) for _ in range(1200)]
    docs = spark.createDataFrame([(i, i % 2, t, "en") for i, t in enumerate(texts[:200])], "doc_id long, toxic int, text string, lang string")
    labels = docs.select("doc_id", "toxic")
    docs = docs.drop("toxic")
    model = corpus_pipeline.toxicity.learn(spark, docs, labels)
    made = []
    real = type(docs).mapInArrow

    def watched(self, function, *more):
        made.append((self.columns, [f.dataType.simpleString() for f in self.schema], function))
        return real(self, function, *more)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    monkeypatch.setattr(corpus_pipeline.toxicity, "learn", lambda *_: model)
    for stage_of in (corpus_pipeline.drop_toxic, corpus_pipeline.keep_known_languages, corpus_pipeline.drop_contaminated, corpus_pipeline.to_pieces):
        made.clear()
        stage_of(spark, docs, FOLDER)
        columns, types, function = made[-1]
        # Carried: doc_id, text and lang at most, none of them twice and none within a struct.
        assert types in (["bigint", "string", "string"], ["bigint", "string"]), stage_of.__name__
        values = [np.arange(len(texts)), texts, ["en"] * len(texts)][: len(types)]
        batch = pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=columns)
        if stage_of is corpus_pipeline.drop_contaminated:
            continue
        tracemalloc.start()
        for out in function(iter([batch])):
            del out
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < 64, (stage_of.__name__, peak)
