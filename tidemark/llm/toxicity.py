"""Toxicity scores from gradient-boosted trees over dense features.

The features are rates of a text: lexicon densities, lexicon words close to a second person, capitals, punctuation,
and obfuscation. The lexicon is learned from labelled rows: words and word beginnings that are much more frequent
in toxic texts, chosen one after the other by how many toxic texts they newly explain, so that a group of near
copies adds few entries and not all of its words. Trees (Spark ML) are fitted on a part of the labelled rows, and
their output is calibrated on the rest by isotonic regression.

The classifier is fitted on a sample of at most about `SAMPLE_ROWS` labelled rows; every row is scored on its
whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.staging import stage
from tidemark.llm.common import SMALL_SLICE_ROWS, numbered, slices, with_arrays

SAMPLE_ROWS = 20_000
# One labelled row in so many is kept for the calibration.
CALIBRATION_PART = 4
THRESHOLD = 0.3
TREES, DEPTH = 20, 3
PREFIXES = (4, 5, 6)
# A lexicon entry stands in so many toxic texts of the sample at least, and is so many times as frequent there as elsewhere.
LEXICON_TEXTS, LEXICON_RATIO = 3, 8.0
# A toxic text is explained when so many entries stand in it.
ENTRIES_A_TEXT = 4
# Words between a lexicon word and a second person that still count as close.
NEAR = 3
# Single letters in a row that are read as one word.
SPACED_LETTERS = 4
# Part of the score that keeps the order of the trees among rows with equal calibrated values.
ORDER_WEIGHT = 0.01
# Words that a task remembers; the memory starts anew when it is full.
MEMORY_WORDS = 64_000

# Second person pronouns of the common languages, and characters that stand for letters.
SECOND_PERSON = (
    "you your yours yourself u ur ya du dich dir dein deine deiner euch euer ihr sie tu te toi ton ta tes vous votre vos "
    "usted ustedes tú ti tus vosotros os vuestro"
).split()
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

FEATURES = (
    "lexicon_density lexicon_count lexicon_weight lexicon_weight_density beginning_density disguised_density near_second_person "
    "second_person_density capitals capital_words lexicon_capitals exclamations punctuation obfuscated stretched spaced length"
).split()

_PARTS = re.compile(r"[^\W_]+")
_STRETCHED = re.compile(r"([^\W\d_])\1\1+")
_MIXED = re.compile(r"[^\W\d_][\d@$!|*_.\-]+[^\W\d_]")
_LOOKALIKE = str.maketrans(LOOKALIKES)
_OUTSIDE = ".,;:!?\"'()[]{}…«»“”"


def spellings(token: str) -> tuple[set[str], set[str]]:
    """The words of a token as written (in lower case), and those that appear when disguises are undone."""
    low = token.lower()
    plain = set(_PARTS.findall(low))
    undone = {"".join(_PARTS.findall(low)), "".join(_PARTS.findall(low.rstrip("!?.,;:").translate(_LOOKALIKE)))}
    undone |= {_STRETCHED.sub(r"\1", w) for w in plain | undone}
    return plain, undone - plain - {""}


def _terms(word: str) -> list[str]:
    """A word, and its beginnings marked with a star."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def _counted(text: str | None) -> tuple[int, Counter]:
    """The number of words of a text, and how often each of its terms occurs."""
    words = Counter(_PARTS.findall((text or "").lower()))
    terms: Counter = Counter()
    for word, n in words.items():
        for term in _terms(word):
            terms[term] += n
    return words.total(), terms


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Terms with the logarithm of their rate in toxic texts over that in others, from (text, toxic) rows of a bounded sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Occurrences in clean and in toxic texts, and the number of toxic texts. The empty term stands for all words.
        seen, texts = (Counter(), Counter()), Counter()
        for part in slices(batches, column=0):
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words, terms = _counted(text)
                seen[toxic].update(terms)
                seen[toxic][""] += words
                if toxic:
                    texts.update(terms.keys())
        terms = list(seen[0] | seen[1])
        arrays = [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (texts, seen[1], seen[0]))]
        yield pa.RecordBatch.from_arrays(arrays, names=["term", "texts", "toxic", "clean"])

    counted = rows.select("text", "toxic").mapInArrow(count, "term string, texts bigint, toxic bigint, clean bigint")
    counted = stage(counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("texts", "toxic", "clean")]), "terms")
    words = counted.filter("term = ''").first()
    toxic_words, clean_words = (words["toxic"], words["clean"]) if words else (0, 0)
    ratio = ((F.col("toxic") + 0.5) / (toxic_words + 1)) / ((F.col("clean") + 0.5) / (clean_words + 1))
    likely = counted.filter((F.col("term") != "") & (F.col("texts") >= LEXICON_TEXTS)).withColumn("ratio", ratio)
    weights = {r["term"]: math.log(r["ratio"]) for r in likely.filter(F.col("ratio") >= LEXICON_RATIO).collect()}
    # The toxic texts of the sample, each reduced to the terms that may be chosen.
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(weights))

    def reduce_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column=0):
            found = [sorted(shared.value & _counted(t)[1].keys()) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["terms"])

    texts = [r["terms"] for r in rows.filter("toxic = 1").select("text").mapInArrow(reduce_text, "terms array<string>").collect()]
    return {t: weights[t] for t in choose_terms(texts, weights)}


def choose_terms(texts: list[list[str]], weights: dict[str, float]) -> list[str]:
    """Greedy cover: always the term in most texts that are not explained; of equals the one of most weight, then the longest, then the first."""
    chosen: list[str] = []
    left = [(set(terms), ENTRIES_A_TEXT) for terms in texts]
    while True:
        counts = Counter(t for terms, _ in left for t in terms)
        best = min(counts, key=lambda t: (-counts[t], -weights[t], -len(t.rstrip("*")), t), default=None)
        if best is None or counts[best] < LEXICON_TEXTS:
            return chosen
        chosen.append(best)
        stem = best.rstrip("*")
        following = []
        for terms, wanted in left:
            if best in terms:
                # Other spellings of the same entry explain nothing more.
                terms = {t for t in terms if not t.rstrip("*").startswith(stem) and not stem.startswith(t.rstrip("*"))}
                wanted -= 1
            if wanted and terms:
                following.append((terms, wanted))
        left = following


class Measurer:
    """Turns slices of texts into feature rows; what is known of a token is remembered."""

    # Per token: letters, capitals, marks, exclamation marks, second person, lexicon weight, found by a beginning,
    # found behind a disguise, in capitals, obfuscated, stretched, a single letter.
    WIDTH = 12

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.people = frozenset(SECOND_PERSON)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, self.WIDTH), dtype=np.float32)

    def weight(self, words: Iterable[str]) -> tuple[float, bool]:
        """The largest weight of the words' terms, and whether it comes from a beginning."""
        best, lexicon = (0.0, True), self.lexicon
        for word in words:
            for term in _terms(word):
                if term in lexicon:
                    best = max(best, (lexicon[term], not term.endswith("*")))
        return best[0], not best[1]

    def describe(self, token: str) -> tuple[float, ...]:
        core = token.strip(_OUTSIDE)
        if core.isalpha():
            # A word with nothing inside that could be a disguise, but perhaps stretched.
            low = core.lower()
            stretched = _STRETCHED.search(low) is not None
            weight, beginning = self.weight((low,))
            disguised = False
            if stretched and not weight:
                weight, beginning = self.weight((_STRETCHED.sub(r"\1", low),))
                disguised = weight > 0
            letters, mixed, person = len(core), False, low in self.people
            capitals = 0 if core == low else sum(map(str.isupper, core))
        else:
            plain, undone = spellings(token)
            weight, beginning = self.weight(plain)
            disguised = False
            if not weight and undone:
                weight, beginning = self.weight(undone)
                disguised = weight > 0
            letters, capitals = sum(map(str.isalpha, token)), sum(map(str.isupper, token))
            mixed, stretched = _MIXED.search(token) is not None, _STRETCHED.search(token.lower()) is not None
            person = not self.people.isdisjoint(plain)
        marks = len(token) - letters if letters == len(core) else sum(not c.isalnum() for c in token)
        single, shouted = letters == 1 and len(token) == 1, letters > 1 and capitals == letters
        return (
            letters, capitals, marks, token.count("!"), person, weight, beginning and weight > 0, disguised, shouted, mixed, stretched, single
        )

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.index) > MEMORY_WORDS:
            self._forget()
        tokens: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            parts = text.split() if text else []
            tokens += parts
            counts[i] = len(parts)
        which = np.fromiter(map(self.index.get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
        unseen = np.flatnonzero(which < 0).tolist()
        if unseen:
            fresh = list(dict.fromkeys(tokens[i] for i in unseen))
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))
            facts = np.fromiter(chain.from_iterable(map(self.describe, fresh)), dtype=np.float32, count=len(fresh) * self.WIDTH)
            self.table = np.concatenate([self.table, facts.reshape(-1, self.WIDTH)])
            which[unseen] = [self.index[tokens[i]] for i in unseen]
        facts = self.table[which]
        doc = np.repeat(np.arange(len(texts)), counts)

        def total(values: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
            return np.bincount(doc[rows], weights=values, minlength=len(texts))

        letters, capitals, marks, calls, person, weight, beginning, disguised, shouted, mixed, stretched, single = facts.T
        sums, tops = total(weight), np.zeros(len(texts))
        hits = np.flatnonzero(weight > 0)
        np.maximum.at(tops, doc[hits], weight[hits])
        hit_count = total(np.ones(len(hits)), hits)
        # Lexicon words with a second person at most NEAR words away in the same text.
        close = np.zeros(len(hits), dtype=bool)
        for step in (*range(-NEAR, 0), *range(1, NEAR + 1)):
            other = np.clip(hits + step, 0, max(0, len(doc) - 1))
            close |= (person[other] > 0) & (doc[other] == doc[hits]) & (other != hits)
        near = total(close, hits)
        spaced = np.zeros(len(texts))
        for begin, end in self._runs(single > 0, doc):
            owner = doc[begin]
            spaced[owner] += 1
            found, _ = self.weight(("".join(tokens[begin:end]).lower(),))
            if found:
                hit_count[owner] += 1
                sums[owner] += found
                tops[owner] = max(tops[owner], found)
        n, all_letters = np.maximum(counts, 1), np.maximum(total(letters), 1)
        return np.column_stack(
            [
                hit_count / n, np.log1p(hit_count), tops, sums / n, total(beginning[hits], hits) / n, total(disguised) / n, near / n,
                total(person) / n, total(capitals) / all_letters, total(shouted) / n, total(shouted[hits], hits), total(calls) / n,
                total(marks) / n, total(mixed) / n, total(stretched) / n, spaced / n, np.log1p(counts),
            ]
        )

    @staticmethod
    def _runs(single: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
        places = np.flatnonzero(single)
        if len(places):
            breaks = np.flatnonzero((np.diff(places) > 1) | (doc[places[1:]] != doc[places[:-1]])) + 1
            for run in np.split(places, breaks):
                if len(run) >= SPACED_LETTERS:
                    yield int(run[0]), int(run[-1]) + 1


def features(spark: SparkSession, docs: DataFrame, lexicon: dict[str, float], text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with `features array<double>`, in the order of `FEATURES`. Null and empty texts have zeros only."""
    shared = spark.sparkContext.broadcast(lexicon)

    def start() -> Callable:
        measure = Measurer(shared.value)

        def work(texts: list[str | None]) -> list[pa.Array]:
            values = measure(texts)
            offsets = np.arange(len(texts) + 1) * len(FEATURES)
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel()))]

        return work

    return with_arrays(docs, text_column, start, "features array<double>", keep, SMALL_SLICE_ROWS)


@dataclass
class ToxicityModel:
    """A lexicon with trees and their calibration; without trees every score is `base`."""

    lexicon: dict[str, float]
    base: float
    fitted: PipelineModel | None = None


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of about `rows` labelled ids at most, chosen by a hash of the id.

    A label other than 0 and 1 is none, an id with both is toxic. Only the chosen ids are broadcast. Of rows with equal texts one is kept.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    # Hash values below the share of their range: the number kept is `rows` up to a small deviation.
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("digest", F.xxhash64("text"))
    # Copies may be any share of the rows: they are counted out on digests before texts move.
    return texts.groupBy("digest").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fits on `docs` (doc_id, text) joined to `labels` (doc_id, toxic); other columns are not read.

    Without rows of both classes the score of every text is the share of toxic rows (0 without rows).
    """
    sample = stage(labelled_sample(docs, labels, rows), "labelled")
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    base = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return ToxicityModel({}, base)
    lexicon = learn_lexicon(sample)
    measured = features(spark, sample, lexicon, keep=["digest", "toxic"])
    measured = stage(measured.select("digest", "toxic", array_to_vector("features").alias("features")), "measured").coalesce(8)
    held = F.pmod("digest", F.lit(CALIBRATION_PART)) == 0
    fit, rest = measured.filter(~held), measured.filter(held)
    if fit.select("toxic").distinct().count() < 2 or rest.select("toxic").distinct().count() < 2:
        fit = rest = measured
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(fit)
    trees.setPredictionCol("tree_class").setRawPredictionCol("tree_margin").setProbabilityCol("tree_probability")
    raw = _with_raw(trees.transform(rest))
    calibration = IsotonicRegression(labelCol="toxic", featuresCol="raw", predictionCol="calibrated").fit(raw)
    return ToxicityModel(lexicon, base, PipelineModel([trees, calibration]))


def _with_raw(df: DataFrame) -> DataFrame:
    return df.withColumn("raw", vector_to_array("tree_probability")[1])


def score(spark: SparkSession, docs: DataFrame, model: ToxicityModel, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with `score double` in 0 to 1 and `predicted int`, 1 from `THRESHOLD` on.

    Only the text is an input. Rows are scored on their own, so repeated rows get equal scores; columns with these names are replaced.
    """
    carried = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    if model.fitted is None:
        rows = docs.select(*carried, F.lit(model.base).alias("score"))
    else:
        trees, calibration = model.fitted.stages
        shown, names, text = numbered(docs, carried, text_column)
        rows = features(spark, shown, model.lexicon, text, names).withColumn("features", array_to_vector("features"))
        rows = calibration.transform(_with_raw(trees.transform(rows)))
        blended = F.col("calibrated") * (1 - ORDER_WEIGHT) + F.col("raw") * ORDER_WEIGHT
        rows = rows.select(*[F.col(n).alias(c) for n, c in zip(names, carried)], F.least(F.greatest(blended, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
