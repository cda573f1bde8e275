"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone. The vector of an n-gram binds the
vectors of its letters, each permuted by its place, by multiplication; a text bundles (adds) its n-grams, and
a language bundles its texts. A text has the language whose profile has the largest cosine with it.

Learning is one aggregation: tasks bundle the counts of their rows and Spark adds up (language, dimension) sums,
which are whole numbers and so do not depend on the order. Only the profiles come to the driver: one vector
for each language code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SMALL_SLICE_ROWS, slices, with_arrays

DIMENSIONS = 1024
GRAM = 3
SEED = 20
UNKNOWN = "und"
# A text's n letters and word gaps make cosine c with its language where 1 / c^2 is about 1 + spread / n: noise of a bundle
# falls with its size. A text is known if 1 / c^2 <= 1 + level + spread / n. Both numbers are measured on labelled rows that the
# profiles have not seen: `SPREAD_TIMES` the spread that `KNOWN_SHARE` of them keep to, and the level at which the
# cosine is `LEVEL_TIMES` the one that this share reaches.
KNOWN_SHARE, SPREAD_TIMES, LEVEL_TIMES = 0.99, 4.0, 0.5
# Steps of the logarithm to base 2 in which rows are counted to measure that share.
STEPS = 32
# N-gram vectors made at a time.
GRAMS_AT_A_TIME = 2048


class Bundler:
    """Bundles texts; letter vectors are remembered."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED):
        self.dimensions, self.gram, self.seed = dimensions, gram, seed
        self.letters: dict[int, np.ndarray] = {}
        # Letters and word gaps of each text of the last call.
        self.spelled = np.zeros(0, dtype=np.int64)
        # Letters in lower case; everything else parts words and is written as a space.
        self.folded = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(0x110000)], dtype=np.uint32)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.default_rng([self.seed, point]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return self.letters[point]

    def __call__(self, texts: list[str | None], owner: np.ndarray | None = None, owners: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The bundle of each text (or of the texts of each owner), and which texts have a letter."""
        owner = np.arange(len(texts)) if owner is None else owner
        owners = len(texts) if owners is None else owners
        spelled = [f" {t} " if t else " " for t in texts]
        points = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letters = self.folded[points]
        sizes = np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled))
        text = np.repeat(np.arange(len(texts)), sizes)
        # One space between words, at the beginning and at the end.
        keep = np.r_[True, (letters[1:] != 32) | (letters[:-1] != 32) | (text[1:] != text[:-1])] if len(letters) else np.zeros(0, dtype=bool)
        letters, text = letters[keep], text[keep]
        lettered = np.bincount(text[letters != 32], minlength=len(texts)) > 0
        self.spelled = np.bincount(text, minlength=len(texts))

        known = np.flatnonzero(np.bincount(letters, minlength=1))
        number = np.zeros(int(known[-1]) + 1 if len(known) else 1, dtype=np.int64)
        number[known] = np.arange(len(known))
        coded = number[letters]
        size, span = len(known), len(coded) - self.gram + 1
        result = np.zeros((owners, self.dimensions))
        if span <= 0:
            return result, lettered
        grams = reduce(lambda code, k: code * size + coded[k : k + span], range(1, self.gram), coded[:span])
        whole = text[:span] == text[self.gram - 1 :]
        keys = np.sort(owner[text[:span][whole]] * size**self.gram + grams[whole])
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.r_[first, len(keys)]).astype(np.float32)
        row, gram = np.divmod(keys[first], size**self.gram)

        distinct, at = np.unique(gram, return_inverse=True)
        vectors = np.stack([self.letter(int(p)) for p in known]) if size else np.zeros((0, self.dimensions), dtype=np.int8)
        placed = [np.roll(vectors, self.gram - 1 - k, axis=1) for k in range(self.gram)]
        for begin in range(0, len(distinct), GRAMS_AT_A_TIME):
            part = distinct[begin : begin + GRAMS_AT_A_TIME]
            digits = [part // size ** (self.gram - 1 - k) % size for k in range(self.gram)]
            bound = reduce(np.multiply, [p[d] for p, d in zip(placed, digits)]).astype(np.float32)
            inside = np.flatnonzero((at >= begin) & (at < begin + GRAMS_AT_A_TIME))
            rows, starts = np.unique(row[inside], return_index=True)
            for r, entries in zip(rows.tolist(), np.split(inside, starts[1:])):
                result[r] += counts[entries] @ bound[at[entries] - begin]
        return result, lettered


def learn_profiles(docs: DataFrame, label_column: str = "lang", text_column: str = "text") -> dict[str, np.ndarray]:
    """The bundle of each language; rows with a null label or text teach nothing, and neither do texts without letters."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(), {}
        for part in slices(batches, SMALL_SLICE_ROWS, column=1):
            labels, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            names = sorted(set(labels))
            owner = np.array([names.index(x) for x in labels], dtype=np.int64)
            vectors, _ = bundler(texts, owner, len(names))
            for name, vector in zip(names, vectors):
                sums[name] = sums.get(name, 0) + vector.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["label", "sums"]
            )

    rows = docs.filter(F.col(label_column).isNotNull() & F.col(text_column).isNotNull())
    rows = rows.select(F.col(label_column).cast("string"), text_column).mapInArrow(bundle, "label string, sums array<bigint>")
    totals = rows.select("label", F.posexplode("sums").alias("place", "value")).groupBy("label", "place").agg(F.sum("value").alias("value"))
    profiles: dict[str, np.ndarray] = {}
    for label, place, value in totals.collect():
        profiles.setdefault(label, np.zeros(DIMENSIONS))[place] = value
    return {label: v for label, v in sorted(profiles.items()) if v.any()}


def identify(
    spark: SparkSession, docs: DataFrame, profiles: dict[str, np.ndarray], text_column: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """`docs` with `lang_pred string`, `score double`, the cosine with that language's profile, at least 0, and
    `spelled bigint`, the letters and word gaps it comes from.

    A text that is null or has no letter is `und` with score 0, as is every text if there is no profile. Equal
    cosines go to the first language in order of names. Whole texts count; columns with these names are replaced.
    """
    shared = spark.sparkContext.broadcast((list(profiles), [v.tolist() for v in profiles.values()]))

    def start() -> Callable:
        names, vectors = shared.value
        unit = np.array(vectors, dtype=np.float64).reshape(len(names), DIMENSIONS)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        bundler = Bundler()

        def work(texts: list[str | None]) -> list[pa.Array]:
            bundles, lettered = bundler(texts)
            length = np.linalg.norm(bundles, axis=1)
            usable = lettered & (length > 0) & bool(names)
            cosines = (bundles @ unit.T) / np.where(length > 0, length, 1)[:, None] if names else np.zeros((len(texts), 1))
            best = cosines.argmax(axis=1)
            score = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
            labels = [names[b] if u else UNKNOWN for b, u in zip(best.tolist(), usable.tolist())]
            return [pa.array(labels, pa.string()), pa.array(np.where(usable, score, 0.0)), pa.array(bundler.spelled.astype(np.int64))]

        return work

    return with_arrays(docs, text_column, start, "lang_pred string, score double, spelled bigint", keep, SMALL_SLICE_ROWS)


@dataclass(frozen=True)
class Border:
    """What a text must reach to be known; the defaults are for a table without rows to measure."""

    level: float = 24.0
    spread: float = 5500.0

    def known(self) -> Column:
        """Whether a row of `identify` resembles a profile: not so random letters and languages without a profile."""
        score = F.col("score")
        enough = F.try_divide(F.lit(1.0), score * score) <= 1 + self.level + self.spread / F.greatest("spelled", F.lit(1))
        return (F.col("lang_pred") != UNKNOWN) & (score > 0) & enough


def learn_border(rows: DataFrame, label_column: str = "lang") -> Border:
    """The border from rows of `identify` that the profiles have not learned from; those whose label was not found do not count."""
    right = rows.filter((F.col(label_column) == F.col("lang_pred")) & F.col("score").between(1e-6, 1 - 1e-6))
    noise = F.lit(1.0) / (F.col("score") * F.col("score")) - 1
    measures = F.explode(F.array(F.struct(F.lit(0).alias("of"), noise.alias("value")), F.struct(F.lit(1).alias("of"), (noise * F.col("spelled")).alias("value"))))
    steps = right.select(measures.alias("m")).select("m.of", F.round(F.log2("m.value") * STEPS).cast("int").alias("step"))
    # At most a few thousand steps reach the driver.
    counts: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for of, step, n in steps.groupBy("of", "step").agg(F.count(F.lit(1))).collect():
        counts[of][step] = n
    if not counts[0]:
        return Border()

    def share(of: int) -> float:
        seen = 0
        for step in sorted(counts[of]):
            seen += counts[of][step]
            if seen >= KNOWN_SHARE * sum(counts[of].values()):
                return 2 ** (step / STEPS)

    return Border((1 + share(0)) / LEVEL_TIMES**2 - 1, SPREAD_TIMES * share(1))
