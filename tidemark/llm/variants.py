"""Spelling variants by finite-state composition.

The vocabulary is a minimised acceptor A. Composed with a transducer T that makes exactly one edit (a code point
replaced, inserted or deleted) and with A again, it accepts the pairs of words that are one edit apart. The
composition is enumerated for one initial state at a time: an edit leaves the first or the second half of a
word alone, so a pair is read by the forward acceptor from the state its common first half leads to, or by the
acceptor of reversed words from the state its common second half leads to. Each pair belongs to one of the two.

Words of one initial state come together by a shuffle, sorted, and a task reads them one state after the
other. States of more than `MOST_WORDS` words are cut into slices, and every two slices meet, so a task never
holds more than two slices; the words of a slice are sent once for each slice, and no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.staging import stage

# Words of one slice of an initial state.
MOST_WORDS = 20_000
LEAST_LENGTH, LEAST_COUNT = 7, 2
# A form is that much more frequent than the word it stands for.
TIMES = 10
RUN = r"[A-Za-z\u00C0-\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Acceptor:
    """The minimal acyclic acceptor of a sorted list of different words (Daciuk et al., 2000).

    State i has `arcs[i]`, symbol to state in order, and `final[i]`. Equal right languages are one state, so equal
    states accept the same words.
    """

    def __init__(self, words: Sequence[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        register: dict[tuple, int] = {}

        def settle(arcs: dict[str, int], final: bool) -> int:
            key = (final, *arcs.items())
            state = register.get(key)
            if state is None:
                state = register[key] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            return state

        # The states along the last word, not yet settled: their settled arcs and whether they are final.
        open_arcs: list[dict[str, int]] = [{}]
        open_final = [False]
        last = ""

        def close(depth: int) -> None:
            while len(open_arcs) > depth + 1:
                state = settle(open_arcs.pop(), open_final.pop())
                open_arcs[-1][last[len(open_arcs) - 1]] = state

        for word in words:
            common = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                common += 1
            close(common)
            for _ in word[common:]:
                open_arcs.append({})
                open_final.append(False)
            open_final[-1] = True
            last = word
        close(0)
        self.start = settle(open_arcs[0], open_final[0])


class Composition:
    """A after T after A, explored from one initial state; what two states accept in common is found once."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self.shared: dict[tuple[int, int], list[str]] = {}
        self.edits: dict[int, list[tuple[str, str]]] = {}

    def common(self, left: int, right: int) -> list[str]:
        """All words that both states accept: the states (left, right) of the composition after the edit."""
        key = (left, right) if left <= right else (right, left)
        found = self.shared.get(key)
        if found is None:
            one, two = self.a.arcs[key[0]], self.a.arcs[key[1]]
            found = [""] if self.a.final[key[0]] and self.a.final[key[1]] else []
            for symbol, state in one.items():
                other = two.get(symbol)
                if other is not None:
                    found += [symbol + rest for rest in self.common(state, other)]
            self.shared[key] = found
        return found

    def edited(self, state: int) -> list[tuple[str, str]]:
        """The pairs whose edit is made in this state: replacements in both orders of symbols once, and a symbol left out."""
        found = self.edits.get(state)
        if found is None:
            found = []
            arcs = list(self.a.arcs[state].items())
            for i, (symbol, target) in enumerate(arcs):
                for other, beside in arcs[:i]:
                    found += [(symbol + rest, other + rest) for rest in self.common(target, beside)]
                found += [(symbol + rest, rest) for rest in self.common(target, state)]
            self.edits[state] = found
        return found

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Accepted pairs, depth first over the prefixes before the edit. A pair may come twice if its edit has several places."""
        todo = [(self.a.start, "")]
        while todo:
            state, prefix = todo.pop()
            for one, two in self.edited(state):
                yield prefix + one, prefix + two
            todo += [(target, prefix + symbol) for symbol, target in self.a.arcs[state].items()]


def one_edit_pairs(rests: Sequence[str]) -> set[tuple[str, str]]:
    """All (larger, smaller) pairs of `rests`, sorted and different, that are one edit apart; larger is the longer, else the later."""
    return {(x, y) if (len(x), x) > (len(y), y) else (y, x) for x, y in Composition(Acceptor(rests)).pairs()}


def owned(longer: str, shorter: str, half: int, forward: bool) -> bool:
    """Whether the pair is read forward: its edit is not in the first `half` code points. Else it is read backward."""
    return (longer[:half] == shorter[:half]) == forward


def states(words: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(state, block, word): each word under the initial states in which it can be one of a near pair.

    A pair whose shorter word has m code points agrees in the first m div 2 or in the last m - m div 2; a word of
    n code points is in pairs with m = n and m = n - 1. States with one word are left out.
    """
    keys = []
    for m in (F.char_length("word"), F.char_length("word") - 1):
        first = F.floor(m / 2).cast("int")
        for forward, half in ((True, F.substring("word", F.lit(1), first)), (False, F.right(F.col("word"), m - first))):
            keys.append(F.struct(m.alias("m"), F.lit(forward).alias("forward"), half.alias("half")))
    rows = words.select("word", F.explode(F.array(*keys)).alias("state"))
    held = rows.groupBy("state").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    rows = rows.join(held, "state").withColumn("slices", F.ceil(F.col("held") / most_words).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high")))
    return rows.select("state", "word", own.alias("slice"), F.explode(met).alias("block"))


def near_pairs(words: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(longer, shorter): every two different words of `words` (word) that are one edit apart, once.

    Words are not null, different, and have at least two code points.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple[str, int]] = []

        def pairs() -> Iterator[tuple[str, str]]:
            (m, forward, half), (low, high) = key
            cut = len(half)
            rests = {(w[cut:] if forward else w[::-1][cut:]): (w, s) for w, s in held}
            for one, two in one_edit_pairs(sorted(rests)):
                (longer, a), (shorter, b) = rests[one], rests[two]
                # In a block of two slices only pairs across them count; a slice's own pairs are in its own block.
                if len(shorter) != m or (low != high and a == b):
                    continue
                if longer < shorter and len(longer) == len(shorter):
                    longer, shorter = shorter, longer
                if owned(longer, shorter, m // 2, forward):
                    yield longer, shorter

        def batch(found: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.string()) for i in (0, 1)], names=["longer", "shorter"])

        found: list[tuple[str, str]] = []
        for part in batches:
            columns = [part.column(i).to_pylist() for i in range(part.num_columns)]
            for m, forward, half, low, high, word, own in zip(*columns):
                now = ((m, forward, half), (low, high))
                if now != key:
                    if len(held) > 1:
                        found += pairs()
                    key, held = now, []
                held.append((word, own))
                if len(found) > 50_000:
                    yield batch(found)
                    found = []
        if len(held) > 1:
            found += pairs()
        yield batch(found)

    rows = states(words, most_words).select("state.m", "state.forward", "state.half", "block.low", "block.high", "word", "slice")
    keys = ["m", "forward", "half", "low", "high"]
    # A stated number of partitions is kept: the rows are few bytes each, but much work.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(read, "longer string, shorter string")


def spelled(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", every: int = 31, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word): every maximal run of letters, A-Z lower-cased, in which one in `every` (by a checksum of id and run) lacks a code point.

    Words of fewer than `least_length` code points are left out. A null text has no words, and a null id counts as empty.
    """
    run = F.col("run")
    low = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(F.col(text_column), _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    ).filter(F.char_length("run") >= least_length)
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return low.select(F.when(h % every == 0, less).otherwise(run).alias("word")).filter(F.char_length("word") >= least_length)


def vocabulary(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): different words with their occurrences, those of fewer than `least_count` left out."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _roots(forms: DataFrame, most: int, times: int) -> DataFrame:
    """(word, root): forms followed to the last. Each form is `times` as frequent, which bounds the length of a chain."""
    steps = (math.floor(math.log(max(most, times), times)) + 2)
    links = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        links = stage(links.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "roots")
    return links


def spelling_variants(words: DataFrame, times: int = TIMES, most_words: int = MOST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of `words` (word, n).

    A word's form is its most frequent near word, the first in code-point order of equals, if that is `times` as
    frequent; else null. The root is reached by following forms; a word without one is its own. Words without
    near words have n_near 0. An empty table gives no rows.
    """
    words = stage(words.select("word", "n"), "vocabulary")
    pairs = stage(near_pairs(words, most_words), "pairs")
    ends = pairs.select(F.col("longer").alias("word"), F.col("shorter").alias("near"))
    ends = ends.unionByName(pairs.select(F.col("shorter").alias("word"), F.col("longer").alias("near")))
    counted = ends.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"), F.count(F.lit(1)).alias("n_near"))
    chosen = words.join(best, "word", "left").withColumn("far", -F.col("best.less") >= F.col("n") * times)
    forms = stage(
        chosen.select(
            "word",
            "n",
            F.when(F.col("far"), F.col("best.near")).alias("form"),
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(F.col("far"), -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    most = forms.agg(F.max("n")).first()[0] or 1
    return forms.join(_roots(forms, most, times), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
