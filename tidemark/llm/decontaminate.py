"""Benchmark decontamination with suffix arrays of the training text.

The words of a slice of documents form one array of numbers, and the suffixes that can begin a match are
sorted: a suffix array, sparse because a suffix that has a word no item has among its first words cannot
match. Every suffix of every test item is then found in it by binary search: the range of its first words
gives all places. Places that continue each other along one item are joined to the longest verbatim matches.

Documents are never compared with each other, so copies and shared passages cost no more than other rows.
Test items are broadcast in blocks of a bounded size; a table of more blocks takes a pass over the documents
for each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.staging import stage
from tidemark.llm.common import numbered, with_arrays

WINDOW_WORDS = 10
# Bytes of item texts in one broadcast block.
BLOCK_BYTES = 8_000_000
# Places that are joined to matches at a time, if one item does not have more.
PLACES_AT_A_TIME = 1_000_000
MADE = (
    "n_words bigint, hits array<struct<start: bigint, length: bigint>>, item_ids array<bigint>, "
    "matches array<struct<item_id: bigint, item_start: bigint, doc_start: bigint, length: bigint>>"
)
# Letters A-Z become lower-case, digits and bytes above 127 stay, and all other ASCII bytes part words.
_SPELLING = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SPELLING).split() if text else []


def test_block(items: list[tuple[int | None, str | None]], window: int) -> dict:
    """What tasks need of a block of items: word numbers, and for each window length its distinct windows and where they stand.

    Items with the same words are one class, named by its smallest id.
    """
    classes: dict[tuple[bytes, ...], set] = {}
    for item, text in items:
        if found := tuple(words(text)):
            classes.setdefault(found, set()).add(item)
    number = {w: i for i, w in enumerate(sorted({w for c in classes for w in c}), 1)}
    by_length: dict[int, tuple[list, dict]] = {}
    for c, found in enumerate(classes):
        numbers = [number[w] for w in found]
        length = min(window, len(numbers))
        entries, seen = by_length.setdefault(length, ([], {}))
        for start in range(len(numbers) - length + 1):
            key = tuple(numbers[start : start + length])
            entries.append((seen.setdefault(key, len(seen)), c, start))
    return {
        "number": number,
        "ids": [sorted(i for i in ids if i is not None) for ids in classes.values()],
        "windows": {n: (np.array(list(seen), dtype=">i4"), np.array(entries, dtype=np.int64)) for n, (entries, seen) in by_length.items()},
    }


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as strings of bytes, which sort as the rows do."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * 4}").ravel()


def suffix_array(numbers: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of `length` words, and their places, of all suffixes that begin with so many known words."""
    unknown = np.r_[0, np.cumsum(numbers == 0)]
    places = np.flatnonzero(unknown[length:] == unknown[:-length])
    if not len(places):
        return np.zeros(0, dtype=f"S{length * 4}"), places
    keys = _as_keys(np.lib.stride_tricks.sliding_window_view(numbers, length)[places].astype(">i4"))
    order = np.argsort(keys, kind="stable")
    return keys[order], places[order]


def _runs(kind: np.ndarray, start: np.ndarray, place: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Rows (class, start, place, windows): neighbours of one class on one diagonal, of which each goes on where the last ends, as one."""
    line = place - start
    order = np.lexsort((start, line, kind))
    kind, start, line, place, many = kind[order], start[order], line[order], place[order], many[order]
    goes_on = (kind[1:] == kind[:-1]) & (line[1:] == line[:-1]) & (start[1:] == start[:-1] + many[:-1])
    first = np.flatnonzero(np.r_[True, ~goes_on]) if len(kind) else np.zeros(0, dtype=np.int64)
    return np.column_stack([kind[first], start[first], place[first], np.add.reduceat(many, first) if len(first) else first])


def _place_cuts(window: np.ndarray, low: np.ndarray, high: np.ndarray, places: np.ndarray) -> list[int]:
    """Borders of stretches of the text in each of which the entries' windows have up to `PLACES_AT_A_TIME` places in all."""
    different, entries = np.unique(window, return_counts=True)
    many = high[different] - low[different]
    where = places[_ranges(low[different], many)]
    order = np.argsort(where, kind="stable")
    total = np.cumsum(np.repeat(entries, many)[order])
    cuts = np.flatnonzero(total[1:] // PLACES_AT_A_TIME != total[:-1] // PLACES_AT_A_TIME) + 1
    return [0, *np.unique(where[order[cuts]]).tolist(), int(where.max()) + 1]


def longest_matches(numbers: np.ndarray, block: dict) -> np.ndarray:
    """Rows (class, start in the item, start in `numbers`, words) of all maximal matches of a window or more.

    Windows that are frequent in item and text are followed one stretch of the text after the other, and the matches
    that cross a border are put together, so memory is that of the matches and of a stretch.
    """
    found = [np.zeros((0, 4), dtype=np.int64)]
    for length, (windows, entries) in block["windows"].items():
        keys, places = suffix_array(numbers, length)
        wanted = _as_keys(windows)
        low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        counts = (high - low)[entries[:, 0]]
        entries, counts = entries[counts > 0], counts[counts > 0]
        class_ends = np.flatnonzero(np.r_[entries[1:, 1] != entries[:-1, 1], True]) + 1 if len(entries) else np.zeros(0, dtype=np.int64)
        before = np.r_[0, np.cumsum(counts)]
        begin = 0
        while begin < len(entries):
            fits = class_ends[(class_ends > begin) & (before[class_ends] - before[begin] <= PLACES_AT_A_TIME)]
            end = fits[-1] if len(fits) else class_ends[class_ends > begin][0]
            window, kind, start = entries[begin:end].T
            cuts = [0, len(numbers)] if len(fits) else _place_cuts(window, low, high, places)
            parts = []
            for first, last in zip(cuts, cuts[1:]):
                a, b = low, high
                if len(cuts) > 2:
                    a, b = low.copy(), high.copy()
                    for w in np.unique(window).tolist():
                        inside = places[low[w] : high[w]]
                        a[w], b[w] = low[w] + np.searchsorted(inside, first), low[w] + np.searchsorted(inside, last)
                many = (b - a)[window]
                place = places[_ranges(a[window], many)]
                parts.append(_runs(np.repeat(kind, many), np.repeat(start, many), place, np.ones(len(place), dtype=np.int64)))
            runs = _runs(*np.concatenate(parts).T) if len(parts) > 1 else parts[0]
            runs[:, 3] += length - 1
            found.append(runs)
            begin = end
    return np.concatenate(found)


def _lists(values: pa.Array, owner: np.ndarray, size: int) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=size))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _structs(**columns: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))


def match_texts(texts: list[str | None], block: dict) -> list[pa.Array]:
    number = block["number"]
    flat: list[int] = []
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, text in enumerate(texts):
        flat += [number.get(w, 0) for w in words(text)]
        flat.append(0)  # no match goes on into the next text
        starts[i + 1] = len(flat)
    numbers = np.array(flat, dtype=np.int32)
    matches = longest_matches(numbers, block)
    kind, item_start, place, length = matches.T
    doc = np.searchsorted(starts, place, "right") - 1

    change = np.zeros(len(numbers) + 1, dtype=np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + length, -1)
    covered = np.r_[False, np.cumsum(change[:-1]) > 0, False]
    begins, ends = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])
    span_doc = np.searchsorted(starts, begins, "right") - 1

    # Distinct (text, class), then the different ids of a text's classes.
    pairs = np.unique(doc * max(1, len(block["ids"])) + kind)
    pair_doc, pair_class = np.divmod(pairs, max(1, len(block["ids"])))
    ids = [block["ids"][c] for c in pair_class.tolist()]
    id_doc = np.repeat(pair_doc, [len(i) for i in ids]) if ids else np.zeros(0, dtype=np.int64)
    # An item may have several texts, and so several classes: a text lists its id once.
    listed = dict.fromkeys(zip(id_doc.tolist(), (i for group in ids for i in group)))
    id_doc = np.fromiter((d for d, _ in listed), dtype=np.int64, count=len(listed))

    order = np.lexsort((length, kind, place))  # by place, and so by text
    kind, item_start, place, length, doc = (x[order] for x in (kind, item_start, place, length, doc))
    named = pa.array([block["ids"][c][0] if block["ids"][c] else None for c in kind.tolist()], pa.int64())
    places = pa.StructArray.from_arrays(
        [named, *(pa.array(x, pa.int64()) for x in (item_start, place - starts[doc], length))],
        names=["item_id", "item_start", "doc_start", "length"],
    )
    return [
        pa.array(np.diff(starts) - 1, pa.int64()),
        _lists(_structs(start=begins - starts[span_doc], length=ends - begins), span_doc, len(texts)),
        _lists(pa.array([i for _, i in listed], pa.int64()), id_doc, len(texts)),
        _lists(places, doc, len(texts)),
    ]


def _merged(columns: list[str]) -> list:
    """Columns after a further block: spans united, ids and matches put together."""
    spans = (
        "aggregate(array_sort(concat(hits, _hits)), cast(array() as array<struct<start: bigint, length: bigint>>), (done, x) -> "
        "if(size(done) = 0 or element_at(done, -1).start + element_at(done, -1).length < x.start, concat(done, array(x)), "
        "concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'length', "
        "greatest(element_at(done, -1).start + element_at(done, -1).length, x.start + x.length) - element_at(done, -1).start)))))"
    )
    return [
        *[F.col(c) for c in columns],
        F.col("n_words"),
        F.expr(spans).alias("hits"),
        F.array_distinct(F.concat("item_ids", "_item_ids")).alias("item_ids"),
        F.concat("matches", "_matches").alias("matches"),
    ]


def find_contamination(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW_WORDS,
    text_column: str = "text",
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` with the verbatim matches of `items` (item_id, text): the columns of `MADE`.

    A window is `window` consecutive words of an item; an item of fewer words is one window as a whole, and
    one of none has none. `hits` are the spans of words that lie in any occurrence of a window, `item_ids`
    the items with an occurring window, `matches` the longest matches, one for each class of items with equal words
    (named by the smallest id) and place. Null and empty texts have no words and no matches. An item without
    an id marks words but is not listed. Repeated rows are kept; columns with the name of a made one are replaced.
    """
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    made = ["n_words", "hits", "item_ids", "matches"]
    carried = [c for c in (docs.columns if keep is None else keep) if c not in made]
    # Several passes keep their own columns beside one column for all that is carried.
    rows = docs.select(F.struct(*carried).alias("row"), docs[text_column].alias("text")) if blocks > 1 else docs
    for k in range(blocks):
        of_block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(test_block([tuple(r) for r in of_block.collect()], window))

        def start(shared=shared) -> Callable:
            return lambda texts: match_texts(texts, shared.value)

        if blocks == 1:
            return with_arrays(docs, text_column, start, MADE, carried)
        if k == 0:
            rows = with_arrays(rows, "text", start, MADE, ["row", "text"])
        else:
            for c in made[1:]:
                rows = rows.withColumnRenamed(c, f"_{c}")
            rows = with_arrays(rows, "text", start, MADE, ["row", "text", *(f"_{c}" for c in made[1:])])
            rows = rows.select(*_merged(["row", "text"]))
        rows = stage(rows, "decontaminated")
    return rows.select("row.*", *made)


def without_contaminated(
    spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, text_column: str = "text"
) -> DataFrame:
    """The rows of `docs` in which no window of an item occurs, with the columns of `docs`."""
    shown, names, text = numbered(docs, docs.columns, text_column)
    found = find_contamination(spark, shown, items, window, text, names)
    return found.filter(F.size("hits") == 0).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
