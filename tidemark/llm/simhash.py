"""Near-duplicate documents by SimHash fingerprints and BK-trees.

Fingerprints are 64-bit majorities of the XXH64 hashes of word shingles. Two fingerprints that differ in at
most `radius` bits agree in at least one of radius + 1 bands of bits, so the distinct fingerprints
are dealt to shards by band and band value, and every shard gets a BK-tree: children hang on their integer
Hamming distance to the parent, and a search follows only edges within the radius. A tree travels to the
fingerprints of its own shard and not to all of them: the trees together grow with the data and have no bound
that would allow a broadcast.

Shards stay bounded. In a shard of more than `SHARD_FINGERPRINTS` all members share the band, so they
differ in the other bits, and those are cut into bands again; after four levels fewer than 2**14
different fingerprints can be in a shard. Copies of a text have one fingerprint and are one entry from the start, and
a shard returns one link for each member that has one, not all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.staging import stage
from tidemark.llm.common import with_arrays
from tidemark.llm.components import components

SHINGLE_WORDS = 3
RADIUS = 2
HASH_SEED = 42
SHARD_FINGERPRINTS = 4096
LEVELS = 4
# Fingerprints whose trees are built and searched at a time, and (query, node) pairs followed at a time.
FOREST_FINGERPRINTS = 65536
FRONTIER = 2_000_000
# Shingles hashed at a time in a long text.
SHINGLES_AT_A_TIME = 65536
# A-Z become lower-case; space and the controls from tab to carriage return part words.
_SPELLING = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in more than half of the shingle hashes; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_SPELLING).split(b" ") if text else []
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    width = min(shingle_words, len(words))
    begins, stops = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for first in range(0, len(begins), SHINGLES_AT_A_TIME):
        part = slice(first, first + SHINGLES_AT_A_TIME)
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(begins[part], stops[part])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with `fingerprint bigint`, its 64 bits as a signed number; 0 for null texts and texts without words."""

    def start() -> Callable:
        def work(texts: list[str | None]) -> list[pa.Array]:
            return [pa.array(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))]

        return work

    return with_arrays(docs, text_column, start, "fingerprint bigint", keep)


# --- BK-trees ---------------------------------------------------------------------------------------------------


class Forest:
    """The BK-trees of many shards, built and searched together, level by level.

    `codes` are distinct within a shard, and `shard` is sorted. A node's key for a child at distance d is
    node * 65 + d; the sorted keys of all children are the edges of all trees.
    """

    def __init__(self, codes: np.ndarray, shard: np.ndarray):
        self.codes = codes
        self.root = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root_of = np.repeat(self.root, np.diff(np.r_[self.root, len(codes)]))
        parents, children = [], []
        members = np.setdiff1d(np.arange(len(codes)), self.root, assume_unique=True)
        parent = self.root_of[members]
        while len(members):
            key = parent * 65 + np.bitwise_count(codes[members] ^ codes[parent])
            order = np.argsort(key, kind="stable")
            members, key = members[order], key[order]
            first = np.r_[True, key[1:] != key[:-1]]
            # The first member under a key becomes the child; the others go down to it.
            parents.append(key[first])
            children.append(members[first])
            parent = np.repeat(members[first], np.diff(np.r_[np.flatnonzero(first), len(key)]))[~first]
            members = members[~first]
        keys = np.concatenate(parents) if parents else np.zeros(0, dtype=np.int64)
        order = np.argsort(keys)
        self.edges = keys[order]
        self.children = np.concatenate(children)[order] if children else keys

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(code, other code) positions of pairs of a shard within the radius, each pair at least once."""
        size = len(self.codes)
        step = max(1, FRONTIER // 64)
        for first in range(0, size, step):
            todo = [(np.arange(first, min(size, first + step)), self.root_of[first : first + step])]
            while todo:
                query, node = todo.pop()
                if len(query) > FRONTIER:
                    half = len(query) // 2
                    todo += [(query[half:], node[half:])]
                    query, node = query[:half], node[:half]
                distance = np.bitwise_count(self.codes[query] ^ self.codes[node]).astype(np.int64)
                near = (distance <= radius) & (query > node)
                if near.any():
                    yield query[near], node[near]
                # Children at distances d - radius to d + radius are neighbours in the sorted keys.
                low = np.searchsorted(self.edges, node * 65 + np.maximum(distance - radius, 0), "left")
                high = np.searchsorted(self.edges, node * 65 + np.minimum(distance + radius, 64), "right")
                count = high - low
                total = int(count.sum())
                if total:
                    ends = np.cumsum(count)
                    edge = np.repeat(low - (ends - count), count) + np.arange(total)
                    todo.append((np.repeat(query, count), self.children[edge]))


def spanning_links(codes: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """One link for each code that has one: to the first code of its component in the shard."""
    label = np.arange(len(codes))

    def settled(x: np.ndarray) -> np.ndarray:
        while True:
            y = x[x]
            if np.array_equal(x, y):
                return x
            x = y

    for a, b in Forest(codes, shard).links(radius):
        while True:
            la, lb = label[a], label[b]
            if np.array_equal(la, lb):
                break
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            label = settled(label)
    linked = np.flatnonzero(label != np.arange(len(codes)))
    return codes[linked], codes[label[linked]]


def _forest_task(radius: int) -> Callable:
    """Maps rows (shard key, code) that are sorted by shard to links; groups of whole shards are worked on together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            if not rows:
                return
            keys, codes = (np.concatenate(x) for x in zip(*held))
            # The last shard may go on in the next batch.
            cut = len(keys) if final else int(np.searchsorted(keys, keys[-1]))
            held, rows = [(keys[cut:], codes[cut:])], len(keys) - cut
            if cut:
                shard = np.cumsum(np.r_[0, keys[1:cut] != keys[: cut - 1]])
                u, v = spanning_links(codes[:cut].view(np.uint64), shard, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
            if rows >= FOREST_FINGERPRINTS:
                yield from flush(False)
        yield from flush(True)

    return work


# --- shards -----------------------------------------------------------------------------------------------------


def band_masks(radius: int, levels: int) -> list[list[int]]:
    """For each level the masks of the bits that a shard's members share, one for each path of bands.

    The free bits of a mask are cut into radius + 1 bands, and a path of the next level adds one of them.
    """
    masks = [[0]]
    for _ in range(levels):
        following = []
        for mask in masks[-1]:
            free = [b for b in range(64) if not mask >> b & 1]
            for band in np.array_split(np.array(free, dtype=np.int64), radius + 1):
                following.append(mask | sum(1 << b for b in band.tolist()))
        masks.append(following)
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def code_links(codes: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_FINGERPRINTS, levels: int = LEVELS) -> DataFrame:
    """Links (u, v) that connect all of `codes` (one column of distinct 64-bit codes) within `radius` bits of each other.

    Links are those of spanning forests of the shards: their components are those of all pairs.
    """
    code = codes.columns[0]
    masks = band_masks(radius, levels)
    open_rows = codes.select(F.col(code).alias("code"), F.lit(0).alias("path"))
    links = None
    for level in range(1, levels + 1):
        shared = F.array(*[F.lit(_signed(m)) for m in masks[level]])
        rows = (
            open_rows.select("code", "path", F.explode(F.array(*[F.lit(b) for b in range(radius + 1)])).alias("band"))
            .select("code", (F.col("path") * (radius + 1) + F.col("band")).alias("path"))
            .withColumn("shard", F.xxhash64("path", F.col("code").bitwiseAND(F.element_at(shared, F.col("path") + 1))))
        )
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        rows = stage(rows.join(sizes, "shard"), "shards")
        # At the last level the free bits bound a shard.
        small = rows.filter(F.col("size") <= shard_size) if level < levels else rows
        found = (
            small.select("shard", "code")
            .repartition("shard")
            .sortWithinPartitions("shard")
            .mapInArrow(_forest_task(radius), "u bigint, v bigint")
        )
        links = found if links is None else links.unionByName(found)
        open_rows = rows.filter(F.col("size") > shard_size).select("code", "path")
        if level == levels or open_rows.isEmpty():
            break
    return links


def near_duplicate_groups(rows: DataFrame, radius: int = RADIUS, id_column: str = "doc_id") -> DataFrame:
    """Adds `component_id` to rows with a `fingerprint`: the smallest id among all rows reachable by links.

    Rows of equal fingerprints are linked, fingerprint 0 included. Null ids are not counted as smallest; a
    component of null ids only has a null. `rows` is read twice: pass a staged table.
    """
    codes = stage(rows.groupBy("fingerprint").agg(F.min(id_column).alias("first")), "fingerprints")
    stars = components(code_links(codes.select("fingerprint"), radius))
    stars = stage(stars, "components")
    least = (
        codes.join(stars, codes["fingerprint"] == stars["node"])
        .groupBy("component")
        .agg(F.min("first").alias("least"))
    )
    known = stars.join(least, "component").select(F.col("node").alias("fingerprint"), "least")
    of_code = codes.join(known, "fingerprint", "left").select("fingerprint", F.coalesce("least", "first").alias("component_id"))
    # Written down, it is a side of its own in the last join, and a fingerprint of very many rows can be split there.
    of_code = stage(of_code, "of-code")
    return rows.drop("component_id").join(of_code, "fingerprint", "left")


def one_of_each_group(docs: DataFrame, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` without near duplicates: of each group the row with the smallest id stays, null ids last.

    Of a group's rows with that id, repeated rows included, one stays.
    """
    digest = F.xxhash64(text_column)
    keyed = docs.select(F.col(id_column).alias("doc_id"), digest.alias("digest"), F.col(text_column).alias("text"))
    marked = stage(fingerprints(keyed, "text", ["doc_id", "digest"]), "marked")
    codes = marked.groupBy("fingerprint").agg(F.min_by(F.struct("doc_id", "digest"), _last_if_null("doc_id", "digest")).alias("first"))
    codes = stage(codes, "fingerprints")
    stars = components(code_links(codes.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    kept = (
        codes.join(stars, "fingerprint", "left")
        .groupBy(F.coalesce("component", "fingerprint").alias("component"))
        .agg(F.min_by("first", _last_if_null("first.doc_id", "first.digest")).alias("first"))
        .select(F.col("first.doc_id").alias("_id"), F.col("first.digest").alias("_digest"))
    )
    kept = stage(kept, "kept")
    same = docs[id_column].eqNullSafe(F.col("_id")) & digest.eqNullSafe(F.col("_digest"))
    # Rows equal in id and text: only they are brought together to keep one.
    repeated = marked.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).count().filter("count > 1")
    repeated = stage(repeated.select("_id", "_digest"), "repeated")
    stays = docs.join(kept, same, "left_semi")
    if repeated.isEmpty():
        return stays
    once = stays.join(repeated, same, "left_semi").dropDuplicates([id_column, text_column])
    return stays.join(repeated, same, "left_anti").unionByName(once)


def _last_if_null(*columns: str) -> Column:
    return F.struct(F.col(columns[0]).isNull(), *columns)
