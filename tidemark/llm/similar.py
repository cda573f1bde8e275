"""Documents whose five-word shingles have a Jaccard similarity of 0.8 or more, by SimHash fingerprints and BK-trees.

At this similarity fingerprints of 64 bits differ in up to a dozen bits, so one code and a small radius find too few.
Each text has `PROBES` codes of its two-word shingles, in which similar texts differ less, and a code of 256 bits of
its five-word shingles. Pairs within `RADIUS` bits in any of the probe codes meet in a shard: the codes are dealt by
bands of bits, and each shard's BK-tree is searched, as for `simhash`. Of the pairs found, those near in the long code,
which leaves nearly no chance pairs, make a forest: one link joins two parts that no link joined before, so a
large group of near copies gives as many links as texts and not all its pairs. The links are checked by the shingles
themselves; components of those that hold are the groups. Where a link does not hold, another pair that it kept out of
the forest may: texts of such a component meet once more in pairs of blocks, in which all near pairs of different
groups are checked.

Shards end at `SHARD_CODES` codes: larger ones are cut by further bands, up to `simhash.LEVELS` times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.staging import stage
from tidemark.llm import simhash
from tidemark.llm.common import with_arrays
from tidemark.llm.components import components

SIMILARITY = 0.8
SHINGLE_WORDS = 5
PROBE_WORDS = 2
PROBES = 3
RADIUS = 6
LONG_CODES = 4
# Bits of the long code in which two texts of the least similarity differ on average are 39; the spread is 6.
LONG_RADIUS = 56
SHARD_CODES = 2048
# A task that checks a component with a failed link holds the shingles of two blocks of about so many texts.
BLOCK_TEXTS = 256
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words; A-Z count as lower-case, space and the controls from tab to carriage return part words."""
    words = text.encode("utf-8", "surrogatepass").translate(simhash._SPELLING).split(b" ") if text else []
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words if w], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, count: int) -> np.ndarray:
    """Sorted different hashes of `count` words in a row; of all words if there are fewer, and none without words."""
    count = min(count, len(words))
    if not count:
        return words
    total = np.zeros(len(words) - count + 1, dtype=np.uint64)
    for i in range(count):
        total = _mixed(total * _PRIME + words[i : len(words) - count + 1 + i])
    return np.unique(total)


def majority(hashes: np.ndarray, seed: int) -> int:
    """A bit is 1 if it is set in more than half of the hashes, mixed with a seed."""
    ones = np.zeros(64, dtype=np.int64)
    salt = np.uint64(seed * int(_PRIME) % 2**64)
    for first in range(0, len(hashes), simhash.SHINGLES_AT_A_TIME):
        part = _mixed(hashes[first : first + simhash.SHINGLES_AT_A_TIME] + salt).astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of 255 bits fit into a byte, in which adding is fastest.
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def codes(text: str | None) -> list[int]:
    """The probe codes of a text and the parts of its long code; all 0 without words."""
    words = word_hashes(text)
    short, long = shingles(words, PROBE_WORDS), shingles(words, SHINGLE_WORDS)
    return [majority(short, i) for i in range(PROBES)] + [majority(long, i) for i in range(LONG_CODES)]


def _listed(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _code_arrays() -> Callable:
    return lambda texts: [_listed([np.array(codes(t), dtype=np.uint64).view(np.int64) for t in texts])]


def _shingle_arrays() -> Callable:
    return lambda texts: [_listed([np.sort(shingles(word_hashes(t), SHINGLE_WORDS).view(np.int64)) for t in texts])]


def forest_links(code: np.ndarray, shard: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs that join all texts near in both codes; a pair is listed if nothing listed joins it yet."""
    label = np.arange(len(code))
    ones, others = [], []

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a, b in simhash.Forest(code, shard).links(RADIUS):
        near = np.bitwise_count(long[a] ^ long[b]).sum(axis=1) <= LONG_RADIUS
        for u, v in zip(a[near].tolist(), b[near].tolist()):
            ru, rv = root(u), root(v)
            if ru != rv:
                label[max(ru, rv)] = min(ru, rv)
                ones.append(u)
                others.append(v)
    return np.array(ones, dtype=np.int64), np.array(others, dtype=np.int64)


def _forest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maps rows (shard, node, code, long), sorted by shard, to links of nodes; whole shards are worked on together."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows
        if not rows:
            return
        keys, nodes, code, long = (np.concatenate(x) for x in zip(*held))
        # The last shard may go on in the next batch.
        cut = len(keys) if final else int(np.searchsorted(keys, keys[-1]))
        held, rows = [(keys[cut:], nodes[cut:], code[cut:], long[cut:])], len(keys) - cut
        if cut:
            shard = np.cumsum(np.r_[0, keys[1:cut] != keys[: cut - 1]])
            u, v = forest_links(code[:cut].view(np.uint64), shard, long[:cut].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["u", "v"])

    for batch in batches:
        flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, LONG_CODES)
        held.append((*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), flat))
        rows += batch.num_rows
        if rows >= simhash.FOREST_FINGERPRINTS:
            yield from flush(False)
    yield from flush(True)


def candidate_links(texts: DataFrame, shard_size: int = SHARD_CODES, levels: int = simhash.LEVELS) -> DataFrame:
    """Links (u, v) of nodes from `texts` (node, codes) that are near in a probe code and in the long code."""
    masks = simhash.band_masks(RADIUS, levels)
    long = F.slice("codes", PROBES + 1, LONG_CODES).alias("long")
    probe = F.explode(F.transform(F.sequence(F.lit(1), F.lit(PROBES)), lambda i: F.struct(i.alias("probe"), F.element_at("codes", i).alias("code"))))
    open_rows = texts.select("node", long, probe.alias("p")).select("node", "long", "p.probe", "p.code", F.lit(0).alias("path"))
    links = None
    for level in range(1, levels + 1):
        shared = F.array(*[F.lit(simhash._signed(m)) for m in masks[level]])
        rows = (
            open_rows.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(RADIUS))))
            .withColumn("path", F.col("path") * (RADIUS + 1) + F.col("band"))
            .withColumn("shard", F.xxhash64("probe", "path", F.col("code").bitwiseAND(F.element_at(shared, F.col("path") + 1))))
        )
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        rows = stage(rows.join(sizes, "shard").drop("band"), "shards")
        # At the last level the free bits bound a shard of different codes.
        small = rows.filter(F.col("size") <= shard_size) if level < levels else rows
        found = small.select("shard", "node", "code", "long").repartition("shard").sortWithinPartitions("shard")
        found = found.mapInArrow(_forest_task, "u bigint, v bigint")
        links = found if links is None else links.unionByName(found)
        open_rows = rows.filter(F.col("size") > shard_size).select("node", "long", "probe", "code", "path")
        if level == levels or open_rows.isEmpty():
            break
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def shingle_sets(docs: DataFrame, texts: DataFrame, candidates: DataFrame, text_column: str) -> DataFrame:
    """(node, shingles) of the nodes of `candidates`, of `texts` (node, key) with the md5 of the texts of `docs` as key."""
    needed = candidates.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(texts, "node").select("node", "key")
    wanted = docs.select(F.md5(F.col(text_column).cast("binary")).alias("key"), F.col(text_column).alias("text")).join(needed, "key")
    one_each = wanted.groupBy("node").agg(F.first("text").alias("text"))
    return with_arrays(one_each, "text", _shingle_arrays, "shingles array<bigint>", ["node"])


def similar_links(candidates: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The links (u, v) of `candidates` whose shingles, of `sets` (node, shingles), have the similarity."""
    both = candidates.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.filter(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v")


def block_links(
    part: np.ndarray, code: np.ndarray, shingles: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float
) -> list[tuple[int, int]]:
    """Positions of similar pairs that join the parts of all near pairs of a `left` and a `right` position."""
    label = {p: p for p in part.tolist()}

    def root(p: int) -> int:
        while label[p] != p:
            label[p] = label[label[p]]
            p = label[p]
        return p

    sizes = np.array([len(s) for s in shingles], dtype=np.int64)
    seen, flat = np.unique(np.concatenate(shingles), return_inverse=True)
    flat = np.split(flat, np.cumsum(sizes)[:-1])
    place, owner = np.concatenate([flat[j] for j in right]), np.repeat(np.arange(len(right)), sizes[right])
    found = []
    for i in left.tolist():
        apart = np.bitwise_count(code[right] ^ code[i])
        near = (apart[:, :PROBES].min(axis=1) <= RADIUS) & (apart[:, PROBES:].sum(axis=1) <= LONG_RADIUS) & (part[right] != part[i])
        if not near.any():
            continue
        mine = np.zeros(len(seen), dtype=bool)
        mine[flat[i]] = True
        common = np.bincount(owner[mine[place]], minlength=len(right))
        for j in right[near & (common >= similarity * (sizes[i] + sizes[right] - common))].tolist():
            one, other = root(int(part[i])), root(int(part[j]))
            if one != other:
                label[one] = other
                found.append((i, j))
    return found


def _block_task(similarity: float) -> Callable:
    """Maps the rows of a pair of blocks (node, part, codes, shingles, is_second) to links."""

    def work(rows: pa.Table) -> pa.Table:
        node, part = (rows[c].to_numpy() for c in ("node", "part"))
        code = rows["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1).view(np.uint64)
        lists = rows["shingles"].combine_chunks()
        shingles = np.split(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1])
        second = rows["is_second"].to_numpy()
        # A block that meets itself has no second rows.
        left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if second.any() else (np.arange(len(node)),) * 2
        links = block_links(part, code, shingles, left, right, similarity) if len(left) and len(right) else []
        return pa.table({"u": pa.array([node[i] for i, _ in links], pa.int64()), "v": pa.array([node[j] for _, j in links], pa.int64())})

    return work


def missed_links(
    candidates: DataFrame, stars: DataFrame, texts: DataFrame, sets: DataFrame, failed: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK_TEXTS
) -> DataFrame:
    """Similar pairs (u, v) that join what a `failed` link of `candidates` kept apart; `stars` are the components of the others.

    Components of `candidates` hold all near pairs. In one with a failed link, the texts of its largest part are dealt to
    blocks, and all others too. Blocks of others meet each other and those of the largest part, whose own texts are joined already.
    """
    whole = stage(components(candidates), "near")
    torn = whole.join(failed.select(F.col("u").alias("node")).distinct(), "node").select("component").distinct()
    parts = whole.join(torn, "component", "left_semi").join(stars.select("node", F.col("component").alias("part")), "node", "left")
    parts = stage(parts.select("component", "node", F.coalesce("part", "node").alias("part")), "parts")
    sizes = parts.groupBy("component", "part").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.groupBy("component").agg(F.max(F.struct("size", "part")).alias("most"), F.sum("size").alias("size")).filter("size > most.size")
    blocks = [F.ceil(n / F.lit(block)).cast("int").alias(name) for n, name in ((F.col("size") - F.col("most.size"), "others"), (F.col("most.size"), "mains"))]
    sizes = sizes.select("component", F.col("most.part").alias("main"), *blocks)
    hashed, in_main = F.xxhash64("node"), F.col("part") == F.col("main")
    own = F.when(in_main, F.col("others") + F.pmod(hashed, "mains")).otherwise(F.pmod(hashed, "others")).cast("int")
    last = F.when(in_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    dealt = parts.join(sizes, "component").select("component", "node", "part", own.alias("own"), last.alias("last"))
    dealt = dealt.join(texts.select("node", "codes"), "node").join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    met = dealt.select(
        "component",
        F.least("own", "other").alias("first"),
        F.greatest("own", "other").alias("second"),
        "node",
        "part",
        "codes",
        "shingles",
        (F.col("own") > F.col("other")).alias("is_second"),
    )
    return met.groupBy("component", "first", "second").applyInArrow(_block_task(similarity), "u bigint, v bigint")


def groups_of(candidates: DataFrame, texts: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the texts that similar pairs join, if all near pairs are joined by `candidates`."""
    links = stage(similar_links(candidates, sets, similarity), "similar")
    stars = stage(components(links), "components")
    failed = stage(candidates.join(links, ["u", "v"], "left_anti"), "failed")
    if failed.isEmpty():
        return stars
    missed = stage(missed_links(candidates, stars, texts, sets, failed, similarity), "missed")
    if missed.isEmpty():
        return stars
    joined = stars.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return stage(components(joined.unionByName(missed)), "components")


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` without near duplicates: of each group the row with the smallest id stays, null ids last.

    Equal texts are one text, and null is a text of its own. Texts without words are near to equal ones only. Of rows
    with one id, the one with the smallest checksum of the text counts, and of repeated rows one stays. Columns of any name
    are carried along. An empty table gives an empty one.
    """
    key = F.md5(F.col(text_column).cast("binary"))
    shown = docs.select(F.col(id_column).alias("id"), key.alias("key"), F.col(text_column).alias("text"))
    marked = stage(with_arrays(shown, "text", _code_arrays, "codes array<bigint>", ["id", "key"]), "marked")
    by_id = F.struct(F.col("id").isNull(), "id", "key")
    texts = marked.groupBy("key").agg(F.first("codes").alias("codes"), F.min(by_id).alias("first"), F.count(F.lit(1)).alias("rows"))
    texts = stage(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    # Equal codes are no matter of trees: the first of them stands for the others in the shards, and a link leads to each.
    same = texts.filter(F.exists("codes", lambda c: c != 0) & F.col("key").isNotNull()).select("node", "codes")
    heads = stage(same.groupBy("codes").agg(F.min("node").alias("node")), "heads")
    equal = same.join(heads.select("codes", F.col("node").alias("v")), "codes").filter("node != v").select(F.col("node").alias("u"), "v")
    candidates = stage(candidate_links(heads).unionByName(equal), "candidates")
    sets = stage(shingle_sets(docs, texts.select("node", "key"), candidates, text_column), "shingles")
    stars = groups_of(candidates, texts, sets)
    group = texts.join(stars, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("first").alias("first"))
    kept = stage(group.select(F.col("first.id").alias("id"), F.col("first.key").alias("key")), "kept")
    # Carried columns travel in a struct, so their names cannot clash.
    rows = docs.select(F.struct(F.col(id_column).alias("id"), key.alias("key")).alias("_of"), F.struct(*docs.columns).alias("_row"))
    stays = rows.join(kept.select(F.struct("id", "key").alias("_kept")), F.col("_of").eqNullSafe(F.col("_kept")), "left_semi")
    repeated = marked.groupBy("id", "key").count().filter("count > 1").select(F.struct("id", "key").alias("_kept"))
    repeated = stage(repeated, "repeated")
    if repeated.isEmpty():
        return stays.select("_row.*")
    again = F.col("_of").eqNullSafe(F.col("_kept"))
    once = stays.join(repeated, again, "left_semi").groupBy("_of").agg(F.first("_row").alias("_row"))
    return stays.join(repeated, again, "left_anti").select("_row.*").unionByName(once.select("_row.*"))
