"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Iterative quantisation (Gong and Lazebnik, CVPR 2011) learns a rotation of the principal axes under
which signs are balanced binary codes. The code is cut into substrings, one hash table for each: vectors that agree
in a whole substring meet in a bucket of its table. There the whole codes are compared, as packed bits: pairs within a
Hamming distance that all but one in a thousand planted pairs keep are candidates, and only rows with a candidate have
their vectors sent, for the comparison in double precision. Substring length follows from the number of vectors. Tables are added until the wanted share of planted pairs,
sample vectors and their copies moved to exactly the threshold, meet under the fitted mean and rotations: where
vectors share a direction, the angle about the mean is larger than that about the origin. More tables than one
rotation has bits for take further rotations.

A bucket may hold any share of the vectors. It is cut into blocks, and pairs of blocks are compared by different
tasks. No pair leaves a task: a vector's links are counted where they are found, in the first table in which the pair
meets, and a spanning forest of the links is what the components are made from. Equal vectors are one row with
a number of copies.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.staging import stage
from tidemark.llm.components import components

THRESHOLD = 0.95
# Vectors that the rotation is fitted on, at most about.
SAMPLE_ROWS = 20_000
ITERATIONS = 30
# Wanted share of pairs found at the threshold itself; closer pairs are found more often.
RECALL = 0.97
# Vectors of a bucket that are compared in one task and, on average, vectors of a bucket.
BLOCK_ROWS, BUCKET_ROWS = 2048, 256
LEAST_BITS, MOST_BITS = 6, 30
# Planted pairs of each kind, and tables above which shorter substrings are taken instead.
PLANTED_PAIRS, MOST_TABLES = 4000, 256
# Rows whose codes are compared with a block at a time, and pairs of vectors that are compared at a time.
STRIP_ROWS = 256
PAIRS_AT_A_TIME = 100_000


def table_shape(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a substring, tables): buckets of about `BUCKET_ROWS` vectors, and enough tables for vectors without a mean.

    Two vectors at an angle agree in a random sign bit with probability 1 - angle / pi. `fit_codes` takes the bits from here.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, vectors) / BUCKET_ROWS))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def rotations(sample: np.ndarray, seed: int = 11) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """(mean, endless rotated principal axes, as columns)."""
    width = sample.shape[1]
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1]
    random = np.random.default_rng(seed)

    def fitted() -> Iterator[np.ndarray]:
        projected = centred @ axes
        while True:
            rotation, _ = np.linalg.qr(random.standard_normal((width, width)))
            for _ in range(ITERATIONS if len(sample) > width else 0):
                codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(codes.T @ projected)
                rotation = (left @ right).T
            yield (axes @ rotation)[:, random.permutation(width)]

    return mean, fitted()


def planted_pairs(sample: np.ndarray, threshold: float, seed: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, others, kind): pairs at exactly the threshold, moved in any direction (0) or as sample vectors differ (1)."""
    random = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, a, b = (random.integers(0, len(unit), 2 * PLANTED_PAIRS) for _ in range(3))
    vectors = unit[chosen]
    kind = np.repeat([0, 1], PLANTED_PAIRS)
    moves = np.where(kind[:, None] == 0, random.standard_normal(vectors.shape), unit[a] - unit[b])
    moves -= (moves * vectors).sum(axis=1, keepdims=True) * vectors
    size = np.linalg.norm(moves, axis=1, keepdims=True)
    # Without a direction to move to (one dimension, equal vectors) there is no such pair.
    movable = size[:, 0] > 1e-9
    vectors, kind = vectors[movable], kind[movable]
    return vectors, threshold * vectors + math.sqrt(max(0.0, 1 - threshold**2)) * (moves / np.maximum(size, 1e-300))[movable], kind


def fit_codes(sample: np.ndarray, vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, projection, bits of a substring): tables until the share `recall` of either kind of planted pairs has met.

    Where that would take more than `MOST_TABLES`, substrings get shorter; with none all vectors are in one bucket.
    """
    mean, fitted = rotations(sample)
    left, right, kind = planted_pairs(sample, threshold)
    projection = next(fitted)
    agrees = ((left - mean) @ projection >= 0) == ((right - mean) @ projection >= 0)
    bits, least = table_shape(vectors, threshold, recall)
    while bits:
        met = np.zeros(len(left), dtype=bool)
        for table in range(MOST_TABLES):
            while agrees.shape[1] < (table + 1) * bits:
                further = next(fitted)
                projection = np.hstack([projection, further])
                agrees = np.hstack([agrees, ((left - mean) @ further >= 0) == ((right - mean) @ further >= 0)])
            met |= agrees[:, table * bits : (table + 1) * bits].all(axis=1)
            if table + 1 >= least and all(met[kind == k].mean() >= recall for k in np.unique(kind)):
                return mean, projection[:, : (table + 1) * bits], bits
            # A bit's agreement says early when the tables will be too many.
            share = max(1e-12, min((agrees[kind == k].mean() for k in np.unique(kind)), default=1.0) ** bits)
            if table == 0 and share < 1 and math.log(1 - recall) / math.log1p(-share) > MOST_TABLES:
                break
        bits -= 1
    return mean, projection[:, :0], 0


def substrings(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray, bits: int) -> np.ndarray:
    """One number for each vector and table: the substring of its code. Without bits all are in one bucket of one table."""
    if not bits:
        return np.zeros((len(vectors), 1), dtype=np.int64)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = (unit - mean) @ projection >= 0
    return signs.reshape(len(vectors), -1, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def packed_codes(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The whole codes, as rows of bytes."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.packbits((unit - mean) @ projection >= 0, axis=1, bitorder="little")


def hamming_limit(sample: np.ndarray, mean: np.ndarray, projection: np.ndarray, threshold: float = THRESHOLD) -> int:
    """Bits in which codes at the threshold may differ: all but one in a thousand planted pairs of either kind do not differ in more."""
    left, right, kind = planted_pairs(sample, threshold)
    apart = (((left - mean) @ projection >= 0) != ((right - mean) @ projection >= 0)).sum(axis=1)
    return int(max((np.quantile(apart[kind == k], 0.999, method="higher") for k in np.unique(kind)), default=projection.shape[1]))


def _bytes_matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)


def _candidates(table: pa.Table, bits: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a cell whose codes differ in up to `limit` bits and that no earlier table has: all of one side, or of left and right."""
    codes = _bytes_matrix(table["packed"])
    width = codes.shape[1]
    words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -width % 8)))).view(np.uint64)
    number = table["table_number"][0].as_py()
    earlier = np.unpackbits(codes, axis=1, count=number * bits, bitorder="little").reshape(len(codes), number, bits) if number else None
    earlier = earlier @ (1 << np.arange(bits, dtype=np.int64)) if number else None
    side = table["side"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(right)
    right = left if within else right
    for begin in range(0, len(left), STRIP_ROWS):
        rows = left[begin : begin + STRIP_ROWS]
        apart = np.zeros((len(rows), len(right)), dtype=np.int32)
        for word in range(words.shape[1]):
            apart += np.bitwise_count(words[rows, word][:, None] ^ words[right, word][None, :])
        a, b = np.nonzero(apart <= limit)
        a, b = rows[a], right[b]
        if within:
            a, b = a[a < b], b[a < b]
        if number:
            # An earlier table has the pair if it agrees there.
            new = ~(earlier[a] == earlier[b]).any(axis=1)
            a, b = a[new], b[new]
        yield a, b


def _near_codes(bits: int, limit: int) -> Callable[[pa.Table], pa.Table]:
    """The rows of a cell that have a candidate in it: only their vectors have to travel."""

    def keep(table: pa.Table) -> pa.Table:
        has = np.zeros(table.num_rows, dtype=bool)
        for a, b in _candidates(table, bits, limit):
            has[a] = has[b] = True
        return table.filter(pa.array(has))

    return keep


def _block_links(threshold: float, bits: int, limit: int) -> Callable[[pa.Table], pa.Table]:
    """Reranks the candidates of a cell by the cosine of the original vectors."""

    def compare(table: pa.Table) -> pa.Table:
        ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
        vectors = _matrix(table["vector"])
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        linked = np.zeros(len(ids), dtype=np.int64)
        label = np.arange(len(ids))
        for all_a, all_b in _candidates(table, bits, limit):
            for begin in range(0, len(all_a), PAIRS_AT_A_TIME):
                a, b = all_a[begin : begin + PAIRS_AT_A_TIME], all_b[begin : begin + PAIRS_AT_A_TIME]
                near = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= threshold
                a, b = a[near], b[near]
                np.add.at(linked, a, copies[b])
                np.add.at(linked, b, copies[a])
                while len(a):
                    la, lb = label[a], label[b]
                    apart = la != lb
                    if not apart.any():
                        break
                    np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
                    while not np.array_equal(label, label[label]):
                        label = label[label]
        found = np.flatnonzero(linked)
        return pa.table({"id": ids[found], "root": ids[label[found]], "links": linked[found]})

    return compare


def near_duplicate_vectors(
    spark: SparkSession,
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    recall: float = RECALL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and vectors of different
    lengths do not link. Equal vectors always link. Rows of one id are different vectors; null ids are never
    the smallest of a component, so a row without an id and without links has no component.
    """
    values = F.col(vector_column).cast("array<double>")
    usable = F.coalesce(
        (F.size(values) > 0)
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(values, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.when(usable, values).alias("vector"))
    # -- one row for each different vector
    classes = rows.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()).withColumn("width", F.size("vector")), "vectors")
    unlinked = rows.filter("vector is null").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
    )
    found = None
    for width, size in sorted(tuple(r) for r in classes.groupBy("width").count().collect()):
        links = _links_of_width(spark, classes.filter(F.col("width") == width), size, threshold, sample_rows, recall)
        found = links if found is None else found.unionByName(links)
    if found is None:
        return unlinked
    found = stage(found, "vector-links")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    stars = stage(components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))), "components")
    least = stars.join(classes.select(F.col("id").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    least = stars.join(least, "component").select(F.col("node").alias("id"), "least")
    known = classes.join(counted, "id", "left").join(least, "id", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id")
    )
    linked = rows.filter("vector is not null").join(known, "vector").select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
    return linked.unionByName(unlinked)


def _links_of_width(spark: SparkSession, classes: DataFrame, size: int, threshold: float, sample_rows: int, recall: float) -> DataFrame:
    """(id, root, links) of classes of one vector length, several rows for an id."""
    share = min(1.0, sample_rows / size)
    chosen = classes.filter(F.pmod(F.xxhash64("vector"), F.lit(1_000_000)) < max(1, int(share * 1_000_000)))
    sample = np.array([r["vector"] for r in chosen.select("vector").collect()] or [classes.first()["vector"]])
    mean, projection, bits = fit_codes(sample, size, threshold, recall)
    limit = hamming_limit(sample, mean, projection, threshold)
    shared = spark.sparkContext.broadcast((mean, projection))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(1))
                parts = substrings(vectors, *shared.value, bits)
                offsets = np.arange(len(parts) + 1) * parts.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(parts.ravel()))
                packed = pa.array([row.tobytes() for row in packed_codes(vectors, *shared.value)], pa.binary())
                columns = [batch.column(0), batch.column(1), batch.column(2), packed, lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "copies", "packed", "codes"])

    made = "id bigint, vector array<double>, copies bigint, packed binary, codes array<bigint>"
    coded = stage(classes.select("id", "vector", "copies").mapInArrow(code, made), "codes")
    entries = coded.select("id", "copies", "packed", F.posexplode("codes").alias("table_number", "substring"))
    sizes = entries.groupBy("table_number", "substring").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # A bucket of n blocks has a cell for each block and each pair of blocks; a row goes to the n cells of its block.
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    placed = entries.join(sizes, ["table_number", "substring"]).withColumn("blocks", blocks)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["table_number", "substring", "low", "high"]
    cells = placed.select(
        "id", "copies", "packed", "table_number", "substring",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    # Codes are compared first; vectors go only where a code has a candidate.
    near = stage(cells.groupBy(*cell).applyInArrow(_near_codes(bits, limit), cells.schema), "near-codes")
    with_vectors = near.join(coded.select("id", "vector"), "id")
    return with_vectors.groupBy(*cell).applyInArrow(_block_links(threshold, bits, limit), "id bigint, root bigint, links bigint")
