"""Exact nearest neighbours in two rounds of bounds.

After the pivot-based k-nearest-neighbour join of Lu et al. (PVLDB 2012): points go to the cell of
their nearest pivot, cut into chunks of bounded size. In the first round every chunk's own points search its
ball tree; the k-th distance found bounds how far a point has to look. In the second round a point goes only to the
chunks of cells that can hold something nearer, by the distance to the cell's pivot less its radius and by the
plane between both pivots, and searches their trees within its bound.

Equal points are searched for once, so copies form no large group. Distances are computed for the leaves that the
bounds leave over; only where the data have no structure at all does that come near all pairs.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.staging import Stage, stage
from tidemark.operators.balltree import SLACK, BallTree

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A task holds the tree of one chunk and as many points that search it.
MOST_CHUNK_ROWS = 20000
# Pairs of chunks for each core, so that tasks of unequal length even out.
BLOCKS_PER_CORE = 4
# Points of a cell on average, as long as there are not more pivots than this.
CELL_ROWS = 5000
MAX_PIVOTS = 1024
_FOUND = "id long, other long, distance double"


def distance_function() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Euclidean distances between two sets of rows.

    Sums run column by column, so they are equal for any cut into blocks. Being an inner function it
    travels to the workers by value and does not need this package installed there.
    """

    def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        total = np.zeros((len(left), len(right)))
        for column in range(left.shape[1]):
            difference = left[:, column, None] - right[None, :, column]
            total += difference * difference
        return np.sqrt(total)

    return distances


def chunk_size(points: int, cores: int) -> int:
    """Rows of a chunk: every pair of chunks is a task, and all cores get some."""
    return max(1, min(MOST_CHUNK_ROWS, math.floor(points / math.sqrt(BLOCKS_PER_CORE * cores))))


def nearest_neighbors(
    points: DataFrame,
    k: int,
    chunk_rows: int | None = None,
    pivots: int | None = None,
    keep: Stage = stage,
    work: Accumulator | None = None,
) -> DataFrame:
    """(id, neighbors): up to k other ids by (distance, id).

    `points` has a unique bigint `id` and `x`, an array of finite doubles, and is scanned several times: pass a
    staged table. A point without any other is not listed. `work` is increased by the number of distances that trees compute.
    """
    different = keep(points.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "x", "copies"), "different")
    distinct, copies = different.agg(F.count(F.lit(1)), F.max("copies")).first()
    if not distinct:
        return points.select("id", F.array("id").alias("neighbors"))
    chunk_rows = chunk_rows or chunk_size(distinct, points.sparkSession.sparkContext.defaultParallelism)
    if pivots is None:
        pivots = min(MAX_PIVOTS, math.ceil(distinct / CELL_ROWS))
    nearest = _nearest_different(different.select("id", "x"), k, chunk_rows, pivots, keep, work)
    if (copies or 0) > 1:
        return _with_copies(points, nearest, k, keep)
    ranked = F.sort_array(F.collect_list(F.struct("distance", "other")))
    return nearest.groupBy("id").agg(ranked.alias("best")).select("id", F.col("best.other").alias("neighbors"))


def _nearest_different(points: DataFrame, k: int, chunk_rows: int, pivots: int, keep: Stage, work: Accumulator | None) -> DataFrame:
    """(id, other, distance): the k nearest of each of different points."""
    seeds = points.orderBy(F.md5(F.col("id").cast("string")), "id").limit(max(1, pivots)).select("x").collect()
    distances = distance_function()
    centers = np.array([row["x"] for row in seeds], dtype=float).reshape(len(seeds), -1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            apart = distances(np.stack(batch["x"].to_numpy()), centers) if len(batch) else np.zeros((0, 1))
            yield batch.assign(cell=apart.argmin(axis=1), reach=apart.min(axis=1))

    placed = points.mapInPandas(assign, "id long, x array<double>, cell long, reach double")
    placed = keep(placed.withColumn("spread", F.xxhash64("id")), "placed")
    # One row for each pivot reaches the driver.
    totals = placed.groupBy("cell").agg(F.max("reach").alias("radius"), F.count(F.lit(1)).alias("rows"))
    cells = {row["cell"]: (row["radius"], max(1, math.ceil(row["rows"] / chunk_rows))) for row in totals.collect()}
    radii = np.array([cells.get(c, (-math.inf, 0))[0] for c in range(len(centers))])
    chunks = [cells.get(c, (0, 0))[1] for c in range(len(centers))]
    chunks_of = F.array(*[F.lit(max(1, n)) for n in chunks])
    chunk = F.pmod("spread", F.element_at(chunks_of, (F.col("cell") + 1).cast("int"))).cast("int")
    placed = placed.select("id", "x", "cell", chunk.alias("chunk"))

    def own(part: pd.DataFrame) -> pd.DataFrame:
        """The nearest in the own chunk, and the other chunks that can hold nearer points."""
        ids, x = part["id"].to_numpy(), np.stack(part["x"].to_numpy())
        tree = BallTree(ids, x)
        row, other, apart = tree.nearest(ids, x, k, np.full(len(ids), math.inf))
        counts = np.bincount(row, minlength=len(ids))
        order = np.lexsort((other, apart, row))
        cuts = np.cumsum(counts)[:-1]
        others, aparts = np.split(other[order], cuts), np.split(apart[order], cuts)
        bound = np.array([a[-1] if len(a) == k else math.inf for a in aparts])
        home, here = int(part["cell"].iloc[0]), int(part["chunk"].iloc[0])
        visits = []
        for start in range(0, len(ids), 1024):
            to_pivot = distances(x[start : start + 1024], centers)
            least = np.maximum(to_pivot - radii, (to_pivot - to_pivot[:, home : home + 1]) / 2)
            inside = least * (1 - SLACK) - SLACK * to_pivot <= bound[start : start + 1024, None]
            inside[:, home] = True
            for cells_of in inside:
                visits.append([c << 32 | n for c in np.flatnonzero(cells_of).tolist() for n in range(chunks[c]) if (c, n) != (home, here)])
        if work is not None:
            work.add(tree.distances_made + len(ids) * len(centers))
        return pd.DataFrame({"id": ids, "x": list(x), "others": others, "aparts": aparts, "bound": bound, "visits": visits})

    first = placed.groupBy("cell", "chunk").applyInPandas(
        own, "id long, x array<double>, others array<long>, aparts array<double>, bound double, visits array<long>"
    )
    first = keep(first, "first_round")
    probes = first.select("id", "x", "bound", F.explode("visits").alias("visit")).select(
        "id", "x", "bound", F.shiftright("visit", 32).alias("cell"), F.col("visit").bitwiseAND((1 << 32) - 1).cast("int").alias("chunk")
    )
    # A chunk is sent once for each slice of the points that visit it; where bounds are tight there is one or none.
    visited = probes.groupBy("cell", "chunk").agg(F.ceil(F.count(F.lit(1)) / MOST_CHUNK_ROWS).cast("int").alias("slices"))
    visited = keep(visited, "visited")
    sliced = F.pmod(F.xxhash64("id"), "slices").cast("int").alias("slice")
    asking = probes.join(visited, ["cell", "chunk"]).select("id", "x", "bound", "cell", "chunk", sliced)
    # Own names for the second side: with shared ones, an unused output lets pruning drop its columns.
    asked = placed.join(visited, ["cell", "chunk"]).select(
        F.col("id").alias("other"), F.col("x").alias("y"), "cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    )

    def beyond(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "other": [], "distance": []})
        tree = BallTree(right["other"].to_numpy(), np.stack(right["y"].to_numpy()))
        ids = left["id"].to_numpy()
        row, other, apart = tree.nearest(ids, np.stack(left["x"].to_numpy()), k, left["bound"].to_numpy())
        if work is not None:
            work.add(tree.distances_made)
        return pd.DataFrame({"id": ids[row], "other": other, "distance": apart})

    block = ["cell", "chunk", "slice"]
    second = asking.groupBy(*block).cogroup(asked.groupBy(*block)).applyInPandas(beyond, _FOUND)
    pairs = F.explode(F.arrays_zip("others", "aparts")).alias("pair")
    known = first.select("id", pairs).select("id", F.col("pair.others").alias("other"), F.col("pair.aparts").alias("distance"))
    # A limit on the rank prunes each task's candidates before they move, and no more than k of an id are gathered.
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return known.unionByName(second).withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _with_copies(points: DataFrame, nearest: DataFrame, k: int, keep: Stage) -> DataFrame:
    """The neighbours of all points from those of different points, whose id is the smallest of their copies.

    No more than k + 1 copies of a point can be neighbours, so the ranks stop there.
    """
    place = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    heads = points.withColumn("place", place).filter(F.col("place") <= k + 1)
    heads = keep(heads.withColumn("first", F.min("id").over(Window.partitionBy("x"))).select("first", "id"), "copies")
    own = heads.select("first", "id", F.lit(0.0).alias("distance"))
    near = keep(nearest, "nearest").select(F.col("id").alias("of"), F.col("other").alias("first"), "distance")
    others = near.join(heads, "first").select(F.col("of").alias("first"), "id", "distance")
    rank = F.row_number().over(Window.partitionBy("first").orderBy("distance", "id"))
    best = own.unionByName(others).withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    lists = best.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("best"))
    firsts = points.groupBy("x").agg(F.min("id").alias("first"))
    rows = points.select("id", "x").join(firsts, "x").select("id", "first").join(lists, "first")
    listed = F.slice(F.filter("best.id", lambda other: other != F.col("id")), 1, k)
    return rows.select("id", listed.alias("neighbors")).filter(F.size("neighbors") > 0)
