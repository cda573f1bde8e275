"""Merkle manifest of a dataset by nested-interval labels.

Leaves get ranks in the order of their tree, and every node is labelled with the interval of leaf ranks it
covers. Runs of `fanout` nodes become their parent, level by level, until a tree has one node; the tops of all
trees are the leaves of one more tree, whose top is the root. Going down again, a containment join attaches to
each node the parent that covers its interval. Nodes of one level cover equal widths, so the interval divided
by the width is a bucket that only the parent has: the join is an equality of (tree, bucket), and a tree of any
share of the rows spreads over its buckets. What the parent covers less the node's own interval are its siblings.

A parent hands its own proof down, so each level moves the proofs of a third of its nodes and the leaves'
proofs are made in the last join. Ranks come from positions in range partitions, with one small row for each
partition and tree. Every level is a written table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.staging import stage

FANOUT = 3
# monotonically_increasing_id holds the partition above these bits and the position in it below.
_POSITION_BITS = 33
_PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` if null, else its UTF-8 byte count, a colon and the value (numbers in decimal)."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def tree_key(source: Column) -> Column:
    """The source as a key that is never null; in byte order of the keys the null source comes first."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, level by level."""
    return digest(F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"]))))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def ranked(rows: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """`rows` (with `tree`) and `rank`, the position in the tree by `order`, and `size`, the rows of the tree.

    Rows equal in `order` are interchangeable; they too are dealt over several ranges.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in ("tree", *order, "_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    dealt = stage(
        dealt.drop("_tie").withColumns({"_part": F.shiftright(place, _POSITION_BITS), "_place": place.bitwiseAND((1 << _POSITION_BITS) - 1)}),
        "ranges",
    )
    runs = dealt.groupBy("_part", "tree").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    of_tree = Window.partitionBy("tree")
    before = F.sum("_rows").over(of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_part", "tree", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_tree).alias("size"))
    rank = (F.col("_place") + F.col("_shift")).alias("rank")
    return dealt.join(runs, ["_part", "tree"]).select(*rows.columns, rank, "size")


@dataclass(frozen=True)
class Level:
    """The nodes of one level of all trees, and how many of them are the tops of their trees."""

    nodes: DataFrame
    tops: int


def _written(nodes: DataFrame) -> tuple[Level, bool]:
    """The level written down, and whether another one is above it."""
    nodes = stage(nodes, "level")
    most, tops = nodes.agg(F.max("size"), F.count_if(F.col("size") == 1)).first()
    return Level(nodes, tops), (most or 0) > 1


def grow(leaves: DataFrame, fanout: int = FANOUT) -> list[Level]:
    """The levels of all trees, leaves first: (tree, low, high, node, size, run), and `row` on the leaves.

    A node covers the ranks low to high - 1, `size` counts the nodes of its tree on its level, and `run` holds its
    children (low, high, node) in order. A tree is on all levels up to its top, the only one with a size of 1.
    """
    children = "array<struct<low: bigint, high: bigint, node: string>>"
    ends = F.col("rank").alias("low"), (F.col("rank") + 1).alias("high")
    level, more = _written(leaves.select("tree", *ends, "node", "size", F.lit(None).cast(children).alias("run"), "row"))
    levels = [level]
    width = fanout
    while more:
        run = F.array_sort(F.collect_list(F.struct("low", "high", "node")))
        above = levels[-1].nodes.filter("size > 1").groupBy("tree", F.expr(f"low div {width}").alias("bucket"))
        above = above.agg(run.alias("run"), F.max("size").alias("below"))
        ends = F.col("run")[0]["low"].alias("low"), F.array_max("run.high").alias("high")
        node = digest(F.array_join("run.node", "")).alias("node")
        size = F.expr(f"(below + {fanout - 1}) div {fanout}").alias("size")
        level, more = _written(above.select("tree", *ends, node, size, "run"))
        levels.append(level)
        width *= fanout
    return levels


def tops(levels: Sequence[Level]) -> DataFrame:
    """(tree, node): the top node of each tree."""
    return reduce(DataFrame.unionByName, [level.nodes.filter("size = 1").select("tree", "node") for level in levels])


def descend(levels: Sequence[Level], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(row, node, path, *) for every leaf: the siblings before and after each node from the leaf to the top.

    `above` has a row for each tree: the path from its top on, and columns that all leaves of the tree take over.
    """
    carried = [c for c in above.columns if c != "tree"]
    down = None
    width = fanout ** len(levels)
    for level in reversed(levels):
        own = [c for c in ("tree", "low", "high", "node", "run", "row") if c in level.nodes.columns]
        found = []
        if level.tops or down is None:
            found.append(level.nodes.filter("size = 1").select(own).join(above, "tree").select(*own, *carried))
        if down is not None:
            covers = [F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("run").alias("_run"), F.col("path").alias("_path")]
            parents = down.select("tree", F.expr(f"low div {width}").alias("_bucket"), *covers, *[c for c in carried if c != "path"])
            nodes = level.nodes.filter("size > 1").select(*own, F.expr(f"low div {width}").alias("_bucket"))
            inside = nodes.join(parents, ["tree", "_bucket"]).filter("_low <= low and high <= _high")
            parts = {"before": "c.high <= low", "after": "c.low >= high"}
            step = F.struct(*[F.array_join(F.expr(f"transform(filter(_run, c -> {which}), c -> c.node)"), "").alias(p) for p, which in parts.items()])
            found.append(inside.withColumn("path", F.concat(F.array(step), "_path")).select(*own, *carried))
        down = reduce(DataFrame.unionByName, found)
        width //= fanout
    return down.select("row", "node", *carried)


def manifest(rows: DataFrame, order: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """`rows` with `subroot`, `root` and `path` (the siblings of every level, through the top of the tree to the root).

    `rows` has `tree` (text, not null) and `node`, a leaf's digest. Leaves of a tree ascend by `order` and then by
    digest, nulls first; equal leaves are interchangeable. Trees ascend by key in byte order. A tree of one leaf
    has it as its subroot, and the only tree's subroot is the root. An empty table gives no rows.
    """
    leaves = ranked(rows.select("tree", "node", *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)], F.struct(*rows.columns).alias("row")),
                    [*[f"_by{i}" for i in range(len(order))], "node"])
    levels = grow(leaves, fanout)
    subroots = tops(levels).select(F.lit("").alias("tree"), "node", F.struct("tree").alias("row"))
    upper = grow(ranked(subroots.withColumn("_by0", F.col("row.tree")), ["_by0"]), fanout)
    root = tops(upper).select("tree", F.expr(f"cast(array() as {_PATH})").alias("path"), F.col("node").alias("root"))
    above = descend(upper, root, fanout).select("row.tree", "path", F.col("node").alias("subroot"), "root")
    return descend(levels, stage(above, "above"), fanout).select("row.*", "subroot", "root", "path")


def document_leaves(docs: DataFrame, columns: Sequence[str], altered: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, tree, node, seen): a leaf for every row, its source as the tree, and the leaf with `altered` columns as found later.

    Null sources are a tree of their own. A null, an empty text and the text `-` have different leaves.
    """
    seen = {c: F.col(c) for c in columns} | (altered or {})
    return docs.select(
        "doc_id",
        tree_key(F.col("source")).alias("tree"),
        digest(*[field(F.col(c)) for c in columns]).alias("node"),
        digest(*[field(seen[c]) for c in columns]).alias("seen"),
    )


def audit(leaves: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for the rows of `document_leaves`.

    The manifest is made of the leaves; a row is verified if the leaf as seen later folds to the root.
    """
    rows = manifest(stage(leaves, "leaves"), ["doc_id"])
    again = folded(F.col("seen"), F.col("path"))
    shown = rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
