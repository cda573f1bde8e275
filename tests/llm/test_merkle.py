"""The manifest against a plain fold of lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle
from tidemark.llm.common import read, remainder
from tidemark.llm.queries import LEAF_COLUMNS, op11_merkle

FOLDER = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enter(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """Top of a tree and, for each leaf, its list of (before, after)."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i // 3 * 3
            paths[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
            at[leaf] = i // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    """{(doc_id, leaf): [(subroot, root, proof, folded root), ...]} of (doc_id, source, lang, n_chars, text) rows."""
    trees = {}
    for row in rows:
        doc_id, text = row[0], row[4]
        leaf = h(*map(enter, row))
        odd = doc_id is None or zlib.crc32(str(doc_id).encode()) % 2
        seen = leaf if odd or text is None else h(*map(enter, (*row[:4], text.replace("\n", ""))))
        trees.setdefault("" if row[1] is None else f"={row[1]}", []).append((doc_id is not None, doc_id or 0, leaf, seen))
    keys = sorted(trees, key=str.encode)
    grown = {k: climb([leaf for _, _, leaf, _ in sorted(trees[k])]) for k in keys}
    root, upper = climb([grown[k][0] for k in keys])
    found = {}
    for k, above in zip(keys, upper):
        for (known, doc_id, leaf, seen), path in zip(sorted(trees[k]), grown[k][1]):
            node = seen
            for before, after in path + above:
                node = h(before, node, after)
            proof = h(*[b + a for b, a in path + above])
            found.setdefault((doc_id if known else None, leaf), []).append((grown[k][0], root, proof, node, node == root))
    return {k: sorted(v) for k, v in found.items()}


def shown(df):
    found = {}
    for r in df.collect():
        row = (r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"])
        found.setdefault((r["doc_id"], r["leaf"]), []).append(row)
    return {k: sorted(v) for k, v in found.items()}


def audit(docs):
    seen = F.when(remainder("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.audit(merkle.document_leaves(docs, LEAF_COLUMNS, {"text": seen}))


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, row string, root string, path string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def test_registered_query(spark):
    docs = read(spark, FOLDER, "documents").select(*LEAF_COLUMNS)
    found = op11_merkle(spark, FOLDER)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = shown(found)
    assert got == plain([tuple(r) for r in docs.collect()])
    assert {v for rows in got.values() for *_, v in rows} == {True, False}


@pytest.mark.parametrize("rows", [1, 4, 27, 28])
def test_tree_sizes(spark, rows):
    made = [(i, "a" if i % 5 else "b", "en", i, f"t{i}\n") for i in range(rows)]
    assert shown(audit(table(spark, made))) == plain(made)


def test_odd_rows_and_a_hot_source(spark):
    """Null source, id, text; empty and very long texts; repeated rows and ids; order of sources by bytes."""
    made = [(None, None, None, None, None), (None, None, None, None, None), (3, "", None, 0, ""), (3, "", None, 0, "-"), (3, "", "é", 1, None)]
    made += [(-5, "é", "en", 2, "a\nb"), (4, "Z", "en", 2, "x\n" * 50000), (5, "z", "en", 2, "\U0001f600\n"), (5, "\U0001f600", "en", 2, "\n")]
    made += [(i, "hot", "en", 1, "same\n") for i in range(200)] + [(7, "hot", "en", 1, "same\n")] * 100
    assert shown(audit(table(spark, made))) == plain(made)


def test_nothing(spark):
    assert audit(table(spark, [(1, "a", "b", 1, "c")]).filter("false")).collect() == []


def test_a_changed_leaf_is_found(spark):
    made = [(i, "s", "en", 1, f"text {i}") for i in range(40)]
    assert all(r["verified"] for r in audit(table(spark, made)).collect())
    leaves = merkle.document_leaves(table(spark, made), LEAF_COLUMNS, {"lang": F.when(F.col("doc_id") == 7, "xx").otherwise(F.col("lang"))})
    assert [r["doc_id"] for r in merkle.audit(leaves).filter("not verified").collect()] == [7]


def test_other_columns_and_fanouts(spark):
    """The manifest keeps the caller's columns whatever their names, and paths fold to the root at any fanout."""
    rows = spark.range(50).select(F.lit("=t").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("node"), "id", F.lit(1).alias("rank"), F.lit(2).alias("low"))
    for fanout in (2, 5):
        found = merkle.manifest(rows, ["id"], fanout)
        assert found.columns == ["tree", "node", "id", "rank", "low", "subroot", "root", "path"]
        assert found.filter(merkle.folded(F.col("node"), F.col("path")) == F.col("root")).count() == 50
        assert found.filter("rank = 1 and low = 2").select("root").distinct().count() == 1
