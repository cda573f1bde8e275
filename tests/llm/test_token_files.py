"""Files of token ids against the tokeniser itself, and the blocks against exact round trips."""

import functools
import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import token_files
from tidemark.llm.common import read
from tidemark.llm.queries import WORD_MODEL, op12_token_files

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(WORD_MODEL)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def want(tokenizer, rows):
    """(doc_id, start, n_tokens, crc32) of (doc_id, text) rows in order."""
    found, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        found.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return found


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect())


def test_registered_query(spark, tokenizer):
    rows = sorted(tuple(r) for r in read(spark, FOLDER, "documents").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in op12_token_files(spark, FOLDER).collect()) == want(tokenizer, rows)


def test_odd_rows(spark, odd, tokenizer):
    """A null id comes first; rows of one id in the order of their texts' checksums; repeated rows are all there."""
    manifest = token_files.write_token_files(spark, odd, PATH, 1, files=5)
    rows = odd.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    found = token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want(tokenizer, [(r["doc_id"], r["text"]) for r in rows])
    assert [r["number"] for r in manifest.collect()] == sorted({r["number"] for r in manifest.collect()})


def test_nothing(spark, nothing):
    manifest = token_files.write_token_files(spark, nothing, PATH, 1)
    assert manifest.collect() == [] and token_files.read_token_files(manifest).collect() == []


def test_one_id_of_many_rows_is_dealt_to_several_files(spark):
    docs = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    manifest = token_files.write_token_files(spark, docs, PATH, 1, files=4)
    assert manifest.count() > 2 and manifest.agg(F.max("documents")).first()[0] < 1200
    starts = sorted(r["start"] for r in token_files.read_token_files(manifest).collect())
    assert starts == list(range(0, 2000 * 4, 4))


loaded = functools.cache(lambda: Tokenizer.from_file(PATH))
WORDS = st.text(st.sampled_from("abzAZéÉßΣςçÇñ'.,!?;:-<>|=0123 \n\t\r\x0b\x1c\x85 ̸́ 中文ǆİ\U0001f600"), max_size=40)


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.one_of(WORDS, st.text(max_size=30), st.just("it's <|endoftext|>, <|endoftext|>x We'LL, o'clock...")), max_size=5))
def test_word_by_word_is_what_the_tokenizer_does(texts):
    tokenizer = loaded()
    ids, lengths = token_files.WordIds(tokenizer).encode(pa.array(texts, pa.string()), 1)
    expected = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert lengths.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def test_memory_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY_BYTES", 20)
    words = token_files.WordIds(tokenizer)
    for text in ("one two three four", "three four five six, seven", None, "one two"):
        ids, _ = words.encode(pa.array([text], pa.string()), 1)
        assert ids.tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_added_tokens_in_any_case(tokenizer):
    assert token_files.WordIds(tokenizer).spelling
    for text in ("<|ENDOFTEXT|> Yes, <|endoftext|>no", "A<|startoftext|>B", "<| A|> ÉÀ", "|>A <B"):
        ids, _ = token_files.WordIds(tokenizer).encode(pa.array([text]), 1)
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=300), st.sampled_from([1, 7, 64]))
def test_blocks_round_trip(ids, size):
    ids = np.array(ids, dtype=np.uint32)
    whole = len(ids) // size * size
    blocks = token_files.pack_blocks(ids[:whole].reshape(-1, size)) if whole else []
    lengths = [size] * len(blocks)
    if whole < len(ids):
        blocks += token_files.pack_blocks(ids[whole:].reshape(1, -1))
        lengths.append(len(ids) - whole)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert token_files.unpack_blocks(b"".join(blocks), starts, np.array(lengths)).tolist() == ids.tolist()


def test_width_follows_the_percentile_and_the_rest_are_exceptions():
    ids = np.full((1, 1000), 5_000_000, dtype=np.uint32)
    ids[0, ::2] += 7
    ids[0, :50] = 4_000_000_000
    (block,) = token_files.pack_blocks(ids)
    assert len(block) == 8 + 1000 * 3 // 8 + 50 * 6
    assert len(token_files.pack_blocks(np.full((1, 1024), 9))[0]) == 8


def test_access_to_any_document(tmp_path):
    path = tmp_path / "x.pfor"
    with open(path, "wb") as stream:
        writer = token_files.FileWriter(stream)
        random = np.random.default_rng(5)
        docs = [random.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 5000, 0, 1024, 70, 600_000, 3)]
        for i, ids in enumerate(docs):
            writer.add([None if i == 1 else i], ids, np.array([len(ids)]))
        assert writer.close() == (len(docs), sum(map(len, docs)))
    with pa.OSFile(str(path)) as file:
        reader = token_files.FileReader(file)
        assert reader.ids.to_pylist() == [0, None, 2, 3, 4, 5, 6, 7]
        for i, ids in enumerate(docs):
            assert reader.tokens(int(reader.firsts[i]), int(reader.firsts[i + 1])).tolist() == ids.tolist()
        assert [g for g in reader.groups(2000)] == [(0, 2), (2, 3), (3, 6), (6, 7), (7, 8)]
    with pytest.raises(ValueError, match="token ids"):
        token_files.FileReader(pa.BufferReader(b"x" * 100))


def test_an_empty_file():
    sink = io.BytesIO()
    sink.close = lambda: None
    assert token_files.FileWriter(sink).close() == (0, 0)
    assert len(token_files.FileReader(pa.BufferReader(sink.getvalue())).ids) == 0
