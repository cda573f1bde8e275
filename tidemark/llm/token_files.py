"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of documents that are neighbours in the order of their ids:

    magic | block 0 | block 1 | ... | index | trailer

    block    <u4 minimum> <u1 width> <u1 zero> <u2 exceptions>, then the offsets from the minimum in `width` bits each,
             then <u2 place> of each exception, then <u4 offset> of each exception
    index    <u8 start of each block>, <i8 document id>, <u1 id is present>, <u8 first id of each document, and the end>
    trailer  <u8 ids> <u8 documents> <u8 blocks> <u8 start of the index> magic

All numbers are little-endian and blocks hold `BLOCK` ids, the last one fewer. The width is that of the offset at a
percentile; wider offsets are exceptions, zero among the packed ones. Block starts give access to any document
without reading what is before it.

Documents are dealt to files by ranges of ids, so only texts move, and each task encodes and writes one file. Names
are new for each attempt: a file counts when its row is in the manifest, so lost or repeated tasks leave no trace in the result.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.functions.staging import new_path, stage
from tidemark.llm.common import slices

MAGIC = b"PFORIDS1"
BLOCK = 1024
# Share of a block's offsets that the packed width must hold.
PERCENTILE = 0.9
_HEAD, _TRAILER = "<IBBH", "<QQQQ8s"
_HEAD_BYTES, _TRAILER_BYTES = struct.calcsize(_HEAD), struct.calcsize(_TRAILER)
# Blocks packed or unpacked at a time.
GROUP_BLOCKS = 512
# Texts encoded at a time, as far as their bytes allow: the more, the fewer words are looked up again.
SLICE_ROWS = 10_000
# UTF-8 bytes of the different words a task remembers; the memory starts anew when it is full.
MEMORY_BYTES = 32_000_000
# Between a letter of these, whose lower case is one letter, and such a sign every pre-tokeniser of the kind ends a word.
_PLAIN = r"^[A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{00FF}]+$"
_LETTER_SIGN = r"([A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{00FF}])([.,!?;:]+)"


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of `ids`, a (blocks, ids in each) array."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    least = ids.min(axis=1)
    offsets = ids - least[:, None]
    at = max(0, int(np.ceil(percentile * ids.shape[1])) - 1)
    limit = np.partition(offsets, at, axis=1)[:, at]
    widths = np.frexp(limit.astype(np.float64))[1]
    wide = (offsets.astype(np.uint64) >> widths[:, None].astype(np.uint64)) > 0
    low = np.where(wide, 0, offsets).astype("<u4")
    packed: list[bytes] = [b""] * len(ids)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        bits = np.unpackbits(low[rows].view(np.uint8).reshape(len(rows), -1, 4), axis=2, count=int(width), bitorder="little")
        for row, payload in zip(rows, np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")):
            packed[row] = payload.tobytes()
    blocks = []
    for row, payload in enumerate(packed):
        places = np.flatnonzero(wide[row])
        head = struct.pack(_HEAD, int(least[row]), int(widths[row]), 0, len(places))
        blocks.append(head + payload + places.astype("<u2").tobytes() + offsets[row, places].astype("<u4").tobytes())
    return blocks


def unpack_blocks(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks, which begin at `starts` in `data` and hold `lengths` ids."""
    ids = np.zeros(int(lengths.sum()), dtype="<u4")
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    heads = [struct.unpack_from(_HEAD, data, int(s)) for s in starts]
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (_, width, _, _) in enumerate(heads):
        alike.setdefault((width, int(lengths[i])), []).append(i)
    for (width, length), members in alike.items():
        size = (width * length + 7) // 8
        raw = np.frombuffer(b"".join(data[int(starts[i]) + _HEAD_BYTES : int(starts[i]) + _HEAD_BYTES + size] for i in members), dtype=np.uint8)
        bits = np.unpackbits(raw.reshape(len(members), size), axis=1, count=width * length, bitorder="little")
        whole = np.zeros((len(members), length, 32), dtype=np.uint8)
        whole[:, :, :width] = bits.reshape(len(members), length, width)
        values = np.packbits(whole, axis=2, bitorder="little").reshape(len(members), -1).view("<u4")
        for i, row in zip(members, values):
            least, _, _, exceptions = heads[i]
            if exceptions:
                at = int(starts[i]) + _HEAD_BYTES + size
                places = np.frombuffer(data, "<u2", exceptions, at)
                row[places] = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
            ids[firsts[i] : firsts[i + 1]] = row + np.uint32(least)
    return ids


class FileWriter:
    """Writes one file to an open stream; `add` takes the ids of whole documents in order."""

    def __init__(self, stream):
        self.stream, self.position = stream, len(MAGIC)
        self.block_starts: list[int] = []
        self.ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.left = np.zeros(0, dtype=np.uint32)
        stream.write(MAGIC)

    def _write(self, ids: np.ndarray, per_block: int) -> None:
        for block in pack_blocks(ids.reshape(-1, per_block)):
            self.block_starts.append(self.position)
            self.stream.write(block)
            self.position += len(block)

    def add(self, doc_ids: list[int | None], tokens: np.ndarray, lengths: np.ndarray) -> None:
        self.ids += doc_ids
        self.lengths.append(lengths)
        tokens = np.concatenate([self.left, tokens.astype(np.uint32)])
        step = GROUP_BLOCKS * BLOCK
        whole = len(tokens) // BLOCK * BLOCK
        for start in range(0, whole, step):
            self._write(tokens[start : min(start + step, whole)], BLOCK)
        self.left = tokens[whole:]

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the finished file."""
        if len(self.left):
            self._write(self.left, len(self.left))
        lengths = np.concatenate([np.zeros(0, dtype=np.int64), *self.lengths])
        firsts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        self.stream.write(np.array(self.block_starts, dtype="<u8").tobytes())
        self.stream.write(np.array([i or 0 for i in self.ids], dtype="<i8").tobytes())
        self.stream.write(np.array([i is not None for i in self.ids], dtype=np.uint8).tobytes())
        self.stream.write(firsts.tobytes())
        total = int(lengths.sum())
        self.stream.write(struct.pack(_TRAILER, total, len(self.ids), len(self.block_starts), self.position, MAGIC))
        self.stream.close()
        return len(self.ids), total


class FileReader:
    """Reads documents from an open file with random access."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        total, documents, blocks, at, magic = struct.unpack(_TRAILER, file.read_at(_TRAILER_BYTES, size - _TRAILER_BYTES))
        if magic != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a file of token ids")
        index = file.read_at(size - _TRAILER_BYTES - at, at)
        self.starts = np.append(np.frombuffer(index, "<u8", blocks), np.uint64(at))
        at = 8 * blocks
        ids, present = np.frombuffer(index, "<i8", documents, at), np.frombuffer(index, np.uint8, documents, at + 8 * documents)
        self.ids = pa.array(ids, mask=present == 0)
        self.firsts = np.frombuffer(index, "<u8", documents + 1, at + 9 * documents).astype(np.int64)
        self.lengths = np.full(blocks, BLOCK, dtype=np.int64)
        if blocks:
            self.lengths[-1] = total - BLOCK * (blocks - 1)

    def tokens(self, first: int, end: int) -> np.ndarray:
        """The ids first to end - 1 of the file; only the blocks that hold them are read."""
        if first == end:
            return np.zeros(0, dtype="<u4")
        low, high = first // BLOCK, (end - 1) // BLOCK + 1
        parts = []
        for at in range(low, high, GROUP_BLOCKS):
            to = min(at + GROUP_BLOCKS, high)
            start = int(self.starts[at])
            data = self.file.read_at(int(self.starts[to]) - start, start)
            parts.append(unpack_blocks(data, self.starts[at:to].astype(np.int64) - start, self.lengths[at:to]))
        return np.concatenate(parts)[first - low * BLOCK : end - low * BLOCK]

    def groups(self, most_tokens: int = GROUP_BLOCKS * BLOCK) -> Iterator[tuple[int, int]]:
        """(first, end) of runs of documents that hold up to `most_tokens` ids; a longer document is a run of its own."""
        first = 0
        while first < len(self.ids):
            end = int(np.searchsorted(self.firsts, self.firsts[first] + most_tokens, side="right")) - 1
            end = min(max(end, first + 1), len(self.ids))
            yield first, end
            first = end


def open_file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; tasks and driver use it alike."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class WordIds:
    """Ids of texts by their different words: a tokeniser that drops white space has no token across it.

    Words are cut at blanks and line feeds, and between a letter and the signs after it, where these pre-tokenisers
    end a word in any case. Each different word is encoded once by the tokeniser and remembered. Words of plain
    letters, most of all, go to the tokeniser's model at once: nothing is to be normalised or cut in them.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.spelling = self._spelling()
        self.forget()

    def _spelling(self) -> dict[int, str]:
        """What the model is given for a plain letter; empty if the tokeniser does more with letters than that."""
        letters = [c for c in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]) if c.isalpha()]
        made = {}
        for letter in letters:
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(letter))
            made[ord(letter)] = "".join(piece for piece, _ in pieces)
        words = [*letters, "".join(letters), "".join(reversed(letters)), *("".join(letters[i::7]) for i in range(7))]
        same = all(self.tokenizer.encode(w, add_special_tokens=False).ids == [t.id for t in self.tokenizer.model.tokenize(w.translate(made))] for w in words)
        return made if same else {}

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.bytes = 0
        self.flat = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)

    def _remember(self, words: pa.Array) -> None:
        """Encodes new words; those of plain letters first."""
        plain = pc.match_substring_regex(words, _PLAIN) if self.spelling else pa.array(np.zeros(len(words), dtype=bool))
        ids: list[int] = []
        counts: list[int] = []
        spelling, tokenize = self.spelling, self.tokenizer.model.tokenize
        first = words.filter(plain).to_numpy(zero_copy_only=False).tolist()
        for word in first:
            found = tokenize(word.translate(spelling))
            ids += [t.id for t in found]
            counts.append(len(found))
        rest = words.filter(pc.invert(plain)).to_numpy(zero_copy_only=False).tolist()
        for start in range(0, len(rest), 10_000):
            for found in self.tokenizer.encode_batch_fast(rest[start : start + 10_000], add_special_tokens=False):
                ids += found.ids
                counts.append(len(found.ids))
        self.codes.update(zip(chain(first, rest), range(len(self.codes), len(self.codes) + len(words))))
        lengths = np.array(counts, dtype=np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.flat = np.concatenate([self.flat, np.array(ids, dtype=np.int64)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.bytes += words.nbytes

    def _codes_of(self, words: pa.Array) -> np.ndarray:
        if self.bytes > MEMORY_BYTES:
            self.forget()
        known = self.codes.get
        found = np.array([known(w, -1) for w in words.to_numpy(zero_copy_only=False)], dtype=np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            unknown = words.take(pa.array(new))
            self._remember(unknown)
            found[new] = [known(w) for w in unknown.to_numpy(zero_copy_only=False)]
        return found

    def _lowered(self, texts: pa.Array) -> pa.Array:
        """A-Z in lower case where the tokeniser does that itself and no added token can be in the text."""
        if not self.spelling or self.spelling[ord("A")] != self.spelling[ord("a")]:
            return texts
        low = pc.ascii_lower(texts)
        for token in self.added:
            low = pc.if_else(pc.match_substring(texts, token[:2]), texts, low)
        return low

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with an end id after each, how many of each text). Null is empty."""
        texts = pc.fill_null(texts, "")
        texts = self._lowered(texts)
        apart = pc.replace_substring(pc.replace_substring_regex(texts, _LETTER_SIGN, r"\1 \2"), "\n", " ")
        lists = pc.split_pattern(apart, " ")
        of_text = np.diff(lists.offsets.to_numpy())
        words = lists.flatten().dictionary_encode()
        codes = self._codes_of(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[codes] - (ends - lengths), lengths) + np.arange(total)]
        per_text = np.add.reduceat(lengths, np.cumsum(of_text) - of_text) if len(of_text) else np.zeros(0, dtype=np.int64)
        out = np.full(total + len(per_text), end, dtype=np.uint32)
        keep = np.ones(len(out), dtype=bool)
        keep[np.cumsum(per_text + 1) - 1] = False
        out[keep] = ids
        return out, per_text + 1


def write_token_files(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, end: int, folder: str | None = None, files: int | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Writes the ids of all texts and returns the manifest (file, number, documents, ids, first_id), in order of `number`.

    Documents ascend by id, nulls first; those of one id by a checksum of the text, and equal rows are dealt to
    several files, so that no id is too large for one. `end` follows each text; null and empty texts have it alone.
    An empty table has an empty manifest. `folder` must be one that every executor reaches.
    """
    folder = (folder or new_path(spark, "token_files")).rstrip("/")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    keys = ["id", "checksum", "tie"]
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text_column).alias("checksum"), F.monotonically_increasing_id().alias("tie"), F.col(text_column).cast("string").alias("text")
    )
    rows = rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys).select("id", "text", F.spark_partition_id().alias("number"))
    location, path = open_file_system(folder)
    location.create_dir(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = name = number = None
        for part in slices(batches, SLICE_ROWS, "text"):
            if writer is None:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                words = WordIds(Tokenizer.from_str(model.value))
                number = part.column(2)[0].as_py()
                name = f"part-{number:06d}-{uuid.uuid4().hex}.pfor"
                system, inside = open_file_system(folder)
                writer = FileWriter(system.open_output_stream(f"{inside}/{name}"))
            writer.add(part.column(0).to_pylist(), *words.encode(part.column(1), end))
        if writer is not None:
            documents, ids = writer.close()
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "number": number, "documents": documents, "ids": ids}], _MANIFEST)

    listed = stage(rows.mapInArrow(write, "file string, number int, documents bigint, ids bigint"), "manifest")
    # One row for each file.
    before = F.sum("ids").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    return listed.withColumn("first_id", F.coalesce(before, F.lit(0))).orderBy("number")


_MANIFEST = pa.schema([("file", pa.string()), ("number", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files: the ids before it, its own count, and its ids
    as little-endian unsigned 32-bit integers. Each task reads one file after the other in groups of blocks."""
    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for name, base in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                system, path = open_file_system(name)
                with system.open_input_file(path) as file:
                    reader = FileReader(file)
                    for first, end in reader.groups():
                        edges = reader.firsts[first : end + 1]
                        data = reader.tokens(int(edges[0]), int(edges[-1])).tobytes()
                        cuts = (edges - edges[0]) * 4
                        ids = [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                        columns = [reader.ids.slice(first, end - first), pa.array(edges[:-1] + base), pa.array(np.diff(edges)), pa.array(ids, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    return manifest.select("file", "first_id").repartition(files).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
