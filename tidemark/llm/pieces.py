"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The words of a slice of texts are one flat symbol array. In every round each word finds its best-ranked
adjacent pair (a segmented minimum), all words merge theirs at once, and the array is compacted, until no
pair is left. Equal words are worked on once; texts are put together from them by gathers.

Merging one pair of each word, the leftmost of the best rank, is what the library does one by one. All
non-overlapping occurrences of a pair merge in the same round where that cannot differ: where no piece that
starts or ends with the merged one has a better or equal rank.

A text that is null or empty has no pieces. Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import SentencePieceProcessor

from tidemark.llm.common import SMALL_SLICE_ROWS, with_arrays

SPACE = "▁"
# A word is cut before a space mark that follows something else, and before line ends: no piece spans these.
WORDS = re.compile(f"\n?{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
# Longer words merge one by one with a heap: rounds that merge one pair each would take time of their square.
ROUND_SYMBOLS = 2048
# Words that a task remembers; the memory starts anew when it is full.
MEMORY_WORDS = 64_000
NONE = np.iinfo(np.int64).max
_SHIFT = 32
_MARK_BYTES = "mark-bytes"


@dataclass(frozen=True)
class Vocabulary:
    """What merging and decoding need of a model file."""

    pieces: list[str]
    ranks: np.ndarray  # by id; equal scores have equal ranks; NONE for ids that never come from merging
    byte_ids: np.ndarray
    end: int
    unknown: int
    pair_keys: np.ndarray  # sorted: left symbol << 32 | right symbol
    pair_piece: np.ndarray
    alone: np.ndarray  # by id: occurrences of this merge are taken one by one

    @property
    def symbol_of(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if self.ranks[i] != NONE}


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a BPE model with byte pieces, a leading space mark and no other normalisation; others are refused."""
    model = SentencePieceProcessor(model_file=path)
    if model.normalize("  ﬁ Ａ ") != f"{SPACE}{SPACE}{SPACE}ﬁ{SPACE}Ａ{SPACE}":
        raise ValueError("only models without text normalisation are supported")
    size = len(model)
    pieces = [model.id_to_piece(i) for i in range(size)]
    merging = [i for i in range(size) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in (pieces[i] for i in merging)):
        raise ValueError("pieces that span words are not supported")
    bytes_found = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
    if len(bytes_found) != 256:
        raise ValueError("the model has no byte pieces")
    scores = np.array([model.get_score(i) for i in merging])
    ranks = np.full(size, NONE, dtype=np.int64)
    ranks[merging] = np.unique(-scores, return_inverse=True)[1]
    symbol = {pieces[i]: i for i in merging}

    def side(part: str) -> int | None:
        found = symbol.get(part)
        return size + ord(part) if found is None and len(part) == 1 else found

    pairs: dict[int, int] = {}
    for i in merging:
        for cut in range(1, len(pieces[i])):
            left, right = side(pieces[i][:cut]), side(pieces[i][cut:])
            if left is not None and right is not None:
                pairs[left << _SHIFT | right] = i
    keys = np.array(sorted(pairs), dtype=np.int64)
    made = np.array([pairs[k] for k in keys.tolist()], dtype=np.int64)
    alone = np.zeros(size, dtype=bool)
    for part in (keys >> _SHIFT, keys & ((1 << _SHIFT) - 1)):
        inside = part < size
        better = ranks[made[inside]] <= ranks[part[inside]]
        alone[part[inside][better]] = True
    return Vocabulary(
        pieces, ranks, np.array([bytes_found[b] for b in range(256)], dtype=np.int32), model.eos_id(), model.unk_id(), keys, made, alone
    )


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _merge_rounds(symbols: np.ndarray, word: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols and their words; `word` is non-decreasing."""
    done_symbols, done_words = [], []
    # The piece that a symbol and the next one make, and its rank.
    piece, rank = np.zeros(len(symbols), dtype=np.int64), np.full(len(symbols), NONE, dtype=np.int64)
    stale = np.arange(len(symbols))
    while len(symbols):
        stale = stale[(stale >= 0) & (stale < len(symbols) - 1)]
        keys = symbols[stale] << _SHIFT | symbols[stale + 1]
        at = np.searchsorted(vocabulary.pair_keys, keys)
        at[at == len(vocabulary.pair_keys)] = 0
        hit = (vocabulary.pair_keys[at] == keys) & (word[stale] == word[stale + 1])
        piece[stale] = vocabulary.pair_piece[at]
        rank[stale] = np.where(hit, vocabulary.ranks[piece[stale]], NONE)
        rank[-1] = NONE

        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lengths = np.diff(np.r_[starts, len(word)])
        best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
        stays = best != NONE
        if not stays.all():
            done_symbols.append(symbols[~stays])
            done_words.append(word[~stays])
        places = np.flatnonzero((rank == best) & stays)
        merged = np.zeros(len(symbols), dtype=bool)
        if len(places):
            first_of_word = np.r_[True, word[places[1:]] != word[places[:-1]]]
            # Overlapping occurrences form runs; every second one is taken, from the left.
            new_run = np.r_[True, np.diff(places) > 1] | first_of_word
            order = np.arange(len(places))
            offset = order - np.maximum.accumulate(np.where(new_run, order, 0))
            take = (offset % 2 == 0) & (first_of_word | ~vocabulary.alone[piece[places]])
            places = places[take]
            symbols[places] = piece[places]
            merged[places] = True
            stays[places + 1] = False
        symbols, word, piece, rank = symbols[stays], word[stays], piece[stays], rank[stays]
        made = np.flatnonzero(merged[stays])
        stale = np.concatenate([made, made - 1])
    if not done_symbols:
        return symbols, word
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


def _merge_with_heap(symbols: list[int], vocabulary: Vocabulary) -> list[int]:
    """The same result for one word, in n log n steps."""
    lookup = dict(zip(vocabulary.pair_keys.tolist(), vocabulary.pair_piece.tolist()))
    ranks = vocabulary.ranks
    after = list(range(1, len(symbols))) + [-1]
    before = list(range(-1, len(symbols) - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(left: int) -> None:
        right = after[left] if left >= 0 else -1
        if right >= 0 and (piece := lookup.get(symbols[left] << _SHIFT | symbols[right])) is not None:
            heapq.heappush(heap, (int(ranks[piece]), left, symbols[left], symbols[right]))

    for i in range(len(symbols) - 1):
        offer(i)
    while heap:
        _, left, a, b = heapq.heappop(heap)
        right = after[left]
        if symbols[left] != a or right < 0 or symbols[right] != b:
            continue
        symbols[left], symbols[right] = lookup[a << _SHIFT | b], -1
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
        offer(before[left])
        offer(left)
    return [s for s in symbols if s >= 0]


def _words(text: str) -> list[str]:
    """The words of a text, without the space mark in front of those that do not begin with a line end."""
    if "  " in text or text[0] == " " or SPACE in text:
        return [w[1:] if w[0] == SPACE else w for w in WORDS.findall(SPACE + text.replace(" ", SPACE))]
    return text.replace("\n", " \n").split(" ")


class Encoder:
    """Encodes slices of texts and remembers the words it has met."""

    def __init__(self, vocabulary: Vocabulary, end: bool = True):
        self.vocabulary = vocabulary
        self.end = end
        table = np.arange(0x110000, dtype=np.int64) + len(vocabulary.pieces)
        for piece, i in vocabulary.symbol_of.items():
            if len(piece) == 1:
                table[ord(piece)] = i
        self.first_symbols = table
        self._forget()

    def _forget(self) -> None:
        # Word 0 is the end of a text; no word contains a space.
        self.index = {" ": 0}
        self.flat = np.array([self.vocabulary.end] if self.end else [], dtype=np.int32)
        self.starts = np.array([0], dtype=np.int64)
        self.lengths = np.array([len(self.flat)], dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        words = [w if w[:1] == "\n" else SPACE + w for w in words]
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = self.first_symbols[points]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        long = sizes > ROUND_SYMBOLS
        found, owner = _merge_rounds(symbols[~long[word]], word[~long[word]], self.vocabulary)
        if long.any():
            parts = [(_merge_with_heap(symbols[word == w].tolist(), self.vocabulary), w) for w in np.flatnonzero(long)]
            found = np.concatenate([found, *(np.array(p, dtype=np.int64) for p, _ in parts)])
            owner = np.concatenate([owner, *(np.full(len(p), w) for p, w in parts)])
            order = np.argsort(owner, kind="stable")
            found, owner = found[order], owner[order]
        outside = found >= len(self.vocabulary.pieces)
        if outside.any():
            coded = [chr(c).encode("utf-8", "surrogatepass") for c in (found[outside] - len(self.vocabulary.pieces)).tolist()]
            repeats = np.ones(len(found), dtype=np.int64)
            repeats[outside] = [len(c) for c in coded]
            outside = np.repeat(outside, repeats)
            found, owner = np.repeat(found, repeats), np.repeat(owner, repeats)
            found[outside] = self.vocabulary.byte_ids[np.frombuffer(b"".join(coded), dtype=np.uint8)]
        lengths = np.bincount(owner, minlength=len(words))
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat = np.concatenate([self.flat, found.astype(np.int32)])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids begin and end."""
        if len(self.index) > MEMORY_WORDS:
            self._forget()
        words: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            before = len(words)
            if text:
                words += _words(text)
            words.append(" ")
            counts[i] = len(words) - before
        which = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        unseen = np.flatnonzero(which < 0).tolist()
        if unseen:
            fresh = list(dict.fromkeys(words[i] for i in unseen))
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))
            self._learn(fresh)
            which[unseen] = [self.index[words[i]] for i in unseen]
        lengths = self.lengths[which]
        ids = self.flat[_ranges(self.starts[which], lengths)]
        ends = np.cumsum(lengths)[np.cumsum(counts) - 1] if len(texts) else np.zeros(0, dtype=np.int64)
        return ids, np.r_[0, ends]


class Decoder:
    """Turns ids back into text: pieces put together, byte pieces as bytes, the first space mark left out."""

    def __init__(self, vocabulary: Vocabulary):
        shown = [p.replace(SPACE, " ").encode() if r != NONE else b"" for p, r in zip(vocabulary.pieces, vocabulary.ranks.tolist())]
        for value, i in enumerate(vocabulary.byte_ids.tolist()):
            shown[i] = bytes([value])
        shown[vocabulary.unknown] = " ⁇ ".encode()
        self.lengths = np.array([len(s) for s in shown], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.spaced = np.array([s.startswith(b" ") for s in shown]) & (vocabulary.ranks != NONE)

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        # Every byte that is not part of a character becomes one replacement character.
        codecs.register_error(_MARK_BYTES, lambda e: ("\ufffd" * (e.end - e.start), e.end))
        lengths, starts = self.lengths[ids], self.starts[ids]
        # The first piece with text of each list of ids.
        visible = np.flatnonzero(lengths > 0)
        if len(visible):
            first = np.searchsorted(visible, bounds[:-1])
            first = first[first < len(visible)]
            first = np.unique(visible[first])
            first = first[self.spaced[ids[first]]]
            starts[first] += 1
            lengths[first] -= 1
        data = self.flat[_ranges(starts, lengths)]
        offsets = np.r_[0, np.cumsum(lengths)][bounds]
        made = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
        try:
            made.validate(full=True)
        except pa.ArrowInvalid:
            made = pa.array([data[a:b].tobytes().decode("utf-8", _MARK_BYTES) for a, b in zip(offsets[:-1], offsets[1:])], pa.large_string())
        return made.cast(pa.string())


def encode_and_decode(
    spark: SparkSession, docs: DataFrame, model_path: str, text_column: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """`docs` with `ids array<int>` (an end id last) and `decoded`, the text that these ids stand for.

    The vocabulary is read by the driver and broadcast; its size is that of the model file. Rows are worked
    on independently, in slices, so repeated and very long texts need no special care; columns named `ids`
    or `decoded` are replaced. A null text counts as empty: its only id is the end id, its decoded text empty.
    """
    shared = spark.sparkContext.broadcast(vars(load_vocabulary(model_path)))

    def start() -> Callable:
        vocabulary = Vocabulary(**shared.value)
        encode, decode = Encoder(vocabulary), Decoder(vocabulary)

        def work(texts: list[str | None]) -> list[pa.Array]:
            ids, bounds = encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            return [lists, decode(ids, bounds)]

        return work

    return with_arrays(docs, text_column, start, "ids array<int>, decoded string", keep, SMALL_SLICE_ROWS)
