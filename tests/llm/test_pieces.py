import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from tidemark.llm.pieces import Decoder, Encoder, encode_and_decode, load_vocabulary

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=MODEL)
VOCABULARY = load_vocabulary(MODEL)


def assert_as_library(texts):
    ids, bounds = Encoder(VOCABULARY)(texts)
    shown = Decoder(VOCABULARY)(ids, bounds).to_pylist()
    for i, text in enumerate(texts):
        want = LIBRARY.encode(text or "", add_eos=True)
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want
        assert shown[i] == LIBRARY.decode(want)


def test_special_texts():
    assert_as_library(
        [None, "", " ", "  ", "\n", "\n\n a", " \n", "▁", "▁▁a ▁b", "<s></s><unk>", "a" * 5000, " " * 4000, " " * 100 + "x", "=" * 3000]
        + ["thethethethe" * 300, "tab\tx\x00y", "  " * 17 + "the", "é中\U0001f600", "12345 6789", "a \nb", "x ▁ y\n▁z"]
    )


def test_random_texts():
    rng = random.Random(1)
    letters = "abcdethin  \n.,=▁é中0123 ▁"
    assert_as_library(["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(1500)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    assert_as_library([t.encode("utf-8", "replace").decode() for t in texts])


def test_any_ids():
    rng = random.Random(2)
    decode = Decoder(VOCABULARY)
    for _ in range(300):
        ids = [rng.randrange(32000) for _ in range(rng.randint(0, 6))] + [rng.randrange(3, 259) for _ in range(rng.randint(0, 3))]
        assert decode(np.array(ids, dtype=np.int64), np.array([0, len(ids)])).to_pylist() == [LIBRARY.decode(ids)]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr("tidemark.llm.pieces.MEMORY_WORDS", 3)
    encode = Encoder(VOCABULARY)
    for text in ("one two three four", "five one six", "one two"):
        assert encode([text])[0].tolist() == LIBRARY.encode(text, add_eos=True)


def test_table(spark, odd, nothing):
    rows = encode_and_decode(spark, odd, MODEL).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["ids"] == LIBRARY.encode(r["text"] or "", add_eos=True) and r["decoded"] == (r["text"] or "")
        assert r["fingerprint"] == "x" and r["_text"] == "_z"
    assert encode_and_decode(spark, nothing, MODEL).collect() == []


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(SentencePieceProcessor, "normalize", lambda self, text: "other")
    with pytest.raises(ValueError, match="normalisation"):
        load_vocabulary(MODEL)
