"""The memo of pieces: what is met often is encoded once, and ids are the library's whatever the memo's size."""

import random
from collections import Counter

import numpy as np

from tidewell.llm import vocab


def test_pieces_that_are_met_often_are_encoded_once(monkeypatch):
    monkeypatch.setattr(vocab, "MEMO", 60)
    for name, often in (("byte_bpe_50k.json", (" same", " words", " and")), ("word_bpe_49k.json", ("same", "words", "and"))):
        encoder, rng, made = vocab.Encoder(vocab.default_path(name)), random.Random(4), Counter()
        make = encoder.memo.make
        encoder.memo.make = lambda piece, make=make, made=made: made.update([piece]) or make(piece)
        for _ in range(300):
            text = "the same words and " + " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(8))
            assert np.frombuffer(encoder.packed(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert len(encoder.memo) <= 60
        assert made.total() > 2000 and {made[piece] for piece in often} == {1}
        assert len(encoder.memo.last) <= 60
