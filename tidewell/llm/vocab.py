"""Exact, fast use of the public tokenizer files: words are memorised, not whole texts.

A text is cut into pieces that its tokenizer treats independently of each other (see ``Encoder``),
and the library's own model encodes each distinct piece once; a piece's result is kept in a
bounded memo. Texts in which a cut could matter (special strings, white space beyond ASCII) go
through the library whole, so results are always those of the library.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct

import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces of each of a memo's two generations; a few hundred bytes each.
MEMO = 400_000
#: White space other than the six ASCII characters, and control characters that some define as such.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
_PIECES = re.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: Texts of these characters alone are split into pre-tokens here: no normaliser changes them but for case.
_SIMPLE = re.compile("[\x00-\x1b -\x7fÀ-ÖØ-öø-ÿ]*")
#: Fixed value: the word vocabulary's own splitter, as its file states it.
WORD_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPLIT_WORDS = re.compile(f"{_ENDINGS}|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
#: Letters are tried first, as most pre-tokens are runs of them; no ending begins with a letter or a space, so the order changes nothing.
_SPLIT_BYTES = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|{_ENDINGS}| ?[0-9]+| ?[^\\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\\s+(?!\\S)|\\s+")


def byte_letters() -> dict[int, int]:
    """The code point that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = byte_letters()


def default_path(name: str) -> str:
    """The file's place as the installed public_tokenizers package gives it."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Piece to packed ids (little-endian unsigned 32 bits), made on first use.

    A full memo becomes the last generation, and a piece of that which is met again passes into the present one; so
    pieces that are met often stay, however many others there are.
    """

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.last: dict[bytes | str, bytes] = {}

    def __missing__(self, piece: bytes | str) -> bytes:
        value = self.last.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.last = dict(self)
                self.clear()
            self[piece] = value
        return value


def byte_pieces(text: str) -> list | None:
    """Pieces of a text without special strings that a byte-level splitter treats independently (str: a pre-token, bytes: text); None: it must be split whole."""
    if _SIMPLE.fullmatch(text):
        return _SPLIT_BYTES.findall(text)
    return None if _ODD_SPACE.search(text) else _PIECES.findall(text.encode("utf-8"))


def known_splitter(path: str) -> str | None:
    """"words" or "bytes" for the two kinds of files whose pieces are known to be independent; None for all others."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec["pre_tokenizer"] or {}
    if spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]:
        return "bytes"
    steps = [s.get("type") for s in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = cut.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"].get("Regex") == WORD_SPLITTER and not cuts[1]["use_regex"]:
        return "words"
    return None


class Encoder:
    """Packed ids of whole texts for one tokenizer file.

    Where pieces are independent: a vocabulary of words (white space is dropped before anything
    can span it) is cut at ASCII white space; a byte-level vocabulary is cut in front of each run
    of ASCII white space, since no pattern of its splitter crosses from other characters into a
    white-space run, and each run is kept whole with what follows it. Files of any other splitter
    or normaliser encode their texts whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = known_splitter(path)
        self.words = self.known == "words"
        self.packed_ids = [struct.pack("<I", i) for i in range(1 + max(self.tokenizer.get_vocab().values(), default=-1))]
        self.memo = Memo(self._piece)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: bytes | str) -> bytes:
        if isinstance(piece, bytes):
            return self._whole(piece.decode("utf-8"))
        letters = piece.encode("utf-8").decode("latin-1").translate(_BYTE_LETTERS)
        return b"".join([self.packed_ids[t.id] for t in self.tokenizer.model.tokenize(letters)])

    def pieces(self, text: str) -> list | None:
        """Independent pieces (str: a pre-token, bytes: text), or None if the text must be encoded whole."""
        if self.known is None or any(s in text for s in self.specials) or (self.words and "<|" in text):
            return None
        if not self.words:
            return byte_pieces(text)
        if _SIMPLE.fullmatch(text):
            return _SPLIT_WORDS.findall(text.lower())
        return None if _ODD_SPACE.search(text) else text.encode("utf-8").lower().split()

    def packed(self, text: str) -> bytes:
        """All ids of a text, four little-endian bytes each."""
        pieces = self.pieces(text)
        return self._whole(text) if pieces is None else b"".join(map(self.memo.__getitem__, pieces))

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop this process's encoders and their memos, and give back what Arrow holds unused.

    Python workers outlive a job. Tasks with large needs of their own that encode nothing begin with this, so
    that what an earlier stage or run memorised is not held beside them.
    """
    if _ENCODERS:
        for one in _ENCODERS.values():
            one.memo.clear()
            one.memo.last.clear()
        _ENCODERS.clear()
        gc.collect()  # an encoder and its memo refer to each other
    pa.default_memory_pool().release_unused()


def file_digest(path: str) -> str:
    """sha256 of a tokenizer file: its version."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
