"""Operator 13, BPE encoding and decoding: a segment tree over the ranks of adjacent pairs.

A text is split into pre-tokens as its tokenizer file says. A pre-token starts as one symbol a
byte, and a segment tree holds (rank, place) of every adjacent pair that can be merged, so its root
is the leftmost pair of lowest rank. That pair is merged, the pairs beside it are put into the
tree anew, each in logarithmic time, and so on until the root is empty. Short pre-tokens of a batch of texts have
their trees side by side in an array, and merge together; a long one has a tree to itself. Pre-tokens' ids are
memorised in two generations, so those that are met often stay. Decoding takes the bytes of all ids of a batch of
rows side by side, as Arrow does, and reads each row's as UTF-8.

Files of another kind (no byte-level splitter, a normaliser, word ends, dropout, …) are refused.

Defined results: a null text is the empty text, which has no ids; special strings in a text become
their ids. Rows that repeat, or share an id, or have none, are encoded each; very long texts are
encoded whole, in memory in proportion to one text; an empty table gives no rows. In decoding a null list is the empty
text, ids that the file does not have and nulls stand for nothing, and bytes that are no UTF-8 become U+FFFD.
Other columns may have any names: encoding ignores them, and decoding hands them on.
"""

from __future__ import annotations

import json
import re
import struct
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewell.llm import vocab

FILE = "byte_bpe_50k.json"
#: Rows of a batch that are held as Python lists at a time.
ROWS = 256
#: Bytes of the longest pre-token that is merged together with others, and memorised.
LONG = 64
#: Pre-tokens of a generation of a process's memo, about 200 bytes each; one that is met again passes from the last generation to the present one.
MEMO = 400_000
_PLACE = 32
_NONE = 1 << 62


def merged(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The symbols after all merges. ranks: rank by ``left << 32 | right``; made: the symbol that each rank makes."""
    n, rank = len(symbols), ranks.get
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = rank(symbols[i] << _PLACE | symbols[i + 1])
        if r is not None:
            tree[size + i] = r << _PLACE | i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, right: int) -> None:
        """The pair of the symbols at i and right (n: none) takes i's leaf."""
        r = rank(symbols[i] << _PLACE | symbols[right]) if right < n else None
        at = i + size
        tree[at] = _NONE if r is None else r << _PLACE | i
        while at > 1:
            least = min(tree[at], tree[at ^ 1])
            at >>= 1
            if tree[at] == least:
                return
            tree[at] = least

    while (root := tree[1]) != _NONE:
        i = root & ((1 << _PLACE) - 1)
        gone = after[i]
        right = after[gone]
        symbols[i] = made[root >> _PLACE]
        after[i] = right
        if right < n:
            before[right] = i
        put(gone, n)
        put(i, right)
        if before[i] >= 0:
            put(before[i], i)
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


def merged_many(symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> np.ndarray:
    """merged() of many rows of symbols (rows, a power of two) at once; the end of a row is filled up with -1.

    keys: the sorted ``left << 32 | right`` of all pairs, ranks: theirs; made: the symbol that each rank makes. Each row has its own segment tree;
    all rows make their next merge together, as long as any has one.
    """
    m, width = symbols.shape
    wide = width + 1  # a last column for what is beyond the end
    symbols = np.concatenate([symbols, np.full((m, 1), -1, np.int64)], axis=1)
    after, before = (np.tile(np.arange(first, first + wide, dtype=np.int32), m) for first in (1, -1))

    def leaves(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        pair = left << _PLACE | right
        found = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (keys[found] == pair), ranks[found] << _PLACE | at, _NONE)

    tree = np.full((m, 2 * width), _NONE, np.int64)
    tree[:, width:] = leaves(symbols[:, :-1], symbols[:, 1:], np.arange(width))
    level = width // 2
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level //= 2
    rows = np.flatnonzero(tree[:, 1] != _NONE)
    ends, tree, symbols = lengths[rows].astype(np.int32), tree.ravel(), symbols.ravel()
    while len(rows):
        at, top = rows * wide, rows * (2 * width)  # where a row begins
        root = tree[top + 1]
        i = root & ((1 << _PLACE) - 1)
        gone = after[at + i]
        right = after[at + gone]
        right = np.where(right < ends, right, width)
        new = made[root >> _PLACE]
        symbols[at + i] = new
        symbols[at + gone] = -1
        after[at + i] = right
        before[at + right] = i
        prior = before[at + i]
        tree[top + width + gone] = _NONE
        tree[top + width + i] = leaves(new, symbols[at + right], i)
        has = np.flatnonzero(prior >= 0)
        p = prior[has]
        tree[top[has] + width + p] = leaves(symbols[at[has] + p], new[has], p)
        nodes = [width + gone, width + i, width + np.maximum(prior, 0)]
        for _ in range(width.bit_length() - 1):
            for k in range(3):
                below = top + (nodes[k] & ~1)
                nodes[k] = nodes[k] >> 1
                tree[top + nodes[k]] = np.minimum(tree[below], tree[below + 1])
        left = tree[top + 1] != _NONE
        rows, ends = rows[left], ends[left]
    return symbols.reshape(m, wide)[:, :-1]


class Bpe:
    """A byte-level BPE file: its merges, its ids' bytes and its splitter."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("normalizer", "post_processor") if spec[k]] + ["added_tokens"] * any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if odd or model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file: {', '.join(odd) or 'model or pre_tokenizer'}")
        ids = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {ids[a] << _PLACE | ids[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        pairs = sorted(self.ranks.items()) or [(-1, 0)]
        self.arrays = np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64), np.array(self.made, np.int64)
        self.first = np.array([ids[chr(letter)] for _, letter in sorted(vocab.byte_letters().items())], np.int64)
        letters = {letter: byte for byte, letter in vocab.byte_letters().items()}
        said = {i: bytes(letters[ord(c)] for c in s) for s, i in ids.items()} | {t["id"]: t["content"].encode() for t in added}
        self.nothing = max(said) + 1
        self.bytes = pa.array([said.get(i, b"") for i in range(self.nothing + 1)], pa.large_binary())
        self.special = {t["content"]: struct.pack("<I", t["id"]) for t in added}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if added else None
        self.splitter = vocab.encoder(path).tokenizer.pre_tokenizer
        self.memo: dict[str, bytes] = dict(self.special)
        self.last: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        """Pre-tokens as the file's own splitter cuts them."""
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        pieces = vocab.byte_pieces(text)
        if pieces is None:
            return self._split(text)
        return pieces if not pieces or isinstance(pieces[0], str) else [t for raw in pieces for t in self._split(raw.decode("utf-8"))]

    def parts(self, text: str) -> list[str]:
        """Pre-tokens and special strings, which no pre-token holds."""
        if self.at_special is None or not self.at_special.search(text):
            return self.pre_tokens(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += [*self.pre_tokens(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.pre_tokens(text[at:])

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens: short ones together by their width, long ones each."""
        out: dict[str, bytes] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8")
            if len(raw) > LONG:
                ids = merged(self.first[np.frombuffer(raw, np.uint8)].tolist(), self.ranks, self.made)
                out[p] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                by_width.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append((p, raw))
        for width, each in by_width.items():
            lengths = np.array([len(raw) for _, raw in each])
            inside = np.arange(width) < lengths[:, None]
            symbols = np.full((len(each), width), -1, np.int64)
            symbols[inside] = self.first[np.frombuffer(b"".join(raw for _, raw in each), np.uint8)]
            found = merged_many(symbols, lengths, *self.arrays)
            held = found >= 0
            ends = [0, *(np.cumsum(held.sum(axis=1)) * 4).tolist()]
            flat = found[held].astype("<u4").tobytes()
            out |= {p: flat[a:b] for (p, _), a, b in zip(each, ends, ends[1:], strict=False)}
        return out

    def packed(self, texts: list[str]) -> list[bytes]:
        """All ids of each text, four little-endian bytes each."""
        cut = [self.parts(t) for t in texts]
        pieces = set().union(*cut)
        new = pieces.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo, self.last = dict(self.special), self.memo
            new = pieces.difference(self.memo)
        met = {p: self.last[p] for p in new if p in self.last}
        new.difference_update(met)
        long = {p for p in new if len(p) * 4 > LONG and len(p.encode("utf-8")) > LONG}
        self.memo |= met
        self.memo |= self.learn(new - long)
        known = ChainMap(self.learn(long), self.memo) if long else self.memo
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]

    def texts(self, ids: pa.ListArray) -> pa.StringArray:
        """The text of each row's ids."""
        flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        taken = self.bytes.take(pa.array(np.where((flat >= 0) & (flat < self.nothing), flat, self.nothing)))
        lengths = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
        after = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy(zero_copy_only=False))])
        ends = after[np.concatenate([[0], np.cumsum(lengths)])]
        rows = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), taken.buffers()[2]])
        try:
            return rows.cast(pa.string())
        except pa.ArrowInvalid:  # some row's bytes are no UTF-8
            return pa.array([raw.decode("utf-8", "replace") for raw in rows.to_pylist()], pa.string())

    def text(self, ids: list[int | None]) -> str:
        return self.texts(pa.array([ids], pa.list_(pa.int64())))[0].as_py()


_LOADED: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """One for each file and process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs (doc_id, text)."""
    path = tokenizer or vocab.default_path(FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = bpe(path).packed
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = packed([t or "" for t in part.column(1).to_pylist()])
                ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, tokenizer: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns of rows, and the text of their ids."""
    path, at_ids = tokenizer or vocab.default_path(FILE), rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = bpe(path).texts
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, read(part.column(at_ids))], [*part.schema.names, text])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(text, StringType())]))
