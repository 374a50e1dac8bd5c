"""Byte-level BPE whose merges come from a segment tree over the ranks of adjacent pairs.

A tokenizer file (JSON) gives the vocabulary, the ordered merges and the added tokens.
A text is first cut at the added tokens, whose ids are taken as they are; what lies
between is cut by the byte-level pattern, and each piece becomes the symbols of its
bytes.  Leaf i of the tree holds (rank, i) of the pair that starts at symbol i, or
nothing where the pair cannot merge, and every inner node the smaller of its two
children, so the root is the leftmost pair of lowest rank.  A merge links out the right
symbol and updates three leaves -- its own, its left neighbour's and the one that went
-- each along one path to the root, until the root is empty: n log n for a piece of n
bytes, however long.

Decoding maps ids to the bytes of their tokens; bytes that are not UTF-8 become U+FFFD
and ids without a token are left out.

Rows: a null or empty text gives no ids and decodes to the empty text; null ids too;
texts are encoded whole, of any length; repeated rows are encoded each; an empty table gives
no rows; extra columns pass through, and the new column's name is lengthened by
underscores where it is taken.  Pieces of up to ``CACHED`` characters are kept in a cache
that is emptied at ``CACHE`` entries.
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .byte_bpe import SIMPLE_LETTERS, byte_chars, simple_pattern
from .common import free_name, slices

CACHE, CACHED = 600_000, 64
#: The byte-level pattern of such tokenizer files (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class BpeFile:
    """What encoding needs of a tokenizer file."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    added: dict[str, int]
    prefix_space: bool


def load(path: str) -> BpeFile:
    """Reads a tokenizer file of the byte-level kind; other kinds fail."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
             "byte_fallback": False, "ignore_merges": False}
    if (model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True)
            or any((model.get(k) or d) != d for k, d in plain.items())
            or any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip"))):
        raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return BpeFile(model["vocab"], merges, {a["content"]: a["id"] for a in added}, bool(pre.get("add_prefix_space")))


def merge(ids: list[int], ranks: dict[int, int], merged: list[int], span: int) -> list[int]:
    """The symbols of one piece after all merges; ``ids`` is used up.

    ``ranks``: rank of the pair (a, b) under ``a * span + b``; ``merged``: the symbol a rank makes."""
    n = len(ids)
    if n < 2:
        return ids
    rank_of = ranks.get
    empty = len(merged) * n                                   # above every rank * n + position
    box = list if n < 1 << 16 else lambda x: array("q", x)    # eight bytes a node for long pieces
    after, before = box(range(1, n + 1)), box(range(-1, n - 1))
    size = 1 << (n - 1).bit_length()
    tree = box([empty]) * (2 * size)
    for i in range(n - 1):
        if (rank := rank_of(ids[i] * span + ids[i + 1])) is not None:
            tree[size + i] = rank * n + i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    while (top := tree[1]) < empty:
        rank, i = divmod(top, n)
        gone = after[i]
        j = after[i] = after[gone]
        own = ids[i] = merged[rank]
        puts = [(gone, empty)]
        rank = None
        if j < n:
            before[j] = i
            rank = rank_of(own * span + ids[j])
        puts.append((i, empty if rank is None else rank * n + i))
        if (h := before[i]) >= 0:
            rank = rank_of(ids[h] * span + own)
            puts.append((h, empty if rank is None else rank * n + h))
        for leaf, key in puts:                                # each up to the first ancestor that stays
            node = size + leaf
            if tree[node] == key:
                continue
            tree[node] = key
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                if other < key:
                    key = other
                if tree[node] == key:
                    break
                tree[node] = key
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


class SegmentBpe:
    """Encoder and decoder of one tokenizer file; packed ids are little-endian u32."""

    def __init__(self, file: BpeFile):
        from tokenizers import pre_tokenizers

        vocab, self.chars = file.vocab, byte_chars()
        self.span = max([*vocab.values(), *file.added.values()], default=0) + 1
        self.by_byte = [vocab.get(c) for c in self.chars]
        self.ranks, self.merged = {}, []
        for rank, (a, b) in enumerate(file.merges):
            self.ranks[vocab[a] * self.span + vocab[b]] = rank       # a pair listed twice: the later rank
            self.merged.append(vocab[a + b])
        of_char = {c: i for i, c in enumerate(self.chars)}
        self.tokens = {i: self._bytes(t, of_char) for t, i in [*vocab.items(), *file.added.items()]}
        self.added = file.added
        longest = sorted(file.added, key=lambda t: (-len(t), t))
        self.find_added = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if longest else lambda t: [t]
        self.prefix_space = file.prefix_space
        self.simple = simple_pattern(PATTERN).findall
        self.not_simple = re.compile(f"[^\\t\\n\\r\\x0b\\x0c -~{SIMPLE_LETTERS}]").search
        # letters and numbers as the file's own library classes them: its character tables are of another year
        self.other = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _bytes(token: str, of_char: dict[str, int]) -> bytes:
        return bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()

    def pieces(self, text: str) -> list[str]:
        if self.prefix_space and not text.startswith(" "):
            text = " " + text
        if self.not_simple(text):
            return [text[a:b] for _, (a, b) in self.other(text)]
        return self.simple(text)

    def encode_piece(self, piece: str) -> list[int]:
        ids = [i for b in piece.encode("utf-8", "replace") if (i := self.by_byte[b]) is not None]
        return merge(ids, self.ranks, self.merged, self.span)

    def _plain(self, text: str) -> bytes:
        """The packed ids of a text without added tokens."""
        pieces, cache = self.pieces(text), self.cache
        new = set(pieces).difference(cache)
        for p in new:
            ids = self.encode_piece(p)
            cache[p] = struct.pack(f"<{len(ids)}I", *ids)
        out = b"".join([cache[p] for p in pieces])
        for p in new:
            if len(p) > CACHED:
                del cache[p]
        return out

    def encode_packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.cache) > CACHE:
            self.cache.clear()
        parts = self.find_added(text)                # every second part is an added token
        return b"".join(struct.pack("<I", self.added[t]) if k % 2 else self._plain(t) for k, t in enumerate(parts) if t)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        none = b""
        return b"".join([self.tokens.get(i, none) for i in ids]).decode("utf-8", "replace")

    def decode_packed(self, packed: bytes | None) -> str:
        return self.decode(np.frombuffer(packed or b"", "<u4").tolist())


_OWN: dict = {}


def worker_codec(shared) -> SegmentBpe:
    """The codec of this Python worker, built once from the broadcast file."""
    path, file = shared.value
    if path not in _OWN:
        _OWN.clear()
        _OWN[path] = SegmentBpe(file)
    return _OWN[path]


def _with(df: DataFrame, path: str, source: str, out: str, keep: list[str] | None, kind: T.DataType, of: Callable) -> DataFrame:
    """df (its columns ``keep``; all) plus ``out``, made row by row from ``source`` by a method of the codec."""
    keep = df.columns if keep is None else keep
    out = free_name(keep, out)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, kind)])
    shared = df.sparkSession.sparkContext.broadcast((path, load(path)))     # bounded by the file
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = of(worker_codec(shared))
        for b in slices(batches, source):
            col = pa.array([make(x) for x in b.column(source).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), col], schema.names)

    return df.mapInArrow(each, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """df plus ``ids``: the packed token ids of every whole text."""
    return _with(df, path, text, ids, keep, T.BinaryType(), lambda c: c.encode_packed)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df plus ``out``: the text that the packed ids stand for."""
    return _with(df, path, ids, out, keep, T.StringType(), lambda c: c.decode_packed)
