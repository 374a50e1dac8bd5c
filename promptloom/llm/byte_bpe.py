"""Byte-level BPE over a sentencepiece model made from a rank file.

A rank file lists byte strings and their merge ranks.  ``model_bytes`` writes a
sentencepiece ``ModelProto`` straight from it, in protobuf wire format: every
token becomes a piece whose bytes are mapped one by one to printable characters
(so that no piece holds white space or control characters), its score is the
negative rank (the best merge has the highest score), and the normaliser is the
identity.  The text is cut by a pattern first and each match is encoded alone, so
no merge crosses a pre-token; a pre-token that is a token as a whole takes its
rank without merging, as rank-file encoders do.  Decoding maps ids to their bytes.

Rows: a null text counts as empty and gives no ids (an empty binary); extra
columns pass through unchanged; repeated rows are encoded each.  Texts are
encoded whole; the pre-token cache is cleared when it holds ``CACHE`` entries.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, slices

CACHE = 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file: one ``base64(token) rank`` a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes are length-delimited, floats 32 bits wide."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


# Fixed values of the sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3              # fields of ModelProto
PIECE, SCORE, TYPE = 1, 2, 3                       # fields of SentencePiece
UNKNOWN = 2                                        # a piece type
MODEL_TYPE, VOCAB_SIZE, BPE = 3, 4, 2              # fields of TrainerSpec, a model type
UNK_ID, BOS_ID, EOS_ID, PAD_ID = 40, 41, 42, 43    # fields of TrainerSpec
NAME, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 1, 3, 4, 5  # fields of NormalizerSpec


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece i + 1 is the token of the i-th smallest rank."""
    chars = byte_chars()
    out = [_field(PIECES, _field(PIECE, b"<unk>") + _field(SCORE, 0.0) + _field(TYPE, UNKNOWN))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        out.append(_field(PIECES, _field(PIECE, piece) + _field(SCORE, -float(rank))))
    absent = (1 << 64) - 1  # -1 as a varint
    out.append(_field(TRAINER, _field(MODEL_TYPE, BPE) + _field(VOCAB_SIZE, len(ranks) + 1)
                      + _field(UNK_ID, 0) + _field(BOS_ID, absent) + _field(EOS_ID, absent)
                      + _field(PAD_ID, absent)))
    out.append(_field(NORMALIZER, _field(NAME, b"identity") + _field(DUMMY_PREFIX, 0)
                      + _field(REMOVE_SPACES, 0) + _field(ESCAPE_SPACES, 0)))
    return b"".join(out)


SIMPLE_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"   # all of them are \\p{L}
SIMPLE_SPACES = r" \t\n\r\x0b\x0c"


def simple_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of ASCII (without the control characters that libraries class
    differently) and SIMPLE_LETTERS only, with the classes spelled out; None if it holds others.

    The standard matcher is a few times faster than the one that knows properties."""
    out, inside = "", False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        inside = (inside or part == "[") and part != "]"
        known = {r"\p{L}": SIMPLE_LETTERS, r"\p{N}": "0-9", r"\s": SIMPLE_SPACES}.get(part)
        if known:
            out += known if inside else f"[{known}]"
        elif part == r"\S" and not inside:
            out += f"[^{SIMPLE_SPACES}]"
        elif part[0] == "\\" and part[1].isalnum():
            return None                     # a class, an anchor or a reference: the other matcher knows it
        else:
            out += part
    return re.compile(out)


class ByteBpe:
    """Encoder and decoder over ids that are ranks; packed ids are little-endian u32."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.by_piece = [0, *sorted(ranks.values())]              # piece id -> rank
        self.tokens = {r: t for t, r in ranks.items()}
        self.findall = regex.compile(pattern).findall
        simple = simple_pattern(pattern)
        self.simple = simple and simple.findall
        self.not_simple = re.compile(f"[^\\t\\n\\r\\x0b\\x0c -~{SIMPLE_LETTERS}]").search
        self.sp = sentencepiece.SentencePieceProcessor()
        self.sp.LoadFromSerializedProto(model or model_bytes(ranks))
        self.table = dict(enumerate(byte_chars()))
        self.space = self.table[32]
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return self.findall(text) if self.simple is None or self.not_simple(text) else self.simple(text)

    def mapped(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", self.space)
        return piece.encode("utf-8", "replace").decode("latin-1").translate(self.table)

    def learn(self, pieces: list[str]) -> None:
        """Puts pre-tokens into the cache: whole tokens by rank, the others merged by the model."""
        rest = []
        for piece in pieces:
            rank = self.ranks.get(piece.encode("utf-8", "replace"))
            if rank is None:
                rest.append(piece)
            else:
                self.cache[piece] = struct.pack("<I", rank)
        by_piece = self.by_piece
        for piece, ids in zip(rest, self.sp.EncodeAsIds([self.mapped(p) for p in rest], num_threads=1) if rest else ()):
            self.cache[piece] = struct.pack(f"<{len(ids)}I", *[by_piece[i] for i in ids])

    def encode_packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.cache) > CACHE:
            self.cache.clear()
        pieces, cache = self.pieces(text), self.cache
        if new := set(pieces).difference(cache):
            self.learn(sorted(new))
        out = b"".join([cache[p] for p in pieces])
        for p in new:
            if len(p) > 64:
                del cache[p]
        return out

    def encode(self, text: str | None) -> list[int]:
        packed = self.encode_packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_packed(self, packed: bytes | None) -> bytes:
        return self.decode(np.frombuffer(packed or b"", "<u4").tolist())


_OWN: dict = {}


def worker_codec(shared) -> ByteBpe:
    """The codec of this Python worker, built once from the broadcast (path-free) parts."""
    ranks, pattern, model = shared.value
    key = (hash(model), pattern)
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = ByteBpe(ranks, pattern, model)
    return _OWN[key]


def share(spark, path: str, pattern: str):
    """Broadcast ranks, pattern and model: about 3 MB, bounded by the vocabulary file."""
    ranks = load_ranks(path)
    return spark.sparkContext.broadcast((ranks, pattern, model_bytes(ranks)))


def _mapped(df: DataFrame, source: str, out: str, keep: list[str] | None, run) -> DataFrame:
    """df (its columns ``keep``; all) with a binary column ``out`` made row by row from ``source``."""
    keep = df.columns if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = run()
        for batch in slices(batches, source):
            col = pa.array([make(x) for x in batch.column(source).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), col], schema.names)

    return df.mapInArrow(each, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
           keep: list[str] | None = None) -> DataFrame:
    """df plus ``ids``: the packed token ids of every whole text."""
    shared, out = share(df.sparkSession, path, pattern), free_name(df.columns, ids)
    return _mapped(df, text, out, keep, lambda: worker_codec(shared).encode_packed)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """df plus ``out``: the bytes that the packed ids stand for (null ids: no bytes)."""
    shared, name = share(df.sparkSession, path, pattern), free_name(df.columns, out)
    return _mapped(df, ids, name, keep, lambda: worker_codec(shared).decode_packed)
