"""Chat formatting by token-level assembly.

Every segment of a turn (a role name where the template has no marker for it, and
the text) is encoded alone; the template's control strings are never encoded but
spliced in as reserved ids above the vocabulary.  The loss mask is derived from
+1 / -1 marks at segment borders by a prefix sum, and a turn's place in its
conversation by a prefix sum of turn lengths.  Control strings that occur inside a
text are escaped first: a backslash is put after their opening bracket, and one
more where backslashes already stand there, so that taking one away undoes it.

Assembled turns are rows, not one array per conversation, so a conversation of any
length is a run of rows; ``read_back`` streams over them in order and keeps only
hash states and counters.  (A SHA-256 over a conversation is sequential, so one
task reads the turns of one conversation; all encoding happens before that, row by
row.)

Rows: a null text or role counts as empty; an empty text gives markers only; a null
conversation id is one conversation of its own; repeated rows and equal turn numbers
are all kept, ordered by turn (nulls first), then role, then token ids; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import share, slices, worker_codec

ROLES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")  # around any other role's name, and after its text


@dataclass(frozen=True)
class Template:
    """Markers around each role's text; ``trained`` names the role under the loss mask."""

    roles: dict = field(default_factory=lambda: dict(ROLES))
    other: tuple = OTHER
    trained: str = "assistant"

    def controls(self) -> list[str]:
        return [*(m for pair in self.roles.values() for m in pair), *self.other]


class Escaper:
    """``[INST]`` in a text becomes ``[\\INST]``, ``[\\INST]`` becomes ``[\\\\INST]``; undone exactly."""

    def __init__(self, controls: list[str]):
        split = [re.match(r"(\W+?)(/?\w.*)", c, re.S).groups() for c in controls]
        some = "|".join(f"{re.escape(a)}\\\\*{re.escape(b)}" for a, b in split)
        self.heads = sorted({a for a, _ in split}, key=len, reverse=True)
        self.plain = re.compile(some)
        self.head = re.compile("|".join(map(re.escape, self.heads)))

    def escape(self, text: str) -> str:
        return self.plain.sub(lambda m: self._shift(m[0], 1), text)

    def unescape(self, text: str) -> str:
        return self.plain.sub(lambda m: self._shift(m[0], -1), text)

    def _shift(self, found: str, by: int) -> str:
        at = self.head.match(found).end()
        return found[:at] + ("\\" + found[at:] if by > 0 else found[at + (found[at] == "\\"):])


class Assembler:
    """Turns to ids and mask, and ids back to turns."""

    def __init__(self, codec, template: Template):
        self.codec, self.template = codec, template
        self.base = max(codec.tokens) + 1
        self.ids = {c: self.base + i for i, c in enumerate(template.controls())}
        self.names = {i: c for c, i in self.ids.items()}
        self.escaper = Escaper(template.controls())
        self.opens = {self.ids[a]: r for r, (a, _) in template.roles.items()}

    def packed(self, control: str) -> bytes:
        return struct.pack("<I", self.ids[control])

    def turn(self, role: str, text: str) -> tuple[bytes, bytes]:
        """Packed ids and the loss mask (one byte a token)."""
        t = self.template
        body = self.codec.encode_packed(self.escaper.escape(text))
        if role in t.roles:
            head, tail = map(self.packed, t.roles[role])
        else:
            name = self.codec.encode_packed(self.escaper.escape(role))
            head = self.packed(t.other[0]) + name + self.packed(t.other[1])
            tail = self.packed(t.other[2])
        ids = head + body + tail
        marks = np.zeros(len(ids) // 4 + 1, np.int8)
        if role == t.trained:
            marks[len(head) // 4] += 1
            marks[(len(head) + len(body)) // 4] -= 1
        return ids, np.cumsum(marks[:-1], dtype=np.int8).tobytes()

    def read(self, ids: bytes, mask: bytes) -> tuple[str, str, str, int]:
        """Role, text, text under the mask, and formatted length, from ids and mask only."""
        a, m = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8)
        at = np.flatnonzero(a >= self.base)
        segments = [self.codec.decode(a[i + 1:j].tolist()).decode("utf-8", "replace")
                    for i, j in zip(at, at[1:])]
        length = sum(map(len, segments)) + sum(len(self.names[int(a[i])]) for i in at)
        plain = self.escaper.unescape
        role = self.opens.get(int(a[0])) if len(at) == 2 else plain(segments[0])
        trained = self.codec.decode(a[m == 1].tolist()).decode("utf-8", "replace")
        return role, plain(segments[-1]), plain(trained), length


FORMATTED = "conv_id bigint, turn bigint, role string, ids binary, mask binary"
ASSEMBLED = FORMATTED + ", token_start bigint"
READ = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, n_tokens bigint, loss_tokens bigint")


def format_turns(turns: DataFrame, path: str, pattern: str, template: Template = Template()) -> DataFrame:
    """One row per turn of (conv_id, turn, role, text): its packed ids and loss mask."""
    shared = share(turns.sparkSession, path, pattern)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Assembler(worker_codec(shared), template)
        for b in slices(batches, "text"):
            made = [maker.turn(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            cols = [pa.array([x[i] for x in made], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), *cols],
                                             ["conv_id", "turn", "role", "ids", "mask"])

    src = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
                       F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(each, FORMATTED)


def in_order(formatted: DataFrame) -> DataFrame:
    """The turns of a conversation in one partition, in order, conversations side by side."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")


def assemble(formatted: DataFrame) -> DataFrame:
    """Adds ``token_start``: where a turn's ids begin in its conversation (a running sum)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = object(), 0
        for b in batches:
            starts = []
            for conv, ids in zip(b.column("conv_id").to_pylist(), b.column("ids")):
                if conv != last:
                    last, total = conv, 0
                starts.append(total)
                total += len(ids.as_buffer()) // 4
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts, pa.int64())],
                                             [*b.schema.names, "token_start"])

    return in_order(formatted).mapInArrow(each, ASSEMBLED)


class _Fold:
    """Running digests of one conversation."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.tokens = self.loss_tokens = 0

    def add(self, read, n_tokens: int, n_loss: int) -> None:
        role, text, trained, length = read
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        self.loss.update(trained.encode("utf-8", "replace"))
        self.n, self.loss_chars, self.chars = self.n + 1, self.loss_chars + len(trained), self.chars + length
        self.tokens, self.loss_tokens = self.tokens + n_tokens, self.loss_tokens + n_loss

    def row(self, conv) -> tuple:
        return (conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
                self.tokens, self.loss_tokens)


def read_back(assembled: DataFrame, path: str, pattern: str, template: Template = Template()) -> DataFrame:
    """One row per conversation, read from ``ids`` and ``mask`` of its turns in order.

    ``assembled`` is the output of ``assemble`` (its partitions hold whole
    conversations in order) or a stored copy of it passed through ``in_order``."""
    shared = share(assembled.sparkSession, path, pattern)
    names = [x.strip().split()[0] for x in READ.split(",")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, state = Assembler(worker_codec(shared), template), None, None
        schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
        for b in batches:
            done = []
            for conv, ids, mask in zip(*(b.column(c).to_pylist() for c in ("conv_id", "ids", "mask"))):
                if state is None or conv != last:
                    if state is not None:
                        done.append(state.row(last))
                    last, state = conv, _Fold()
                state.add(reader.read(ids, mask), len(mask), sum(mask))
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in done], schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, state.row(last)))], schema)

    return assembled.mapInArrow(each, READ)
