"""WARC archives as a chunked record table.

``choose_records`` decides which rows of equal payload are stored and which
revisit them; ``record_chunks`` cuts payloads into rows of at most ``CHUNK`` bytes, and
``write_archives`` streams these rows into gzip members, in files of the shared folder; ``read_chunks``
reads them back as rows (record_id, chunk_no, ...) of at most ``CHUNK`` payload
bytes that carry the SHA-1 of the payload so far, so that the last chunk of a
record has its full digest and no reader holds a whole record; ``read_records``
keeps those last chunks.

Recovery: a task writes files under a name of its own (a fresh uuid) and returns
their blocks as rows; the rows are stored as Parquet, whose commit counts one
attempt of each task, and only files listed there are read.  What a lost attempt
left behind is never looked at.

Rows: a null payload is an empty one; a null id is written as ``-`` and read back as
null (as the reference of a revisit it stays null); of equal payloads the largest id is the response, and repeated rows of
that same id are each a response; an empty table gives no records (and no files);
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_facts, cut_lineage, shared_folder, slices

CHUNK = 1 << 20
FEW = 100_000           # revisits (some 80 bytes each) that are broadcast at most
BLOCK = 64 << 20        # a reader task's share of an archive, compressed
DATE = "2024-01-01T00:00:00Z"   # WARC-Date: archives of equal rows are equal
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"   # fixed value of the format
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

BLOCKS = "file string, start bigint, length bigint, records bigint"
CHUNKS = ("record_id bigint, chunk_no bigint, chunk_start bigint, chunk binary, sha1_so_far binary, "
          "is_last boolean, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
          "uri string")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def choose_records(pages: DataFrame, key: str = "page_id", payload: str = "html", uri: str = "url",
                   min_revisit_bytes: int = 0) -> DataFrame:
    """(key, uri, payload, digest, refers_to): refers_to is set on the rows that revisit another.

    Only ids and digests are grouped; the payload joins last, on its own row's id
    where that id is unique.  A digest that holds a large part of all rows is
    resolved by a broadcast of the few such digests (``attach_facts``)."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    slim = cut_lineage(pages.select(F.col(key).cast("bigint").alias("key"), F.sha1(body).alias("digest"),
                                    F.length(body).alias("bytes")).distinct())
    facts = slim.filter(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(
        F.max("key").alias("response"), F.count(F.lit(1)).alias("n"))
    facts = cut_lineage(facts.filter("n > 1"))
    total = slim.count()
    revisits = attach_facts(slim, facts, "digest", "n", total).filter("key is null or key < response")
    revisits = cut_lineage(revisits.select(F.coalesce("key", F.lit(0)).alias("k"),
                                           F.col("key").isNull().alias("no_key"), "digest",
                                           F.col("response").alias("refers_to")))
    if revisits.count() <= FEW:     # else both sides shuffle by key and digest
        revisits = F.broadcast(revisits)
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(uri).cast("string").alias("uri"),
                        F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumns({"k": F.coalesce("key", F.lit(0)), "no_key": F.col("key").isNull(),
                             "digest": F.sha1(F.col("payload").cast("binary"))})
    return rows.join(revisits, ["k", "no_key", "digest"], "left").select("key", "uri", "payload", "refers_to")


def record_chunks(records: DataFrame, chunk: int | None = None) -> DataFrame:
    """(key, uri, refers_to, bytes, digest, no, last, chunk) of (key, uri, payload, refers_to) rows: the
    payload of a response in rows of at most ``chunk`` bytes, which lie one after the other; one
    row without bytes for a revisit or an empty payload.  No task outside the JVM gets more of a
    record at once."""
    chunk = chunk or CHUNK
    body = records.select("key", "uri", "refers_to", F.col("payload").cast("binary").alias("payload"))
    sized = body.select("*", F.length("payload").cast("bigint").alias("bytes"), F.sha1("payload").alias("digest"))
    held = F.when(F.col("refers_to").isNull(), F.col("bytes")).otherwise(0)
    top = F.greatest(F.ceil(held / chunk).cast("bigint") - 1, F.lit(0).cast("bigint"))
    rows = sized.select("*", held.alias("held"), top.alias("top"), F.explode(F.sequence(F.lit(0).cast("bigint"), top)).alias("no"))
    piece = F.substr("payload", (F.col("no") * chunk + 1).cast("int"), F.least(F.lit(chunk), F.col("held") - F.col("no") * chunk).cast("int"))
    return rows.select("key", "uri", "refers_to", "bytes", "digest", "no", (F.col("no") == F.col("top")).alias("last"), piece.alias("chunk"))


def _head(key, uri, refers_to, size: int, digest: str) -> bytes:
    """The header of a record; its payload's digest and size are known beforehand."""
    kind, held = ("response", size) if refers_to is None else ("revisit", 0)
    uri = " ".join((uri or "").split())
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{'-' if key is None else key}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(digest))}", f"X-Payload-Length: {size}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(HTTP) + held}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, "", ""]).encode() + HTTP


def open_folder(folder: str):
    """A pyarrow file system and the path in it (any store that pyarrow opens by URI)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def write_archives(records: DataFrame, folder: str | None = None, chunk: int | None = None) -> DataFrame:
    """Writes (key, uri, payload, refers_to) rows, chunk by chunk; returns the stored table of blocks.

    The running SHA-1 of a record's chunks must end at the digest in its header.  The table is
    written as Parquet beside the archives, so the archives are written once."""
    folder = folder or shared_folder(records.sparkSession, "warc")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        out, blocks, at, since, n = None, [], 0, 0, 0
        gz = sha = None
        name = f"{uuid.uuid4().hex}.warc.gz"

        def put(data: bytes) -> int:
            if data:
                out.write(data)
            return len(data)

        for b in slices(batches, "chunk"):
            rest = (b.column(c).to_pylist() for c in ("key", "uri", "refers_to", "bytes", "digest", "no", "last"))
            for piece, key, uri, refers_to, size, digest, no, last in zip(b.column("chunk"), *rest):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                if no == 0:
                    gz, sha = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()    # a gzip member for each record
                    at += put(gz.compress(_head(key, uri, refers_to, size, digest)))
                data = memoryview(piece.as_buffer())
                sha.update(data)
                at += put(gz.compress(data))
                if not last:
                    continue
                if refers_to is None and sha.hexdigest() != digest:
                    raise ValueError(f"record {key}: its chunks have digest {sha.hexdigest()}, not {digest}")
                at += put(gz.compress(b"\r\n\r\n") + gz.flush())
                n += 1
                if at - since >= BLOCK:
                    blocks.append((name, since, at - since, n))
                    since, n = at, 0
        if out is not None:
            out.close()
            if n:
                blocks.append((name, since, at - since, n))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*blocks)],
                                             ["file", "start", "length", "records"])

    table = f"{folder}/blocks.parquet"
    record_chunks(records, chunk).mapInArrow(each, BLOCKS).withColumn("folder", F.lit(folder)).write.parquet(table)
    return records.sparkSession.read.parquet(table)


class _Unzip:
    """Bytes of a block of gzip members, read on demand."""

    def __init__(self, source, length: int, step: int = 1 << 18):
        self.source, self.left, self.step = source, length, step
        self.gz, self.raw, self.have = zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(min(self.step, self.left))
            self.left -= len(self.raw)
            if not self.raw:
                return False
        self.have += self.gz.decompress(self.raw, self.step)
        self.raw = self.gz.unconsumed_tail
        if self.gz.eof:
            self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes:
        """Up to and with ``mark``; empty at the end of the block."""
        seen = 0
        while (at := self.have.find(mark, seen)) < 0:
            seen = max(0, len(self.have) - len(mark))
            if not self._more():
                return b""
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self._more():
            pass
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def _id(value: str | None) -> int | None:
    return int(x) if value and (x := value.rpartition(":")[2].strip(">")) != "-" else None


def _chunks(stream: _Unzip, chunk: int | None = None) -> Iterator[tuple]:
    """The chunk rows of a block's records."""
    chunk = chunk or CHUNK
    while head := stream.until(b"\r\n\r\n"):
        fields = dict(x.split(": ", 1) for x in head.decode().strip().split("\r\n")[1:])
        left = int(fields["Content-Length"]) - len(stream.until(b"\r\n\r\n"))
        kind = fields["WARC-Type"]
        given = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        about = (kind, _id(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"])
        record, state, no, at = _id(fields["WARC-Record-ID"]), hashlib.sha1(), 0, 0
        while True:
            data = stream.take(min(chunk, left))
            if left and not data:
                raise ValueError(f"record {record}: the archive ends inside its payload")
            left -= len(data)
            state.update(data)
            so_far, last = state.digest(), not left
            if last and kind == "response" and base32(so_far) != given:
                raise ValueError(f"record {record}: payload digest {base32(so_far)}, header {given}")
            size, digest = (int(fields["X-Payload-Length"]), given) if kind == "revisit" else \
                (at + len(data), base32(so_far))
            yield (record, no, at, data, so_far, last, size if last else None, digest if last else None, *about)
            no, at = no + 1, at + len(data)
            if last:
                break
        stream.take(4)


def read_chunks(blocks: DataFrame, with_payload: bool = True, chunk: int | None = None) -> DataFrame:
    """The chunk rows of all archives listed in ``blocks``; a revisit is one chunk of no bytes.

    ``with_payload=False`` leaves ``chunk`` null where only digests are wanted."""
    chunk = chunk or CHUNK
    names = [x.strip().split()[0] for x in CHUNKS.split(",")]
    schema = pa.schema([("record_id", pa.int64()), ("chunk_no", pa.int64()), ("chunk_start", pa.int64()),
                        ("chunk", pa.binary()), ("sha1_so_far", pa.binary()), ("is_last", pa.bool_()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                store, root = open_folder(row["folder"])
                with store.open_input_file(f"{root}/{row['file']}") as f:
                    f.seek(row["start"])
                    rows, size = [], 0
                    for x in _chunks(_Unzip(f, row["length"]), chunk):
                        rows.append(x if with_payload else (*x[:3], None, *x[4:]))
                        size += len(x[3])
                        if size >= 4 * chunk or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names)

    # a number of its own: the few small rows stand for large reads and must not be coalesced
    return blocks.repartition(min(max(1, blocks.count()), 100_000)).mapInArrow(each, CHUNKS)


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk: sizes, digest, type and reference.

    Where chunks carry their bytes, a response's last one must end where its payload does."""
    ends = F.col("chunk").isNull() | (F.col("record_type") == "revisit") | (F.col("chunk_start") + F.length("chunk") == F.col("payload_bytes"))
    whole = F.when(ends, True).otherwise(F.raise_error(F.concat(F.lit("a record's chunks do not add up: "), F.col("record_id").cast("string"))).cast("boolean"))
    return chunks.filter("is_last").filter(whole).select("record_id", "payload_bytes", "payload_digest", "record_type",
                                                         "refers_to", "uri", (F.col("chunk_no") + 1).alias("n_chunks"))


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Chooses, writes and reads back: one row per page."""
    return read_records(read_chunks(write_archives(choose_records(pages, **options), folder)))
