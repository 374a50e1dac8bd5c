"""Byte-level BPE, chat formatting and WARC: round trips and edge cases."""

import base64
import gzip
import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken

from promptloom.llm import byte_bpe, chat_format, queries, warc

PATH, PATTERN = queries.vocabulary()
ODD = "".join(map(chr, range(1, 0x3000))) + " 😀 عربي 漢字　\x85 '’s don't I'LL 12½    a_b\n\n  x"
TEXTS = ["", None, "Hello world", ODD, "a" * 5000, " " * 400 + "x", "Ünïcödé straße", "\x1c\x1f\x00", "x\n" * 60_000,
         "0123456789" * 30, "<|endoftext|>", "ʼn ǅ ß ªº"]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.ByteBpe(byte_bpe.load_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_ids_are_the_librarys(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids).decode() == text


def test_other_vocabulary_and_bounded_cache(library, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = byte_bpe.ByteBpe(byte_bpe.load_ranks(path), PATTERN)
    other = tiktoken.Encoding("o", pat_str=PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    for text in (t for t in TEXTS if t):
        assert own.encode(text) == other.encode_ordinary(text)


def test_simple_pattern_only_where_classes_are_known():
    assert byte_bpe.simple_pattern(PATTERN)
    assert byte_bpe.simple_pattern(r"\w+|\s+") is None and byte_bpe.simple_pattern(r"\p{Lu}+") is None


@pytest.mark.parametrize("pattern", [r"\p{Lu}+|\s+|.", r" ?[\p{L}\p{M}]+|\p{N}{1,3}|\s+|[^\s\p{L}\p{M}\p{N}]+", r"\P{L}+|\p{L}+",
                                     r" ?\p{L}+|\d+|\s+|[^\s\p{L}\d]+"])
def test_patterns_with_other_classes(pattern):
    ranks = byte_bpe.load_ranks(PATH)
    own = byte_bpe.ByteBpe(ranks, pattern)
    other = tiktoken.Encoding("p", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in ("ABC def ÀÉ 12345 x", "e\u0301te\u0301 漢字 Ünï\n\nA1", "Hello World  "):
        assert own.encode(text) == other.encode_ordinary(text)


def test_encode_and_decode_tables(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.encode(df, PATH, PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "ids_"]
    back = byte_bpe.decode(out, PATH, PATTERN, ids="ids_").collect()
    assert len(back) == len(rows)
    for r in back:
        want = library.encode_ordinary(r.text or "")
        assert bytes(r.ids_) == struct.pack(f"<{len(want)}I", *want) and bytes(r.decoded).decode() == (r.text or "")
    assert byte_bpe.decode(byte_bpe.encode(df.limit(0), PATH, PATTERN), PATH, PATTERN, ids="ids_").count() == 0


# ---- chat formatting

CONTROL = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/INST] <\\s> <</SYS>>", "<<s>", "<<<SYS>>", "[INST", "<</TURN>><<ROLE>>", "\\", "<s></s>"]


@pytest.mark.parametrize("text", CONTROL)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    e = chat_format.Escaper(chat_format.Template().controls())
    escaped = e.escape(text)
    assert e.unescape(escaped) == text
    assert not any(c in escaped for c in chat_format.Template().controls())


def test_conversations(spark):
    turns = [(1, 0, "system", "be brief"), (1, 1, "user", CONTROL[0]), (1, 2, "assistant", CONTROL[2]), (1, 3, "tool", "42"),
             (1, 4, "assistant", None), (1, 5, "assistant", "é😀" * 40_000), (2, 0, "user", None), (3, None, None, "lost"),
             (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (None, 0, "user", "no id"), (4, 0, "[INST]", "odd role")]
    df = spark.createDataFrame([(*t, "x", 0) for t in turns], "conv_id long, turn long, role string, text string, ids string, mask int")
    ready = chat_format.assemble(chat_format.format_turns(df, PATH, PATTERN))
    rows = ready.collect()
    starts = {}
    for r in rows:                                              # token_start is a running sum within a conversation
        starts.setdefault(r.conv_id, []).append((r.token_start, len(r.ids) // 4))
        assert len(r.mask) == len(r.ids) // 4
    for held in starts.values():
        at = 0
        for start, n in sorted(held):
            assert start == at
            at += n
    got = {r.conv_id: r for r in chat_format.read_back(ready, PATH, PATTERN).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted([t for t in turns if t[0] == conv], key=lambda t: (t[1] is not None, t[1] or 0))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 5
    assert chat_format.read_back(chat_format.assemble(chat_format.format_turns(df.limit(0), PATH, PATTERN)), PATH, PATTERN).count() == 0


def test_reserved_ids_are_spliced_and_masked(codec):
    maker = chat_format.Assembler(codec, chat_format.Template())
    ids, mask = maker.turn("assistant", "[INST] hi")
    a = struct.unpack(f"<{len(ids) // 4}I", ids)
    assert [x for x in a if x >= maker.base] == [a[0], a[-1]] and list(mask) == [0, *[1] * (len(a) - 2), 0]
    assert set(maker.turn("user", "hi")[1]) == {0}


# ---- WARC

PAGES = [(1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, "http://c", ""), (4, "http://d", None), (5, None, "é" * 700_000),
         (6, "http://e\r\nX: y", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (7, "u", "<p>same</p>"), (7, "u", "<p>same</p>"), (None, "n", "<p>same</p>"), (None, "n", "lone")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, k int")


def test_records_come_back(spark):
    got = sorted(warc.archive(spark, pages(spark, PAGES)).collect(), key=str)
    want = []
    for key, url, html in PAGES:
        body = (html or "").encode()
        same = [k for k, _, h in PAGES if (h or "") == (html or "") and k is not None]
        refers = max(same, default=None)
        refers = None if refers is None or refers == key else refers
        want.append((key, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                     "response" if refers is None else "revisit", refers))
    assert sorted([(r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(want, key=str)


def test_chunks_carry_running_digests(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    df = spark.createDataFrame([(1, "u", "ab" * 2600, None), (2, "v", "", None), (3, "w", "gone", 1)],
                               "key long, uri string, payload string, refers_to long")
    blocks = warc.write_archives(df)
    # tasks run with the module's own value, so chunks are whole here; the reader is driven by hand below
    rows = [r for r in warc.read_chunks(blocks).collect()]
    assert {r.record_id for r in rows if r.is_last} == {1, 2, 3}
    for b in blocks.collect():
        store, root = warc.open_folder(b.folder)
        with store.open_input_file(f"{root}/{b.file}") as f:
            f.seek(b.start)
            for x in warc._chunks(warc._Unzip(f, b.length, 100)):
                record, no, at, data, so_far, last = x[:6]
                if record == 1:
                    whole = b"ab" * 2600
                    assert data == whole[at:at + 1000] and so_far == hashlib.sha1(whole[:at + len(data)]).digest()
                    assert last == (no == 5)


def test_records_of_several_chunks_come_back_byte_by_byte(spark):
    """Written from chunk rows and read as chunk rows, both through Spark, of unlike sizes."""
    rng = __import__("random").Random(3)
    texts = {i: "".join(rng.choices("abé漢 \r\n", k=n)) for i, n in enumerate([0, 1, 99, 100, 101, 5000, 70_000, 250])}
    rows = [(i, f"u{i}", t, None) for i, t in texts.items()] + [(50, "v", texts[5], 5), (None, "n", "null id " * 40, None)]
    df = spark.createDataFrame(rows, "key long, uri string, payload string, refers_to long")
    cut = warc.record_chunks(df, 100)
    assert cut.filter("length(chunk) > 100").count() == 0 and cut.filter("key = 5").count() == -(-len(texts[5].encode()) // 100)
    chunks = warc.read_chunks(warc.write_archives(df, chunk=100), chunk=64)
    assert chunks.filter("length(chunk) > 64").count() == 0
    got = {}
    for r in sorted(chunks.filter("record_id is not null").collect(), key=lambda r: (r.record_id, r.chunk_no)):
        data, n = got.setdefault(r.record_id, (hashlib.sha1(), bytearray()))
        assert r.chunk_start == len(n)
        data.update(bytes(r.chunk))
        n += bytes(r.chunk)
        assert bytes(r.sha1_so_far) == data.digest()
    assert {i: bytes(n).decode() for i, (_, n) in got.items()} == {**texts, 50: ""}
    ends = {r.record_id: (r.payload_bytes, r.n_chunks) for r in warc.read_records(chunks).collect()}
    assert ends[6] == (len(texts[6].encode()), -(-len(texts[6].encode()) // 64)) and ends[50] == (len(texts[5].encode()), 1)


def test_archives_are_plain_gzip_members(spark):
    df = spark.createDataFrame([(1, "u", "x", None), (2, "v", "y", None)], "key long, uri string, payload string, refers_to long")
    blocks = warc.write_archives(df.coalesce(1)).collect()
    store, root = warc.open_folder(blocks[0].folder)
    with store.open_input_file(f"{root}/{blocks[0].file}") as f:
        text = gzip.decompress(f.read()).decode()
    assert text.count("WARC/1.1\r\n") == 2 and text.endswith("y\r\n\r\n")


def test_min_revisit_bytes_and_empty_table(spark):
    got = warc.archive(spark, pages(spark, PAGES), min_revisit_bytes=100).collect()
    assert {r.record_type for r in got} == {"response"} and len(got) == len(PAGES)
    assert warc.archive(spark, pages(spark, [])).count() == 0


def test_a_damaged_archive_is_noticed(spark):
    class Source:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    raw = warc._head(1, "u", None, 7, hashlib.sha1(b"payload").hexdigest()) + b"payload\r\n\r\n"
    good = gzip.compress(raw)
    assert [x[3] for x in warc._chunks(warc._Unzip(Source(good), len(good)))] == [b"payload"]
    for bad in (raw.replace(b"payload", b"pay1oad"), raw[:-8]):
        data = gzip.compress(bad)
        with pytest.raises(ValueError):
            list(warc._chunks(warc._Unzip(Source(data), len(data))))
