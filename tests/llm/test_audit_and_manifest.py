"""Source divergence, segment-tree BPE and Merkle manifest against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from promptloom.llm import divergence, merkle, queries, segment_bpe

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATH = public_tokenizers.path("byte_bpe_50k.json")

# ---- segment-tree BPE

ODD = "".join(map(chr, range(1, 0x3000))) + " 😀 عربي 漢字　\x85 '’s don't I'LL 12½    a_b\n\n  x"
TEXTS = ["", None, "Hello world", ODD, "a" * 5000, " " * 400 + "x", "Ünïcödé straße", "\x1c\x1f\x00", "x\n" * 60_000,
         "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftex", "ab" * 40_000, "0123456789" * 30, "Ա֊౜ೝ𐤀𒑯 x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return segment_bpe.SegmentBpe(segment_bpe.load(PATH))


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None])
def test_ids_and_text_are_the_librarys(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == want
    assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_characters_of_newer_tables_are_classed_as_the_library_does(codec, library):
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(chr(rng.choice((rng.randrange(0x500, 0xD000), rng.randrange(0x10000, 0x33480), 32, 49)))
                       for _ in range(500))
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_any_ids_decode_as_in_the_library(codec, library):
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(20)]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert codec.decode([10 ** 6]) == ""


def naive_merge(ids, ranks, merged, span):
    ids = list(ids)
    while True:
        best = min(((ranks[a * span + b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a * span + b in ranks), default=None)
        if best is None:
            return ids
        rank, i = best
        ids[i:i + 2] = [merged[rank]]


@pytest.mark.parametrize("seed", range(20))
def test_merges_are_those_of_repeated_scans(seed):
    rng = random.Random(seed)
    span, ranks, merged = 40, {}, []
    for _ in range(60):
        pair = rng.randrange(span) * span + rng.randrange(span)
        if pair not in ranks:
            ranks[pair] = len(merged)
            merged.append(rng.randrange(span))
    for n in [1, 2, 3, 4, 5, 8, 9, 16, 17, 100, 400]:
        ids = [rng.randrange(4 if n % 2 else span) for _ in range(n)]
        assert segment_bpe.merge(list(ids), ranks, merged, span) == naive_merge(ids, ranks, merged, span)


def test_long_piece_in_compact_arrays(codec, library):
    text = "x" * 70_000 + "yx" * 3000            # one piece of more than 2 ** 16 symbols
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_whole_tables(spark, library, monkeypatch):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = segment_bpe.encode(df, PATH)
    assert out.columns == ["doc_id", "text", "ids", "ids_"]
    back = segment_bpe.decode(out, PATH, ids="ids_").collect()
    assert len(back) == len(rows)
    for r in back:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids_), "<u4").tolist() == want and r.decoded == (r.text or "")
    empty = segment_bpe.decode(segment_bpe.encode(df.limit(0), PATH, keep=["doc_id", "text"]), PATH)
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "ids", "decoded"]


def test_cache_is_bounded(codec, library, monkeypatch):
    monkeypatch.setattr(segment_bpe, "CACHE", 3)
    own = segment_bpe.SegmentBpe(segment_bpe.load(PATH))
    for text in TEXTS:
        assert own.encode(text) == library.encode(text or "", add_special_tokens=False).ids


def test_op12_is_the_library_on_the_whole_table(spark, library):
    got = {r.doc_id: r for r in queries.op12_segment_bpe(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        segment_bpe.load(public_tokenizers.path("word_bpe_49k.json"))


# ---- divergence

def plain_audit(rows, min_docs=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        c = Counter(divergence.TERM.findall((text or "").translate(FOLD)))
        docs[lang].update(c.keys())
        counts[lang, source].update(c)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(names):
            n = sum(counts[lang, s][t] for s in names for t in kept)
            return {t: 1 + 10 ** 9 * (sum(counts[lang, s][t] for s in names) + 1) // (n + len(kept)) for t in kept}

        q, p = shares(sources), {s: shares([s]) for s in sources}
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def audited(spark, rows, **options):
    df = spark.createDataFrame([(1, *r, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, rank string, n int")
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "straße", "漢字", "a-b", "x1y", "zz"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(40))), rng.choice(["en", "de", None]), rng.choice(["s", "t", None, ""]))
            for _ in range(n)]
    return rows + [(None, "en", "only null"), ("", "none", "a"), ("one two", "none", "b"), ("lone", "single", "a"),
                   ("the " * 50_000, "en", "long"), ("the of", "en", "s")] + [("the of", "en", "s")] * 40


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_is_the_plain_one(spark, seed, monkeypatch):
    rows = corpus(seed)
    assert audited(spark, rows) == plain_audit(rows)


def test_audit_spills_blocks_and_cut(spark, monkeypatch):
    rows = corpus(3)
    assert audited(spark, rows, min_docs=1, top=5) == plain_audit(rows, 1, 5)
    # the passes in small pieces give the same
    batch = pa.RecordBatch.from_pydict({"lang": [r[1] or "" for r in rows], "source": [r[2] or "" for r in rows],
                                        "text": [(r[0] or "").translate(FOLD) for r in rows]})

    def merged(spill, step):
        got = pa.Table.from_batches(divergence.fold_documents([batch], spill)).sort_by([("lang", "ascending"), ("term", "ascending")])
        parts = [b for i in range(0, got.num_rows, step) for b in got.slice(i, step).combine_chunks().to_batches()]
        rows = [r for b in divergence.merge_sorted(parts, 3) for r in b.to_pylist()]
        for r in rows:
            assert len(set(r["sources"])) == len(r["sources"])
            pairs = sorted(zip(r["sources"], r["counts"]))
            r["sources"], r["counts"] = [s for s, _ in pairs], [n for _, n in pairs]
        return rows, got.num_rows

    (one, n_one), (many, n_many) = merged(10 ** 9, 10 ** 9), merged(10, 7)
    assert one == many and n_many > n_one
    monkeypatch.setattr(divergence, "CELLS", 3)
    groups = Counter()
    for r in one:
        for s, c in zip(r["sources"], r["counts"]):
            groups[r["lang"], s] += c
    totals = divergence.Totals([(*g, n) for g, n in groups.items()], Counter(r["lang"] for r in one))
    stripes = pa.RecordBatch.from_pylist(one)
    sums, parts = Counter(), 0
    for b in divergence.emit([stripes], totals):
        for r in b.to_pylist():
            if r["part"] == "pair":
                sums[r["lang"], r["source"], r["item"]] += r["value"]
                parts += 1
    assert parts > len(sums)                         # handed on more than once
    wanted = {(g, s, i): v for g, s, part, i, v, _ in plain_audit(rows) if part == "pair" and (g, s) in groups and (g, i) in groups}
    assert {k: v for k, v in sums.items() if k in wanted} == wanted


def test_shares_are_exact_beyond_64_bits():
    rng = random.Random(5)
    for _ in range(200):
        total = rng.randrange(1, 9 * 10 ** 15)
        count = rng.randrange(total)
        got = divergence.share(np.array([count]), np.array([total]))[0]
        assert got == 1 + 10 ** 9 * (count + 1) // total


def test_audit_of_an_empty_table_and_too_many_groups(spark):
    rows = [("a", "en", "s")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert divergence.audit(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="groups"):
        divergence.audit(df, max_groups=0)


# ---- Merkle manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes, arity):
    """(root, proofs): per node, a list of (before, after) on the way up."""
    proofs, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i:i + arity] for i in range(0, len(nodes), arity)]
        for i, own in enumerate(at):
            run, k = runs[i // arity], i % arity
            for x in own:
                proofs[x].append(("".join(run[:k]), "".join(run[k + 1:])))
        at = [[x for own in at[i:i + arity] for x in own] for i in range(0, len(at), arity)]
        nodes = [sha("".join(r)) for r in runs]
    return (nodes[0] if nodes else None), proofs


def plain_manifest(rows, arity=16):
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaves = [(r, sha("".join(map(plain_field, r)))) for r in rows]
    by = defaultdict(list)
    for r, leaf in leaves:
        by[r[1]].append((r, leaf))
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for k in keys:
        by[k].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[k] = plain_tree([leaf for _, leaf in by[k]], arity)
    root, over = plain_tree([trees[k][0] for k in keys], arity)
    out = []
    for k, above in zip(keys, over):
        for (r, leaf), proof in zip(by[k], trees[k][1]):
            steps = proof + above
            changed = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                changed = sha("".join(map(plain_field, (*r[:4], None if r[4] is None else r[4].translate(FOLD)))))
            for a, b in steps:
                changed = sha(a + changed + b)
            out.append((r[0], leaf, trees[k][0], root, sha("".join(a + b for a, b in steps)), changed, changed == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int, tree string"


def manifested(spark, monkeypatch, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)
    monkeypatch.setattr(queries, "read_docs", lambda *_: df)
    return sorted((tuple(r) for r in queries.op13_merkle(spark, "").collect()), key=str)


def manifest_rows(n, sources):
    rng = random.Random(n)
    return [(i, sources[min(int(rng.expovariate(0.7)), len(sources) - 1)], rng.choice(["en", None]), rng.choice([i, None]),
             rng.choice([None, "", f"Text {i}", f"lower {i}", "Ünï Straße"])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    [], [(1, "a", "en", 3, "One")], [(1, None, None, None, None)], manifest_rows(16, ["a"]), manifest_rows(17, ["a"]),
    manifest_rows(40, [f"s{i}" for i in range(40)]) + [(100 + i, f"t{i}", "x", 1, "A") for i in range(20)],
    manifest_rows(900, ["big", None, "", "é", "z", "lone"]) + [(5000, "single", "de", 2, "Ä" * 100_000)],
    [(7, "s", "en", 1, "Same")] * 300 + [(None, "s", "en", 1, f"N{i}") for i in range(40)] + [(3, "s", "en", 1, "a"), (3, "s", "en", 1, "b")],
], ids=["empty", "one", "nulls", "16", "17", "many sources", "hot source", "repeats and null ids"])
def test_manifest_is_the_plain_one(spark, monkeypatch, rows):
    got = manifested(spark, monkeypatch, rows)
    assert got == plain_manifest(rows)
    if len(rows) == 900:
        assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("limit", [64 << 20, -1], ids=["broadcast", "shuffle"])
def test_narrow_tree_needs_many_rounds(spark, monkeypatch, limit):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", limit)
    rows = manifest_rows(200, ["a", "b", "c", "d", "e"])
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)
    leaf = merkle.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    got = merkle.manifest(df, leaf, arity=2).select(
        "doc_id", F.lower(F.hex("leaf")), F.lower(F.hex("subroot")), F.lower(F.hex("root")), merkle.proof_digest(F.col("steps")),
        merkle.folded(F.lower(F.hex("leaf")), F.col("steps")), F.size("steps"))
    got = sorted((tuple(r) for r in got.collect()), key=str)
    want = plain_manifest(rows, 2)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(r[5] == r[3] for r in got) and max(r[6] for r in got) > 8
