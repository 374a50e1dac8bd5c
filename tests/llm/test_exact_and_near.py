"""Exact dedup, SimHash and packing against brute force, with their edge cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from promptloom.llm import exact_dedup, packing, simhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, keep_id string, text_sha256 string, digest int"


def docs(spark, rows):
    """Rows with extra columns whose names clash with those of the results."""
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS)


TEXTS = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "ÀB"), (6, "àb"), (7, "Àb"), (8, "x" * 300_000),
         (9, "X" * 300_000), (9, "x" * 300_000), (None, "lone"), (None, "LONE"), (11, "K"), (12, "K"), (13, "k")]


def expected_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    out = []
    for i, t in rows:
        t = (t or "").translate(FOLD)
        ids = [x for x in groups[t] if x is not None]
        out.append((i, max(ids, default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("repeat", [1, 40])
def test_exact_dedup(spark, repeat):
    rows = TEXTS + [(100 + i, "often") for i in range(repeat)] + [(1000 + i, f"t{i}") for i in range(repeat)]
    got = exact_dedup.decisions(docs(spark, rows)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected_exact(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_heavy_and_light_ways_agree(spark, monkeypatch):
    rows = [(i, f"T{i % 7}") for i in range(300)] + TEXTS
    a = sorted(map(str, exact_dedup.decisions(docs(spark, rows)).collect()))
    monkeypatch.setattr(exact_dedup, "HEAVY", 1)      # no digest is heavy
    assert sorted(map(str, exact_dedup.decisions(docs(spark, rows)).collect())) == a


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.decisions(docs(spark, TEXTS))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_drop_duplicates_keeps_one_row_and_all_columns(spark):
    out = exact_dedup.drop_duplicates(docs(spark, TEXTS))
    assert out.columns == ["doc_id", "text", "keep_id", "text_sha256", "digest"]
    got = out.collect()
    assert len(got) == len({(t or "").translate(FOLD) for _, t in TEXTS})
    assert {2, 4, 9, 13} <= {r.doc_id for r in got} and None in {r.doc_id for r in got}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.decisions(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert packing.pack(none, F.length("text")).count() == 0


# ---- SimHash

def slow_fingerprint(text, words=3):
    tokens = [w for w in (text or "").translate(FOLD).replace("\t", " ").replace("\n", " ").replace("\r", " ")
              .replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs, max_bits=3):
    """pairs: (doc_id, fp); by all pairs."""
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= max_bits:
                parent[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted([(d, f, least.get(find(k))) for k, (d, f) in enumerate(pairs)], key=str)


@pytest.mark.parametrize("text", ["", None, "one", "A b", "a B c", "x y z " * 50_000, "É é É word two", "a\tb\x0bc\x0cd"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_near_duplicates_of_texts(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows = []
    for i in range(40):
        words = [rng.choice(base) for _ in range(300)]
        rows.append((i, " ".join(words)))
        for c in range(i % 4):
            copy = list(words)
            copy[rng.randrange(300)] = "changed"
            rows.append((100 + 10 * i + c, " ".join(copy)))
    rows += [(900, ""), (901, None), (902, "  \n"), (5, rows[0][1]), (None, rows[3][1]), (None, "alone in null")]
    got = sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in
                  simhash.near_duplicates(docs(spark, rows)).collect()], key=str)
    assert got == slow_components([(d, slow_fingerprint(t)) for d, t in rows])


def linked(spark, fps, **options):
    """Components of fingerprints by the trie join, as the set of sets of its members."""
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in set(fps)], "fp long")
    label = {}
    for r in simhash.components(simhash.links(df, **options)).collect():
        label[r.node] = r.root
    groups = {}
    for f in set(fps):
        s = int(np.uint64(f).astype(np.int64))
        groups.setdefault(label.get(s, s), set()).add(f)
    return {frozenset(g) for g in groups.values()}


def brute(fps):
    groups = {}
    for d, f, c in slow_components([(i, f) for i, f in enumerate(sorted(set(fps)))]):
        groups.setdefault(c, set()).add(f)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("node_rows", [50_000, 20])
def test_trie_join_finds_every_link(spark, node_rows):
    rng = random.Random(node_rows)
    fps = [rng.getrandbits(64) for _ in range(150)] + [0, 1, 3, 7, 15, (1 << 64) - 1, 1 << 63]
    for f in list(fps[:60]):
        for bits in (1, 2, 3, 4, 5):
            g = f
            for b in rng.sample(range(64), bits):
                g ^= 1 << b
            fps.append(g)
    assert linked(spark, fps, node_rows=node_rows) == brute(fps)


def test_dense_ball_is_one_component_from_few_edges(spark):
    centre = 0x123456789ABCDEF0
    fps = [centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = simhash.links(df)
    assert edges.count() <= 20 * len(fps)
    assert linked(spark, fps[:400]) == brute(fps[:400])


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}


# ---- packing

def slow_best_fit(lengths, capacities, cost, fill):
    bins = []
    where = []
    for n in lengths:
        open_ = [(c - u, -last, i) for i, (c, u, last) in enumerate(bins) if c - u >= n]
        if open_:
            i = min(open_)[2]
        else:
            size = min((c for c in capacities if c >= n), key=lambda c: (cost(c) / (n + fill * (c - n)), c))
            bins.append([size, 0, 0])
            i = len(bins) - 1
        where.append((i, bins[i][1]))
        bins[i][1] += n
        bins[i][2] = len(where)
    return where, [min(c for c in capacities if c >= u) for _, u, _ in bins]


@pytest.mark.parametrize("fill", [0.0, 0.9])
def test_best_fit_is_best_fit(fill):
    rng = random.Random(3)
    lengths = sorted((rng.randint(1, 64) for _ in range(400)), reverse=True)
    where, offsets, sizes, total = packing.best_fit(lengths, (16, 32, 64), lambda c: c + 5, fill)
    assert (list(zip(where, offsets)), sizes) == slow_best_fit(lengths, (16, 32, 64), lambda c: c + 5, fill)
    assert total == sum(c + 5 for c in sizes)


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 90)) for i in range(300)] + [(400, "y" * 1000), (401, None), (None, "z" * 30), (7, "again")]
    df = docs(spark, rows).withColumns({"bin": F.lit("clash"), "length": F.lit(0)})
    got = packing.pack(df, F.length("text"), capacities=(16, 32, 64), shard_pieces=100).collect()
    bins, pieces = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        if r.length == 0:
            assert r.bin is None and r.capacity is None
        else:
            bins.setdefault((r.shard, r.bin), []).append(r)
    assert sum(r.length for r in got) == sum(len(t or "") for _, t in rows)
    assert [(r.piece, r.start) for r in sorted(pieces[400])] == [(i, 64 * i) for i in range(16)]
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        ends = [0, *(r.offset + r.length for r in held)]
        assert [r.offset for r in held] == ends[:-1]                   # nothing overlaps, no gap
        assert {r.capacity for r in held} == {min(c for c in (16, 32, 64) if c >= ends[-1])}
    assert len({r.shard for r in got if r.bin is not None}) > 1
    again = packing.pack(df, F.length("text"), capacities=(16, 32, 64), shard_pieces=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_packing_query_against_plain_best_fit(spark):
    """The whole table: every shard's bins cost what the cheapest of the plain packings costs."""
    from conftest import SF_SMALL

    from promptloom.llm import queries
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = queries.op8_best_fit(spark, SF_SMALL).collect()
    size, shards = {}, {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
        if r.length:
            shards.setdefault(r.shard, []).append(r)
    assert size == {i: len(t.encode()) + 1 if t else 0 for i, t in texts.items()}
    for rows in shards.values():
        lengths = sorted((r.length for r in rows), reverse=True)
        cost = packing.sequence_cost
        best = min(sum(map(cost, slow_best_fit(lengths, packing.CAPACITIES, cost, f)[1])) for f in (0.0, 0.5, 0.9, 1.0))
        bins = {}
        for r in rows:
            bins.setdefault(r.bin, []).append(r)
        assert sum(cost(held[0].capacity) for held in bins.values()) == pytest.approx(best)
        for held in bins.values():
            held.sort(key=lambda r: r.offset)
            assert [r.offset for r in held] == [sum(x.length for x in held[:i]) for i in range(len(held))]
            assert held[0].capacity == min(c for c in packing.CAPACITIES if c >= sum(x.length for x in held))


def test_equal_rows_spread_over_the_shards(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    got = packing.pack(rows, F.length("text"), shard_pieces=1000)
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(sizes) == 20 and sum(sizes) == 20_000 and max(sizes) < 1500


REPEATED = [(1, "alpha beta gamma"), (2, "alpha beta gamma"), (2, "quite another text"), (None, "Alpha beta gamma"),
            (None, "only here"), (None, "only here"), (3, "only there"), (3, "only there"), (4, "ONLY THERE"), (5, None), (None, "")]


def test_rows_of_repeated_and_null_ids(spark):
    df = docs(spark, REPEATED * 30)
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    want = [(2, "alpha beta gamma"), (2, "quite another text"), (None, "only here"), (4, "ONLY THERE"), (5, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    near = simhash.drop_near_duplicates(df)
    assert near.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in near.collect()), key=str)
    want = [(1, "alpha beta gamma"), (2, "quite another text"), (None, "only here"), (3, "only there"), (5, None)]
    assert got == sorted(want, key=str)
    assert exact_dedup.drop_duplicates(df.limit(0)).collect() == simhash.drop_near_duplicates(df.limit(0)).collect() == []


def test_near_stage_loses_no_text_of_its_own(spark):
    """Any rows, ids repeated and null: one row of every component, and only rows of the input."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(25)]
    rows = []
    for t in base:
        for _ in range(rng.randint(1, 4)):
            x = t.split()
            if rng.random() < 0.5:
                x[rng.randrange(60)] = "changed"
            rows.append((rng.choice([None, 1, 2, 3, 50, 60]), " ".join(x)))
    rows += rng.choices(rows, k=20)
    got = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()]
    parts = slow_components([(i, slow_fingerprint(t)) for i, (_, t) in enumerate(rows)])
    root = {i: c for i, _, c in parts}
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(root[i], []).append(row)
    best = [min(g, key=lambda r: (r[0] is None, r[0] or 0, bytes.fromhex(hashlib.sha256(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest())))
            for g in groups.values()]
    assert sorted(map(str, got)) == sorted(map(str, best))


def test_many_equal_rows_of_no_id(spark):
    """A text that a third of the rows hold under no id is decided by aggregates and a broadcast."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"),
                                  F.when(F.col("id") % 3 == 0, "often").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    kept = exact_dedup.drop_duplicates(df)
    assert kept.count() == 2001 and kept.filter("doc_id is null").count() == 1
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan and "Arrow" not in plan
