import hashlib
import math
import re
from collections import Counter

import numpy as np

from promptloom.operators.bm25 import bm25_join
from promptloom.operators.embed import embed_text

DOCS = ["the cat sat on the mat", "dogs and cats", "the the the", "Éte à Paris, été!", "cat cat dog", ""]
QUERIES = ["cat on mat", "été paris", "the"]


def toks(s):
    return [t for t in re.split(r"[^\w]+", s.lower()) if t and not t.startswith("_")]


def brute(k, k1=1.2, b=0.75):
    dt = [toks(d) for d in DOCS]
    n = len(dt)
    avgdl = sum(map(len, dt)) / n
    df = Counter(t for d in dt for t in set(d))
    out = {}
    for qi, q in enumerate(QUERIES):
        qc = Counter(toks(q))
        scores = []
        for di, d in enumerate(dt):
            tf = Counter(d)
            s = sum(c * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] / (tf[t] + k1 * (1 - b + b * len(d) / avgdl))
                    for t, c in qc.items() if tf[t])
            if s != 0 or any(tf[t] for t in qc):
                scores.append((-round(s, 9), di, s))
        out[qi] = [(di, s) for _, di, s in sorted(scores)[:k]]
    return out


def test_bm25_brute_force(spark):
    q = spark.createDataFrame(list(enumerate(QUERIES)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    for small in (True, False):
        r = bm25_join(q, d, 2, query_key="item_id", corpus_key="doc_id",
                      max_broadcast_rows=10**6 if small else 0)
        got = {}
        for row in r.orderBy("query_id", "rank").collect():
            got.setdefault(row["query_id"], []).append((row["doc_id"], row["score"]))
        exp = brute(2)
        assert set(got) == set(exp)
        for qi in exp:
            assert [x[0] for x in got[qi]] == [x[0] for x in exp[qi]]
            assert all(math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(got[qi], exp[qi]))


def number(s):
    return int(hashlib.md5(s.encode()).hexdigest()[:8], 16)


def test_embedder_matches_numpy(spark):
    texts = ["Hello world hello", "été à Paris", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in embed_text(df, "text", dim=16).collect()}
    for i, t in enumerate(texts):
        v = np.zeros(16)
        for tok in [x for x in re.split(r"[^\w]+", (t or "").lower()) if x]:
            h = number(tok)
            v[h % 16] += 1 if h >= 1 << 31 else -1
        n = np.linalg.norm(v)
        v = v / n if n else v
        assert np.allclose(got[i], v, atol=1e-6)


def test_bm25_salted_hot_terms(spark):
    q = spark.createDataFrame(list(enumerate(QUERIES)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    r = bm25_join(q, d, 2, query_key="item_id", corpus_key="doc_id", max_broadcast_rows=0, task_postings=1)
    got = {}
    for row in r.orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["doc_id"], row["score"]))
    exp = brute(2)
    for qi in exp:
        assert [x[0] for x in got[qi]] == [x[0] for x in exp[qi]]
        assert all(math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(got[qi], exp[qi]))


def test_null_texts_are_no_documents_on_either_way(spark):
    """N and avgdl must not depend on how the join goes."""
    q = spark.createDataFrame(list(enumerate(QUERIES)), "item_id long, text string")
    d = spark.createDataFrame([*enumerate(DOCS), (100, None), (101, None), (102, None)], "doc_id long, text string")
    ways = [bm25_join(q, d, 3, query_key="item_id", corpus_key="doc_id", max_broadcast_rows=n, task_postings=t)
            for n, t in ((10**6, 10), (0, 10**6), (0, 1))]
    got = [sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in w.collect()) for w in ways]
    assert got[0] == got[1] == got[2]
    plain = bm25_join(q, d.where("text IS NOT NULL"), 3, query_key="item_id", corpus_key="doc_id").collect()
    assert got[0] == sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in plain)


def test_scores_are_summed_where_the_postings_lie(spark):
    """What is shuffled after the join with the queries is k rows a query and task, not every (query, document) pair."""
    q = spark.createDataFrame(list(enumerate(QUERIES)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    p = bm25_join(q, d, 2, query_key="item_id", corpus_key="doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in p and not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", p), p


def test_embedding_of_a_batch_in_bounded_pieces():
    import pyarrow as pa

    from promptloom.operators import embed
    rng = np.random.default_rng(3)
    rows = [[int(x) for x in rng.integers(0, 1 << 32, n)] for n in (3, 0, 500, 1, 40)] + [None]
    numbers = pa.array(rows, pa.list_(pa.int64()))
    whole = embed.dense_vectors(numbers, 8).to_pylist()
    assert len(whole) == 6 and embed.dense_vectors(numbers, 8, most=64).to_pylist() == whole
    assert embed.dense_vectors(numbers.slice(1, 3), 8, most=2).to_pylist() == whole[1:4]
