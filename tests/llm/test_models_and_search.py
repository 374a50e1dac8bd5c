"""Classifiers on held-out rows, exact search against brute force, the pipeline and the queries."""

import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.llm import codepoints, lang_id, quality, queries, topk_search, toxicity
from promptloom.llm.common import attach_facts, free_name, label_split

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SF = "/root/testdata/sf0.001"
EDGE = [None, "", "   ", "12 + 3 = 15 !!", "́̂", "word " * 300_000, "漢字 かな", "ABC"]


def edge_docs(spark, texts=EDGE):
    rows = [(i, t, None, 0.5, "x") for i, t in enumerate(texts)] + [(0, "again", None, 0.5, "x"), (None, "no id", None, 0.5, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")


# ---- words

def test_words_and_grams_match_plain_python():
    texts = ["Don't STOP, straße!", "", "a bc def ghij ÀÉ", "x1y"]
    import regex
    want = [(i, w.lower()) for i, t in enumerate(texts) for w in regex.findall(r"[\p{L}\p{M}]+", t)]
    w = codepoints.Words(texts)
    letters = w.letters.astype(np.uint32).tobytes().decode("utf-32-le")
    assert [(int(t), letters[a:a + n]) for t, a, n in zip(w.text, w.offset, w.length)] == want
    h, of = w.grams(3)
    grams = [(k, x[i:i + 3]) for k, (_, x) in enumerate(want) for i in range(len(x) - 2)]
    assert of.tolist() == [k for k, _ in grams]
    by = {}
    for a, (_, g) in zip(h.tolist(), grams):
        assert by.setdefault(g, a) == a
    assert len(set(by.values())) == len(by)
    assert len(codepoints.Words(["", "1 2"]).hashes()) == 0


def test_long_texts_are_cut_between_words():
    text = "abc défg " * 200
    pieces = list(codepoints.cut(text, 50))
    assert "".join(pieces) == text and all(len(p) <= 50 for p in pieces)
    assert [x for p in pieces for x in p.split()] == text.split()
    assert [len(p) for p in codepoints.cut("a" * 120, 50)] == [50, 50, 20]


# ---- language

def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.fit(docs, label_split("doc_id", 4) != 2)
    out = lang_id.predict(docs, model).filter(label_split("doc_id", 4) == 2)
    right, n, low, high = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 100 and right > 0.97 and 0 <= low <= high <= 1


def test_language_edges(spark):
    train = spark.createDataFrame([(1, "the and of", "en"), (2, "der und das", "de"), (3, None, "en"), (4, "x", None), (None, "el la", "es")],
                                  "doc_id long, text string, lang string")
    model = lang_id.fit(train, F.lit(True))
    docs = edge_docs(spark)
    got = lang_id.predict(docs, model)
    assert got.columns == [*docs.columns, "lang_pred_", "score_"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        no_letter = r.text in (None, "", "   ", "12 + 3 = 15 !!", "́̂")
        assert (r.lang_pred_ == "und") == no_letter and (0 <= r.score_ <= 1)
    blank = lang_id.predict(docs, lang_id.fit(train.limit(0), F.lit(True))).collect()
    assert {r.lang_pred_ for r in blank} == {"und"}
    assert lang_id.predict(docs.limit(0), model).count() == 0


def test_backoff_takes_the_longest_known_order():
    texts = ["abcde abcde abcdx zz", "qq"]
    w = codepoints.Words(texts)
    keys, logs = {}, {}
    for n in (0, *lang_id.ORDERS):
        h = np.unique(w.hashes()[:1] if n == 0 else w.grams(n, np.array([True] + [False] * (w.n - 1)))[0])
        keys[n], logs[n] = h, np.stack([np.full(len(h), -1.0 - n), np.full(len(h), -2.0 - n)], 1)
    m = lang_id.LangModel(["a", "b"], keys, logs)
    total, n = m.scores(texts)
    # two known words, one by its 4-gram abcd (4/5 of a word), one unknown; then nothing known
    assert total[0].tolist() == pytest.approx([-1 - 1 - 5 * 0.8, -2 - 2 - 6 * 0.8]) and n.tolist() == [4, 1]
    assert total[1].tolist() == [0, 0]


# ---- quality

def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, label_split("_id", 4) != 2)
    out = quality.score(docs, model).join(labels, "doc_id").filter(label_split("doc_id", 4) == 2).collect()
    good, bad = ([r.score for r in out if r.quality == k] for k in (1, 0))
    assert np.mean(np.array(good) >= 0.7) > 0.95 and np.mean(np.array(bad) < 0.7) > 0.8


def test_quality_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(0, 1, "x"), (1, 0, "x"), (2, None, "x"), (7, 1, "x"), (7, 0, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    model = quality.fit(docs, labels, F.lit(True))
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score_ <= 1 for r in rows)
    assert next(r.score_ for r in rows if r.doc_id == 1) == next(r.score_ for r in rows if r.text is None)   # empty as null
    blank = quality.fit(docs, labels.limit(0), F.lit(True))
    assert not blank.fitted and {r.score_ for r in quality.score(docs, blank).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    m = quality.fit_gam(x, y, n_pairs=1)
    assert m.pairs[0][:2] == (0, 1)
    assert np.mean((m.score(x) > 0.5) == (y > 0.5)) > 0.95
    assert np.isfinite(quality.fit_gam(np.ones((5, 2)), np.ones(5)).score(np.ones((1, 2)))).all()


def plain_gam(m, x):
    """A score entry by entry: each feature's bin by counting the edges below it."""
    b = [sum(1 for e in m.edges[j] if e <= v) for j, v in enumerate(x)]
    z = m.intercept + sum(t[b[j]] for j, t in enumerate(m.tables))
    for i, j, t in m.pairs:
        z += t[b[i] // m.fold][b[j] // m.fold]
    return 1 / (1 + math.exp(-z))


def test_quality_query_against_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.fit(docs, labels, label_split("_id", 4) != 2)
    want = {r.doc_id: plain_gam(m, quality.features(r.text)) for r in docs.collect()}
    got = {r.doc_id: (r.score, r.predicted) for r in queries.op5_quality(spark, SF).collect()}
    assert set(got) == set(want)
    for i, p in want.items():
        assert got[i][0] == pytest.approx(p, abs=1e-9) and got[i][1] == int(got[i][0] >= 0.7)


# ---- toxicity

WORDS = ["river", "stone", "green", "table", "window", "paper", "light", "morning", "under", "after"]


def toxic_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 200))]
        if i % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron"]))
        out.append((" ".join(words), float(i % 3 == 0)))
    return out


def test_toxicity_of_held_out_texts(spark):
    data = toxic_texts(600, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(data)], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, int(y)) for i, (_, y) in enumerate(data)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("_id") % 4 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, (_, y) in enumerate(data) if i % 4 == 0]
    assert np.mean([(s >= 0.5) == (y > 0) for s, y in held]) > 0.95
    # one insult far inside a long text is found, a long clean text is left alone
    plain = [random.Random(5).choice(WORDS) for _ in range(20_000)]
    s = toxicity.score(spark.createDataFrame([(0, " ".join(plain)), (1, " ".join([*plain[:9000], "idiot moron idiot", *plain[9000:]]))], "doc_id long, text string"), model)
    clean, foul = (r.score for r in sorted(s.collect()))
    assert clean < 0.5 <= foul


def test_toxicity_reads_every_window_of_long_training_texts(spark):
    # one short passage far inside texts of 95 to 190 windows: 48 spread windows miss most of them
    rng = random.Random(11)
    data = toxic_texts(300, 2)
    for i in range(160):
        words = [rng.choice(WORDS) for _ in range(rng.randint(3_000, 6_000))]
        at = rng.randrange(len(words))
        data.append((" ".join([*words[:at], *(["idiot", "moron", "idiot"] if i % 2 else []), *words[at:]]), float(i % 2)))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, (_, y) in enumerate(data)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("_id") % 4 > 1)
    got = {r.doc_id: r.score for r in toxicity.score(docs.filter("doc_id % 4 < 2"), model).collect()}
    held = [(s, data[i][1]) for i, s in got.items() if i >= 300]
    assert len(held) == 80 and np.mean([(s >= 0.5) == (y > 0) for s, y in held]) > 0.95


def test_toxicity_sample_holds_the_rare_label(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(2000)] + [(None, 1), (3, None)], "doc_id long, toxic int")

    def sample(max_docs, allowed=F.lit(True)):
        rows, prior = toxicity.sample_by_label(docs, labels, allowed, "doc_id", "toxic", "text", max_docs)
        y = [r.y for r in rows.collect()]
        return len(y), sum(y), prior
    assert sample(100) == (100, 40, pytest.approx(math.log(40 / 40) - math.log(1960 / 60)))
    assert sample(40) == (40, 20, pytest.approx(math.log(40 / 20) - math.log(1960 / 20)))
    assert sample(5000) == (2000, 40, 0.0)
    assert sample(100, F.col("_id") % 50 != 0) == (100, 0, 0.0)


def test_toxicity_is_fitted_on_half_of_each_label(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(2000)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit_network", lambda sample, **options: sample)
    y = [r.y for r in toxicity.fit(docs, labels, F.lit(True), max_docs=60).collect()]
    assert (len(y), sum(y)) == (60, 30)                                # 2 % of the labels are toxic


def test_toxicity_of_a_rare_label(spark):
    plain, foul = [x for x in toxic_texts(3000, 4) if not x[1]], [x for x in toxic_texts(300, 5) if x[1]]
    data = plain + foul                                                # 5 % toxic
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, (_, y) in enumerate(data)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("_id") % 4 != 0, max_docs=200)
    got = toxicity.score(docs.filter("doc_id % 4 = 0"), model).collect()
    hit = [r.score >= 0.5 for r in got if data[r.doc_id][1]]
    flagged = [r.score >= 0.5 for r in got if not data[r.doc_id][1]]
    assert np.mean(hit) > 0.8 and np.mean(flagged) < 0.02


def test_toxicity_search_reads_whole_texts():
    import pyarrow as pa
    texts = [" ".join(WORDS[i % 7] + WORDS[i % 9] for i in range(n)) for n in (20_000, 30, 0, 700)]
    model = toxicity.ToxicModel(np.empty(0, np.uint64), toxicity.new_params(0, np.random.default_rng(3)), (1, 0, 0))
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7, 8]), pa.array([1.0] * 4), pa.array(texts)], ["key", "y", "text"])
    (got,) = toxicity._searched(iter([batch]), model, 1)
    for text, r in zip(texts, got.to_pylist()):
        logits, _ = toxicity.window_logits(model, [text])
        words = text.split()
        k = [" ".join(words[i * 32:i * 32 + 48]) for i in range(len(logits))]
        assert r["n"] == len(k) and r["best"] == pytest.approx(logits.max(), abs=1e-5) and r["other"] in k
        assert logits[[i for i, x in enumerate(k) if x == r["top"]]].max() == pytest.approx(r["best"], abs=1e-5)


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score_ <= 1 for r in rows)
    assert len({round(r.score_, 6) for r in rows if not (r.text or "").strip()}) == 1
    blank = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert all(r.score_ < 1e-9 for r in toxicity.score(docs, blank).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 47, 48, 49, 80, 81, 500):
        index, mask, text = toxicity.windows(np.array([3, n]))
        own = [sorted(index[:, k][mask[:, k]] - 3) for k in np.flatnonzero(text == 1)]
        assert sorted({int(i) for x in own for i in x}) == list(range(n))
        assert all(b[0] - a[0] == toxicity.STRIDE for a, b in zip(own, own[1:]))


def test_pieces_of_a_long_text_have_its_windows():
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(2000))
    model = toxicity.ToxicModel(np.empty(0, np.uint64), toxicity.new_params(0, np.random.default_rng(0)), (1, 0, 0))
    whole, _ = toxicity.window_logits(model, [text])
    pieces = [h for _, h in toxicity.parts([text], 900)]
    assert len(pieces) > 5
    assert np.allclose(np.concatenate([toxicity.window_logits(model, h)[0] for h in pieces]), whole, atol=1e-5)


def test_scoring_pass_equals_training_pass():
    rng = np.random.default_rng(1)
    texts = [t for t, _ in toxic_texts(20, 3)]
    w = codepoints.Words(texts)
    index, mask, _ = toxicity.windows(np.bincount(w.text, minlength=20))
    m = toxicity.ToxicModel(np.sort(np.unique(w.hashes())[::2]), {}, (1, 0, 0))
    m.params = toxicity.new_params(len(m.vocab), rng)
    x, number = m.inputs(w)
    at, p = np.append(number, len(x) - 1)[index], m.params
    states = np.concatenate([toxicity._run(x @ p[d + "W"] + p[d + "b"], at, mask, p[d + "U"], d == "b") for d in "fb"], 2)
    assert np.allclose(toxicity._pool(p, states, mask)[1] @ p["out"] + p["out_b"], m.logits(w, index, mask), atol=1e-5)


def plain_toxicity(m, text):
    """The score of a whole text, window by window and word by word over the fitted parameters."""
    import unicodedata
    full, odd = 2 ** 64 - 1, 0x9E3779B97F4A7C15

    def mix(h):
        h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & full
        return h ^ h >> 29

    def powered(x):
        return sum(ord(c) * pow(odd, i + 1, 2 ** 64) for i, c in enumerate(x)) & full

    p = {k: v.astype(float) for k, v in m.params.items()}
    place = {h: i for i, h in enumerate(m.vocab.tolist())}
    words = [""]
    for c in text or "":
        if unicodedata.category(c)[0] in "LM":
            words[-1] += c.lower() if len(c.lower()) == 1 else c
        elif words[-1]:
            words.append("")
    words = [x for x in words if x]

    def vector(x):
        own = p["word"][place.get(mix(powered(x) ^ len(x) << 44), -1)]
        grams = [mix(n + powered(x[i:i + n]) & full) & (toxicity.BUCKETS - 1) for n in toxicity.GRAMS for i in range(len(x) - n + 1)]
        return np.concatenate([own, np.mean([p["char"][g] for g in grams], 0) if grams else np.zeros(toxicity.EMBED)])

    def states(xs, d):
        h, out, k = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for x in xs if d == "f" else xs[::-1]:
            a, u = x @ p[f"{d}W"] + p[f"{d}b"], h @ p[f"{d}U"]
            z, r = (1 / (1 + np.exp(-(a[i * k:i * k + k] + u[i * k:i * k + k]))) for i in range(2))
            c = np.tanh(a[2 * k:] + r * u[2 * k:])
            h = z * h + (1 - z) * c
            out.append(h)
        return out if d == "f" else out[::-1]

    cache, logits, start = {}, [], 0
    while True:
        xs = [cache[x] if x in cache else cache.setdefault(x, vector(x)) for x in words[start:start + toxicity.WINDOW]]
        if xs:
            s = np.array([np.concatenate(x) for x in zip(states(xs, "f"), states(xs, "b"))])
            a = np.tanh(s @ p["att"]) @ p["att_v"]
            w = np.exp(a - a.max())
            logits.append(float((w / w.sum()) @ s @ p["out"] + p["out_b"][0]))
        else:
            logits.append(float(p["out_b"][0]))
        if start + toxicity.WINDOW >= len(words):
            break
        start += toxicity.STRIDE
    a, b, c = m.line
    return 1 / (1 + math.exp(-(a * max(logits) + b * math.log(len(logits)) + c)))


def test_toxicity_query_against_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs, labels, label_split("_id", 5) != 0)
    odd = [(10 ** 6 + i, t) for i, t in enumerate([None, "", "12 !", "a", "Ünï " * 100, "one two three " * 16, "word " * 49])]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = docs.filter("doc_id % 3 = 0 or doc_id >= 1000000").collect()
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    assert len(got) == docs.count() and len(rows) > 60
    for r in rows:
        assert got[r.doc_id] == pytest.approx(plain_toxicity(m, r.text), abs=2e-4), r.doc_id


def test_known_words_are_those_that_tell_labels_apart(spark):
    """More distinct words than places: the few that only toxic texts have are known."""
    rng = random.Random(4)
    rows = [(i, float(i % 4 == 0), " ".join([f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(60)]
                                           + ["grobian"] * (i % 4 == 0))) for i in range(200)]
    sample = spark.createDataFrame(rows, "key long, y double, text string").cache()
    m = toxicity.fit_network(sample, rounds=1, max_vocab=3)
    from promptloom.llm.codepoints import Words
    assert len(m.vocab) == 3 and Words(["grobian"]).hashes()[0] in m.vocab


def test_gradients_are_right():
    rng = np.random.default_rng(2)
    data = toxicity._Windows([[t] for t, _ in toxic_texts(4, 9)], 100, 1)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_params(len(data.vocab), rng).items()}
    batch, y, weight = data.batch(np.arange(4)), np.array([1.0, 0, 0, 1]), np.ones(4)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    toxicity._step(p, batch, y, weight, grads)
    for k in p:
        i = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        ends = []
        for e in (1e-3, -1e-3):
            q = {**p, k: p[k].copy()}
            q[k][i] += e
            ends.append(toxicity._step(q, batch, y, weight, {a: np.zeros_like(b) for a, b in q.items()}))
        assert grads[k][i] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=2e-2, abs=1e-5), k


# ---- search

def slow_search(rows, k):
    v = [(i, np.floor(64 * np.array(e, float)).astype(int)) for i, e in rows
         if i is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)]
    dim = max(len(e) for _, e in v)
    v = [(i, np.pad(e, (0, dim - len(e)))) for i, e in v]
    out = []
    for q, e in {i: e for i, e in sorted(v, key=lambda x: (x[0], tuple(-x[1])))}.items():
        if q % 20 == 0:
            best = sorted((-int(e @ x), i) for i, x in v if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("part_rows", [4096, 16])
def test_search_is_exact(spark, part_rows):
    rng = np.random.default_rng(part_rows)
    centre = rng.normal(size=(6, 12))
    rows = [(i, (centre[i % 6] + 0.2 * rng.normal(size=12)).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 12) for i in range(100)]                       # equal vectors: ties
    rows += [(2000, None), (2001, [float("nan")] + [0.0] * 11), (2002, [float("inf")] * 12), (2003, [None] + [1.0] * 11),
             (2020, [0.1] * 5), (2040, []), (None, [1.0] * 12), (7, [0.3] * 12), (2060, [1e-9] * 12), (2061, [-3.0] * 12)]
    df = spark.createDataFrame([(i, e, 1, 2.0) for i, e in rows], "vec_id long, embedding array<float>, score int, r double")
    got = topk_search.search(topk_search.whole_vectors(df), F.col("id") % 20 == 0, 20, pivots=8, part_rows=part_rows, block_queries=10)
    f32 = [(i, None if e is None else [None if c is None else float(np.float32(c)) for c in e]) for i, e in rows]
    assert sorted(map(tuple, got.collect())) == slow_search(f32, 20)


def test_search_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (21, [2.0, 1.0]), (40, None)], "vec_id long, embedding array<float>")
    rows = topk_search.whole_vectors(df)
    assert sorted(map(tuple, topk_search.search(rows, F.col("id") % 20 == 0, 20).collect())) == [(20, 1, 21, 16384)]
    assert topk_search.search(rows.limit(0), F.col("id") % 20 == 0, 20).count() == 0


def test_large_integers_are_summed_exactly():
    space = topk_search.Space(np.zeros((1, 3)), 2 ** 55, 2)
    q = np.array([[2 ** 27 + 1, 3]])
    assert not space.exact and space.scores(q, q).tolist() == [[(2 ** 27 + 1) ** 2 + 9]]


# ---- helpers, queries, pipeline

def test_attach_facts_takes_both_ways(spark):
    rows = spark.createDataFrame([(i, None if i == 9 else "hot" if i < 70 else f"k{i % 7}") for i in range(100)], "id long, key string")
    facts = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("most")).filter("n > 1")
    for parts in (2, 1000):
        got = {r.id: r.most for r in attach_facts(rows, facts, "key", "n", 100, parts).collect()}
        assert len(got) == 100 and got[0] == 69 and got[9] is None and got[70] == 98


def test_free_name():
    assert free_name(["a", "Score", "score_"], "score") == "score__"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_its_sql(spark, name):
    import oracle_harness as H
    sql = queries.ORACLE_SQL.get(name)
    info = H.compare(spark, H.duck(SF), name, queries.QUERIES[name], sql, SF)
    assert info["ok"] in (True, None) and info["rows"] > 0, info


def test_tokens_query_is_the_librarys(spark):
    import hashlib
    import struct

    import public_tokenizers
    import tiktoken

    from promptloom.llm.byte_bpe import load_ranks
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(queries.vocabulary()[0]), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op3_byte_bpe(spark, SF).collect():
        ids = lib.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_near_duplicates_query_against_all_pairs(spark):
    from test_exact_and_near import slow_components, slow_fingerprint
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = slow_components([(i, slow_fingerprint(t)) for i, t in texts])
    got = sorted([(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op7_simhash(spark, SF).collect()], key=str)
    assert got == want


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from test_exact_and_near import FOLD, slow_components, slow_fingerprint
    assert [n for n, _ in P.STAGES] == ["quality classifier", "language ID", "exact dedup", "SimHash near-dedup", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    score = quality.score(docs, quality.fit(docs, labels, label_split("_id", 4) != 2))
    want = {r.doc_id for r in score.filter("score >= 0.7").collect()}
    docs = P.quality_stage(spark, docs, SF)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == want
    docs = P.language_stage(spark, docs, SF)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} <= want
    rows = {r.doc_id: r.text for r in docs.collect()}
    last = {(t or "").translate(FOLD): i for i, t in sorted(rows.items())}
    docs = P.exact_stage(spark, docs, SF)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == set(last.values())
    want = slow_components([(i, slow_fingerprint(rows[i])) for i in last.values()])
    docs = P.near_stage(spark, docs, SF)
    kept = {r.doc_id for r in docs.collect()}
    assert docs.columns == columns and kept == {c for _, _, c in want}
    packed = P.packing_stage(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == kept
    whole = P.run(spark, SF).collect()
    assert sorted(map(str, whole)) == sorted(map(str, packed))


def slow_language(model, text):
    """(language, posterior) of a text, word by word in plain Python over the fitted tables."""
    import unicodedata
    full, odd = 2 ** 64 - 1, 0x9E3779B97F4A7C15

    def mix(h):
        h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & full
        return h ^ h >> 29

    def powered(x):
        return sum(ord(c) * pow(odd, i + 1, 2 ** 64) for i, c in enumerate(x)) & full
    table = {n: dict(zip(model.keys[n].tolist(), model.logs[n].tolist())) for n in model.keys}
    words, letter = [], False
    for c in (text or "") + " ":
        kind = unicodedata.category(c)[0]
        letter |= kind == "L"
        if kind not in "LM":
            words.append("")
        else:
            words = words or [""]
            words[-1] += c.lower() if len(c.lower()) == 1 else c
    if not letter:
        return lang_id.UNKNOWN, 0.0, None
    total, known = [0.0] * len(model.langs), [0] * len(model.langs)
    for x in filter(None, words):
        got = table[0].get(mix(powered(x) ^ len(x) << 44))
        known = known if got is None else [a + (v > model.unseen + 1e-3) for a, v in zip(known, got)]
        for n in (5, 4, 3, 2, 1) if got is None else ():
            hits = [table[n].get(mix(n + powered(x[i:i + n]) & full)) for i in range(len(x) - n + 1)]
            hits = [h for h in hits if h is not None]
            if hits:
                got = [sum(v) / len(hits) * n / (n + 1) for v in zip(*hits)]
                break
        total = [a + b for a, b in zip(total, got or [0.0] * len(total))]
    best = max(total)
    i = total.index(best)
    return model.langs[i], 1 / sum(math.exp(v - best) for v in total), \
        known[i] / n - model.floor[i] if (n := len([x for x in words if x])) >= lang_id.FIT_WORDS else None


def test_language_stage_against_plain_python(spark, tmp_path):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10 ** 6 + i, t, "en") for i, t in enumerate([None, "", "12 + 3", "\u0301\u0302", "漢字 かな", "q", "zu", "xk vv", "ABC"])]
    docs = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = lang_id.fit(docs, label_split("doc_id", 4) != 2)
    slow = {r.doc_id: slow_language(model, r.text) for r in docs.collect()}
    want = {i for i, (lang, p, fit) in slow.items() if lang != lang_id.UNKNOWN and p >= 0.5 and (fit is None or fit >= -P.FIT_MARGIN)}
    got = P.language_stage(spark, docs, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.doc_id for r in got} == want
    assert 0 < len(want) < len(slow)
    fast = {r.doc_id: (r.lang_pred, r.score, r.fit) for r in lang_id.predict(docs, model, fit="fit").collect()}
    for i, (lang, p, fit) in slow.items():
        assert fast[i][0] == lang and fast[i][1] == pytest.approx(p, abs=1e-5)
        assert fast[i][2] == (fit if fit is None or math.isinf(fit) else pytest.approx(fit, abs=1e-4))


def test_a_rare_language_is_learned(spark):
    """One row in 20,000; many languages; repeated rows and null ids, which take no place."""
    common = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("the cat and dog number "), F.element_at(F.array(*map(F.lit, ["runs", "eats", "sleeps", "walks"])), (F.col("id") % 4 + 1).cast("int")),
        F.lit(" near the house of ours")).alias("text"), F.when(F.col("id") % 3 > 0, "en").otherwise("en2").alias("lang"))
    common = common.unionByName(spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("zzz qqq").alias("text"), F.lit("null").alias("lang")))
    common = common.unionByName(spark.range(500).select(F.lit(77_000).cast("long").alias("doc_id"), F.lit("jeden dwa trzy").alias("text"), F.lit("pl").alias("lang")))
    rare = [(30_000 + i, t, lang) for i, (t, lang) in enumerate([("mitakuye oyasin wakan tanka unci maka", "lkt")])]
    rare += [(40_000 + i, f"wort{chr(97 + i % 26) * 3}ein noch{chr(97 + i % 26) * (2 + i // 26)}mal", f"x{i}") for i in range(30)]
    docs = common.unionByName(spark.createDataFrame(rare, common.schema))
    model = lang_id.fit(docs, F.lit(True))
    assert {"lkt", "pl", *(f"x{i}" for i in range(30))} <= set(model.langs) and "null" not in model.langs and model.langs[0] == "en"
    asked = spark.createDataFrame([(1, "wakan tanka oyasin"), (2, "the dog sleeps near the house"), (3, "worthhhein nochhhmal"), (4, "trzy jeden")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in lang_id.predict(asked, model).collect()}
    assert got[1] == "lkt" and got[2] in ("en", "en2") and got[3] == "x7" and got[4] == "pl"


def test_language_fit_does_not_grow_with_length(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_id.fit(docs, label_split("doc_id", 4) != 2)
    model.floor = np.zeros(len(model.langs))                        # the shares themselves; a small language has no floor
    own = docs.filter("lang = 'en'").orderBy("doc_id").first().text
    noise = " ".join(f"xq{chr(97 + i % 26)}zvk{chr(97 + i % 7)}jj" for i in range(400))
    df = spark.createDataFrame([(1, own), (2, own * 20), (3, noise), (4, noise * 20)], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.fit) for r in lang_id.predict(df, model, fit="fit").collect()}
    assert got[1][1] == pytest.approx(got[2][1], abs=0.02) and got[3][1] == pytest.approx(got[4][1], abs=0.02)
    assert got[4][0] > 0.5 and got[3][1] < 0.05 < 0.3 < got[1][1]    # the posterior is sure of noise, the fit is not


def test_pipeline_with_nulls_and_extra_columns(spark, tmp_path):
    import corpus_pipeline as P
    rows = [(1, "the same words here", "en"), (2, "the same words here", "en"), (3, None, None), (4, "", "en"), (None, "other words there", "de")]
    df = spark.createDataFrame([(*r, "x", 0.0, "y") for r in rows], "doc_id long, text string, lang string, lang_pred string, score double, _dedup_key string")
    for table, frame in (("documents", df), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))):
        frame.write.parquet(f"{tmp_path}/{table}.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {2, None}                    # texts without letters go, and one of two copies
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
