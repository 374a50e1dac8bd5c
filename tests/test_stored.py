"""Committed folders, discovery, the lexical and the vector index, drawing, vocabulary, counters,
margins, spans and summary-level ROUGE against plain versions."""

import math
import random
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from promptloom.functions import metrics as M
from promptloom.operators import lexical_index, vector_index, vocab
from promptloom.operators.augment import augment, augment_logged
from promptloom.operators.bm25 import ENGLISH_STOP_WORDS, bm25_join
from promptloom.operators.knn import knn_join
from promptloom.operators.mixture import draw, quotas
from promptloom.operators.rank import confidence, rank_classify, second_scores
from promptloom.session import bounded_broadcast
from promptloom.sources import discovery, io
from promptloom.sources.commit import MARK, Folder, is_committed
from promptloom.sources.tables import read_table


# ---- committed folders

def test_writes_count_only_when_whole(spark, tmp_path):
    one, two = spark.range(3), spark.range(5)
    path = f"{tmp_path}/out"
    one.write.parquet(path)                                   # no mark: an interrupted attempt
    assert not is_committed(spark, path)
    assert io.write_once(lambda: two, spark, path) and spark.read.parquet(path).count() == 5
    assert not io.write_once(lambda: 1 / 0, spark, path)      # whole: the plan is not even made
    with pytest.raises(ZeroDivisionError):
        Folder(spark, path).write(lambda folder: (one.write.parquet(folder), 1 / 0))
    assert spark.read.parquet(path).count() == 5 and is_committed(spark, path)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]    # attempts that failed are gone
    (tmp_path / "out" / MARK).unlink()
    with pytest.raises(FileNotFoundError):
        io.load_shard(spark, str(tmp_path), "out")
    assert io.write_once(lambda: one, spark, path, partition_by=()) and spark.read.parquet(path).count() == 3


def test_shards_are_replaced_whole(spark, tmp_path):
    for n in (4, 2):
        io.save_shard(spark.range(n), str(tmp_path), "s", key_name="id", extra={"n": n})
        df, conf = io.load_shard(spark, str(tmp_path), "s")
        assert df.count() == n and conf["n"] == n and conf["dataset_paths"] == []


def test_metadata_in_one_object_or_one_a_line(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "t1": {"original_dataset_name": ["x"]},\n "t2": {"omit_templates": ["y"]}\n}\n')
    (tmp_path / "b.json").write_text('{"t1": {"original_dataset_name": ["x"]}}\n{"t2": {"omit_templates": ["y"]}}\n\n')
    for name in "ab":
        rows = sorted(map(tuple, io.task_metadata(spark, f"{tmp_path}/{name}.json").collect()))
        assert rows == [("t1", ["x"], None), ("t2", None, ["y"])]


# ---- discovery

NAMES = {"cos_e__v1.11__k-20": ["cos_e_v1.11_rationale", "cos_e_v1.11_a b", "cos_e_v1.11_q+x"], "cos__none__k-20": ["cos_e", "cos_own"],
         "odd[1]__none__k": ["odd[1]_{x}", "odd1_y"]}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("folders")
    n = 0
    for ds, names in NAMES.items():
        for name in names:
            for split in ("train", "test"):
                n += 1
                spark.range(n).select(F.col("id"), F.lit(name).alias("t")).write.parquet(f"{root}/{ds}/{name}/split={split}")
    return str(root)


def test_folders_by_prefix_and_first(spark, folders):
    def names(**kw):
        return sorted((r.task, r.basename) for r in discovery.list_folders(spark, folders, **kw).collect())
    every = sorted((None, b) for ns in NAMES.values() for b in ns)
    assert names() == every
    assert names(tasks=["cos_e", "cos"]) == sorted(
        [("cos", b) for ns in list(NAMES.values())[:2] for b in ns] + [("cos_e", b) for b in NAMES["cos_e__v1.11__k-20"] + ["cos_e"]])
    assert names(tasks=["cos_e_v1.11"], exact=True) == sorted(("cos_e_v1.11", b) for b in NAMES["cos_e__v1.11__k-20"])
    assert names(tasks=["odd[1]"]) == [("odd[1]", "odd[1]_{x}")]
    assert names(tasks=["cos"], first=2) == [("cos", "cos_e"), ("cos", "cos_own")]
    assert names(tasks=["none such"]) == names(tasks=[]) == []


def test_folders_read_in_one_scan(spark, folders):
    paths = discovery.folder_paths(discovery.list_folders(spark, folders))
    got = discovery.read_folders(spark, paths, "id bigint, t string")
    counts = {(r.path.rsplit("/", 1)[1], r.split): r["count"] for r in got.groupBy("path", "split", "t").count().collect()}
    assert all(r.path.endswith("/" + r.t) and r.path in paths for r in got.select("path", "t").distinct().collect())
    n, want = 0, {}
    for names in NAMES.values():
        for name in names:
            for split in ("train", "test"):
                n += 1
                want[name, split] = n
    assert counts == want
    assert len(got.inputFiles()) > 1 and discovery.read_folders(spark, [], "id bigint").collect() == []


def test_schema_contract_names_the_folder(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/d/good")
    spark.range(2).select(F.col("id").cast("string")).write.parquet(f"{tmp_path}/d/bad")
    paths = discovery.folder_paths(discovery.list_folders(spark, str(tmp_path)))
    with pytest.raises(ValueError, match="bad: id is string, not bigint"):
        discovery.read_folders(spark, paths, "id bigint")
    with pytest.raises(ValueError, match="x is missing"):
        discovery.read_folders(spark, paths[1:], "id bigint, x string")


# ---- lexical index

def same_ranking(a, b):
    a, b = (sorted(map(tuple, x.select("query_id", "rank", "doc_id", "score").collect())) for x in (a, b))
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert all(math.isclose(x[3], y[3], rel_tol=1e-9) for x, y in zip(a, b))
    return a


@pytest.mark.parametrize("shards,block_docs,k,seed_terms", [(16, 64, 5, 4), (3, 4, 1, 1), (1, 1, 10, 2), (2, 1000, 3, 50)])
def test_index_gives_the_exact_ranking(spark, tmp_path, shards, block_docs, k, seed_terms):
    rng = random.Random(shards)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 200]))) for _ in range(250)] + [None, "", "the The w1 w2", "w1"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 30])))) for i in range(40)] + [(90, None), (91, ""), (92, "unseen"), (93, "w1 w1 the")]
    queries = spark.createDataFrame(asked, "q long, text string")
    assert lexical_index.build(docs, f"{tmp_path}/ix", corpus_key="doc_id", shards=shards, block_docs=block_docs)
    assert not lexical_index.build(docs, f"{tmp_path}/ix", corpus_key="doc_id")
    index = lexical_index.LexicalIndex(spark, f"{tmp_path}/ix")
    rows = same_ranking(index.search(queries, k, query_key="q", seed_terms=seed_terms), bm25_join(queries, docs, k, query_key="q", corpus_key="doc_id"))
    assert len(rows) > 40 or k == 1


def test_index_skips_blocks_of_whole_tables(spark, tmp_path):
    docs, queries = read_table(spark, SF_SMALL, "documents"), read_table(spark, SF_SMALL, "benchmark")
    lexical_index.build(docs, f"{tmp_path}/ix", corpus_key="doc_id", block_docs=4, stop_words=ENGLISH_STOP_WORDS)
    index = lexical_index.LexicalIndex(spark, f"{tmp_path}/ix")
    kw = dict(query_key="item_id", stop_words=ENGLISH_STOP_WORDS)
    same_ranking(index.search(queries, 5, **kw), bm25_join(queries, docs, 5, corpus_key="doc_id", **kw))
    n = index.pair_rows(queries, 1, **kw)
    assert n["scored"] < n["all"] and n["blocks_kept"] < n["blocks"] / 2, n


def test_index_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    lexical_index.build(docs, f"{tmp_path}/ix", corpus_key="doc_id")
    queries = spark.createDataFrame([(1, "a b")], "q long, text string")
    assert lexical_index.LexicalIndex(spark, f"{tmp_path}/ix").search(queries, 3, query_key="q").collect() == []
    with pytest.raises(FileNotFoundError):
        lexical_index.LexicalIndex(spark, f"{tmp_path}/none")


def test_index_blocks_lie_together_and_are_scored_in_place(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.choice([3, 20])))) for i in range(400)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices(words, k=20))) for i in range(20)], "q long, text string")
    lexical_index.build(docs, f"{tmp_path}/ix", corpus_key="doc_id", shards=3, block_docs=4)
    index = lexical_index.LexicalIndex(spark, f"{tmp_path}/ix")
    lies = index.postings.withColumn("file", F.input_file_name()).groupBy("shard", "block").agg(F.countDistinct("file").alias("files"))
    assert {r.files for r in lies.collect()} == {1}
    # a bound that terms and blocks keep, but not a row for every query, block and term
    monkeypatch.setattr(lexical_index, "bounded_broadcast", lambda df: bounded_broadcast(df, max_rows=1000))
    weights = index.weights(queries, "q", "text")
    blocks = index.candidates(weights, index.floors(weights, 5, 4, 5))
    assert weights.count() <= 1000 < blocks.join(weights, "query_id").count()
    plan = index.scores(blocks, weights)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan
    same_ranking(index.search(queries, 5, query_key="q"), bm25_join(queries, docs, 5, query_key="q", corpus_key="doc_id"))


def test_index_ranks_alike_beyond_every_broadcast(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i % 7}" * (1 + i % 2)) for i in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b1 c2"), (2, "c3 c4"), (None, "a")], "q long, text string")
    lexical_index.build(docs, f"{tmp_path}/ix", corpus_key="doc_id", shards=2, block_docs=4)
    index = lexical_index.LexicalIndex(spark, f"{tmp_path}/ix")
    near = sorted(map(tuple, index.search(queries, 4, query_key="q").collect()))
    monkeypatch.setattr(lexical_index, "bounded_broadcast", lambda df: df)
    far = sorted(map(tuple, index.search(queries, 4, query_key="q").collect()))
    assert [r[:3] for r in near] == [r[:3] for r in far] and len(near) == 8


# ---- vector index

def vectors(spark, n, dim=8, seed=1, clusters=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 10
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim))
    x[: n // 10] = x[0]                                                       # equal vectors: ties
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 3)) for i in range(n)] + [(n, None, 0)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, shard int")


@pytest.mark.parametrize("shard,exclude,k,part_rows", [(None, True, 5, 16), ("shard", False, 3, 8), ("shard", True, 60, 4000), (None, False, 1000, 32)])
def test_vector_index_is_exact(spark, shard, exclude, k, part_rows):
    v = vectors(spark, 400)
    kw = dict(query_key="id", corpus_key="id", shard_col=shard, exclude_self=exclude)
    a = vector_index.indexed_join(v, v, k, part_rows=part_rows, **kw)
    b = knn_join(v, v, k, **kw)
    assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_vector_index_skips_parts(spark):
    counts = {}
    v = vectors(spark, 2000, clusters=40)
    r = vector_index.indexed_join(v, v, 5, query_key="id", corpus_key="id", pivots=40, part_rows=20, counts=counts)
    assert r.count() == 10_000
    assert counts["met"] < counts["pairs"] / 5, counts
    assert vector_index.indexed_join(v, v.limit(0), 5, query_key="id", corpus_key="id").collect() == []


def test_vector_index_stores_no_pairs_of_query_and_part(spark):
    """Queries that reach every part: what is shuffled does not grow with the pairs, no list is merged."""
    v = vectors(spark, 300)
    index = vector_index.VectorIndex.build(v, corpus_key="id", part_rows=4)
    q = v.where("embedding IS NOT NULL").select(F.col("id").alias("query_id"), F.col("embedding").alias("vec"))
    assert index.parts.count() > 50 and index._seeds(q, 4).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 4
    p = index.search(v, 4, query_key="id")._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in p and "Window [row_number" not in p, p


def test_rows_of_one_query_id_share_a_list(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in (1, 2, 3, 4, 5)] + [(1, [1.0, 0.0])], "id long, embedding array<float>")
    r = vector_index.indexed_join(v, v, 5, query_key="id", corpus_key="id", exclude_self=True).where("query_id = 1").orderBy("rank").collect()
    assert [x.corpus_id for x in r] == [2, 2, 2, 2, 3]
    t = knn_join(v, v, 3, query_key="id", corpus_key="id", exclude_self=True, strategy="tiled").where("query_id = 1").orderBy("rank").collect()
    assert [x.corpus_id for x in t] == [2, 2, 3]


# ---- drawing in proportion

def plain_draw(examples, mix, n, seed=42):
    by = defaultdict(list)
    for t, k in examples:
        by[t].append(k)
    out = []
    for m in sorted({m for m, _, _ in mix}):
        live = [(t, r) for x, t, r in mix if x == m and r and r > 0 and by.get(t)]
        total = sum(r for _, r in live)
        exact = {t: float(n) * r / total for t, r in live}
        quota = {t: math.floor(x) for t, x in exact.items()}
        for t in sorted(exact, key=lambda t: (-(exact[t] - quota[t]), t))[:n - sum(quota.values())]:
            quota[t] += 1
        draws = []
        for t, q in quota.items():
            keys = sorted(by[t], key=lambda k: (md5(f"{seed}|{k}".encode()).hexdigest(), k))
            for i in range(q):
                e, pos = divmod(i, len(keys))
                start = int(md5(f"{seed}|{t}|{e}".encode()).hexdigest()[:8], 16)
                draws.append(((i + 0.5) / q, md5(f"{seed}|{m}|{t}|{i}".encode()).hexdigest(), t, e, keys[(pos - start) % len(keys)]))
        out += [(m, i, t, e, k) for i, (_, _, t, e, k) in enumerate(sorted(draws))]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 7, 100, 1000])
def test_draw_is_the_plain_one(spark, n):
    examples = [("hot", i) for i in range(120)] + [("few", 1000 + i) for i in range(4)] + [("one", 5000)] + [("no rate", 6000)]
    mix = [("m", "hot", 10.0), ("m", "few", 3.0), ("m", "one", 0.5), ("m", "absent", 5.0), ("m", "no rate", 0.0),
           ("other", "few", 1.0), ("other", "one", 1.0), ("none", "absent", 1.0), ("none", "hot", None)]
    ex, mx = spark.createDataFrame(examples, "task_name string, idx long"), spark.createDataFrame(mix, "mixture string, task_name string, rate double")
    got = sorted(map(tuple, draw(ex, mx, n).collect()))
    assert got == plain_draw(examples, mix, n)
    per = Counter(r[0] for r in got)
    assert per == {"m": n, "other": n}
    if n == 1000:
        seen = Counter(r[4] for r in got if r[0] == "m" and r[2] == "few")
        assert len(seen) == 4 and max(seen.values()) - min(seen.values()) <= 1     # epochs go through all
        first = Counter(r[2] for r in got if r[0] == "m" and r[1] < 100)
        assert abs(first["hot"] - 74) <= 2                                          # every stretch in proportion


def test_quotas_add_up(spark):
    rng = random.Random(3)
    mix = [("m", f"t{i}", rng.random()) for i in range(37)]
    mx = spark.createDataFrame(mix, "mixture string, task_name string, rate double")
    sizes = mx.select("task_name", F.lit(5).alias("size"))
    for n in (1, 10, 999):
        assert quotas(mx, sizes, n).agg(F.sum("quota")).first()[0] == n


# ---- vocabulary

@pytest.mark.parametrize("hot", [100_000, 2])
def test_vocabulary_round_trip(spark, monkeypatch, hot):
    monkeypatch.setattr(vocab, "HOT_TOKENS", hot)
    texts = ["a b a c", "b  b\n a", None, "", "é a rare", "c c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    v = vocab.build_vocab(df, "text")
    assert {r.token: r.id for r in v.collect()} == {"a": 3, "b": 4, "c": 5, "rare": 6, "é": 7}
    ids = vocab.encode(df, v, key="id", col="text", eos=True)
    back = {r.id: r for r in vocab.decode(ids, v, key="id", ids="ids").collect()}
    for i, t in enumerate(texts):
        assert back[i].tokens == (t or "").split() and back[i].ids[-1] == vocab.EOS
    few = vocab.build_vocab(df, "text", min_count=2, max_size=2)
    got = {r.id: (r.ids, r.tokens) for r in vocab.decode(vocab.encode(df, few, key="id", col="text"), few, key="id", ids="ids").collect()}
    assert got[4] == ([2, 3, 2], ["<unk>", "a", "<unk>"]) and got[2] == ([], [])


def test_every_document_comes_back(spark):
    df = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    v = vocab.build_vocab(df, "text")
    out = vocab.decode(vocab.encode(df, v, key="doc_id", col="text"), v, key="doc_id", ids="ids")
    assert out.where(F.array_join("tokens", " ") != F.array_join(F.array_remove(F.split("text", r"[ \t\n\x0B\f\r]+"), ""), " ")).count() == 0
    assert out.count() == df.count()


def test_tokens_are_looked_up_where_they_lie(spark, monkeypatch):
    """No token is shuffled while the vocabulary is within the bounds; rows of one key share their ids."""
    df = spark.createDataFrame([(1, "a b a"), (2, None), (None, "a")], "id long, text string")
    v = vocab.build_vocab(df, "text")
    ids = vocab.encode(df, v, key="id", col="text")
    p = ids._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in p and "Generate" not in p, p
    assert {r.id: r.ids for r in ids.collect()} == {1: [3, 4, 3], 2: [], None: []}
    twice = df.unionByName(spark.createDataFrame([(1, "b")], df.schema))
    assert [r.ids for r in vocab.encode(twice, v, key="id", col="text").where("id = 1").collect()] == [[3, 4, 4, 3]] * 2


# ---- counters

def test_log_of_the_run_itself(spark):
    rows = spark.createDataFrame([(i, f"d{i % 3}", "en" if i % 2 else "de", i, f"in {i}", "x") for i in range(12)],
                                 "row_id long, dataset_name string, template_name string, idx long, inputs_pretokenized string, targets_pretokenized string")
    cand = [(q, 0, r + 1, (q + r) % 12, float(r)) for q in range(12) for r in range(4)]
    c = spark.createDataFrame(cand, "query_id long, shard_ord int, rank int, corpus_id long, score double")
    omit = rows.where("template_name = 'de'").select("dataset_name", "template_name")
    out, log = augment_logged(rows, c, rows, 2, max_length=6, omit_templates=omit)
    n = log.first().asDict()
    assert n["n_candidates"] == 48 and n["n_self"] == 12
    assert n["n_not_original"] == sum(1 for q, _, _, d, _ in cand if q != d and d % 2 == 0)
    assert n["n_rows"] == 12 and n["n_not_enough"] == out.where(F.size("chosen_examples") < 2).count() > 0
    assert n["n_exceed_max_length"] == out.where(F.size("inputs") == 6).count() > 0
    plain = augment(rows, c, rows, 2, max_length=6, omit_templates=omit)
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
    assert augment_logged(rows, c, rows, 0)[1].first()["n_candidates"] == 0


# ---- margin, spans, summaries

def test_margin(spark):
    s = spark.createDataFrame([(1, 0, -1.0), (1, 1, -3.0), (1, 2, -2.0), (2, 0, -5.0), (3, 0, -1.0), (3, 1, -1.0)], "id int, choice_idx int, score double")
    p = second_scores(s, rank_classify(s, ["id"]), ["id"])
    got = {r.id: (r.prediction, r.confidence) for r in confidence(p, order="margin").collect()}
    assert got == {1: (0, 1.0), 2: (0, None), 3: (0, 0.0)}


def test_spans_are_cut_by_tokens(spark):
    rows = [(1, ["a well known, fact"], "It is a well-known, fact.", 2, 5), (2, ["x"], "x y", 1, 0), (3, ["x y"], "x y", 0, 9),
            (4, ["y"], "x y", -1, 1), (5, ["y"], "x y", None, 1), (6, [""], None, 0, 1), (7, ["y"], "x y", 1, 1)]
    df = spark.createDataFrame(rows, "id int, answers array<string>, context string, start int, end int")
    got = {r.id: r.t for r in df.select("id", M.span_text("context", "start", "end").alias("t")).collect()}
    assert got == {1: "a well known fact", 2: "", 3: "x y", 4: "", 5: "", 6: "", 7: "y"}
    r = M.span_squad(df, ["id"], "id").collect()
    assert {x.id: x.exact_match for x in r} == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 0.0, 6: 1.0, 7: 1.0}
    text = M.squad(df.withColumn("p", F.lit("a well-known, fact")).where("id = 1"), [], "id", prediction="p").first()
    assert text.exact_match == 0.0                                    # the text form keeps the hyphenated word whole


def plain_lcs_sets(a, b):
    """All longest common subsequences of a and b, as sets of places in a."""
    best, found = 0, {frozenset()}
    for mask in range(1 << len(a)):
        at = [i for i in range(len(a)) if mask >> i & 1]
        rest = iter(b)
        if all(any(a[i] == y for y in rest) for i in at):
            if len(at) > best:
                best, found = len(at), set()
            if len(at) == best:
                found.add(frozenset(at))
    return found


def test_common_places_are_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(7))] for _ in range(2))
        assert frozenset(M._common_places(a, b)) in plain_lcs_sets(a, b)


def test_summary_level_rouge(spark):
    # w1 w2 w3 w4 w5 against two sentences: the union of w1 w2 and w1 w3 w5 (the published example)
    ref, summary = [["w1", "w2", "w3", "w4", "w5"]], [["w1", "w2", "w6", "w7", "w8"], ["w1", "w3", "w8", "w9", "w5"]]
    assert M.union_lcs_hits(ref, summary) == 4
    assert M.union_lcs_hits([["a", "a"]], [["a"], ["a"]]) == 1          # both sentences match the same place
    assert M.union_lcs_hits([["a"], ["a"]], [["a"]]) == 1               # a token counts once for each that the summary holds
    df = spark.createDataFrame([(1, "w1 w2 w3 w4 w5", "W1 w2 w6, w7 w8\nw1 w3 w8 w9 w5\n\n"), (2, "", "x"), (3, None, "x")], "g int, target string, prediction string")
    got = {r.g: r.rougeLsum for r in M.rouge_l_sum(df, ["g"]).collect()}
    assert got[1] == pytest.approx(2 * 0.8 * 0.4 / 1.2) and got[2] == 0.0
    one = spark.createDataFrame([(1, "a b c d", "a c d e")], "g int, target string, prediction string")
    assert M.rouge_l_sum(one, []).first()[0] == pytest.approx(M.rouge_l(one, []).first()[0])


# ------------------------------------------------------- template-augmented folders
SET_SCHEMA = "id bigint, inputs_pretokenized string, targets_pretokenized string"


def _stored_set(spark, tmp_path, rows):
    root = str(tmp_path / "p3")
    for ds, name, split, i, text in rows:
        spark.createDataFrame([(i, text, "y")], SET_SCHEMA).write.mode("append").parquet(f"{root}/{ds}/{name}/split={split}")
    return root


def test_template_set_of_folders(spark, tmp_path):
    from promptloom.plans.composite import template_augmented_folders
    root = _stored_set(spark, tmp_path, [
        ("anli__none__k-1", "anli_ask_r1_score_eval", "train", 1, "a b"), ("anli__none__k-1", "anli_ask_r2", "validation", 2, "c"),
        ("anli__none__k-1", "anli_left_out", "train", 3, "d"), ("glue__mrpc__k-1", "glue_mrpc_same", "train", 4, None)])
    tpl = spark.createDataFrame([("anli", "ask", "A ?"), ("glue_mrpc", "same", "S")], "task string, template_name string, template_str string")
    meta = spark.createDataFrame([("anli", ["left"]), ("glue_mrpc", None)], "task string, omit_templates array<string>")
    out, log = template_augmented_folders(spark, root, str(tmp_path / "own"), tpl, schema=SET_SCHEMA, metadata=meta, max_length=4)
    got = {r["id"]: r for r in out.collect()}
    assert set(got) == {1, 2, 4}
    assert got[1]["inputs_pretokenized"] == "A ?\n\na b" and len(got[1]["inputs"]) == 4
    assert got[1]["chosen_examples"].asDict() == {"task_full_name": "anli", "template_name": "ask", "template_str": "A ?"}
    assert (got[2]["basename"], got[2]["split"]) == ("anli_ask_r2", "validation")
    assert got[4]["output_name"] == "glue__mrpc__p3__template_augmented_use_original" and got[4]["inputs_pretokenized"] is None
    assert log.collect() == [(4, 1, 3, 1)]
    # a whole set is not written again, whatever the folders hold by then
    again, log = template_augmented_folders(spark, str(tmp_path / "p3"), str(tmp_path / "own"), tpl, schema=SET_SCHEMA,
                                            metadata=meta, tasks=["anli"])
    assert again.count() == 3 and log.first()["n_folders"] == 4
    # inputs as they are
    out, log = template_augmented_folders(spark, root, str(tmp_path / "none"), tpl, schema=SET_SCHEMA, metadata=meta,
                                          tasks=["anli"], mode="none")
    assert sorted((r["id"], r["inputs_pretokenized"], r["chosen_examples"]) for r in out.collect()) == [(1, "a b", None), (2, "c", None)]
    assert log.collect() == [(3, 1, 2, 0)]
    # the nearest training template
    train = spark.createDataFrame([("t", "x", "S S"), ("t", "y", "other words")], tpl.schema)
    out, _ = template_augmented_folders(spark, root, str(tmp_path / "near"), tpl, schema=SET_SCHEMA, metadata=meta,
                                        tasks=["glue_mrpc"], mode="nearest", train_templates=train)
    assert [r["chosen_examples"]["template_name"] for r in out.collect()] == ["x"]


def test_template_set_fails_or_is_empty(spark, tmp_path):
    from promptloom.plans.composite import template_augmented_folders
    root = _stored_set(spark, tmp_path, [("a__none__k", "a_t", "train", 1, "x")])
    tpl = spark.createDataFrame([("a", "u", "A")], "task string, template_name string, template_str string")
    meta = spark.createDataFrame([("a", [])], "task string, omit_templates array<string>")
    with pytest.raises(Exception, match="no template: a/t"):
        template_augmented_folders(spark, root, str(tmp_path / "o1"), tpl, schema=SET_SCHEMA, metadata=meta)
    with pytest.raises(Exception, match="unseen task: a"):
        template_augmented_folders(spark, root, str(tmp_path / "o2"), tpl, schema=SET_SCHEMA, metadata=meta.where("task = 'b'"))
    assert not (tmp_path / "o1").exists() and not (tmp_path / "o2").exists()
    out, log = template_augmented_folders(spark, root, str(tmp_path / "o3"), tpl, schema=SET_SCHEMA, metadata=meta, tasks=["b"])
    assert out.count() == 0 and log.collect() == [(0, 0, 0, 0)]
