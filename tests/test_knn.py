import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.operators.knn import knn_join, merged_order


def brute(X, ids, shards, k, exclude):
    out = set()
    for i in range(len(ids)):
        for s in sorted(set(shards)):
            m = (shards == s) & ((ids != ids[i]) if exclude else True)
            d = ((X[m] - X[i]) ** 2).sum(1)
            o = np.lexsort((ids[m], d))[:k]
            for r, j in enumerate(o):
                out.add((int(ids[i]), str(s), r + 1, int(ids[m][j]), round(float(d[j]), 9)))
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(300, 8)).astype(np.float32)
    X[10] = X[11] = X[12]          # exact copies: ties broken by id
    ids = np.arange(300, dtype=np.int64) * 3 + 1
    shards = (ids % 3).astype(np.int64)
    rows = [(int(i), [float(v) for v in x], int(s)) for i, x, s in zip(ids, X, shards)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, shard int")
    return df, X.astype(np.float64), ids, shards


@pytest.mark.parametrize("strategy", ["corpus", "broadcast", "tiled"])
@pytest.mark.parametrize("exclude", [True, False])
def test_knn_matches_brute_force(spark, vectors, strategy, exclude):
    df, X, ids, shards = vectors
    r = knn_join(df, df, 7, query_key="id", corpus_key="id", shard_col="shard", exclude_self=exclude,
                 strategy=strategy, tile_queries=64, tile_corpus=50)
    got = {(a, b, c, d, round(e, 9)) for a, b, c, d, e in
           r.select("query_id", "shard", "rank", "corpus_id", "score").collect()}
    assert got == brute(X, ids, shards, 7, exclude)


def test_knn_same_for_1_and_8_partitions(spark, vectors):
    df, *_ = vectors
    a = knn_join(df.coalesce(1), df.coalesce(1), 5, query_key="id", corpus_key="id", shard_col="shard")
    b = knn_join(df.repartition(8), df.repartition(8), 5, query_key="id", corpus_key="id", shard_col="shard")
    assert sorted(a.collect()) == sorted(b.collect())


def test_k_larger_than_shard_gives_fewer_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 2.0], 1)],
                               "id long, embedding array<float>, shard int")
    r = knn_join(df, df, 5, query_key="id", corpus_key="id", shard_col="shard")
    assert r.where("query_id = 1 AND shard = '0'").count() == 2
    assert r.where("query_id = 1 AND shard = '1'").count() == 1
    m = merged_order(r).where("query_id = 1").orderBy("pos").select("corpus_id").collect()
    assert [x[0] for x in m] == [1, 2, 3]


def test_knn_threshold_pruning_is_exact(spark, vectors):
    df, X, ids, shards = vectors
    r = knn_join(df.repartition(6), df.repartition(6), 4, query_key="id", corpus_key="id", shard_col="shard",
                 exclude_self=True, strategy="broadcast", prune_buckets=3)
    got = {(a, b, c, d, round(e, 9)) for a, b, c, d, e in
           r.select("query_id", "shard", "rank", "corpus_id", "score").collect()}
    assert got == brute(X, ids, shards, 4, True)


def test_more_shards_than_a_task_holds(spark, vectors):
    df, X, ids, _ = vectors
    many = df.withColumn("shard", F.col("id") % 9)
    r = knn_join(many, many, 2, query_key="id", corpus_key="id", shard_col="shard", strategy="broadcast")
    got = {(a, b, c, d, round(e, 9)) for a, b, c, d, e in
           r.select("query_id", "shard", "rank", "corpus_id", "score").collect()}
    assert got == brute(X, ids, ids % 9, 2, False)


@pytest.mark.parametrize("strategy", ["corpus", "broadcast", "tiled"])
def test_named_shards_are_ordered_by_name(spark, vectors, strategy):
    df, *_ = vectors
    named = df.withColumn("shard", F.concat(F.lit("p"), ((F.col("id") / 3).cast("int") % 3).cast("string")))
    r = knn_join(named, named, 1, query_key="id", corpus_key="id", shard_col="shard", strategy=strategy).collect()
    assert {(x.shard, x.shard_ord) for x in r} == {("p0", 0), ("p1", 1), ("p2", 2)}
    assert len(r) == 3 * df.count()


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
@pytest.mark.parametrize("strategy", ["corpus", "broadcast", "tiled"])
def test_a_vector_without_distances_fails(spark, vectors, bad, strategy):
    df, *_ = vectors
    worse = df.unionByName(spark.createDataFrame([(5000, [bad] + [0.0] * 7, 0)], df.schema))
    with pytest.raises(Exception, match="non-finite"):
        knn_join(df.limit(5), worse, 3, query_key="id", corpus_key="id", strategy=strategy).collect()


def test_pruning_is_decided_from_plan_nodes(spark, tmp_path, vectors):
    from promptloom.operators.knn import _prune_buckets
    df, *_ = vectors
    path = f"{tmp_path}/Join/Python-Window"      # words of a path are not nodes
    df.repartition(70).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
    try:
        assert _prune_buckets(spark.read.parquet(path).where("id > 0"), 8) > 1
        assert _prune_buckets(spark.read.parquet(path).join(df.select("id"), "id"), 8) == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tiled_lists_are_final(spark, vectors):
    """The corpus streams past blocks of queries: no cogroup of tiles, no merge of partial lists by query."""
    df, *_ = vectors
    r = knn_join(df, df, 3, query_key="id", corpus_key="id", shard_col="shard", strategy="tiled", tile_queries=100)
    p = r._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in p and "Window [row_number" not in p, p


def test_as_many_blocks_as_cores_whatever_the_size():
    from promptloom.operators.knn import _tiles
    assert [_tiles(n, 1 << 17, 12) for n in (100, 50_000, 500_000, 1_500_000)] == [1, 12, 12, 12]
    assert _tiles(3_000_000, 1 << 17, 12) == 23


@pytest.mark.parametrize("strategy", ["corpus", "broadcast", "tiled"])
def test_large_groups_of_copies(spark, strategy):
    rows = [(i, [1.0, float(i % 2)]) for i in range(400)] + [(i, [1e6 + i, 1e6]) for i in range(400, 420)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    X = np.array([x for _, x in rows], np.float32).astype(float)
    r = knn_join(df, df, 4, query_key="id", corpus_key="id", exclude_self=True, strategy=strategy, tile_queries=50)
    got = {(a, str(b), c, d, round(e, 9)) for a, b, c, d, e in r.select("query_id", "shard", "rank", "corpus_id", "score").collect()}
    ids = np.arange(420)
    assert got == brute(X, ids, np.zeros(420, int), 4, True)


def test_copies_that_no_list_can_reach_are_left_out(spark):
    from promptloom.operators.knn import _distinct_enough, _spread_equals
    rows = [(i % 50, "s", [0.0, 1.0]) for i in range(100)] + [(7, "t", [0.0, 1.0])]
    c = spark.createDataFrame(rows, "corpus_id long, shard string, vec array<float>")
    assert _distinct_enough(c, 2).count() == 3 * 2 + 1
    left = _spread_equals(np.array([r[2] for r in rows], np.float32), np.array([r[0] for r in rows]), np.array([r[1] for r in rows], object), 2)
    assert len(left) == 7


def test_runs_out_of_reach_are_left_out(spark):
    """Queries are not compared with a run of the corpus that its bound keeps out of their reach."""
    from promptloom.operators.knn import _Lists, _Pivots
    rng = np.random.default_rng(3)
    for offset in (0.0, 1e6):        # far from the origin distances are known less well, and bounds give way
        groups = [rng.normal(size=(200, 6)) + offset + 1000.0 * g for g in range(4)]
        X = np.concatenate(groups)
        pivots = _Pivots(X, 16)
        own, r = pivots.place(X)
        order = np.lexsort((r, own))
        lists = _Lists(X, np.arange(len(X)), 5, False)
        pivots.hold(lists)
        lists.bound(X[::4])
        met = 0
        for p in np.unique(own):
            at = order[own[order] == p]
            left = pivots.left(lists, p, r[at[0]], r[at[-1]])
            met += len(left) * len(at)
            lists.fold(X[at], at, left)
        lists.merge()
        assert met < 0.35 * len(X) ** 2      # of four groups far apart, three are out of reach
        d = ((X[:, None] - X[None]) ** 2).sum(2)
        for i in range(len(X)):
            assert list(lists.ids[i]) == list(np.lexsort((np.arange(len(X)), d[i]))[:5])


def test_tiled_limits_hold_where_a_shard_has_few_rows(spark):
    """A sample with fewer than k rows of a shard bounds nothing; rows of one id share a list."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=4)], 0 if i < 290 else 1) for i in range(296)]
    df = spark.createDataFrame(rows + rows[:3], "id long, embedding array<float>, shard int")
    a, b = (sorted(map(tuple, knn_join(df, df, 10, query_key="id", corpus_key="id", shard_col="shard", exclude_self=True,
                                       strategy=s, tile_queries=100).select("query_id", "shard", "rank", "corpus_id", F.round("score", 9)).collect()))
            for s in ("broadcast", "tiled"))
    assert len(b) == 296 * 10 + 287 * 6 + 3 * 10 + 6 * 5
    assert len(a) == len(b) and [x[:3] for x in a] == [x[:3] for x in b]
