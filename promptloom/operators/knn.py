"""Exact k-nearest-neighbour similarity join over ``array<float>`` vectors.

Score is the squared L2 distance (smaller is nearer), the flat-index meaning.
Result rows: ``query_id, shard, shard_ord, rank, corpus_id, score`` with at
most ``k`` rows per (query, shard) -- k from *each* shard, never re-cut to k
over all shards.  Ties are broken by ``corpus_id`` so the order is total.

Three physical strategies, all exact, chosen by size:

* ``corpus`` -- the corpus fits ``max_broadcast_bytes``: it is shipped once to
  every task and the queries are scanned in place by ``mapInArrow``.  A task sees
  the whole corpus, so its lists are final: no shuffle at all.
* ``broadcast`` -- the query side fits: it is shipped, the corpus is scanned in
  place, each task keeps a running top-k per (query, shard) and emits at most k
  rows of each.  A task holds the state of at most ``_LIVE_SHARDS`` shards; the
  oldest is emitted when more turn up (partial lists merge anyway).
* ``tiled`` -- beyond both bounds, queries are dealt into blocks, about one a core; a task
  holds a block (bounded in bytes, float32 vectors stay float32) while the whole corpus
  streams past it, shard by shard, so its lists are final.  What is shuffled is the
  queries once and the corpus once a block; no list of candidates is.  The corpus comes
  in the order of its nearest of ``MAX_PIVOTS`` pivots and the distance from it; a run of
  rows is compared with the queries alone that its bound (triangle inequality, or the plane
  midway between two pivots) leaves in reach.  Pivots and a first bound of the reach come
  from a sample of the corpus.

The partial lists of the second are merged by a ``row_number() <= k`` window
over (query, shard); Spark inserts a partial ``WindowGroupLimit`` before that
shuffle, so each task ships at most k rows per (query, shard).

Distances are first taken in float32 by one matrix product a block, against the k-th distance so
far of each query plus a bound of the rounding error; what is not above it is computed again
exactly in float64.  Of equal vectors of a shard only the ``k + 1`` smallest ids take part, as
no others can be listed.

Query ids are unique.  Null vectors take no part; a vector with a null or non-finite component fails the
query, as it has no distance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PARTIAL_SCHEMA = "query_id long, shard string, corpus_id long, score double"
_PARTIAL_ARROW = pa.schema([("query_id", pa.int64()), ("shard", pa.string()),
                            ("corpus_id", pa.int64()), ("score", pa.float64())])
FINAL_SCHEMA = PARTIAL_SCHEMA + ", rank int"
_FINAL_ARROW = _PARTIAL_ARROW.append(pa.field("rank", pa.int32()))

# distances taken at a time (4 MiB), and the corpus rows among them
_BLOCK_CELLS = 1 << 20
_BLOCK_CORPUS = 1024
_EXACT_PAIRS = 1 << 15     # pairs computed again exactly at a time
_EMIT_ROWS = 1 << 16
_LIVE_SHARDS = 4
MAX_SIDE_BYTES = 64 << 20  # of a side that every task holds
MAX_PIVOTS = 64
_SAMPLE_ROWS = 1 << 13     # of the corpus, and of at most so many bytes
_SAMPLE_BYTES = 8 << 20
MAX_SHARDS = 10_000        # shards are saved index files, named by their makers


def _vectors(col: pa.ChunkedArray | pa.Array, own: bool = False) -> np.ndarray:
    """Arrow list<float> column -> (n, d) float64 matrix (rows must share d); ``own``: of the column's own type."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0))
    offsets = col.offsets.to_numpy()
    lengths = np.diff(offsets)
    d = int(lengths[0])
    if not np.all(lengths == d):
        raise ValueError("all vectors of a knn_join must have the same length")
    values = col.flatten().to_numpy(zero_copy_only=False)
    if not own or values.dtype.kind != "f":
        values = values.astype(np.float64, copy=False)
    if not np.isfinite(values).all():
        raise ValueError("a vector has a null or non-finite component")
    return values.reshape(n, d)


def _norms(x: np.ndarray) -> np.ndarray:
    """Squared lengths in float64, a bounded number of rows at a time."""
    out = np.empty(len(x))
    for lo in range(0, len(x), _EXACT_PAIRS):
        part = x[lo:lo + _EXACT_PAIRS].astype(np.float64, copy=False)
        out[lo:lo + _EXACT_PAIRS] = np.einsum("nd,nd->n", part, part)
    return out


def _exact(Q: np.ndarray, C: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact float64 squared L2 of the pairs (Q[rows], C[cols])."""
    out = np.empty(len(rows))
    for lo in range(0, len(rows), _EXACT_PAIRS):
        at = slice(lo, lo + _EXACT_PAIRS)
        diff = Q[rows[at]].astype(np.float64) - C[cols[at]]
        out[at] = np.einsum("nd,nd->n", diff, diff)
    return out


class _Lists:
    """The k nearest found so far, by (exact score, corpus id), of every query of a block.

    ``limit``: per query a score that its k-th cannot exceed, where one is known."""

    def __init__(self, Q: np.ndarray, qids: np.ndarray, k: int, exclude_self: bool, limit: np.ndarray | None = None):
        self.Q, self.qids, self.k, self.exclude_self = Q, qids, k, exclude_self
        self.norms = _norms(Q)
        self.limit = np.full(len(Q), np.inf) if limit is None else limit
        self.left = None
        self.clear()

    def clear(self) -> None:
        self.scores = np.full((len(self.Q), self.k), np.inf)
        self.ids = np.full((len(self.Q), self.k), -1, dtype=np.int64)
        self.found, self.n_found = [], 0        # beyond the lists: (query, score, id), not yet merged

    def bound(self, C: np.ndarray) -> None:
        """Takes the limits from some rows of the corpus; a query's own row may be among them."""
        self.limit = np.full(len(self.Q), np.inf)
        k = self.k + 1 if self.exclude_self else self.k
        if len(C) < k or C.shape[1] != self.Q.shape[1]:
            return
        cn, qn = _norms(C), self.norms
        error = np.finfo(np.float64).eps * (C.shape[1] + 8) * (np.sqrt(qn) + np.sqrt(cn.max())) ** 2
        right = -2.0 * C.T.astype(np.float64)
        step = max(1, _BLOCK_CELLS // len(C))
        for lo in range(0, len(self.Q), step):
            near = self.Q[lo:lo + step].astype(np.float64) @ right + cn
            self.limit[lo:lo + step] = np.partition(near, k - 1, axis=1)[:, k - 1] + qn[lo:lo + step] + 2 * error[lo:lo + step]

    def reach(self, rows=slice(None)) -> np.ndarray:
        """No score above it can join a query's list."""
        return np.minimum(self.scores[rows, -1], self.limit[rows])

    def _left(self, kind) -> np.ndarray:
        """(-2 q, 1): its product with (c, |c|^2) is the distance without |q|^2."""
        if self.left is None or self.left.dtype != kind:
            self.left = np.ones((self.Q.shape[0], self.Q.shape[1] + 1), kind)
            np.multiply(self.Q, -2, out=self.left[:, :-1], casting="same_kind")
        return self.left

    def fold(self, C: np.ndarray, cids: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Takes the corpus block into the lists of all queries, or of those at ``rows``."""
        n = len(self.Q) if rows is None else len(rows)
        if not n or not len(C):
            return
        if C.shape[1] != self.Q.shape[1]:
            raise ValueError("query and corpus vectors differ in length")
        cn, d = _norms(C), C.shape[1]
        most = np.sqrt(cn.max())
        kind = np.float32 if 1e-30 < cn.max() < 1e30 and self.norms.max(initial=0) < 1e30 else np.float64
        right = np.empty((d + 1, len(C)), kind)
        right[:-1], right[-1] = C.T, cn
        left = self._left(kind)
        step = max(1, _BLOCK_CELLS // min(len(C), _BLOCK_CORPUS))
        for lo in range(0, n, step):
            at = np.arange(lo, min(n, lo + step)) if rows is None else rows[lo:lo + step]
            qn = self.norms[at]
            error = np.finfo(kind).eps * (d + 8) * (np.sqrt(qn) + most) ** 2 + 1e-35
            part = left[lo:lo + step] if rows is None else left[at]
            for a in range(0, len(C), _BLOCK_CORPUS):
                b = min(len(C), a + _BLOCK_CORPUS)
                self._take(at, part @ right[:, a:b], qn, error, C[a:b], cids[a:b])

    def _take(self, at, near, qn, error, C, cids) -> None:
        reach = self.reach(at)
        most = reach - qn + error
        fresh = np.flatnonzero(np.isinf(reach))
        if len(fresh) and self.k < len(C):
            # no list yet: the k-th of the block bounds it
            own = near[fresh]
            if self.exclude_self:
                own[self.qids[at[fresh]][:, None] == cids[None, :]] = np.inf
            most[fresh] = np.partition(own, self.k - 1, axis=1)[:, self.k - 1] + 2 * error[fresh]
        most = np.nextafter(most.astype(near.dtype), near.dtype.type(np.inf))
        some = np.flatnonzero(near.min(axis=1) <= most)
        if not len(some):
            return
        r, c = np.divmod(np.flatnonzero(near[some] <= most[some, None]), len(C))
        r = some[r]
        if self.exclude_self:
            other = self.qids[at[r]] != cids[c]
            r, c = r[other], c[other]
        s = _exact(self.Q, C, at[r], c)
        in_reach = s <= reach[r]
        self.found.append((at[r[in_reach]], s[in_reach], cids[c[in_reach]]))
        self.n_found += len(self.found[-1][0])
        if len(fresh) or self.n_found * 2 > len(self.Q) * self.k:
            self.merge()

    def merge(self) -> None:
        """Takes what was found since the last time into the lists."""
        if not self.n_found:
            return
        r, s, i = map(np.concatenate, zip(*self.found))
        self.found, self.n_found = [], 0
        k, (to, r) = self.k, np.unique(r, return_inverse=True)
        r = np.concatenate([np.repeat(np.arange(len(to)), k), r])
        s = np.concatenate([self.scores[to].ravel(), s])
        i = np.concatenate([self.ids[to].ravel(), i])
        order = np.lexsort((i, s, r))
        r, s, i = r[order], s[order], i[order]
        place = np.arange(len(r)) - np.searchsorted(r, np.arange(len(to)))[r]
        kept = place < k
        # every query has k places at least, so the kept ones fill its row in order
        self.scores[to], self.ids[to] = s[kept].reshape(-1, k), i[kept].reshape(-1, k)

    def rows(self, shard: str):
        """The lists as record batches of bounded size, with their ranks."""
        self.merge()
        step = max(1, _EMIT_ROWS // self.k)
        for lo in range(0, len(self.Q), step):
            at = slice(lo, lo + step)
            yield _emit(self.qids[at], {shard: (self.scores[at], self.ids[at])}, final=True)


def _topk_against(Q, qids, C, cids, shards, k, exclude_self, state):
    """Fold block C into ``state[shard]``, the ``_Lists`` of every shard present."""
    for shard in np.unique(shards):
        cols = np.nonzero(shards == shard)[0]
        if shard not in state:
            state[shard] = _Lists(Q, qids, k, exclude_self)
        state[shard].fold(C[cols], cids[cols])


def _spread_equals(C: np.ndarray, cids: np.ndarray, shards: np.ndarray, k: int) -> np.ndarray:
    """The rows that are left when of equal vectors of a shard only the k + 1 smallest ids take part."""
    codes = np.unique(shards.astype(str), return_inverse=True)[1]
    _, vec = np.unique(np.ascontiguousarray(C + 0.0).view(f"V{C.shape[1] * C.itemsize}").ravel(), return_inverse=True)
    order = np.lexsort((cids, vec, codes))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(vec[order]) != 0) | (np.diff(codes[order]) != 0)
    step = np.ones(len(order), np.int64)
    step[1:] = np.diff(cids[order]) != 0
    place = np.cumsum(step | new)
    place -= place[np.flatnonzero(new)][np.cumsum(new) - 1]
    return np.sort(order[place <= k])


def _emit(qids, state, thresholds=None, final=False) -> pa.RecordBatch:
    """The lists in ``state`` as rows; ``final`` lists carry their ranks."""
    parts_q, parts_s, parts_c, parts_d, parts_r = [], [], [], [], []
    for shard, lists in state.items():
        if isinstance(lists, _Lists):
            lists.merge()
            lists = lists.scores, lists.ids
        best_s, best_i = lists
        mask = np.isfinite(best_s)
        if thresholds is not None and shard in thresholds:
            # exact pruning: nothing above the subset's k-th distance can be in the top k
            mask &= best_s <= thresholds[shard][:, None]
        rows, place = np.nonzero(mask)
        parts_r.append(place + 1)
        parts_q.append(qids[rows])
        parts_s.append(np.full(len(rows), shard, dtype=object))
        parts_c.append(best_i[mask])
        parts_d.append(best_s[mask])
    schema = _FINAL_ARROW if final else _PARTIAL_ARROW
    if not parts_q:
        return pa.RecordBatch.from_pylist([], schema=schema)
    parts = [parts_q, parts_s, parts_c, parts_d, *([parts_r] if final else [])]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(parts, schema.types)],
                                      schema=schema)


def _shard_values(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Shard names as objects, one Python string per distinct name."""
    col = batch.column("shard")
    col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).dictionary_encode()
    return np.asarray(col.dictionary.to_pylist(), dtype=object)[col.indices.to_numpy(zero_copy_only=False)]


def _prepare(queries: DataFrame, corpus: DataFrame, query_key, corpus_key,
             vector_col, query_vector_col, shard_col):
    qv = query_vector_col or vector_col
    q = (queries.where(F.col(qv).isNotNull())
         .select(F.col(query_key).cast("long").alias("query_id"),
                 F.col(qv).alias("vec")))
    shard = (F.coalesce(F.col(shard_col).cast("string"), F.lit("")) if shard_col
             else F.lit("0"))
    c = (corpus.where(F.col(vector_col).isNotNull())
         .select(F.col(corpus_key).cast("long").alias("corpus_id"),
                 F.col(vector_col).alias("vec"), shard.alias("shard")))
    return q, c


def _collect_bounded(side: DataFrame, k: int, max_bytes: int, state_rows: int):
    """One side as an Arrow table when it fits ``max_bytes``, else None.

    The first row gives the dimension, then at most N + 1 rows are collected
    (``limit``); more than N rows means "too big".  ``state_rows``: rows of k
    (score, id) pairs that a task holds for each row of this side."""
    first = side.limit(1).toArrow()
    if first.num_rows == 0:
        return first
    per_row = len(first.column("vec")[0]) * 8 + state_rows * k * 16 + 64
    n_max = max(1, max_bytes // per_row)
    table = side.limit(n_max + 1).toArrow()
    return table if table.num_rows <= n_max else None


_SCAN_NODES = {"LogicalRelation", "LogicalRDD", "Project", "Filter"}


def _is_scan(df: DataFrame) -> bool:
    """Is it read straight from files or a stored table (decided from the classes of the plan's nodes)?"""
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() not in _SCAN_NODES:
            return False
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return True


def _spread(q: DataFrame) -> DataFrame:
    """The queries in parts of like size, two a core at least: a scan is as wide as its bytes ask
    and a derived table as its last shuffle was, but every query costs a pass over the corpus."""
    n = 2 * q.sparkSession.sparkContext.defaultParallelism
    return q if _is_scan(q) and q.rdd.getNumPartitions() >= n else q.repartition(n, "query_id")


def _prune_buckets(c: DataFrame, dim: int) -> int:
    """In how many hash buckets to cut the corpus so that one of them, about 32 times a
    scan task's rows, gives the thresholds; 0: no pruning.

    Only for a corpus that is read straight from files or a stored table over 64 splits
    or more: estimates of joins and aggregates are not sizes, and a derived corpus would
    be computed twice.  No job runs; the result rows are the same either way."""
    if not _is_scan(c):
        return 0
    split = int(c.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    splits = int(str(c._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // split
    return splits // 32 if splits >= 64 and dim else 0


def _thresholds(q_collected, subset: DataFrame, k: int, exclude_self: bool):
    """Per shard, the k-th smallest exact distance of every query within a
    subset of the corpus (+inf when the subset has fewer than k rows of that
    shard).  Any subset gives an upper bound of the true k-th distance."""
    qids, _ = q_collected
    part = _partial_broadcast(None, subset, k, exclude_self, q_collected)
    w = Window.partitionBy("query_id", "shard").orderBy("score", "corpus_id")
    top = part.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == k)
    rows = top.select("query_id", "shard", "score").toArrow()   # at most |Q| x shards rows
    by = np.argsort(qids, kind="stable")
    at = by[np.searchsorted(qids[by], rows.column("query_id").to_numpy())]
    shards, score = _shard_values(rows), rows.column("score").to_numpy()
    out: dict = {}
    for shard in set(shards):
        m = shards == shard
        out[shard] = np.full(len(qids), np.inf)
        out[shard][at[m]] = score[m]
    return out


def _shipped(spark, table: pa.Table, k: int | None = None):
    """A whole corpus, bounded by ``_collect_bounded``, as a broadcast of arrays; ``k``: for lists of k."""
    C, cids, shards = _vectors(table.column("vec"), own=True), table.column("corpus_id").to_numpy(), _shard_values(table)
    if k is not None and C.size:
        left = _spread_equals(C, cids, shards, k)
        C, cids, shards = C[left], cids[left], shards[left]
    return spark.sparkContext.broadcast((C, cids, shards))


class HeldCorpus:
    """A corpus for many searches: stored, and shipped to the executors once if it fits.

    Pass it to ``knn_join`` in the corpus's place; ``release`` lets the copies go."""

    def __init__(self, corpus: DataFrame, *, corpus_key: str, vector_col: str = "embedding", shard_col: str | None = None,
                 shard_order: list | None = None, max_broadcast_bytes: int = MAX_SIDE_BYTES):
        _, c = _prepare(corpus, corpus, corpus_key, corpus_key, vector_col, None, shard_col)
        self.rows = cut_lineage(c)
        self.shard_ord = _shard_ord(corpus, shard_col, shard_order)
        table = _collect_bounded(self.rows, 1, max_broadcast_bytes, 0)
        self.shipped = None if table is None else _shipped(corpus.sparkSession, table)

    def release(self) -> None:
        if self.shipped is not None:
            self.shipped.unpersist()


def _partial_corpus(q: DataFrame, bc, k: int, exclude_self: bool) -> DataFrame:
    """Queries scanned in place against the whole, broadcast corpus: final lists."""
    def scan(batches):
        C, cids, shards = bc.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            Q = _vectors(batch.column("vec"), own=True)
            if len(C) and C.shape[1] != Q.shape[1]:
                raise ValueError("query and corpus vectors differ in length")
            qids = batch.column("query_id").to_numpy()
            state: dict = {}
            _topk_against(Q, qids, C, cids, shards, k, exclude_self, state)
            for shard, lists in state.items():
                yield from lists.rows(shard)

    return q.mapInArrow(scan, FINAL_SCHEMA)


def _partial_broadcast(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, collected,
                       thresholds=None) -> DataFrame:
    qids, Q = collected
    bq = c.sparkSession.sparkContext.broadcast((qids, Q, thresholds))

    def scan(batches):
        qids_, Q_, thr = bq.value
        state: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            C = _vectors(batch.column("vec"), own=True)
            if Q_.shape[0] and C.shape[1] != Q_.shape[1]:
                raise ValueError("query and corpus vectors differ in length")
            cids = batch.column("corpus_id").to_numpy()
            _topk_against(Q_, qids_, C, cids, _shard_values(batch), k, exclude_self, state)
            while len(state) > _LIVE_SHARDS:
                first = next(iter(state))
                yield _emit(qids_, {first: state.pop(first)}, thr)
        yield _emit(qids_, state, thr)

    return c.mapInArrow(scan, PARTIAL_SCHEMA)


def _tiles(nq: int, tile_queries: int, parallelism: int) -> int:
    """Into how many blocks to deal the queries: one a core, more if a block would be too large."""
    return max(1, math.ceil(nq / tile_queries), min(parallelism, math.ceil(nq / _BLOCK_CORPUS)))


def _distinct_enough(c: DataFrame, k: int) -> DataFrame:
    """The corpus without the equal vectors that no list of k can reach: see ``_spread_equals``."""
    w = Window.partitionBy(F.xxhash64("vec"), "shard", "vec").orderBy("corpus_id")
    return c.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= k + 1).drop("_r")


class _Pivots:
    """Points of the corpus's space, and what distances from them leave in reach of a block of queries."""

    def __init__(self, x: np.ndarray, n: int, rounds: int = 4, seed: int = 1):
        """The means of ``n`` groups of the sample ``x``, or fewer: a few rounds of k-means."""
        rng = np.random.default_rng(seed)
        self.at = x[rng.choice(len(x), min(n, len(x)), replace=False)] if len(x) else np.zeros((0, 0))
        for _ in range(rounds if len(x) else 0):
            own = self.distances(x).argmin(1)
            sums = np.zeros_like(self.at)
            np.add.at(sums, own, x)
            counts = np.bincount(own, minlength=len(self.at))[:, None]
            self.at = np.where(counts > 0, sums / np.maximum(counts, 1), self.at)
        self.longest = float(np.sqrt(_norms(self.at).max(initial=0)))
        self.apart = np.sqrt(np.array([_norms(self.at - p) for p in self.at]))
        self.eps = np.finfo(np.float64).eps * (self.at.shape[1] + 8) * 4

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of every vector to every pivot; their squares are right to ``eps (|x| + longest)^2``."""
        out, norms = np.empty((len(x), len(self.at))), _norms(self.at)
        if len(x) and x.shape[1] != self.at.shape[1]:
            raise ValueError("query and corpus vectors differ in length")
        for lo in range(0, len(x), _EXACT_PAIRS):
            part = x[lo:lo + _EXACT_PAIRS].astype(np.float64, copy=False)
            square = _norms(part)[:, None] + norms - 2 * (part @ self.at.T)
            out[lo:lo + _EXACT_PAIRS] = np.sqrt(np.maximum(square, 0))
        return out

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every vector's nearest pivot and its distance from it."""
        if not len(self.at):
            return np.zeros(len(x), np.int32), np.zeros(len(x))
        far = self.distances(x)
        own = far.argmin(1)
        return own.astype(np.int32), far[np.arange(len(x)), own]

    def hold(self, lists: _Lists) -> None:
        """From now on it is about these queries."""
        self.far, self.lengths = self.distances(lists.Q) if len(self.at) else None, np.sqrt(lists.norms)
        if len(self.at):
            self.own = self.far.argmin(1)
            self.nearest = self.far[np.arange(len(self.own)), self.own] ** 2

    def left(self, lists: _Lists, pivot: int, near: float, far: float) -> np.ndarray | None:
        """The queries that may reach a vector whose nearest pivot this is and whose distance from it lies in [near, far]; None: all."""
        if not len(self.at):
            return None
        # without a list there is no bound: a number that every product here stays finite with
        dist, reach = self.far[:, pivot], np.minimum(np.sqrt(np.maximum(lists.reach(), 0)) * (1 + 1e-9), 1e150)
        size = self.lengths + 2 * self.longest + far
        slack = 2 * np.sqrt(self.eps) * size
        ring = np.maximum(dist - far, near - dist) - slack
        # no nearer than the plane midway between the query's own pivot and this one
        apart = self.apart[self.own, pivot]
        beyond = dist ** 2 - self.nearest - 4 * self.eps * size ** 2
        return np.flatnonzero((ring <= reach) & (beyond <= 2 * apart * reach))


def _sample(c: DataFrame) -> pa.Table:
    """A bounded number of the corpus's rows, those of smallest id hash."""
    first = c.limit(1).toArrow()
    rows = max(1, min(_SAMPLE_ROWS, _SAMPLE_BYTES // (8 * max(1, len(first.column("vec")[0]))))) if first.num_rows else 1
    return c.select("corpus_id", "vec", "shard").orderBy(F.xxhash64("corpus_id"), "corpus_id").limit(rows).toArrow()


def _tiled(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, nq: int, tile_queries: int, tile_corpus: int) -> DataFrame:
    """A block of queries a task, the corpus streamed past it: final lists."""
    spark = q.sparkSession
    n = _tiles(nq, tile_queries, spark.sparkContext.defaultParallelism)
    kind = c.schema["vec"].dataType.simpleString()
    if q.schema["vec"].dataType.simpleString() != kind:
        kind = "array<double>"
    vec = F.col("vec").cast(kind).alias("vec")
    some = _sample(c)
    sample, names = _vectors(some.column("vec")), _shard_values(some) if some.num_rows else np.array([], object)
    bc = spark.sparkContext.broadcast((_Pivots(sample, min(MAX_PIVOTS, len(sample) // 64 + 1)), sample, names))

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, bc.value[0].place(_vectors(b.column("vec"), own=True)))],
                                                 [*b.schema.names, "pivot", "r"])

    placed = _distinct_enough(c, k).select("corpus_id", vec, "shard").mapInArrow(
        place, f"corpus_id long, vec {kind}, shard string, pivot int, r double")
    held = q.select(F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("tile"), F.lit(0).alias("side"), F.lit("").alias("shard"),
                    F.lit(-1).alias("pivot"), F.lit(0.0).alias("r"), F.col("query_id").alias("id"), vec)
    past = placed.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tile"), F.lit(1).alias("side"), "shard", "pivot", "r",
                         F.col("corpus_id").alias("id"), "vec")
    run = min(tile_corpus, _BLOCK_CORPUS)

    def scan(batches):
        pivots, sample, of = bc.value
        tile, shard, held, lists = None, None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tiles, sides, names = batch.column("tile").to_numpy(), batch.column("side").to_numpy(), _shard_values(batch)
            near, r = batch.column("pivot").to_numpy(), batch.column("r").to_numpy()
            ids, vecs = batch.column("id").to_numpy(), _vectors(batch.column("vec"), own=True)
            cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(sides) != 0) | (names[1:] != names[:-1]) | (np.diff(near) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if tiles[lo] != tile:
                    if lists is not None:
                        yield from lists.rows(shard)
                    tile, held, lists, shard = tiles[lo], [], None, None
                if sides[lo] == 0:
                    held.append((vecs[lo:hi].copy(), ids[lo:hi].copy()))
                    continue
                if lists is None and held:
                    lists, held = _Lists(*map(np.concatenate, zip(*held)), k, exclude_self), []
                    pivots.hold(lists)
                if lists is not None and names[lo] != shard:
                    if shard is not None:
                        yield from lists.rows(shard)
                        lists.clear()
                    shard = names[lo]
                    lists.bound(sample[of == shard])
                for at in range(lo, hi if lists is not None else lo, run):
                    end = min(hi, at + run)
                    lists.fold(vecs[at:end], ids[at:end], pivots.left(lists, near[lo], r[at], r[end - 1]))
        if lists is not None:
            yield from lists.rows(shard)

    rows = held.unionByName(past).repartitionById(n, "tile").sortWithinPartitions("tile", "side", "shard", "pivot", "r")
    return rows.mapInArrow(scan, FINAL_SCHEMA)


def knn_join(queries: DataFrame, corpus: DataFrame | HeldCorpus, k: int, *,
             query_key: str, corpus_key: str | None = None, vector_col: str = "embedding",
             query_vector_col: str | None = None, shard_col: str | None = None,
             shard_order: list | None = None, exclude_self: bool = False,
             strategy: str = "auto", max_broadcast_bytes: int = MAX_SIDE_BYTES,
             tile_queries: int = 1 << 17, tile_corpus: int = 16384,
             prune_buckets: int | None = None) -> DataFrame:
    """k nearest corpus rows (per shard) for every query row; exact.

    ``exclude_self`` drops pairs whose query and corpus ids are equal before
    ranking.  ``corpus`` may be a ``HeldCorpus``, whose own key and shards then hold.  ``shard_order`` fixes the order of shards (``shard_ord``); without
    it integral shards are their own order and others are numbered by name.

    ``strategy``: ``corpus``, ``broadcast`` or ``tiled`` to insist on one (a side
    that does not fit falls through to the next); ``auto`` takes the first that fits.
    ``tile_queries``: queries that a task of the tiled plan holds at most; ``tile_corpus``:
    corpus rows that it folds in at a time.

    ``prune_buckets`` (broadcast strategy): first rank the queries against one of
    so many hash buckets of the corpus (a filter, run by all scan tasks) and keep,
    in the full scan, only candidates within each query's k-th distance there --
    still exact, and each task then ships far fewer than k rows per query.
    ``None`` decides from the scan's size; 0 disables.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    if strategy not in ("auto", "corpus", "broadcast", "tiled"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if isinstance(corpus, HeldCorpus):
        q, _ = _prepare(queries, queries, query_key, query_key, query_vector_col or vector_col, None, None)
        c, shard_ord, shipped = corpus.rows, corpus.shard_ord, corpus.shipped
    else:
        q, c = _prepare(queries, corpus, query_key, corpus_key, vector_col,
                        query_vector_col, shard_col)
        shard_ord = _shard_ord(corpus, shard_col, shard_order)
        held = _collect_bounded(c, k, max_broadcast_bytes, 0) if strategy in ("auto", "corpus") else None
        shipped = None if held is None else _shipped(q.sparkSession, held, k)
    if shipped is not None:
        ranked = _partial_corpus(_spread(q), shipped, k, exclude_self)
    else:
        held = _collect_bounded(q, k, max_broadcast_bytes, _LIVE_SHARDS) if strategy != "tiled" else None
        if held is not None:
            collected = held.column("query_id").to_numpy(), _vectors(held.column("vec"), own=True)
            n = _prune_buckets(c, collected[1].shape[1]) if prune_buckets is None else prune_buckets
            thresholds = None
            if n > 1 and len(collected[0]):
                subset = c.where(F.pmod(F.xxhash64("corpus_id"), F.lit(n)) == 0)
                thresholds = _thresholds(collected, subset, k, exclude_self)
            partial = _partial_broadcast(q, c, k, exclude_self, collected, thresholds)
            ranked = _ranked(partial, k)
        else:
            nq, ids = q.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
            ranked = _tiled(q, c, k, exclude_self, nq, tile_queries, tile_corpus)
            if ids < nq:        # rows of one id share a list
                ranked = _ranked(ranked.drop("rank"), k)
    return ranked.select("query_id", "shard", shard_ord.alias("shard_ord"),
                         F.col("rank").cast("int").alias("rank"), "corpus_id", "score")


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "shard").orderBy("score", "corpus_id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _shard_ord(corpus: DataFrame, shard_col: str | None, shard_order: list | None):
    """The place of a shard: as given, else its integral value, else its place by name.

    Names are listed from the corpus (one row per shard, a pruned column)."""
    integral = shard_col is None or corpus.schema[shard_col].dataType.simpleString() in (
        "tinyint", "smallint", "int", "bigint")
    if shard_order is None and integral:
        return F.col("shard").cast("int")
    if shard_order is None:
        names = corpus.select(F.coalesce(F.col(shard_col).cast("string"), F.lit("")).alias("s")).distinct()
        shard_order = sorted(r["s"] for r in names.limit(MAX_SHARDS + 1).collect())
        if len(shard_order) > MAX_SHARDS:
            raise ValueError(f"more than {MAX_SHARDS} shard names: give shard_order or integral shards")
        if all(s.lstrip("-").isdigit() for s in shard_order):
            return F.col("shard").cast("int")
    order = F.create_map(*[x for i, s in enumerate(shard_order) for x in (F.lit(str(s)), F.lit(i))]) \
        if shard_order else F.create_map().cast("map<string,int>")
    return order[F.col("shard")].cast("int")


def merged_order(candidates: DataFrame, global_k: int | None = None) -> DataFrame:
    """One ascending list over all shards, still k x shards rows per query, or
    with ``global_k`` the first that many of it.

    Adds ``pos`` (1-based) ordered by (score, shard_ord, rank).
    """
    w = Window.partitionBy("query_id").orderBy("score", "shard_ord", "rank")
    merged = candidates.withColumn("pos", F.row_number().over(w))
    return merged if global_k is None else merged.where(F.col("pos") <= global_k)


def search(corpus: DataFrame, query_vector, k: int, *, corpus_key: str,
           vector_col: str = "embedding") -> DataFrame:
    """Single query vector, top k by (distance, id); a TakeOrderedAndProject.

    ``query_vector`` is a Python list of floats or a Column holding one vector
    (for instance from a one-row aggregate joined by the caller).
    """
    qv = query_vector if not isinstance(query_vector, (list, tuple, np.ndarray)) \
        else F.array(*[F.lit(float(x)) for x in query_vector])
    diffs = F.zip_with(F.col(vector_col), qv,
                       lambda a, b: (a.cast("double") - b.cast("double"))
                       * (a.cast("double") - b.cast("double")))
    dist = F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return (corpus.select(F.col(corpus_key).alias("corpus_id"), dist.alias("score"))
            .orderBy("score", "corpus_id").limit(k))
