"""Exact top-k inner products through a pivot-distance index.

Inner products become distances by one more component: a vector x gets
sqrt(M - |x|^2) (M: the largest squared norm), a query gets 0; then
|q - x|^2 = |q|^2 + M - 2 <q, x>.  Every vector is keyed by its nearest pivot and its
distance r to it.  A cell's vectors are cut into annuli by r, and an annulus into parts
of at most about ``part_rows`` (equal vectors, which no radius separates, by a hash).
By the triangle inequality a vector of the annulus [r1, r2] is at least
max(D - r2, r1 - D) from a query at distance D from the pivot, which bounds its score.

Search: each query first meets one part near it; its k-th score there is a floor.
Then it meets only the parts whose bound reaches the floor.  Inside a part the sorted
radii are expanded outwards from D in steps, and a query stops when the bound of the
next annulus falls below its k-th score so far.  At most k rows per query leave a part,
none below the floor, and a window keeps the k best.

Pivots are fitted on a bounded sample (``sample`` vectors of smallest hash); every
vector is indexed.  Scores are integers and exact: they are summed in float64 where no
partial sum can exceed 2**53, in int64 beyond.  Bounds carry a margin above any
rounding error, so rounding costs work and never a result.

Rows: null vectors and vectors with a null or non-finite component take no part;
shorter vectors count as filled up with zeros; a null id takes no part; repeated ids
are rows of their own (a query meets no row of its own id), and a query id that occurs
twice is searched once, with its smallest vector; ties go to the smaller id; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

MARGIN = 1e-6            # of the largest squared distance: far above float64 rounding
FOUND = "query_id bigint, vec_id bigint, score bigint"


def whole_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v, norm): floor(scale * component) of the vectors that take part, and the squared norm."""
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = table.filter(e.isNotNull() & F.col(vec_id).isNotNull() & fine)
    rows = rows.select(F.col(vec_id).cast("bigint").alias("id"),
                       F.transform(e, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return rows.withColumn("norm", F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x * x))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Integer vectors as rows, zero-filled to ``dim`` components."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


class Space:
    """Pivots in the extended space, and the bounds."""

    def __init__(self, pivots: np.ndarray, most: int, dim: int):
        self.pivots, self.most, self.dim = pivots, float(most), dim
        self.slack = MARGIN * (4 * self.most + 1)
        self.exact = most < 2 ** 53

    def distances(self, v: np.ndarray, norm: np.ndarray, query: bool) -> np.ndarray:
        """To every pivot."""
        last = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.most - norm, 0.0))
        x = np.concatenate([v.astype(float), last[:, None]], 1)
        length = norm.astype(float) if query else np.full(len(v), self.most)
        d2 = length[:, None] - 2 * x @ self.pivots.T + (self.pivots ** 2).sum(1)
        return np.sqrt(np.maximum(d2, 0))

    def bound(self, norm: np.ndarray, away: np.ndarray) -> np.ndarray:
        """The largest score of a vector at least ``away`` from a query."""
        return (norm + self.most - np.maximum(away, 0) ** 2) / 2 + self.slack

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.exact:
            return np.rint(q.astype(float) @ x.astype(float).T).astype(np.int64)
        return q.astype(np.int64) @ x.astype(np.int64).T


def fit_space(rows: DataFrame, pivots: int = 32, sample: int = 4096, rounds: int = 8) -> Space | None:
    """Pivots by k-means over the sample; the largest norm and dimension over all rows."""
    most, dim = rows.agg(F.max("norm"), F.max(F.size("v"))).first()
    if most is None:
        return None
    dim = max(1, dim)
    got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v", "norm").toArrow()
    v, norm = matrix(got.column("v"), dim).astype(float), got.column("norm").to_numpy()
    x = np.concatenate([v, np.sqrt(np.maximum(float(most) - norm, 0.0))[:, None]], 1)
    centre = np.unique(x, axis=0)
    centre = centre[np.linspace(0, len(centre) - 1, min(pivots, len(centre))).astype(int)]
    for _ in range(rounds):
        near = (-2 * x @ centre.T + (centre ** 2).sum(1)).argmin(1)
        count = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return Space(centre, int(most), dim)


def keyed(rows: DataFrame, shared) -> DataFrame:
    """rows plus (cell, r): the nearest pivot and the distance to it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            d = s.distances(matrix(b.column("v"), s.dim), b.column("norm").to_numpy(), False)
            cell = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                                             [*b.schema.names, "cell", "r"])

    return rows.mapInArrow(each, "id bigint, v array<bigint>, norm bigint, cell int, r double")


def build(rows: DataFrame, shared, part_rows: int = 4096, max_parts: int = 32_768) -> tuple[DataFrame, np.ndarray]:
    """The stored index (id, v, norm, cell, r, part) and its directory: part, cell, r1, r2.

    At most about ``max_parts`` parts: beyond that they grow with the table."""
    index = cut_lineage(keyed(rows, shared))
    n = index.count()
    part_rows = max(part_rows, -(-n // max_parts))
    cells = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
        "r", [i / 64 for i in range(1, 64)], 1000).alias("cuts")).collect()     # one row per pivot
    rings, at = {}, 0
    for row in sorted(cells, key=lambda x: x["cell"]):
        k = min(64, -(-row["n"] // part_rows))
        cuts = sorted({row["cuts"][round(i * 64 / k) - 1] for i in range(1, k)})
        rings[row["cell"]] = (cuts, at)
        at += len(cuts) + 1
    ring = F.lit(0)
    for cell, (cuts, base) in rings.items():
        own = F.lit(base)
        for c in cuts:
            own = own + (F.col("r") > c).cast("int")
        ring = F.when(F.col("cell") == cell, own).otherwise(ring)
    index = index.withColumn("ring", ring)
    sizes = index.groupBy("ring").count().collect()                             # 64 rings a pivot at most
    many = {r["ring"]: -(-r["count"] // (2 * part_rows)) for r in sizes if r["count"] > 2 * part_rows}
    subs = F.lit(1)
    for r, k in many.items():
        subs = F.when(F.col("ring") == r, k).otherwise(subs)
    index = index.withColumn("part", F.col("ring").cast("bigint") * 1_000_000 + F.pmod(F.xxhash64("id", "v"), subs))
    index = cut_lineage(index.select("id", "v", "norm", "cell", "r", "part"))
    parts = index.groupBy("part").agg(F.first("cell").alias("cell"), F.min("r").alias("r1"), F.max("r").alias("r2"))
    return index, parts.toArrow().to_pandas().sort_values("part").to_numpy(float)


def _routes(queries: DataFrame, shared, directory, floor: bool, blocks: int) -> DataFrame:
    """A row (tile, query) for each part a query must meet: the part nearest to it, or,
    with a floor, all those whose bound reaches it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, parts = shared.value, directory.value
        part, cell = parts[:, 0].astype(np.int64), parts[:, 1].astype(int)
        for batch in batches:
            step = max(1, (4 << 20) // max(1, len(part)))
            for i in range(0, batch.num_rows, step):
                b = batch.slice(i, step)
                norm = b.column("norm").to_numpy().astype(float)
                d = s.distances(matrix(b.column("v"), s.dim), norm, True)[:, cell]
                away = np.maximum(d - parts[:, 3], parts[:, 2] - d)
                if floor:
                    low = b.column("floor").to_numpy(zero_copy_only=False).astype(float)
                    q, p = np.nonzero(~(s.bound(norm[:, None], away) < np.where(np.isnan(low), -np.inf, low)[:, None]))
                else:
                    q, p = np.arange(len(d)), np.maximum(away, 0).argmin(1)
                ids = b.column("id").to_numpy()
                tile = part[p] * blocks + (ids[q].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
                take = pa.array(q)
                cols = [pa.array(tile), *(b.column(c).take(take) for c in ("id", "v", "norm"))]
                cols.append(b.column("floor").take(take) if floor else pa.nulls(len(q), pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, ["tile", "id", "v", "norm", "floor"])

    return queries.mapInArrow(each, "tile bigint, id bigint, v array<bigint>, norm bigint, floor bigint")


def expand(q_id, q, q_norm, floor, ids, x, r, d, space: Space, k: int, step: int = 256):
    """Top-k of each query in one part, by annuli of ``step`` sorted radii outwards from d.

    Returns (query row, id, score) arrays; none below a query's floor."""
    by = np.argsort(r, kind="stable")
    ids, x, r = ids[by], x[by], r[by]
    begins = np.arange(0, len(r), step)
    r1, r2 = r[begins], r[np.minimum(begins + step, len(r)) - 1]
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    best_s, best_i = np.full((len(q), k), low), np.full((len(q), k), high)
    away = np.maximum(np.maximum(d[:, None] - r2, r1 - d[:, None]), 0)
    order = np.argsort(away, axis=1, kind="stable")          # sorted outwards: once one is out, all after are
    going = np.ones(len(q), bool)
    for t in range(len(begins)):
        ring = order[:, t]
        reach = space.bound(q_norm, away[np.arange(len(q)), ring])
        going &= reach >= np.maximum(best_s[:, -1], floor)
        if not going.any():
            break
        for g in np.unique(ring[going]):
            rows = np.flatnonzero(going & (ring == g))
            at = slice(begins[g], begins[g] + step)
            s = space.scores(q[rows], x[at])
            i = np.broadcast_to(ids[at], s.shape)
            least = np.maximum(best_s[rows, -1], floor[rows])
            good = (s >= least[:, None]) & (i != q_id[rows][:, None])
            some = good.any(1)
            if not some.any():
                continue
            rows, good = rows[some], good[some]
            s = np.concatenate([best_s[rows], np.where(good, s[some], low)], 1)
            i = np.concatenate([best_i[rows], np.where(good, i[some], high)], 1)
            top = np.lexsort((i, ~s))[:, :k]         # ~s falls as s grows
            best_s[rows], best_i[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
    ok = (best_i != high) & (best_s >= floor[:, None])
    row, col = np.nonzero(ok)
    return row, best_i[row, col], best_s[row, col]


def _meet(routes: DataFrame, index: DataFrame, shared, k: int, blocks: int) -> DataFrame:
    """Every tile's queries against its part: (query_id, vec_id, score)."""
    tiles = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0)
    tiled = index.withColumn("b", tiles).select((F.col("part") * blocks + F.col("b")).alias("tile"), "id", "v", "r", "cell")

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        s = shared.value
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        q, norm = matrix(left.column("v"), s.dim), left.column("norm").to_numpy().astype(float)
        cell = right.column("cell").to_numpy()[0]
        q_id = left.column("id").to_numpy()
        low = left.column("floor").fill_null(np.iinfo(np.int64).min).to_numpy()
        d = s.distances(q, norm, True)[:, cell]
        row, ids, score = expand(q_id, q, norm, low, right.column("id").to_numpy(), matrix(right.column("v"), s.dim),
                                 right.column("r").to_numpy(), d, s, k)
        return pa.table({"query_id": q_id[row], "vec_id": ids, "score": score})

    return routes.groupBy("tile").cogroup(tiled.groupBy("tile")).applyInArrow(each, FOUND)


def search(rows: DataFrame, is_query: Column, k: int = 20, pivots: int = 32, block_queries: int = 8192,
           part_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each query.

    ``rows``: the output of ``whole_vectors``; ``is_query`` is over its ``id``."""
    rows = cut_lineage(rows)
    space = fit_space(rows, pivots)
    if space is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(space)                             # pivots: a few KB each
    index, parts = build(rows, shared, part_rows)
    directory = sc.broadcast(parts)                          # max_parts rows of 32 bytes, about
    queries = rows.filter(is_query).groupBy("id").agg(F.min("v").alias("v"), F.min_by("norm", "v").alias("norm"))
    queries = cut_lineage(queries)
    blocks = max(1, -(-queries.count() // block_queries))
    near = _meet(_routes(queries, shared, directory, False, blocks), index, shared, k, blocks)
    floors = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
    floors = floors.filter(F.col("n") >= k).select(F.col("query_id").alias("id"), "floor")
    queries = cut_lineage(queries.join(floors, "id", "left"))
    found = _meet(_routes(queries, shared, directory, True, blocks), index, shared, k, blocks)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
