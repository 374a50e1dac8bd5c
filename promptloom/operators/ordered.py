"""Running sums in a total order without sorting a whole group in one task.

``running_sum`` gives, for every row, the sum of a weight over the rows of
its group that come before it in ``order_cols`` order.  Rows are range
partitioned on (group, order) -- a group holding a third of all rows is
spread over many range partitions -- and sorted inside each partition.  That
one arrangement is stored (a reliable checkpoint): range bounds come from a
sample, so a second evaluation could draw others.  From the stored copy an
Arrow pass sums each partition (numpy ``cumsum`` with resets at group changes),
and an aggregate gives the totals per partition and group.  A group that goes
on from an earlier partition is the first one of its partition, so there is at
most one offset per range partition; those few rows are broadcast.

Used for lineage positions (P1/W1), prompt reranks (L2) and the rank
statistics of Spearman / AUC (E4, E6).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def _order_exprs(order_cols):
    return [F.col(c) if isinstance(c, str) else c for c in order_cols]


def _changes(col: pa.Array) -> np.ndarray:
    """Does each value but the first differ from the one before?  Nulls equal nulls and
    NaN equals NaN, as in a GROUP BY."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(col.type):
        differ = pc.and_(differ, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
    return pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _same(a, b) -> bool:
    """Equality of two key tuples, with NaN equal to NaN."""
    return b is not None and all(x == y or (x != x and y != y) for x, y in zip(a, b))


def running_sum(df: DataFrame, group_cols, order_cols, weights: dict, *,
                n_ranges: int | None = None, inclusive: bool = False) -> DataFrame:
    """Add one column per ``weights`` entry (``out -> weight column`` or ``None``
    for a count): the sum over earlier rows of the group (``inclusive`` adds
    the row itself).  Ties in ``order_cols`` are ordered arbitrarily, so make
    the order total (add an id) when positions matter."""
    g = list(group_cols)
    outs = list(weights)
    w_cols = {o: (F.col(w).cast("double") if w else F.lit(1.0)) for o, w in weights.items()}
    n = n_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df.select("*", *[w_cols[o].alias(f"_w_{o}") for o in outs])
    order = _order_exprs(order_cols)
    ranged = cut_lineage(base.repartitionByRange(n, *[F.col(c) for c in g], *order)
                         .sortWithinPartitions(*[F.col(c) for c in g], *order)
                         .withColumn("_pid", F.spark_partition_id()))
    schema = T.StructType(ranged.schema.fields + [T.StructField(f"_l_{o}", T.DoubleType()) for o in outs])

    def local_sums(batches):
        last_key, carry = None, {o: 0.0 for o in outs}
        for b in batches:
            n_rows = b.num_rows
            if n_rows == 0:
                continue
            keys = [b.column(k) for k in g]
            change = np.zeros(n_rows, dtype=bool)
            change[0] = True
            for c in keys:
                change[1:] |= _changes(c)
            continues = _same([c[0].as_py() for c in keys], last_key)
            seg = np.cumsum(change) - 1                    # segment of every row
            starts = np.nonzero(change)[0]
            cols = []
            for o in outs:
                w = b.column(f"_w_{o}").to_numpy(zero_copy_only=False).astype(np.float64)
                cs = np.cumsum(w)
                run = cs - np.concatenate(([0.0], cs))[starts][seg]
                if continues:
                    run[seg == 0] += carry[o]
                carry[o] = float(run[-1])
                cols.append(run if inclusive else run - w)
            last_key = [c[-1].as_py() for c in keys]
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array(c, pa.float64()) for c in cols],
                                             names=b.schema.names + [f"_l_{o}" for o in outs])

    summed = ranged.mapInArrow(local_sums, schema)
    totals = ranged.groupBy("_pid", *g).agg(*[F.sum(f"_w_{o}").alias(f"_t_{o}") for o in outs])
    earlier = Window.partitionBy(*g).orderBy("_pid")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.select(F.col("_pid").alias("_k_pid"), *[F.col(c).alias(f"_k_{c}") for c in g],
                             F.row_number().over(earlier).alias("_k_no"),
                             *[F.sum(f"_t_{o}").over(before).alias(f"_o_{o}") for o in outs])
               .where(F.col("_k_no") > 1).drop("_k_no"))      # at most one row per range partition
    cond = F.col("_pid") == F.col("_k_pid")
    for c in g:   # null-safe: a null group key is a group too
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = summed.join(F.broadcast(offsets), cond, "left").drop("_k_pid", *[f"_k_{c}" for c in g])
    for o in outs:
        joined = joined.withColumn(o, F.col(f"_l_{o}") + F.coalesce(F.col(f"_o_{o}"), F.lit(0.0)))
    drop = ["_pid"] + [f"_{p}_{o}" for o in outs for p in ("w", "l", "o")]
    return joined.drop(*drop)


def positions(df: DataFrame, group_cols, order_cols, out: str = "idx", *, base: int = 0,
              n_ranges: int | None = None) -> DataFrame:
    """0-based (or ``base``-based) position of every row inside its group."""
    r = running_sum(df, group_cols, order_cols, {out: None}, n_ranges=n_ranges)
    return r.withColumn(out, (F.col(out) + F.lit(base)).cast("long"))
