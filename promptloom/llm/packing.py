"""Best-fit packing into bins of several permitted capacities.

Documents longer than the largest capacity are cut into pieces of it; pieces are dealt
evenly to shards of about ``shard_pieces`` (by a hash of row number and piece number, so that
neither an id nor rows that are equal can fill one), and every shard is packed longest piece first.  A piece goes into
the open bin that it leaves least room in; where none fits, a bin is opened at the
capacity of least cost per token it is expected to hold: cost(c) over the piece plus a
fraction ``fill`` of the room beyond it.  Several fractions are tried and the
cheapest packing stays.  At last each bin shrinks to the smallest permitted capacity
that holds its contents.

Rows: a null or zero length gives one row with no bin; a negative length fails;
equal lengths go by id and piece number; a null id is packed like any other; repeated
rows are packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

CAPACITIES = (1024, 2048, 4096, 8192)
PACKED = "piece bigint, start bigint, length bigint, shard bigint, bin bigint, capacity bigint, offset bigint"


def sequence_cost(capacity: int) -> float:
    """Default cost of a sequence: linear and attention work, and a fixed share per sequence."""
    return 64 + capacity * (1 + capacity / 32768)


def open_size(length: int, capacities: Sequence[int], cost: Callable[[int], float], fill: float) -> int:
    """The capacity of least cost per token expected in it; ties: the smaller one."""
    return min((c for c in capacities if c >= length),
               key=lambda c: (cost(c) / (length + fill * (c - length)), c))


def best_fit(lengths: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float],
             fill: float) -> tuple[list[int], list[int], list[int], float]:
    """Packs lengths in the order given: bin and offset of each, capacity of each bin, total cost.

    Open bins lie in stacks by the room they have left; a bit set of the rooms in use
    finds the smallest one that is large enough.  Equal rooms: the bin used last."""
    rooms: dict[int, list[int]] = {}
    in_use, sizes, used, where, offsets = 0, [], [], [], []
    opened = {}
    for n in lengths:
        above = in_use >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                in_use &= ~(1 << room)
        else:
            room = opened.get(n) or opened.setdefault(n, open_size(n, capacities, cost, fill))
            b = len(sizes)
            sizes.append(room)
            used.append(0)
        where.append(b)
        offsets.append(used[b])
        used[b] += n
        if left := room - n:
            rooms.setdefault(left, []).append(b)
            in_use |= 1 << left
    final = [min(c for c in capacities if c >= u) for u in used]
    return where, offsets, final, sum(map(cost, final))


def pack_shard(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES,
               cost: Callable[[int], float] = sequence_cost, fills: Sequence[float] = (0.0, 0.5, 0.9, 1.0)):
    """The cheapest of the packings by each ``fill``; ties: the first."""
    return min((best_fit(lengths, capacities, cost, f) for f in fills), key=lambda x: x[3])


def pack(docs: DataFrame, length: Column, doc_id: str = "doc_id", capacities: Sequence[int] = CAPACITIES,
         cost: Callable[[int], float] = sequence_cost, fills: Sequence[float] = (0.0, 0.5, 0.9, 1.0),
         shard_pieces: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, piece, start and length in its document, and the shard,
    bin, final capacity and offset it is packed at."""
    capacities = sorted(capacities)
    top = capacities[-1]
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("bigint").alias("n"))
    sized = sized.withColumn("n", F.when(F.col("n") < 0, F.raise_error("a length is negative").cast("bigint")).otherwise(F.col("n")))
    # stored with a number: rows of one id and length are told apart, and a task that runs again deals them alike
    sized = cut_lineage(sized.withColumn("row", F.monotonically_increasing_id()))
    total = sized.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / top).cast("bigint"))
    pieces = sized.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "row", "piece", (F.col("piece") * top).alias("start"),
                           F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("bigint").alias("length"))
    empty = pieces.filter("length = 0")
    dealt = pieces.filter("length > 0").withColumn(
        "shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    kind = docs.schema[doc_id].dataType.simpleString()

    def each(table: pa.Table) -> pa.Table:
        t = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        where, offsets, sizes, _ = pack_shard(t.column("length").to_pylist(), capacities, cost, fills)
        add = {"bin": where, "capacity": [sizes[b] for b in where], "offset": offsets}
        for name, values in add.items():
            t = t.append_column(name, pa.array(values, pa.int64()))
        return t.select(["doc_id", *(x.split()[0] for x in PACKED.split(", "))])

    packed = dealt.groupBy("shard").applyInArrow(each, f"doc_id {kind}, {PACKED}")
    none = F.lit(None).cast("bigint")
    return packed.unionByName(empty.select("doc_id", "piece", "start", "length", none.alias("shard"),
                                           none.alias("bin"), none.alias("capacity"), none.alias("offset")))
