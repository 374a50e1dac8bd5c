"""A counted vocabulary: text to ids and back.

``build_vocab`` numbers the distinct tokens of a corpus by frequency, then token; the table is
stored and joined by ``encode`` and ``decode``, so equal texts have equal ids in every run and
ids give their tokens back, which hashed ids cannot.  Ids 0, 1 and 2 are padding, end and the
unknown token.

The most frequent entries, ``HOT_TOKENS`` and ``HOT_BYTES`` at most, are shipped to every task, which looks
tokens up batch by batch where the rows lie: no token is exploded or shuffled.  Only the tokens of a
larger vocabulary's rest are: they go through a join and back into the places they left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import whitespace_tokens
from ..session import bounded_broadcast
from .ordered import positions

PAD, EOS, UNKNOWN = 0, 1, 2
FIRST = 3
UNKNOWN_TOKEN = "<unk>"
HOT_TOKENS = 1_000_000
HOT_BYTES = 32 << 20


def build_vocab(df: DataFrame, col: str, *, min_count: int = 1, max_size: int | None = None, tokens=whitespace_tokens) -> DataFrame:
    """(token, n, id) of the tokens that occur ``min_count`` times, the ``max_size`` most frequent."""
    t = df.select(F.explode_outer(tokens(col)).alias("token")).where(F.col("token").isNotNull())
    counts = t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    ranked = positions(counts.withColumn("_less", -F.col("n")), [], ["_less", "token"], "id", base=FIRST).drop("_less")
    return ranked if max_size is None else ranked.where(F.col("id") < FIRST + max_size)


def _hot(vocab: DataFrame) -> tuple[pa.Table, int | None]:
    """The entries of smallest id within the bounds, and the first id beyond them (None: these are all)."""
    t = vocab.select("id", "token").where(F.col("token").isNotNull()).orderBy("id").limit(HOT_TOKENS + 1).toArrow().combine_chunks()
    sizes = np.cumsum(np.asarray(pc.binary_length(t["token"]), dtype=np.int64))
    n = min(HOT_TOKENS, int(np.searchsorted(sizes, HOT_BYTES, side="right")))
    return t.slice(0, n), None if n == t.num_rows else t["id"][n].as_py()


def _one(a: pa.ChunkedArray | pa.Array) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def _lists(a: pa.Array, values: pa.Array) -> pa.Array:
    """``values`` in place of the list array's own; a null list is an empty one."""
    ends = np.cumsum(np.asarray(a.value_lengths().fill_null(0)), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), values)


def _replaced(df: DataFrame, vocab: DataFrame, key: str, given: Column, source: str, target: str, kind: str, unknown) -> DataFrame:
    """df plus ``_all``: for every item of the array ``given`` (entries' ``source``) its ``target``, or ``unknown``."""
    hot, rest = _hot(vocab)
    given = F.when(F.col(key).isNotNull(), given)        # a row without a key has no items
    bc = df.sparkSession.sparkContext.broadcast((_one(hot[source]), _one(hot[target])))

    @F.arrow_udf(f"array<{kind}>")
    def look_up(items: pa.Array) -> pa.Array:
        known, values = bc.value
        return _lists(items, values.take(pc.index_in(items.flatten().cast(known.type), value_set=known)))

    @F.arrow_udf(f"array<{kind}>")
    def fill(found: pa.Array, late: pa.Array) -> pa.Array:
        flat = found.flatten()
        return _lists(found, pc.replace_with_mask(flat, pc.is_null(flat), late.flatten().cast(flat.type)))

    def known(items):
        return F.transform(items, lambda x: F.coalesce(x, F.lit(unknown).cast(kind)))

    if rest is None:
        return df.withColumn("_all", known(look_up(given)))
    df = df.withColumn("_given", given).withColumn("_found", look_up("_given"))
    # the items left open, in order, by row
    left = F.filter(F.transform(F.arrays_zip(F.col("_given").alias("g"), F.col("_found").alias("f")),
                                lambda x, i: F.struct(i.alias("_pos"), x["g"].alias("_item"), x["f"].isNull().alias("_open"))), lambda x: x["_open"])
    late = df.select(key, F.explode_outer(left).alias("_x")).where(F.col("_x").isNotNull()).select(key, "_x._pos", "_x._item")
    cold = vocab.where(F.col("id") >= rest).select(F.col(source).alias("_item"), F.col(target).alias("_value"))
    late = late.join(bounded_broadcast(cold), "_item", "left").withColumn("_value", F.coalesce("_value", F.lit(unknown).cast(kind)))
    late = late.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_value"))).alias("_late"))
    late = late.select(key, F.transform("_late", lambda x: x["_value"]).alias("_late"))
    out = df.join(late, key, "left").withColumn("_all", fill("_found", F.coalesce("_late", F.array().cast(f"array<{kind}>"))))
    return out.drop("_given", "_found", "_late")


def _repeats(df: DataFrame, key: str) -> bool:
    return not df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).isEmpty()


def _gathered(df: DataFrame, vocab: DataFrame, key: str, items: DataFrame, source: str, target: str, kind: str, unknown) -> DataFrame:
    """``_replaced`` where keys repeat: rows of one key share the items (key, _pos, _item) of all of them."""
    known = vocab.select(F.col(source).alias("_item"), F.col(target).alias("_value"))
    t = items.join(bounded_broadcast(known), "_item", "left").withColumn("_value", F.coalesce("_value", F.lit(unknown)).cast(kind))
    one = t.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_value"))).alias("_all"))
    one = one.select(key, F.transform("_all", lambda x: x["_value"]).alias("_all"))
    return df.join(one, key, "left").withColumn("_all", F.coalesce("_all", F.array().cast(f"array<{kind}>")))


def encode(df: DataFrame, vocab: DataFrame, *, key: str, col: str, out: str = "ids", tokens=whitespace_tokens,
           eos: bool = False) -> DataFrame:
    """df plus ``out``, the ids of the text's tokens; rows of one ``key`` share theirs.  A null text has no ids."""
    how = "token", "id", "bigint", UNKNOWN
    if _repeats(df, key):
        found = _gathered(df, vocab, key, df.select(key, F.posexplode(tokens(col)).alias("_pos", "_item")), *how)
    else:
        found = _replaced(df, vocab, key, tokens(col), *how)
    ids = F.concat("_all", F.array(F.lit(EOS).cast("long"))) if eos else F.col("_all")
    return found.withColumn(out, ids).drop("_all")


def decode(df: DataFrame, vocab: DataFrame, *, key: str, ids: str = "ids", out: str = "tokens") -> DataFrame:
    """df plus ``out``, the tokens of the ids; padding and end go, an id without a token is the unknown one."""
    how = "id", "token", "string", UNKNOWN_TOKEN
    if _repeats(df, key):
        items = df.select(key, F.posexplode(ids).alias("_pos", "_item")).where(~F.col("_item").isin(PAD, EOS))
        found = _gathered(df, vocab, key, items, *how)
    else:
        found = _replaced(df, vocab, key, F.filter(ids, lambda i: ~i.isin(PAD, EOS)), *how)
    return found.withColumn(out, F.col("_all")).drop("_all")
