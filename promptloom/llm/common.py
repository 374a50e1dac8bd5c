"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.session import bounded_broadcast, cut_lineage, ensure_checkpoint_dir

__all__ = ["attach_facts", "cut_lineage", "fold", "free_name", "label_split", "log2_parts",
           "read_docs", "shared_folder", "slices", "stored", "without"]


def read_docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """Scan one driver table as it lies; narrow scans are spread over the cluster.

    A scan with fewer splits than the default parallelism (one file of one row
    group) is dealt out evenly by a round-robin exchange; wide scans are left alone.
    The number of splits comes from the file listing, not from a job."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if len(df.inputFiles()) == 1:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below ``spark.checkpoint.dir`` (seen by driver and executors)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def free_name(columns: Iterable[str], base: str) -> str:
    """``base``, lengthened by underscores until no column has that name (in any case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def label_split(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null id: as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def log2_parts(n: int, per: int) -> int:
    """Smallest b with 2**b * per >= n."""
    return max(0, (max(1, -(-n // per)) - 1).bit_length())


def fold(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    ``lower`` maps other letters too, so it serves only where every character is
    one byte long (then the text is ASCII and both agree)."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.char_length(t)
    return F.when(ascii_only, F.lower(t)).otherwise(
        F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def slices(batches: Iterable[pa.RecordBatch], column: str, budget: int = 8 << 20
           ) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``budget`` bytes in each (one row at least)."""
    for batch in batches:
        n, col = batch.num_rows, batch.column(column)
        if not n:
            continue
        width = col.nbytes / n
        if col.nbytes <= budget:
            yield batch
            continue
        step = max(1, int(budget / max(width, 1)))
        for i in range(0, n, step):
            yield batch.slice(i, step)


def attach_facts(rows: DataFrame, facts: DataFrame, key: str, n_col: str, total: int,
                 parts: int = 1000) -> DataFrame:
    """Left-join ``facts`` (one row per ``key``, with its row count ``n_col``) to ``rows``.

    Keys holding more than ``total / parts`` rows are fewer than ``parts`` by
    pigeonhole, so those facts are broadcast and their rows never shuffle; every
    other key has at most ``total / parts`` rows and goes through a plain shuffle
    join.  ``rows`` and ``facts`` are read twice: pass stored tables.  Null keys
    match nothing and keep null facts."""
    bound = max(1, total // parts)
    hot = facts.filter(F.col(n_col) > bound)
    cold = facts.filter(F.col(n_col) <= bound)
    by_map = rows.join(F.broadcast(hot), key)
    by_shuffle = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return by_map.select(*by_shuffle.columns).unionByName(by_shuffle)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """df written as Parquet below the shared folder and read back: its lineage ends there."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, key: Column, found: DataFrame, total: int, parts: int = 10_000) -> DataFrame:
    """docs without some rows, found by a key of their content.

    ``found``: stored rows (key, n: rows of docs that have it, kept), one per key; where ``kept``,
    one row of the key stays, else none.  Keys that are not in it stay as they are.  Rows
    do not move while ``found`` is small enough to be broadcast; of a larger one, the fewer
    than ``parts`` keys of more than ``total / parts`` rows still are, and only then the others
    shuffle docs.  Of equal keys any one row stays, by an aggregate with map-side combine."""
    name = free_name(docs.columns, "_key")
    own = docs.withColumn(name, key)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = found.filter("not kept or n > 1").withColumnRenamed("key", name)
    hot, cold = (found.filter(c).select(name) for c in (F.col("n") > total // parts, F.col("n") <= total // parts))
    rest = own.join(F.broadcast(hot), name, "left_anti").join(bounded_broadcast(cold), name, "left_anti").select(*columns)
    repeated = found.filter("kept").select(name)
    if repeated.isEmpty():
        return rest
    twice = own.join(bounded_broadcast(repeated), name, "left_semi").groupBy(name).agg(F.any_value(F.struct(*columns)).alias("row"))
    return rest.unionByName(twice.select("row.*"))
