"""Exact duplicates with a heavy-hitter split, in DataFrame functions only.

A text's digest is the SHA-256 of its normalised form.  ``approx_top_k`` (a mergeable
frequent-items sketch of the Misra-Gries family, ``TRACKED`` counters) names the
candidates that may hold a large part of the rows.  Their exact counts are taken by an
aggregation with map-side combine; those that really exceed ``rows / HEAVY`` are the
winners, fewer than ``HEAVY`` by pigeonhole, and are broadcast: their rows are
decided where they lie and never shuffle.  All other digests are shuffled as usual.  Only digests
and ids move: ``drop_duplicates`` finds the rows that go by a key and removes them from
the documents where these lie.
The sketch decides only which way a digest goes, never the result: a frequent digest
that it missed is decided by the shuffle.

Rows: a null text counts as empty; of equal texts the row with the largest id stays,
among repeated rows of that id one of them; a null id is smaller than any other, and a
group of null ids keeps one row with ``keep_id`` null; an empty table gives no rows;
extra columns are ignored by ``decisions`` and kept by ``drop_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_facts, cut_lineage, fold, without

HEAVY = 500          # a digest of more than 1 / HEAVY of the rows is heavy
PARTS = 50_000       # of the others, one of more than 1 / PARTS of the rows is looked up map-side too
TRACKED = 4096       # counters of the sketch


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_sha256) of every row."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.sha2(fold(F.col(text)).cast("binary"), 256).alias("text_sha256"))


def _facts(rows: DataFrame) -> DataFrame:
    """Per digest: its largest id, the row that stays and the number of its rows."""
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("best")     # a null id is the smallest
    facts = rows.groupBy("text_sha256").agg(best, F.count(F.lit(1)).alias("group_size"))
    return facts.select("text_sha256", F.col("best.doc_id").alias("top"), (-F.col("best.row")).alias("stays"), "group_size")


def heavy_digests(rows: DataFrame, bound: int) -> DataFrame:
    """Facts of the digests with more than ``bound`` rows that the sketch names."""
    named = rows.agg(F.expr(f"approx_top_k(text_sha256, {HEAVY}, {TRACKED})").alias("top"))
    named = named.select(F.explode("top").alias("x")).select(F.col("x.item").alias("text_sha256"))
    return _facts(rows.join(F.broadcast(named), "text_sha256", "left_semi")).filter(F.col("group_size") > bound)


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_sha256, keep_id, group_size, kept."""
    rows = cut_lineage(digests(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    heavy = cut_lineage(heavy_digests(rows, max(1, total // HEAVY)))
    by_map = rows.join(F.broadcast(heavy), "text_sha256")
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    # facts by aggregates with map-side combine; a digest that the sketch missed is still not one task's
    by_shuffle = attach_facts(rest, cut_lineage(_facts(rest)), "text_sha256", "group_size", total, PARTS)
    return by_map.select(*by_shuffle.columns).unionByName(by_shuffle).select(
        "doc_id", "text_sha256", F.col("top").alias("keep_id"), "group_size", (F.col("row") == F.col("stays")).alias("kept"))


def content_key(doc_id: Column, digest: Column) -> Column:
    """32 bytes for an id (null: none) and a digest."""
    return F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest), 256))


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found = cut_lineage(decisions(docs, doc_id, text))
    key = content_key(F.col("doc_id"), F.col("text_sha256"))
    keys = found.filter("group_size > 1").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    own = content_key(F.col(doc_id), F.sha2(fold(F.col(text)).cast("binary"), 256))
    return without(docs, own, cut_lineage(keys), found.count())
