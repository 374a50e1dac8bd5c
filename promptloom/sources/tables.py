"""Readers for the driver tables and their prompted views.

The driver tables stand in for the reference's prompted datasets:

* ``documents`` -> prompted rows: dataset_name = source, template_name = lang,
  split = 'train', idx = doc_id, inputs_pretokenized = text,
  targets_pretokenized = lang.  ``row_id`` = doc_id is the unique long key.
* ``document_vectors``: every document's text embedded in the plan; shard =
  doc_id % 2 assigns the two corpus shards.
* ``embeddings`` -> given vectors keyed by ``vec_id``; shard = vec_id % 2 (every
  row is kept, nothing is filtered).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# text tables and their keys: spread when the scan is narrower than the cluster
TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id",
             "benchmark": "item_id"}


def read_table(spark: SparkSession, sf_dir: str, name: str, *, spread: bool = True) -> DataFrame:
    """Scan one driver table.

    A text table whose file has fewer splits than the default parallelism
    (e.g. one large row group) is hash-partitioned on its key so the
    tokenising stages use every core; on a cluster-sized scan the number of
    splits already exceeds the parallelism and nothing is added."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    key = TEXT_KEYS.get(name)
    if spread and key:
        par = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < par:
            df = df.repartition(par, key)
    return df


def prompted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("dataset_name"),
        F.col("lang").alias("template_name"),
        F.lit("train").alias("split"),
        F.col("doc_id").alias("idx"),
        F.col("text").alias("inputs_pretokenized"),
        F.col("lang").alias("targets_pretokenized"),
    )


def shard_vectors(spark: SparkSession, sf_dir: str, n_shards: int = 2) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", "label",
                    F.pmod(F.col("vec_id"), F.lit(n_shards)).cast("int").alias("shard"))


def document_vectors(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """(row_id, embedding, shard) of every document, embedded once and stored (a
    reliable checkpoint); texts and keys are read from ``prompted_documents``."""
    from ..operators.embed import embed_text
    d = prompted_documents(spark, sf_dir).select("row_id", "inputs_pretokenized")
    v = embed_text(d, "inputs_pretokenized", dim=dim)
    return cut_lineage(v.select("row_id", "embedding", F.pmod(F.col("row_id"), F.lit(2)).cast("int").alias("shard")))
