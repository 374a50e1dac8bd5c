"""J14 online: retrieval-augmented prompts for a stream of evaluation inputs.

New prompt rows arrive through Structured Streaming; every micro-batch is
embedded, joined with the static corpus by ``knn_join`` and augmented in the
online prefix style (F5), then appended to a Parquet table partitioned by
``batch_id``.  The write overwrites only its own ``batch_id`` partition, so a
micro-batch replayed from the checkpoint after a lost executor or driver
produces the same files once -- end-to-end exactly-once on top of the
source offsets kept in ``checkpoint_location``.

The corpus is held across micro-batches, stored and shipped to the executors once, under the
version that ``version`` reads from storage; a micro-batch that finds another version loads
the new corpus and lets the old one go.  There is no event time and no state: the
reference has no streaming semantics beyond per-query retrieval.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.augment import augment
from ..operators.embed import embed_text
from ..operators.knn import HeldCorpus, knn_join
from ..session import cut_lineage
from ..sources.commit import Folder


def prompt_stream(spark: SparkSession, path: str, schema, *, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of prompt rows landing as files under ``path``."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def augment_batch(batch: DataFrame, corpus: DataFrame, *, k: int, K: int, key: str = "row_id",
                  text_col: str = "inputs_pretokenized", style: str = "online", dim: int = 64,
                  embedder=None, max_length: int = 1024, shard_col: str | None = "shard",
                  held: HeldCorpus | None = None) -> DataFrame:
    """One micro-batch (also usable on a static DataFrame): embed -> k-NN -> augment.

    ``held``: the vectors of ``corpus``, held for several batches."""
    q = embed_text(batch, text_col, dim=dim, embedder=embedder)
    shard = shard_col if shard_col and shard_col in corpus.columns else None
    cand = knn_join(q, held or corpus, k, query_key=key, corpus_key=key, shard_col=shard)
    corpus_rows = corpus.drop("embedding", *([shard] if shard else []))
    return augment(batch, cand, corpus_rows, K, query_key=key, corpus_key=key, style=style,
                   exclude_self=False, max_length=max_length)


class CorpusCache:
    """The corpus of the current version: (rows, their held vectors)."""

    def __init__(self, loader: Callable[[SparkSession], DataFrame], version: Callable[[SparkSession], object] | None, key: str,
                 shard_col: str | None = "shard"):
        self.loader, self.version, self.key, self.shard_col = loader, version, key, shard_col
        self.seen, self.rows, self.held, self.loads = None, None, None, 0

    def get(self, spark: SparkSession) -> tuple[DataFrame, HeldCorpus]:
        now = self.version(spark) if self.version else "fixed"
        if self.held is None or now != self.seen:
            rows = cut_lineage(self.loader(spark))
            shard = self.shard_col if self.shard_col in rows.columns else None
            held = HeldCorpus(rows, corpus_key=self.key, shard_col=shard)
            if self.held is not None:
                self.held.release()
            self.seen, self.rows, self.held, self.loads = now, rows, held, self.loads + 1
        return self.rows, self.held


def folder_version(path: str) -> Callable[[SparkSession], object]:
    """The version of a committed folder: when its mark was written (None without one)."""
    def read(spark: SparkSession) -> object:
        return Folder(spark, path).marked_at()
    return read


def write_batch(out: DataFrame, batch_id: int, output_path: str) -> None:
    """Idempotent sink: (re)writes only the ``batch_id`` partition."""
    (out.withColumn("batch_id", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(output_path))


def online_augment(stream: DataFrame, corpus_loader, output_path: str, checkpoint_location: str, *,
                   k: int = 1, K: int = 1, key: str = "row_id", text_col: str = "inputs_pretokenized",
                   style: str = "online", dim: int = 64, embedder=None, trigger: dict | None = None,
                   query_name: str | None = None, version: Callable[[SparkSession], object] | None = None,
                   cache: CorpusCache | None = None) -> StreamingQuery:
    """Start the streaming job.  ``corpus_loader(spark) -> DataFrame`` returns the
    corpus with ``embedding`` (and optionally ``shard``); it is called again only when
    ``version(spark)`` changes.  ``cache`` takes the place of both."""
    cache = cache or CorpusCache(corpus_loader, version, key)

    def run(batch: DataFrame, batch_id: int) -> None:
        corpus, held = cache.get(batch.sparkSession)
        out = augment_batch(batch, corpus, k=k, K=K, key=key, text_col=text_col, style=style,
                            dim=dim, embedder=embedder, held=held)
        write_batch(out, batch_id, output_path)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
