import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from promptloom.operators.embed import embed_text
from promptloom.sources.tables import prompted_documents, read_table
from promptloom.operators.knn import HeldCorpus, knn_join
from promptloom.sources import io
from promptloom.streaming.online import (CorpusCache, augment_batch, folder_version, online_augment, prompt_stream,
                                         write_batch)


def test_online_stream_equals_batch(spark):
    scratch = tempfile.mkdtemp(prefix="pl-stream-")
    bench = read_table(spark, SF_SMALL, "benchmark").select(
        (F.col("item_id") + 10**9).alias("row_id"), F.lit("benchmark").alias("dataset_name"),
        F.lit("item").alias("template_name"), F.col("item_id").alias("idx"),
        F.col("text").alias("inputs_pretokenized"), F.lit("").alias("targets_pretokenized"))
    # the input lands as two files so the stream sees more than one batch
    bench.where("idx % 2 = 0").write.parquet(f"{scratch}/in/a")
    bench.where("idx % 2 = 1").write.parquet(f"{scratch}/in/b")

    def corpus(s):
        return embed_text(prompted_documents(s, SF_SMALL), "inputs_pretokenized")

    stream = prompt_stream(spark, f"{scratch}/in/*", bench.schema, max_files_per_trigger=1)
    q = online_augment(stream, corpus, f"{scratch}/out", f"{scratch}/ckpt", k=2, K=1)
    q.awaitTermination(300)
    got = {r["row_id"]: r["inputs_pretokenized"] for r in spark.read.parquet(f"{scratch}/out").collect()}
    exp = {r["row_id"]: r["inputs_pretokenized"]
           for r in augment_batch(bench, corpus(spark), k=2, K=1).collect()}
    assert got == exp and len(got) == bench.count()


def test_replayed_batch_is_idempotent(spark):
    scratch = tempfile.mkdtemp(prefix="pl-replay-")
    a = spark.range(5).withColumnRenamed("id", "row_id")
    b = spark.range(5, 8).withColumnRenamed("id", "row_id")
    write_batch(a, 0, f"{scratch}/out")
    write_batch(b, 1, f"{scratch}/out")
    write_batch(b, 1, f"{scratch}/out")          # the same micro-batch again after a failure
    got = sorted(r["row_id"] for r in spark.read.parquet(f"{scratch}/out").collect())
    assert got == list(range(8))


def test_corpus_is_loaded_once_a_version(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(i), 1.0], f"t{i}") for i in range(6)], "row_id long, embedding array<float>, inputs_pretokenized string")
    calls = []

    def load(s):
        calls.append(1)
        return io.load_shard(s, str(tmp_path), "c")[0].drop("shard")

    cache = CorpusCache(load, folder_version(f"{tmp_path}/c"), "row_id")
    io.save_shard(vectors, str(tmp_path), "c", key_name="x")
    for _ in range(3):
        rows, held = cache.get(spark)
    assert len(calls) == cache.loads == 1 and rows.count() == 6
    q = vectors.where("row_id < 2")
    a = knn_join(q, held, 2, query_key="row_id")
    b = knn_join(q, vectors, 2, query_key="row_id", corpus_key="row_id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    import time
    time.sleep(1.1)                                   # marks are told apart by their time
    io.save_shard(vectors.where("row_id <> 1"), str(tmp_path), "c", key_name="x")
    assert cache.get(spark)[0].count() == 5 and len(calls) == 2


def test_held_corpus_too_large_to_ship(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i)], f"s{i % 2}") for i in range(60)], "id long, embedding array<float>, shard string")
    held = HeldCorpus(v, corpus_key="id", shard_col="shard", max_broadcast_bytes=100)
    assert held.shipped is None
    a = knn_join(v, held, 3, query_key="id", exclude_self=True)
    b = knn_join(v, v, 3, query_key="id", corpus_key="id", shard_col="shard", exclude_self=True)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
