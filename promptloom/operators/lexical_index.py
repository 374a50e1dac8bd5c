"""A stored lexical index in shards, and BM25 top-k over it that skips what cannot win.

Layout (``build``; one committed folder, read back by ``search`` in any session):

* ``postings/shard=...``: one row per (shard, block, term) with the documents of the block that
  hold the term, their counts and lengths, and ``bound``, the largest term weight
  ``tf / (tf + norm)`` among them.  A block is about ``block_docs`` documents of one shard
  that follow each other in length, so their norms are alike and the bound is close.  A block
  is made and written by one task, and its rows follow each other in a file;
* ``terms``: per term its document frequency and the largest bound of any block;
* ``parted``: keys that are not unique and lie in several blocks;
* ``stats``: number of documents, mean length, the parameters.

Search, all of it joins and aggregates over equal keys.  A small query side is broadcast and the
bounds are read where they lie; the postings of query terms come block by block into one task before
queries multiply them, so that a document's score is summed there and dropped there if it is below the
floor.  Pairs of query terms and postings are never shuffled:

1. *A floor.*  Each query's few blocks of largest bound over its rarest terms are scored; the
   k-th score found is a floor of the final k-th score.
2. *Blocks that can win.*  What the bounds of a query's terms in a block give together must reach the
   floor.  One pass over the bounds decides it; no document is looked at.
3. Blocks that are left are scored exactly and ranked.

Every step drops only what is proven to lie below the floor, so the ranking is that of
``bm25.bm25_join`` over the same tokens; ``pair_rows`` counts both ways.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast, cut_lineage
from ..sources.commit import require_committed, write_committed
from .bm25 import lexical_tokens
from .ordered import positions

POSTINGS = ("block bigint, term string, n int, bound double, docs array<struct<doc_id:bigint,tf:int,dl:int>>, "
            "shard int")
SLACK = 1e-9            # sums in another order differ in their last bits
ROUNDED = 1e-8          # scores closer than this may be equal when rounded for the ranking
MOST_WORDS = 512         # of 64 bits, for the queries that want a block
TASK_TOKENS = 4_000_000  # tokens whose postings one task of the build makes


def build(corpus: DataFrame, root: str, *, corpus_key: str, corpus_text: str = "text", shards: int = 16,
          block_docs: int = 64, k1: float = 1.2, b: float = 0.75, stop_words=None, replace: bool = False) -> bool:
    """Writes the index of ``corpus`` below ``root`` once; False if it is there already.

    A null text is no document, an empty one is a document of length 0; keys are unique."""
    spark = corpus.sparkSession

    def fill(path: str) -> None:
        toks = corpus.where(F.col(corpus_text).isNotNull()).select(
            F.col(corpus_key).cast("long").alias("doc_id"), lexical_tokens(corpus_text, stop_words).alias("toks"))
        docs = toks.select("doc_id", F.size("toks").alias("dl"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "toks")
        # ranges of (shard, length), stored, as their bounds come from a sample; numbered where they lie
        n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = cut_lineage(docs.repartitionByRange(n_ranges, "shard", "dl", "doc_id").sortWithinPartitions("shard", "dl", "doc_id")
                             .withColumn("at", F.monotonically_increasing_id()))
        # a row's place in its shard: its place in the range and what the shard has in earlier ranges, one row a range and shard
        part = placed.groupBy(F.shiftright("at", 33).alias("range"), "shard").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        shift = part.select("range", "shard", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
        placed = placed.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(shift), ["range", "shard"])
        pos = F.col("at") + F.col("shift")
        placed = placed.withColumns({"block": F.floor(pos / block_docs), "doc": pos % block_docs})
        stats = placed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).withColumns(
            {"k1": F.lit(float(k1)), "b": F.lit(float(b)), "shards": F.lit(shards), "block_docs": F.lit(block_docs)})
        stats.write.parquet(f"{path}/stats")
        # keys that came more than once, with rows in several blocks
        placed.groupBy(F.col("doc_id").alias("part_id")).agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select(
            "part_id").write.parquet(f"{path}/parted")
        total = spark.read.parquet(f"{path}/stats").first()
        avgdl = total["avgdl"]
        # a block's documents in one task before their tokens are: nothing after this is shuffled
        tasks = max(n_ranges, ceil(total["n"] * avgdl / TASK_TOKENS))
        tf = placed.repartition(tasks, "shard", "block").select("shard", "block", "doc", "doc_id", "dl", F.explode_outer("toks").alias("term")).where(F.col("term").isNotNull())
        tf = tf.groupBy("shard", "block", "term", "doc").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("doc_id").alias("doc_id"),
                                                             F.first("dl").alias("dl"))
        weight = F.col("tf") / (F.col("tf") + _norm(F.col("dl"), avgdl, k1, b))
        post = tf.groupBy("shard", "block", "term").agg(
            F.count(F.lit(1)).cast("int").alias("n"), F.max(weight).alias("bound"),
            F.collect_list(F.struct("doc_id", "tf", "dl")).alias("docs"))
        post.write.partitionBy("shard").parquet(f"{path}/postings")
        post = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
        post.groupBy("term").agg(F.sum("n").alias("df"), F.max("bound").alias("most")).write.parquet(f"{path}/terms")

    return write_committed(spark, root, fill, replace=replace)


def _norm(dl, avgdl: float, k1: float, b: float):
    return F.lit(float(k1)) * (F.lit(1.0 - b) + F.lit(float(b)) * dl / F.lit(avgdl or 1.0))


class LexicalIndex:
    """A committed index, opened for search."""

    def __init__(self, spark: SparkSession, root: str):
        require_committed(spark, root)
        self.postings = spark.read.schema(POSTINGS).parquet(f"{root}/postings")
        self.terms = spark.read.parquet(f"{root}/terms")
        self.parted = spark.read.parquet(f"{root}/parted")
        self.stats = spark.read.parquet(f"{root}/stats").first()

    def weights(self, queries: DataFrame, query_key: str, query_text: str, stop_words=None) -> DataFrame:
        """(query_id, no, term, w, most, df): the weight of every indexed term of every query, stored;
        queries are numbered, those without an id left out."""
        terms = (queries.select(F.col(query_key).cast("long").alias("query_id"),
                                F.explode_outer(lexical_tokens(query_text, stop_words)).alias("term"))
                 .where(F.col("term").isNotNull()).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))
        idf = F.ln(F.lit(1.0) + (F.lit(float(self.stats["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        numbered = positions(terms.select("query_id").distinct(), [], ["query_id"], "no")
        terms = terms.join(bounded_broadcast(numbered), "query_id")
        return cut_lineage(self.terms.join(bounded_broadcast(terms), "term").select(
            "query_id", "no", "term", (F.col("qtf") * idf).alias("w"), "most", "df"))

    def heads(self, weights: DataFrame) -> DataFrame:
        """(query_id, shard, block, term, gain): what a term can add at most to a block's documents."""
        return self.postings.select("shard", "block", "term", "bound").join(bounded_broadcast(weights), "term").select(
            "query_id", "shard", "block", "term", (F.col("w") * F.col("bound")).alias("gain"))

    def scores(self, blocks: DataFrame, weights: DataFrame, floors: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score): the exact scores of all documents of some (query_id, shard, block), and
        maybe of others; with ``floors``, not of documents below their query's."""
        # one row a block, with a bit for each query that wants it: it does not grow with queries x terms.  Beyond
        # 64 x MOST_WORDS queries some share a bit: a block is scored for each of them, which is only more work
        n_words = min(MOST_WORDS, (weights.agg(F.max("no")).first()[0] or 0) // 64 + 1)
        bit = (F.col("no") % (64 * n_words)).cast("int")
        numbers = weights.select("query_id", "no").distinct()
        marks = blocks.join(bounded_broadcast(numbers), "query_id").withColumn("_bit", bit).select(
            "shard", "block", F.shiftright("_bit", 6).alias("word"), F.expr("shiftleft(1L, _bit & 63)").alias("mark"))
        words = marks.groupBy("shard", "block", "word").agg(F.bit_or("mark").alias("mark")).groupBy("shard", "block").agg(
            F.map_from_entries(F.collect_list(F.struct("word", "mark"))).alias("marks"))
        words = words.select("shard", "block", F.transform(F.sequence(F.lit(0), F.lit(n_words - 1)), lambda i: F.coalesce(
            F.col("marks")[i], F.lit(0).cast("long"))).alias("words"))
        asks = weights.withColumn("_bit", bit).select("query_id", "term", "w", "_bit")
        near = self.postings.join(bounded_broadcast(words), ["shard", "block"]).join(
            bounded_broadcast(weights.select("term").distinct()), "term", "left_semi")
        # a block's postings of query terms in one task, before queries multiply them
        n = max(int(self.postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(self.stats["n"] * self.stats["avgdl"] / TASK_TOKENS))
        hit = near.repartition(n, "shard", "block").join(bounded_broadcast(asks), "term")
        hit = hit.where(F.expr("shiftright(words[shiftright(_bit, 6)], _bit & 63) & 1 = 1"))
        hit = hit.select("query_id", "shard", "block", "w", F.explode("docs").alias("d"))
        part = F.col("w") * F.col("d.tf") / (F.col("d.tf") + _norm(F.col("d.dl"), self.stats["avgdl"], self.stats["k1"], self.stats["b"]))
        found = hit.groupBy("shard", "block", "query_id", F.col("d.doc_id").alias("doc_id")).agg(F.sum(part).alias("score"))
        if floors is not None:
            # a key that lies in several blocks has its score only when these are added
            parted = self.parted.withColumn("parted", F.lit(True))
            found = found.join(bounded_broadcast(floors), "query_id", "left").join(
                bounded_broadcast(parted), found["doc_id"].eqNullSafe(parted["part_id"]), "left")
            found = found.where((F.col("score") >= F.coalesce("floor", F.lit(0.0)) - ROUNDED) | F.col("parted"))
        return found.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))

    def floors(self, weights: DataFrame, k: int, seed_terms: int, seed_blocks: int) -> DataFrame:
        """(query_id, floor): a proven lower bound of each query's k-th score; none for a query that
        met fewer than k documents."""
        rare = Window.partitionBy("query_id").orderBy(F.desc("w"), "term")
        seeds = weights.withColumn("_r", F.row_number().over(rare)).where(F.col("_r") <= seed_terms)
        gains = self.heads(seeds).groupBy("query_id", "shard", "block").agg(F.sum("gain").alias("gain"))
        first = Window.partitionBy("query_id").orderBy(F.desc("gain"), "shard", "block")
        blocks = gains.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= seed_blocks).select("query_id", "shard", "block")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"))
        ranked = self.scores(blocks, weights).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
        return ranked.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).drop("_n")

    def candidates(self, weights: DataFrame, floors: DataFrame) -> DataFrame:
        """(query_id, shard, block): the blocks that can hold a document of the floor's score, stored."""
        gains = self.heads(weights).groupBy("query_id", "shard", "block").agg(F.sum("gain").alias("gain"))
        floor = F.coalesce("floor", F.lit(0.0)) * (1 - SLACK)
        return cut_lineage(gains.join(bounded_broadcast(floors), "query_id", "left")
                           .where(F.col("gain") >= floor).select("query_id", "shard", "block"))

    def search(self, queries: DataFrame, k: int, *, query_key: str, query_text: str = "text", stop_words=None,
               seed_terms: int = 4, seed_blocks: int | None = None) -> DataFrame:
        """Top-k documents per query: ``query_id, rank, doc_id, score``; ties to the smaller doc_id."""
        weights = self.weights(queries, query_key, query_text, stop_words)
        floors = cut_lineage(self.floors(weights, k, seed_terms, seed_blocks or k))
        scored = self.scores(self.candidates(weights, floors), weights, floors)
        w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.asc("doc_id"))
        return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))

    def pair_rows(self, queries: DataFrame, k: int, *, query_key: str, query_text: str = "text", stop_words=None,
                  seed_terms: int = 4, seed_blocks: int | None = None) -> dict[str, int]:
        """How many (query term, posting) rows scoring without the index makes, and how many rows
        ``search`` makes: block bounds met and postings scored."""
        weights = self.weights(queries, query_key, query_text, stop_words)
        everything = weights.agg(F.sum("df")).first()[0] or 0
        floors = cut_lineage(self.floors(weights, k, seed_terms, seed_blocks or k))
        blocks = self.candidates(weights, floors)
        wanted = blocks.join(weights.select("query_id", "term"), "query_id")
        scored = self.postings.join(wanted, ["shard", "block", "term"]).agg(F.sum("n")).first()[0] or 0
        n_blocks = self.postings.select("shard", "block").distinct().count()
        n_queries = weights.select("query_id").distinct().count()
        return {"all": int(everything), "scored": int(scored), "blocks_kept": blocks.count(), "blocks": n_blocks * n_queries}
