"""Lexical top-k with BM25 (J6) as joins and aggregates.

Scoring (Lucene 8+ form, exact document lengths)::

    idf(t)   = ln(1 + (N - df + 0.5) / (df + 0.5))
    s(q, d)  = sum over query-term occurrences t of
               idf(t) * tf / (tf + k1 * (1 - b + b * dl / avgdl))

Tokens: lower-cased text split on runs of non letters/digits; an optional
stop-word set is removed on both sides.

Plan: document tokens are exploded and narrowed to the query vocabulary by
a semi join before the ``(doc, term, tf)`` aggregation.  When the query side is small (its term rows are
counted and checked against ``max_broadcast_rows``) it is broadcast: the
postings are probed in place, so a term present in a third of all documents
never lands in one task, and the postings lie by document, so that the scores of all
(query, document) pairs are summed where they are made.  Otherwise the join is a shuffle join on ``term``
whose hot terms (more than ``task_postings`` documents) are salted across
tasks, with AQE's skew split as a second line.  Pair scores are summed with
a map-side partial aggregate and ranked with ``row_number() <= k`` (partial
WindowGroupLimit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast, cut_lineage

# fixed values: the English stop-word set of the Lucene/Elasticsearch
# "_english_" analyzer
ENGLISH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
DOC_MARK = ""   # empty strings are removed from token arrays, so this is no term


def lexical_tokens(col, stop_words=None):
    c = F.col(col) if isinstance(col, str) else col
    toks = F.array_remove(F.split(F.lower(c), TOKEN_SPLIT), "")
    if stop_words:
        stops = F.array(*[F.lit(w) for w in stop_words])
        toks = F.filter(toks, lambda t: ~F.array_contains(stops, t))
    return toks


def _salted_term_join(post: DataFrame, qw: DataFrame, df_terms: DataFrame, task_postings: int) -> DataFrame:
    """Shuffle join on term with hot terms split: the postings of a term go to
    ``ceil(df / task_postings)`` tasks by ``hash(doc)`` and its query rows are
    repeated once per salt, so no task gets much more than ``task_postings`` of
    one term however frequent it is.  Terms are the query vocabulary."""
    hot = (df_terms.where(F.col("df") > task_postings)
           .select("term", F.ceil(F.col("df") / F.lit(task_postings)).cast("int").alias("n_salt")))
    hot = bounded_broadcast(hot)
    p = (post.join(hot, "term", "left")
         .withColumn("salt", F.when(F.col("n_salt").isNull(), F.lit(0))
                     .otherwise(F.pmod(F.xxhash64("doc_id"), F.col("n_salt")).cast("int")))
         .drop("n_salt"))
    q = (qw.join(hot, "term", "left")
         .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n_salt"), F.lit(1)) - 1)))
         .drop("n_salt"))
    return p.join(q, ["term", "salt"]).drop("salt")


def bm25_join(queries: DataFrame, corpus: DataFrame, k: int, *, query_key: str,
              corpus_key: str, query_text: str = "text", corpus_text: str = "text",
              k1: float = 1.2, b: float = 0.75, stop_words=None,
              max_broadcast_rows: int = 2_000_000, materialize: bool = True,
              task_postings: int = 200_000) -> DataFrame:
    """Top-k corpus rows per query: ``query_id, rank, doc_id, score``.

    N and avgdl count the documents whose text is not null (an empty text is a
    document of length 0), whichever way the join goes."""
    docs = corpus.where(F.col(corpus_text).isNotNull()).select(F.col(corpus_key).cast("long").alias("doc_id"),
                         lexical_tokens(corpus_text, stop_words).alias("toks"))
    qterms = (queries.select(F.col(query_key).cast("long").alias("query_id"),
                             F.explode_outer(lexical_tokens(query_text, stop_words)).alias("term"))
              .where(F.col("term").isNotNull())
              .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))
    n_qterms = qterms.count()
    small = n_qterms <= max_broadcast_rows
    vocab = qterms.select("term").distinct()
    # one corpus scan: every document also emits a marker posting (the empty
    # term, never a token) that carries its length, so N and avgdl come from
    # the postings instead of a second tokenising pass
    vocab = vocab.unionByName(vocab.sparkSession.createDataFrame([(DOC_MARK,)], "term string"))
    toks = F.concat(F.array(F.lit(DOC_MARK)), F.col("toks"))
    # only postings of query terms are ever aggregated: the semi join runs
    # on the exploded tokens, before the (doc, term) aggregation.
    # explode_outer: a plain explode lets Catalyst infer size(toks) > 0 and push
    # that filter (the whole tokenisation) into the scan, ahead of any exchange
    occ = (docs.select("doc_id", F.size("toks").alias("dl"), F.explode_outer(toks).alias("term"))
           .where(F.col("term").isNotNull())
           .join(F.broadcast(vocab) if small else vocab, "term", "left_semi"))
    post = occ.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
    if materialize:
        # statistics, document frequencies and scoring all read these
        # postings: write them once (reliable checkpoint)
        post = cut_lineage(post)
    stats = (post.where(F.col("term") == DOC_MARK)
             .agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first())
    post = post.where(F.col("term") != DOC_MARK)
    n_docs, avgdl = int(stats["n"]), float(stats["avgdl"] or 0.0)
    df_terms = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    qw = (qterms.join(df_terms, "term")
          .select("query_id", "term", (F.col("qtf") * idf).alias("w")))
    if small:
        # a document's postings in one place, before queries multiply them: its scores are summed there,
        # and only the k best a query and task are shuffled.  A fixed number: pairs are many times the bytes seen
        n = int(post.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = post.repartition(n, "doc_id").join(F.broadcast(qw), "term")
    else:
        pairs = _salted_term_join(post, qw, df_terms, task_postings)
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl if avgdl else 1.0))
    part = F.col("w") * F.col("tf") / (F.col("tf") + norm)
    scored = pairs.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    # exact copies of a document may differ in the last bits of their sums:
    # rank on the score rounded to 1e-9 so such ties go to the smaller doc_id
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.asc("doc_id"))
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
