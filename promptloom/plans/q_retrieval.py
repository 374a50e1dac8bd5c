"""Retrieval and augmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.augment import augment, augment_stats
from ..operators.bm25 import bm25_join
from ..operators.chosen import chosen_corpus
from ..operators.knn import knn_join, merged_order
from ..sources.tables import document_vectors, prompted_documents, read_table, shard_vectors
from .catalog import register

K_RETRIEVE = 20
WS = r"[ \t\n\x0B\f\r]+"
LEX = r"[^\p{L}\p{N}]+"


def _dist(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) ^ 2))")


_E = ("(SELECT vec_id, embedding, label, CAST(vec_id % 2 AS INTEGER) AS shard_ord, "
      "CAST(vec_id % 2 AS VARCHAR) AS shard FROM embeddings)")


def _round(c="score"):
    return F.round(F.col(c), 6).alias(c)


# --------------------------------------------------------------------- k-NN
KNN_SQL = f"""
WITH e AS {_E},
d AS (SELECT q.vec_id AS query_id, c.vec_id AS corpus_id, {_dist('q.embedding', 'c.embedding')} AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, corpus_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, corpus_id) AS rank FROM d)
WHERE rank <= {K_RETRIEVE}
"""


@register("knn_topk", KNN_SQL)
def knn_topk(spark, sf):
    """J1 + J4 + W2: every vector's 20 nearest others (flat squared L2)."""
    v = read_table(spark, sf, "embeddings")
    r = knn_join(v, v, K_RETRIEVE, query_key="vec_id", corpus_key="vec_id", exclude_self=True)
    return r.select("query_id", "rank", "corpus_id", _round())


SHARDS_SQL = f"""
WITH e AS {_E},
d AS (SELECT q.vec_id AS query_id, c.shard, c.vec_id AS corpus_id, {_dist('q.embedding', 'c.embedding')} AS score
      FROM e q JOIN e c ON TRUE)
SELECT query_id, shard, CAST(rank AS INTEGER) AS rank, corpus_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, shard ORDER BY score, corpus_id) AS rank FROM d)
WHERE rank <= {K_RETRIEVE}
"""


@register("knn_multi_shard", SHARDS_SQL)
def knn_multi_shard(spark, sf):
    """K from each of two shards, lists kept per shard (2k rows per query)."""
    v = shard_vectors(spark, sf)
    r = knn_join(v, v, K_RETRIEVE, query_key="vec_id", corpus_key="vec_id", shard_col="shard")
    return r.select("query_id", "shard", "rank", "corpus_id", _round())


@register("knn_merged", f"""
WITH e AS {_E},
d AS (SELECT q.vec_id AS query_id, c.shard, c.shard_ord, c.vec_id AS corpus_id, {_dist('q.embedding', 'c.embedding')} AS score
      FROM e q JOIN e c ON TRUE),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, shard ORDER BY score, corpus_id) AS rank FROM d
      QUALIFY rank <= {K_RETRIEVE})
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, shard_ord, rank) AS INTEGER) AS pos,
       shard, corpus_id, round(score, 6) AS score
FROM r
""")
def knn_merged(spark, sf):
    """Per-shard top-k merged into one ascending list (k x shards rows)."""
    v = shard_vectors(spark, sf)
    r = knn_join(v, v, K_RETRIEVE, query_key="vec_id", corpus_key="vec_id", shard_col="shard")
    return merged_order(r).select("query_id", F.col("pos").cast("int").alias("pos"), "shard",
                                  "corpus_id", _round())


def _centroids(e, by=None):
    keys = [by] if by else []
    x = e.select(*keys, F.posexplode("embedding").alias("pos", "x"))
    m = x.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return (m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s"))
            .select(*keys, F.transform("s", lambda z: z["m"]).alias("embedding")))


@register("nearest_template", f"""
WITH u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
cent AS (SELECT label, list(m ORDER BY pos) AS embedding
         FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM u GROUP BY label, pos) GROUP BY label),
d AS (SELECT q.vec_id AS query_id, CAST(c.label AS BIGINT) AS template_label,
             {_dist('q.embedding', 'c.embedding')} AS score
      FROM embeddings q JOIN cent c ON TRUE)
SELECT query_id, template_label, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, template_label) AS r FROM d)
WHERE r = 1
""")
def nearest_template(spark, sf):
    """The nearest 'template' (one centroid vector per label), k = 1."""
    e = read_table(spark, sf, "embeddings")
    cent = _centroids(e, "label")
    r = knn_join(e, cent, 1, query_key="vec_id", corpus_key="label")
    return r.select("query_id", F.col("corpus_id").alias("template_label"), _round())


@register("search_top3", f"""
WITH u AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
cent AS (SELECT list(m ORDER BY pos) AS embedding FROM (SELECT pos, avg(x::DOUBLE) AS m FROM u GROUP BY pos)),
d AS (SELECT c.vec_id AS corpus_id, {_dist('q.embedding', 'c.embedding')} AS score FROM cent q JOIN embeddings c ON TRUE)
SELECT CAST(row_number() OVER (ORDER BY score, corpus_id) AS INTEGER) AS rank, corpus_id, round(score, 6) AS score
FROM d ORDER BY score, corpus_id LIMIT 3
""")
def search_top3(spark, sf):
    """One query (the mean vector of the table), top 3."""
    e = read_table(spark, sf, "embeddings")
    q = _centroids(e).select(F.lit(0).cast("long").alias("qid"), "embedding")
    r = knn_join(q, e, 3, query_key="qid", corpus_key="vec_id")
    return r.select("rank", "corpus_id", _round())


# --------------------------------------------------------------------- BM25
_BM25_SQL = f"""
WITH dt AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{LEX}'), lambda t: length(t) > 0) AS toks
            FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM dt),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl
         FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM dt) GROUP BY doc_id, term),
qt AS (SELECT item_id AS query_id, term, count(*) AS qtf
       FROM (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '{LEX}'),
                                                lambda t: length(t) > 0)) AS term FROM benchmark)
       GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term),
qw AS (SELECT qt.query_id, qt.term, qt.qtf * ln(1 + (st.n - dfs.df + 0.5) / (dfs.df + 0.5)) AS w
       FROM qt JOIN dfs USING (term) CROSS JOIN st),
sc AS (SELECT qw.query_id, p.doc_id,
              sum(qw.w * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / st.avgdl))) AS score
       FROM qw JOIN post p USING (term) CROSS JOIN st GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)
WHERE rank <= 5
"""


@register("bm25_topk", _BM25_SQL)
def bm25_topk(spark, sf):
    """BM25 top 5 documents for every benchmark item."""
    q = read_table(spark, sf, "benchmark")
    d = read_table(spark, sf, "documents")
    r = bm25_join(q, d, 5, query_key="item_id", corpus_key="doc_id")
    return r.select("query_id", "rank", "doc_id", _round())


# ------------------------------------------------------------------ augment
def embed_sql(table: str, key: str, text: str, tag: str) -> str:
    """CTEs up to emb{tag}(key, embedding): V1's hashed vectors of 64 buckets."""
    return f"""tok{tag} AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT AS c
         FROM (SELECT {key}, unnest(list_filter(string_split_regex(lower({text}), '{LEX}'),
                                                lambda t: length(t) > 0)) AS t FROM {table})),
bkt{tag} AS (SELECT {key}, c % 64 AS b, sum(CASE WHEN c >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS w
        FROM tok{tag} GROUP BY ALL),
nrm{tag} AS (SELECT {key}, sqrt(sum(w * w)) AS n FROM bkt{tag} GROUP BY {key}),
emb{tag} AS MATERIALIZED (SELECT d.{key}, list(CASE WHEN n > 0 THEN coalesce(w, 0) / n ELSE 0 END::FLOAT ORDER BY i.b) AS embedding
        FROM {table} d CROSS JOIN (SELECT unnest(range(64)) AS b) i
        LEFT JOIN bkt{tag} k ON k.{key} = d.{key} AND k.b = i.b
        LEFT JOIN nrm{tag} m ON m.{key} = d.{key} GROUP BY d.{key})"""


_P_SQL = f"""{embed_sql('documents', 'doc_id', 'text', '')},
p AS MATERIALIZED (SELECT d.doc_id AS row_id, d.source AS dataset_name, d.lang AS template_name, d.doc_id AS idx,
                          d.text AS inp, d.lang AS tgt, e.embedding, CAST(d.doc_id % 2 AS INTEGER) AS shard_ord
                   FROM documents d JOIN emb e USING (doc_id))"""


def _augment_block(K: int, dedup: bool, corpus: str = "p", tag: str = "") -> str:
    """CTEs knn{tag}, kept{tag}, kept2{tag}, ranked{tag}: the first K kept
    candidates of every row of ``p`` against the rows of ``corpus``."""
    dedup_cte = (f"kept2{tag} AS (SELECT * FROM kept{tag} QUALIFY row_number() OVER "
                 "(PARTITION BY query_id, c_ds, c_idx ORDER BY score, shard_ord, rank, corpus_id) = 1),"
                 if dedup else f"kept2{tag} AS (SELECT * FROM kept{tag}),")
    return f"""knn{tag} AS (SELECT *, row_number() OVER (PARTITION BY query_id, shard_ord ORDER BY score, corpus_id) AS rank
        FROM (SELECT q.row_id AS query_id, c.row_id AS corpus_id, c.shard_ord,
                     {_dist('q.embedding', 'c.embedding')} AS score FROM p q JOIN {corpus} c ON TRUE)
        QUALIFY rank <= {K_RETRIEVE}),
kept{tag} AS (SELECT k.*, c.dataset_name AS c_ds, c.template_name AS c_tpl, c.idx AS c_idx, c.inp AS c_in, c.tgt AS c_tgt
         FROM knn{tag} k JOIN {corpus} c ON c.row_id = k.corpus_id JOIN p q ON q.row_id = k.query_id
         WHERE NOT (c.dataset_name = q.dataset_name AND c.idx = q.idx)),
{dedup_cte}
ranked{tag} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, shard_ord, rank, corpus_id) AS pos
           FROM kept2{tag} QUALIFY pos <= {K}),"""


def _augment_sql(K: int, dedup: bool, tail: str) -> str:
    return f"""
WITH {_P_SQL},
{_augment_block(K, dedup)}
{tail}
"""


_TOKS = f"len(list_filter(string_split_regex(inputs_pretokenized, '{WS}'), lambda t: length(t) > 0))"

_AUGMENT_ROWS = f"""SELECT row_id, inputs_pretokenized, chosen_ids,
       CAST(least({_TOKS}, 1024) AS INTEGER) AS n_inputs
FROM out"""

_AUGMENT_STATS = f"""SELECT count(*) AS n_rows,
       CAST(count_if(least({_TOKS}, 1024) = 1024) AS BIGINT) AS n_exceed_max_length,
       CAST(count_if(chosen_ids = '' OR len(string_split(chosen_ids, ',')) < 3) AS BIGINT) AS n_not_enough
FROM out"""


def _augment_tail(select: str = _AUGMENT_ROWS, ranked: str = "ranked") -> str:
    return f"""demos AS (SELECT query_id,
                  string_agg(rtrim(c_in, chr(10)) || chr(10) || ltrim(c_tgt, chr(10)), chr(10) || chr(10) ORDER BY pos) AS demo,
                  string_agg(CAST(c_idx AS VARCHAR), ',' ORDER BY pos) AS chosen_ids
           FROM {ranked} GROUP BY query_id),
out AS (SELECT p.row_id, coalesce(d.demo, '') || chr(10) || chr(10) || p.inp AS inputs_pretokenized,
               coalesce(d.chosen_ids, '') AS chosen_ids
        FROM p LEFT JOIN demos d ON d.query_id = p.row_id)
{select}"""


def _neighbours(spark, sf, v=None):
    """Every document's nearest documents, k from each of two shards."""
    v = document_vectors(spark, sf) if v is None else v
    return knn_join(v, v, K_RETRIEVE, query_key="row_id", corpus_key="row_id", shard_col="shard")


def _augmented(spark, sf, K, dedup, v=None, keys=False):
    rows = prompted_documents(spark, sf)
    return augment(rows, _neighbours(spark, sf, v), rows, K, max_length=1024, exclude_self=True, dedup=dedup, keys=keys)


def _augment_view(a):
    return a.select("row_id", "inputs_pretokenized",
                    F.concat_ws(",", F.transform("chosen_examples",
                                                 lambda x: x["idx"].cast("string"))).alias("chosen_ids"),
                    F.size("inputs").alias("n_inputs"))


@register("augment_k1", _augment_sql(1, False, _augment_tail()))
def augment_k1(spark, sf):
    """K = 1 demonstration, self excluded, left truncation to 1024 tokens."""
    return _augment_view(_augmented(spark, sf, 1, False))


@register("augment_k3_dedup", _augment_sql(3, True, _augment_tail()))
def augment_k3_dedup(spark, sf):
    """D1 with K = 3 and de-duplication by (dataset_name, idx)."""
    return _augment_view(_augmented(spark, sf, 3, True))


@register("chosen_corpus", _augment_sql(3, True, """done AS (SELECT 1)
SELECT c_ds AS dataset_name, c_tpl AS template_name, c_idx AS idx, query_id AS first_query,
       CAST(pos AS INTEGER) AS first_pos, round(score, 6) AS score
FROM ranked QUALIFY row_number() OVER (PARTITION BY c_ds, c_tpl, c_idx ORDER BY query_id, pos) = 1"""))
def chosen_corpus_q(spark, sf):
    """Distinct chosen examples of the K = 3 augmentation, first seen kept."""
    cc = chosen_corpus(_augmented(spark, sf, 3, True, keys=True), order_cols=("row_id",))
    return cc.select("dataset_name", "template_name", "idx",
                     F.col("first_seen.row_id").alias("first_query"),
                     (F.col("first_seen.pos") + 1).cast("int").alias("first_pos"), _round())


@register("augment_stats", _augment_sql(3, False, _augment_tail(_AUGMENT_STATS)))
def augment_stats_q(spark, sf):
    """Rows reaching the token limit and rows with fewer than K demos."""
    return augment_stats(_augmented(spark, sf, 3, False), 3, 1024).select(
        "n_rows", "n_exceed_max_length", "n_not_enough")
