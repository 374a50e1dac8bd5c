"""Queries over what is stored and read back: folders, indexes, vocabularies, drawn mixtures and
logs (S7, S12, S13, D3, J6, M4, F9, A6, J7, C1, F22, E8, E12)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.names import task_name
from ..functions.text import whitespace_tokens
from ..operators.augment import augment_logged
from ..operators.lexical_index import LexicalIndex, build
from ..operators.mixture import draw, mixtures, task_lists
from ..operators.rank import choice_scores, confidence, rank_classify, second_scores, self_reference
from ..operators.vector_index import indexed_join
from ..operators.vocab import build_vocab, decode, encode
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import io
from ..sources.commit import Folder
from ..sources.discovery import list_folders, read_folders
from ..sources.tables import prompted_documents, read_table, shard_vectors
from .catalog import register
from ..streaming.online import folder_version, online_augment, prompt_stream
from .composite import build_index, index_folders, save_index, template_augmented_folders
from .q_evaluate import _PAIRS_SQL, CHOICES, WS, _logp, _lp_sql, _pairs
from .q_mixture import BLACKLIST, MAX_EXAMPLES, _mixture_sql, _registry, _templates
from .q_retrieval import K_RETRIEVE, KNN_SQL, SHARDS_SQL, _BM25_SQL, _augment_sql, _augment_tail, _neighbours, _dist, _round, _TOKS, embed_sql
from .q_rules import _CFG, _SPLIT, _docs

SHARDS = 16


def _root(spark, kind):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- lexical index
@register("bm25_shards", _BM25_SQL)
def bm25_shards_q(spark, sf):
    """The documents' lexical index written once in 16 shards, opened again and searched for
    every benchmark item; blocks that cannot reach the k-th score are skipped."""
    root = _root(spark, "lexical")
    build(read_table(spark, sf, "documents"), root, corpus_key="doc_id", shards=SHARDS)
    r = LexicalIndex(spark, root).search(read_table(spark, sf, "benchmark"), 5, query_key="item_id")
    return r.select("query_id", "rank", "doc_id", _round())


# ---------------------------------------------------------------- vector index
@register("knn_indexed", KNN_SQL)
def knn_indexed_q(spark, sf):
    """J1 + J4 by the pivot index: every vector's 20 nearest others, parts out of reach skipped."""
    v = read_table(spark, sf, "embeddings")
    r = indexed_join(v, v, K_RETRIEVE, query_key="vec_id", corpus_key="vec_id", exclude_self=True, part_rows=64)
    return r.select("query_id", "rank", "corpus_id", _round())


@register("knn_indexed_shards", SHARDS_SQL)
def knn_indexed_shards_q(spark, sf):
    """J2 by the pivot index: k from each of two shards."""
    v = shard_vectors(spark, sf)
    r = indexed_join(v, v, K_RETRIEVE, query_key="vec_id", corpus_key="vec_id", shard_col="shard", part_rows=64)
    return r.select("query_id", "shard", "rank", "corpus_id", _round())


# ------------------------------------------------------------------- mixtures
DRAWN = 500


def _draw_sql(mixture: str) -> str:
    base = _mixture_sql().strip().removesuffix("""SELECT mixture, task_name, rate, round(CASE WHEN t > 0 THEN rate / t ELSE 0.0 END, 6) AS share
FROM mix JOIN tot USING (mixture)""")
    return base + f""",
ex AS (SELECT doc_id AS key, {_DATASET_SQL} || coalesce('_' || {_SUBSET_SQL}, '') || '_' || lang AS task_name FROM documents),
size AS (SELECT task_name, count(*) AS size FROM ex GROUP BY task_name),
can AS (SELECT mix.mixture, task_name, rate, size FROM mix JOIN size USING (task_name) WHERE rate > 0 AND mixture IN {mixture}),
x AS (SELECT *, {DRAWN}::DOUBLE * rate / sum(rate) OVER (PARTITION BY mixture) AS x FROM can),
q AS (SELECT mixture, task_name, size, floor(x)::BIGINT + CASE WHEN row_number() OVER (
             PARTITION BY mixture ORDER BY x - floor(x) DESC, task_name) <= {DRAWN} - sum(floor(x)) OVER (PARTITION BY mixture)
             THEN 1 ELSE 0 END AS quota FROM x),
pos AS (SELECT *, row_number() OVER (PARTITION BY task_name ORDER BY md5('42|' || key), key) - 1 AS pos FROM ex),
dr AS (SELECT mixture, task_name, key, epoch, quota, epoch * size
              + (pos + ('0x' || substr(md5('42|' || task_name || '|' || epoch), 1, 8))::BIGINT) % size AS t
       FROM pos JOIN q USING (task_name) CROSS JOIN (SELECT unnest(range({DRAWN})) AS epoch) WHERE quota > 0 AND epoch <= (quota - 1) // size)
SELECT mixture, row_number() OVER (PARTITION BY mixture ORDER BY (t + 0.5) / quota, md5('42|' || mixture || '|' || task_name || '|' || t)) - 1 AS place,
       task_name, epoch, key
FROM dr WHERE t < quota
"""


_DATASET_SQL = "CASE source WHEN 'src19' THEN 'anli' ELSE source END"
_SUBSET_SQL = "CASE WHEN CAST(substr(source, 4) AS INTEGER) % 3 = 0 THEN 'v' || CAST(substr(source, 4) AS INTEGER) % 2 END"
_DRAWN_MIXTURES = ("train", "train_one_original_prompt", "train_plus_plus")


@register("mix_draw", _draw_sql("('train', 'train_one_original_prompt', 'train_plus_plus')"))
def mix_draw_q(spark, sf):
    """M4: 500 examples of each of three training mixtures in proportion to their rates (the sample
    size is the feature); tasks smaller than their quota are passed again."""
    t = task_lists(_registry(spark, sf), _templates(spark, sf), MAX_EXAMPLES)
    m = mixtures(t, blacklist=BLACKLIST, max_examples=MAX_EXAMPLES).where(F.col("mixture").isin(*_DRAWN_MIXTURES))
    n = F.substring("source", 4, 10).cast("int")
    dataset = F.when(F.col("source") == "src19", "anli").otherwise(F.col("source"))
    subset = F.when(n % 3 == 0, F.concat(F.lit("v"), (n % 2).cast("string")))
    d = read_table(spark, sf, "documents").select("doc_id", task_name(dataset, subset, "lang").alias("task_name"))
    return draw(d, m, DRAWN, key_col="doc_id")


# -------------------------------------------------------------- committed writes
@register("write_resumed", """
SELECT 'torn' AS state, true AS wrote, count(*) AS n FROM documents WHERE source < 'src2' UNION ALL
SELECT 'whole', false, count(*) FROM documents WHERE source < 'src2' UNION ALL
SELECT 'failed', false, count(*) FROM documents WHERE source < 'src2' UNION ALL
SELECT 'shard', true, count(*) FROM documents
""")
def write_resumed_q(spark, sf):
    """A folder that an interrupted write left behind is written again, a whole one is
    skipped, a write that fails leaves what was there, and an unmarked shard is not loaded."""
    root = _root(spark, "resumed")
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    part = d.where("source < 'src2'")
    d.where("source = 'src1'").write.parquet(f"{root}/out")              # files of a writer that was lost: no mark
    wrote = [("torn", io.write_once(lambda: part, spark, f"{root}/out")), ("whole", io.write_once(lambda: d, spark, f"{root}/out"))]
    try:
        Folder(spark, f"{root}/out").write(lambda folder: (d.write.parquet(folder), 1 / 0))
    except ZeroDivisionError:
        wrote.append(("failed", False))
    counts = [(s, w, spark.read.parquet(f"{root}/out").count()) for s, w in wrote]
    d.write.parquet(f"{root}/shards/one/data")
    try:
        io.load_shard(spark, f"{root}/shards", "one")
        loaded = False                                                   # it must not be there yet
    except FileNotFoundError:
        io.save_shard(d, f"{root}/shards", "one", key_name="doc_id")
        loaded = True
    counts.append(("shard", loaded, io.load_shard(spark, f"{root}/shards", "one")[0].count()))
    return spark.createDataFrame(counts, "state string, wrote boolean, n bigint")


# ------------------------------------------------------------------- discovery
_TASK = f"source || coalesce('_' || nullif(nullif({_CFG}, 'None'), ''), '')"
FIRST = 3
_FOUND = ("src1", "src2", "src11")
_FOLDER_SCHEMA = "doc_id bigint, inputs_pretokenized string, targets_pretokenized string"


def _folders(spark, sf):
    """Every document in its task and template folder, with its split: ds__cfg__k/task_template/split."""
    root = _root(spark, "datasets")
    c = F.when(F.col("cfg").isin("None", ""), None).otherwise(F.col("cfg"))
    d = _docs(spark, sf).withColumns({
        "ds": F.concat("source", F.lit("__"), F.coalesce(c, F.lit("none")), F.lit("__k-20")),
        "name": F.concat_ws("_", "source", c, "lang")})
    d = d.select("doc_id", F.col("text").alias("inputs_pretokenized"), F.col("lang").alias("targets_pretokenized"), "ds", "name", "split")
    # at most eight files a folder and split, however many rows it holds
    d.repartition(F.col("ds"), F.col("name"), F.col("split"), F.pmod(F.xxhash64("doc_id"), F.lit(8))) \
        .write.partitionBy("ds", "name", "split").parquet(root)
    return root


@register("discover_folders", f"""
WITH t(task) AS (VALUES {", ".join(f"('{t}')" for t in _FOUND)}),
d AS (SELECT {_TASK} || '_' || lang AS basename, source || '__' || coalesce(nullif(nullif({_CFG}, 'None'), ''), 'none') || '__k-20' AS ds FROM documents),
f AS (SELECT t.task, ds, basename, count(*) AS n FROM d JOIN t ON starts_with(d.basename, t.task) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY 'ds=' || ds || '/name=' || basename) AS r FROM f)
SELECT task, basename, n, r <= {FIRST} AS among_first FROM r
""")
def discover_folders_q(spark, sf):
    """Dataset folders written, found again by task prefix and by sorted first n, and read."""
    root = _folders(spark, sf)
    found = cut_lineage(list_folders(spark, root, _FOUND))
    first = list_folders(spark, root, _FOUND, first=FIRST).select("task", "path", F.lit(True).alias("_first"))
    paths = sorted({r["path"] for r in found.select("path").collect()})
    rows = read_folders(spark, paths, _FOLDER_SCHEMA).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return (found.join(first, ["task", "path"], "left").join(rows, "path")
            .select("task", "basename", "n", F.coalesce("_first", F.lit(False)).alias("among_first")))


@register("index_folders", f"""
WITH d AS (SELECT *, {_TASK} AS task, {_SPLIT} AS split FROM documents WHERE lang IN ('en', 'fr') AND starts_with(source, 'src1')),
h AS (SELECT task, lang, bool_or(split = 'train') AS has FROM d GROUP BY ALL),
k AS MATERIALIZED (SELECT d.* FROM d JOIN h USING (task, lang) WHERE NOT has OR split = 'train'),
{embed_sql('k', 'doc_id', 'text', '')}
SELECT k.doc_id, task AS dataset_name, lang AS template_name, split,
       row_number() OVER (PARTITION BY task, lang, split ORDER BY k.doc_id) - 1 AS idx,
       CAST(list_position(embedding, list_max(embedding)) AS BIGINT) AS peak, round(list_max(embedding)::DOUBLE, 5) AS height
FROM k JOIN emb USING (doc_id)
""")
def index_folders_q(spark, sf):
    """D3: stored folders found by prefix, cut to originals, checked, read in one scan, embedded, saved
    as a named shard and loaded again, in one call."""
    root = _folders(spark, sf)
    names = [f"src{i}" for i in [1, *range(10, 20)]]
    n = F.substring("source", 4, 10).cast("int")
    c = F.when(n % 3 == 1, F.lit("cfg"))
    meta = read_table(spark, sf, "documents").where(F.col("source").isin(*names) & F.col("lang").isin("en", "fr"))
    meta = meta.select(F.lit("src1").alias("task"), F.concat_ws("_", "source", c, "lang").alias("b")).groupBy("task").agg(
        F.collect_set("b").alias("original_dataset_name"))
    index = index_folders(spark, root, ["src1"], _root(spark, "index"), "documents", schema=_FOLDER_SCHEMA, order_col="doc_id", metadata=meta)
    return index.select("doc_id", "dataset_name", "template_name", "split", "idx",
                        F.array_position("embedding", F.array_max("embedding")).alias("peak"),
                        F.round(F.array_max("embedding").cast("double"), 5).alias("height"))


# ------------------------------------------------------------------ vocabulary
_VOCAB_TOKS = f"list_filter(string_split_regex(text, '{WS}'), lambda t: length(t) > 0)"


@register("vocab_encode", f"""
WITH t AS (SELECT doc_id, {_VOCAB_TOKS} AS toks FROM documents),
c AS (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM t) GROUP BY token HAVING count(*) >= 2),
v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 2 AS id FROM c),
e AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM t),
i AS (SELECT doc_id, string_agg(coalesce(id, 2)::VARCHAR, ' ' ORDER BY pos) AS ids, string_agg(CASE WHEN id IS NULL THEN '<unk>' ELSE token END, ' ' ORDER BY pos) AS back,
             count(*) AS n FROM e LEFT JOIN v USING (token) GROUP BY doc_id)
SELECT t.doc_id, coalesce(i.n, 0) AS n_ids, md5(coalesce(ids, '')) AS ids_md5, md5(coalesce(back, '')) AS back_md5 FROM t LEFT JOIN i USING (doc_id)
""")
def vocab_encode_q(spark, sf):
    """ids of every document's tokens from a counted vocabulary of the documents (tokens that occur
    twice), and the tokens that the ids give back."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    vocab = cut_lineage(build_vocab(d, "text", min_count=2))
    ids = cut_lineage(encode(d, vocab, key="doc_id", col="text").drop("text"))
    back = decode(ids, vocab, key="doc_id")
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"),
                       F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")).alias("ids_md5"),
                       F.md5(F.array_join("tokens", " ")).alias("back_md5"))


# -------------------------------------------------------------------- counters
@register("augment_log", _augment_sql(3, False, _augment_tail(f"""SELECT count(*) AS n_rows,
       CAST(count_if(least({_TOKS}, 1024) = 1024) AS BIGINT) AS n_exceed_max_length,
       CAST(count_if(chosen_ids = '' OR len(string_split(chosen_ids, ',')) < 3) AS BIGINT) AS n_not_enough,
       (SELECT count(*) FROM knn) AS n_candidates,
       (SELECT count(*) FROM knn k JOIN p c ON c.row_id = k.corpus_id JOIN p q ON q.row_id = k.query_id
        WHERE c.dataset_name = q.dataset_name AND c.idx = q.idx) AS n_self,
       (SELECT count(*) FROM knn k JOIN p c ON c.row_id = k.corpus_id JOIN p q ON q.row_id = k.query_id
        WHERE NOT (c.dataset_name = q.dataset_name AND c.idx = q.idx) AND c.template_name = 'de') AS n_not_original
FROM out""")).replace("WHERE NOT (c.dataset_name = q.dataset_name AND c.idx = q.idx)),",
                      "WHERE NOT (c.dataset_name = q.dataset_name AND c.idx = q.idx) AND c.template_name <> 'de'),"))
def augment_log_q(spark, sf):
    """The counters of one augmentation run, gathered in its own pass: rows, full and short
    ones, candidates seen, discarded as the row itself and as not original."""
    rows = prompted_documents(spark, sf)
    omit = rows.where("template_name = 'de'").select("dataset_name", "template_name").distinct()
    return augment_logged(rows, _neighbours(spark, sf), rows, 3, max_length=1024, omit_templates=omit)[1]


# ------------------------------------------------------------------ confidence
@register("self_reference_margin", f"""
WITH {_lp_sql()},
two AS (SELECT doc_id, template_name, prompt_mode, prediction, best_score - max(score) AS confidence
        FROM pr JOIN sc USING (doc_id, template_name, prompt_mode) WHERE choice_idx <> prediction
        GROUP BY doc_id, template_name, prompt_mode, prediction, best_score),
pool AS (SELECT doc_id AS pool_doc, CAST(row_number() OVER (ORDER BY confidence DESC, doc_id) - 1 AS BIGINT) AS slot
         FROM two ORDER BY confidence DESC, doc_id LIMIT 10),
np AS (SELECT count(*) AS n FROM pool),
pick AS (SELECT c.doc_id, c.confidence, (('0x' || substr(md5(CAST(c.doc_id AS VARCHAR) || '|0'), 1, 8))::BIGINT % np.n) AS slot
         FROM two c CROSS JOIN np)
SELECT pick.doc_id, round(pick.confidence, 6) AS margin, pool.pool_doc FROM pick JOIN pool USING (slot)
""")
def self_reference_margin_q(spark, sf):
    """C1 / F22 / C2 with ``order='margin'``: best score minus the second best."""
    keys = ["doc_id", "template_name", "prompt_mode"]
    scores = cut_lineage(choice_scores(_logp(spark, sf), keys))
    pred = confidence(second_scores(scores, rank_classify(scores, keys), keys), order="margin")
    docs = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("inputs_pretokenized"))
    pred = pred.join(docs, "doc_id").withColumn("prediction_text", F.get(F.array(*[F.lit(c) for c in CHOICES]), F.col("prediction")))
    out = self_reference(pred.select("doc_id", "confidence", "inputs_pretokenized"), pred, key="doc_id", concat_num=1, pool_size=10)
    return out.select("doc_id", F.round("confidence", 6).alias("margin"), F.get(F.col("pool_keys"), 0).alias("pool_doc"))


# --------------------------------------------------------------------- metrics
_W = "list_filter(string_split_regex({c}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda t: length(t) > 0)"
_SQ = ("list_filter(string_split_regex(regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~]', '', 'g'), '" + WS
       + "'), lambda t: length(t) > 0 AND t NOT IN ('a', 'an', 'the'))")


@register("metric_span_squad", f"""
WITH {_PAIRS_SQL},
s AS (SELECT pair_id, turn, "user" AS c, array_to_string(list_slice({_W.format(c='"user"')}, pair_id % 5 + 1, pair_id % 5 + 4), ' ') AS p,
             array_to_string(list_slice(list_filter(string_split_regex("user", '{WS}'), lambda t: length(t) > 0), pair_id % 3 + 1, pair_id % 3 + 4), ' ') AS g FROM pairs),
t AS (SELECT pair_id, turn, {_SQ.format(c='g')} AS g, {_SQ.format(c='p')} AS p FROM s),
pc AS (SELECT pair_id, item, count(*) AS a FROM (SELECT pair_id, unnest(p) AS item FROM t) GROUP BY ALL),
gc AS (SELECT pair_id, item, count(*) AS b FROM (SELECT pair_id, unnest(g) AS item FROM t) GROUP BY ALL),
cm AS (SELECT pair_id, sum(least(a, b))::DOUBLE AS c FROM pc JOIN gc USING (pair_id, item) GROUP BY pair_id),
f AS (SELECT turn, CASE WHEN array_to_string(p, ' ') = array_to_string(g, ' ') THEN 1.0 ELSE 0.0 END AS em,
             CASE WHEN len(p) = 0 OR len(g) = 0 THEN CASE WHEN len(p) = len(g) THEN 1.0 ELSE 0.0 END
                  WHEN c IS NULL THEN 0.0 ELSE 2 * (c / len(p)) * (c / len(g)) / (c / len(p) + c / len(g)) END AS f1
      FROM t LEFT JOIN cm USING (pair_id))
SELECT turn, round(avg(em), 6) AS exact_match, round(avg(f1), 6) AS f1 FROM f GROUP BY turn
""")
def metric_span_squad_q(spark, sf):
    """Spans of four tokens of every user turn against four of its words as they stand."""
    p = _pairs(spark, sf)
    words = F.slice(whitespace_tokens("user"), (F.col("pair_id") % 3 + 1).cast("int"), 4)
    p = p.select("pair_id", "turn", F.array(F.array_join(words, " ")).alias("answers"), F.col("user").alias("context"),
                 (F.col("pair_id") % 5).alias("start"), (F.col("pair_id") % 5 + 3).alias("end"))
    r = M.REGISTRY["Span Squad"](p, ["turn"], "pair_id")
    return r.select("turn", F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"))


@register("metric_rouge_l_sum")
def metric_rouge_l_sum_q(spark, sf):
    """Summary-level ROUGE-L over the lines of every turn (no SQL form; brute-force tested)."""
    p = _pairs(spark, sf).select("turn", *[F.regexp_replace(c, "[.!?] ", ".\n").alias(c) for c in ("user", "assistant")])
    r = M.rouge_l_sum(p, ["turn"], target="assistant", prediction="user")
    return r.select("turn", F.round("rougeLsum", 6).alias("rougeLsum"))


# ------------------------------------------------------------------- streaming
@register("retrieve_stream", f"""
WITH {embed_sql('documents', 'doc_id', 'text', '')},
{embed_sql('benchmark', 'item_id', 'text', '_b')},
near AS (SELECT b.item_id, e.doc_id FROM emb_b b CROSS JOIN emb e
         QUALIFY row_number() OVER (PARTITION BY b.item_id ORDER BY {_dist('b.embedding', 'e.embedding')}, e.doc_id) = 1)
SELECT b.item_id, n.doc_id AS chosen_idx, md5(rtrim(d.text || d.lang, chr(10)) || chr(10) || chr(10) || b.text) AS prompt_md5
FROM benchmark b JOIN near n USING (item_id) JOIN documents d ON d.doc_id = n.doc_id
""")
def retrieve_stream_q(spark, sf):
    """The benchmark's items as a stream of files, each micro-batch retrieving from the documents'
    stored shard, which all of them share; what the stream has stored."""
    root = _root(spark, "stream")
    items = read_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("row_id"), F.lit("benchmark").alias("dataset_name"), F.lit("item").alias("template_name"),
        F.col("item_id").alias("idx"), F.col("text").alias("inputs_pretokenized"), F.lit("").alias("targets_pretokenized"))
    items.repartition(4, "row_id").write.parquet(f"{root}/in")
    save_index(build_index(prompted_documents(spark, sf)), root, "corpus")
    stream = prompt_stream(spark, f"{root}/in", items.schema, max_files_per_trigger=1)
    query = online_augment(stream, lambda s: io.load_shard(s, root, "corpus")[0].drop("shard"), f"{root}/out", f"{root}/state",
                           version=folder_version(f"{root}/corpus"))
    query.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.select(F.col("row_id").alias("item_id"), F.get("chosen_examples", F.lit(0))["idx"].alias("chosen_idx"),
                      F.md5("inputs_pretokenized").alias("prompt_md5"))


# ------------------------------------------------------- template-augmented folders
_SET_SQL = f"""
WITH d AS (SELECT *, {_TASK} AS task, {_SPLIT} AS split FROM documents),
x AS (SELECT doc_id, task, lang AS template_name, split,
             'Write ' || lang || ' prose for ' || task || '.' || chr(10) || chr(10) || text AS x
      FROM d WHERE NOT (lang = 'fr' AND starts_with(source, 'src1'))),
n AS (SELECT *, least(len(list_filter(string_split_regex(x, '{WS}'), lambda s: length(s) > 0)), 64) AS n FROM x)"""


def _template_set(spark, sf):
    root = _folders(spark, sf)
    c = F.when(F.col("cfg").isin("None", ""), None).otherwise(F.col("cfg"))
    t = _docs(spark, sf).select(F.concat_ws("_", "source", c).alias("task"), F.col("lang").alias("template_name")).distinct()
    templates = t.withColumn("template_str", F.concat(F.lit("Write "), "template_name", F.lit(" prose for "), "task", F.lit(".")))
    omit = F.when(F.startswith("task", F.lit("src1")), F.array(F.lit("_fr"))).otherwise(F.array().cast("array<string>"))
    meta = t.select("task").distinct().withColumn("omit_templates", omit)
    return template_augmented_folders(spark, root, _root(spark, "template-set"), templates, schema=_FOLDER_SCHEMA,
                                      metadata=meta, max_length=64)


@register("template_augmented_folders", f"""{_SET_SQL}
SELECT doc_id, task, template_name, split, md5(x) AS input_md5, CAST(n AS INTEGER) AS n_inputs FROM n
""")
def template_augmented_folders_q(spark, sf):
    """Stored folders, some omitted, to a stored template-augmented set that is read back."""
    out = _template_set(spark, sf)[0]
    return out.select("doc_id", "task", "template_name", "split", F.md5("inputs_pretokenized").alias("input_md5"),
                      F.size("inputs").alias("n_inputs"))


@register("template_augmented_log", f"""{_SET_SQL},
f AS (SELECT count(DISTINCT task || '_' || lang) AS n_folders,
             count(DISTINCT task || '_' || lang) FILTER (lang = 'fr' AND starts_with(source, 'src1')) AS n_omitted FROM d)
SELECT n_folders, n_omitted, count(*) AS n_rows, count(*) FILTER (n = 64) AS n_exceed_max_length FROM n, f GROUP BY ALL
""")
def template_augmented_log_q(spark, sf):
    """A6 of D8: folders found and left out, rows, and rows at the length limit, of that one run."""
    return _template_set(spark, sf)[1]
