"""Queries over sources, names, lookups and small rules (S2-S15, P2-P4, P15-P19, J9, J12,
J13, A5, A13, C3, D4, D7, W4, E9, R1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import names as N
from ..functions.templates import remove_hyphens
from ..operators.augment import rank_demonstrations
from ..operators.chosen import first_paths
from ..operators.filters import audit_templates, keep_original, slice_rows, train_or_all, used_templates, with_lineage
from ..operators.knn import knn_join
from ..operators.mixture import map_splits
from ..operators.perplexity import tail_perplexity, transpose_prompts
from ..operators.rank import compare_accuracy, evaluate
from ..session import ensure_checkpoint_dir
from ..sources import io
from ..sources.tables import document_vectors, prompted_documents, read_table, shard_vectors
from .catalog import register
from .composite import chosen_index, knowledge_set, nest_candidates, retrieval_log
from .q_evaluate import _MODES_SQL, _PAIRS_SQL, MODES, WS, _labelled, _logp, _lp_sql, _pairs, _predictions
from .q_retrieval import K_RETRIEVE, _augment_sql, _augmented, _dist, _neighbours, embed_sql
from .q_text import in_conversations

WRITERS = 8        # tasks that a written dataset is dealt to at most
_SPLIT = "CASE WHEN (doc_id // 20) % 5 = 0 THEN 'validation' ELSE 'train' END"
_CFG = "CASE CAST(substr(source, 4) AS INTEGER) % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'cfg' ELSE '' END"
# a mixture directory for every document: .../{ds}__{cfg}__k/{task}_{template}[_score_eval]
_PATH = (f"'root/' || source || '__' || coalesce(nullif(nullif({_CFG}, 'None'), ''), 'none') || '__k-20/' || source "
         f"|| coalesce('_' || nullif(nullif({_CFG}, 'None'), ''), '') || '_' || lang "
         "|| CASE WHEN doc_id % 2 = 0 THEN '_score_eval' ELSE '' END")


def _docs(spark, sf):
    n = F.substring("source", 4, 10).cast("int")
    cfg = F.when(n % 3 == 0, "None").when(n % 3 == 1, "cfg").otherwise("")
    return read_table(spark, sf, "documents").withColumns({
        "cfg": cfg, "split": F.when(F.floor(F.col("doc_id") / 20) % 5 == 0, "validation").otherwise("train")})


def _paths(spark, sf):
    d = _docs(spark, sf)
    c = N.null_config("cfg")
    return d.withColumn("path", F.concat(
        F.lit("root/"), F.col("source"), F.lit("__"), F.coalesce(c, F.lit("none")), F.lit("__k-20/"),
        F.concat_ws("_", "source", c, "lang"), F.when(F.col("doc_id") % 2 == 0, "_score_eval").otherwise("")))


def _folder(spark, kind):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ sources
@register("read_task", f"""
SELECT 'plain' AS which, doc_id FROM documents WHERE source = 'src1' AND {_SPLIT} = 'train'
UNION ALL SELECT 'prefer', doc_id FROM documents WHERE source = 'src3' AND {_SPLIT} = 'validation'
UNION ALL SELECT 'prefer_absent', doc_id FROM documents WHERE source = 'src4'
UNION ALL SELECT 'config_is_split', doc_id FROM documents WHERE source = 'src2' AND {_SPLIT} = 'train'
""")
def read_task_q(spark, sf):
    """The prompted table written partitioned, then named datasets read:
    by split, preferring a split, and with the config as the split name."""
    root = _folder(spark, "prompted")
    name = F.when(F.col("source") == "src2", "anli").otherwise(F.col("source")).alias("dataset_name")
    _docs(spark, sf).select("doc_id", name, F.when(F.col("source") == "src2", "").otherwise(F.col("cfg")).alias("dataset_config_name"),
                            "split") \
        .repartition(F.col("dataset_name"), F.pmod(F.xxhash64("doc_id"), F.lit(WRITERS))).write.partitionBy("dataset_name").parquet(root)
    reads = (("plain", io.read_task(spark, root, "src1", "cfg", "train")),
             ("prefer", io.read_task(spark, root, "src3", prefer="validation")),
             ("prefer_absent", io.read_task(spark, root, "src4", "cfg", prefer="test")),
             ("config_is_split", io.read_task(spark, root, "anli", "train")))
    out = None
    for which, df in reads:
        df = df.select(F.lit(which).alias("which"), "doc_id")
        out = df if out is None else out.unionByName(df)
    return out


@register("json_sources", """
SELECT source AS task, count(*) AS n, CAST(count(DISTINCT lang) AS BIGINT) AS n_original FROM documents GROUP BY source
""")
def json_sources_q(spark, sf):
    """documents' sources as JSON lines, and task metadata as one JSON object."""
    root = _folder(spark, "json")
    d = read_table(spark, sf, "documents")
    d.select("doc_id", "source", "lang").write.json(f"{root}/rows")
    meta = d.groupBy("source").agg(F.collect_set("lang").alias("l")).select(F.create_map(
        F.col("source"), F.struct(F.col("l").alias("original_dataset_name"),
                                  F.array().cast("array<string>").alias("omit_templates"))).alias("m"))
    meta.select(F.to_json("m").alias("value")).write.text(f"{root}/meta")      # an object a line
    tasks = io.task_metadata(spark, f"{root}/meta").select("task", F.size("original_dataset_name").cast("bigint").alias("n_original"))
    rows = io.read_jsonl(spark, f"{root}/rows", "doc_id bigint, source string, lang string")
    return rows.groupBy(F.col("source").alias("task")).agg(F.count(F.lit(1)).alias("n")).join(tasks, "task")


@register("registry_sources", """
SELECT source AS HF_name, CASE WHEN length(source) > 4 THEN 'long' END AS subset, count(*) AS train_size,
       CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS n_audit
FROM documents GROUP BY source
""")
def registry_sources_q(spark, sf):
    """A registry CSV and an audit TSV made of the documents' sources, read back."""
    root = _folder(spark, "registry")
    d = read_table(spark, sf, "documents")
    reg = d.groupBy("source").agg(F.count(F.lit(1)).alias("train_size")).select(
        F.col("source").alias("HF_name"), F.when(F.length("source") > 4, "long").alias("subset"),
        F.lit("qa").alias("task_by_convention"), F.lit("BASE").alias("do_train"), F.lit("").alias("do_eval"), "train_size")
    reg.write.option("header", True).csv(f"{root}/csv")
    d.where("lang = 'en'").select(F.lit("qa").alias("category"), F.col("source").alias("t"), F.col("doc_id").alias("d")) \
        .write.option("header", True).option("sep", "\t").csv(f"{root}/tsv")
    audit = io.read_audit_tsv(spark, f"{root}/tsv").groupBy(F.col("task").alias("HF_name")).agg(F.count("dataset").alias("n_audit"))
    return io.read_registry(spark, f"{root}/csv").join(audit, "HF_name", "left").select(
        "HF_name", "subset", "train_size", F.coalesce("n_audit", F.lit(0)).alias("n_audit"))


_TASKS = ("src1", "src2", "src11")


@register("discover", f"""
WITH t(task) AS (VALUES {", ".join(f"('{t}')" for t in _TASKS)}),
p AS (SELECT doc_id, {_PATH} AS path FROM documents),
b AS (SELECT doc_id, string_split(path, '/')[-1] AS basename FROM p)
SELECT b.doc_id, t.task, b.basename FROM b JOIN t ON starts_with(b.basename, t.task)
""")
def discover_q(spark, sf):
    """Directories found by task prefix; src1 also finds src10 to src19, as a glob does."""
    prefixes = spark.createDataFrame([(t,) for t in _TASKS], "task string")
    return io.discover(_paths(spark, sf).select("doc_id", "path"), prefixes).select("doc_id", "task", "basename")


@register("results_report", "WITH " + _lp_sql() + """
SELECT 'results__documents__none__original__ret-20_concat-1' AS result_name, template_name, count(*) AS n,
       round(avg(CASE WHEN prediction = target_idx THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM pt GROUP BY template_name
""")
def results_report_q(spark, sf):
    """``evaluate`` over the log-prob table, written as named JSON results
    and as a TSV report, both read back and joined."""
    keys = ["doc_id", "template_name", "prompt_mode"]
    targets = read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("target_idx")).join(
        _labelled(spark, sf).select("doc_id", F.col("lang").alias("template_name"), F.lit("original").alias("prompt_mode")), "doc_id")
    r = evaluate(_logp(spark, sf), targets, example_keys=keys, group_cols=["template_name", "prompt_mode"])
    r = r.withColumns({"dataset_name": F.lit("documents"), "dataset_config_name": F.lit("None"),
                       "retrieve_num": F.lit(20), "concat_num": F.lit(1), "accuracy": F.round("accuracy", 6)})
    root = _folder(spark, "results")
    io.write_results(r, f"{root}/json")
    io.write_report(r, f"{root}/tsv")
    back = spark.read.schema("template_name string, n bigint, result_name string").json(f"{root}/json")
    tsv = spark.read.schema("template_name string, accuracy double").option("sep", "\t").csv(f"{root}/tsv")
    return back.join(tsv, "template_name").select("result_name", "template_name", "n", "accuracy")


@register("train_or_all", f"""
WITH d AS (SELECT doc_id, source || '/' || lang AS path, CASE WHEN lang = 'de' THEN 'test' ELSE {_SPLIT} END AS split FROM documents),
t AS (SELECT path, bool_or(split = 'train') AS has FROM d GROUP BY path)
SELECT doc_id, path, split FROM d JOIN t USING (path) WHERE NOT has OR split = 'train'
""")
def train_or_all_q(spark, sf):
    """The train rows of every source path, or all rows of a path without any."""
    d = _docs(spark, sf).select("doc_id", F.concat_ws("/", "source", "lang").alias("path"),
                                F.when(F.col("lang") == "de", "test").otherwise(F.col("split")).alias("split"))
    return train_or_all(d).select("doc_id", "path", "split")


# -------------------------------------------------------------------- names
@register("parse_task_path", f"""
SELECT doc_id, source || coalesce('_' || nullif(nullif({_CFG}, 'None'), ''), '') AS task, lang AS template, lang || '_x' AS inside,
       coalesce('_' || nullif(nullif({_CFG}, 'None'), ''), '') || '_' || lang || CASE WHEN doc_id % 2 = 0 THEN '_score_eval' ELSE '' END AS from_basename,
       source || '__' || coalesce(nullif(nullif({_CFG}, 'None'), ''), 'none') || '__root__k-20' AS output_name
FROM documents
""")
def parse_task_path_q(spark, sf):
    """Task and template of a mixture path, template by prefix, output name."""
    p = _paths(spark, sf)
    # a directory spells a missing config 'none', which is the null config
    k = N.parse_task_path(F.col("path"))
    # the suffix and the task inside a name go as well
    inside = N.parse_task_path(F.concat("path", F.lit("_score_eval_"), k["task"], F.lit("_x")))
    return p.select("doc_id", k["task"].alias("task"), k["template"].alias("template"), inside["template"].alias("inside"),
                    N.template_from_basename(F.element_at(F.split("path", "/"), -1), "source").alias("from_basename"),
                    N.output_name("source", "cfg", "root", 20).alias("output_name"))


@register("alias_originals", """
SELECT doc_id FROM documents WHERE (source = 'src1' AND lang IN ('en', 'de')) OR (source <> 'src1' AND lang = 'fr')
""")
def alias_originals_q(spark, sf):
    """src1 looks its originals up under another metadata key."""
    d = read_table(spark, sf, "documents").select("doc_id", F.col("source").alias("task"), F.col("lang").alias("basename"))
    meta = [(f"src{i}", ["fr"]) for i in range(20) if i != 1] + [("src1_original", ["en", "de"])]
    allow = spark.createDataFrame(meta, "task string, original_dataset_name array<string>")
    return keep_original(d, allow, aliases={"src1": "src1_original"}).select("doc_id")


@register("map_splits", """
SELECT conv_id, turn, CASE split WHEN 'validation' THEN 'dev' ELSE split END || '_' || round AS mapped, split AS plain
FROM (SELECT conv_id, turn, ['train', 'validation', 'test'][conv_id % 3 + 1] AS split, 'r' || (turn % 3 + 1) AS round
      FROM conversations)
""")
def map_splits_q(spark, sf):
    """Logical splits to a round's physical ones; columns without hyphens."""
    c = read_table(spark, sf, "conversations").select(
        "conv_id", "turn", F.get(F.array(F.lit("train"), F.lit("validation"), F.lit("test")),
                                 (F.col("conv_id") % 3).cast("int")).alias("the-split"),
        F.concat(F.lit("r"), (F.col("turn") % 3 + 1).cast("string")).alias("the-round"))
    c = remove_hyphens(c)
    return c.select("conv_id", "turn", map_splits("the_split", "the_round").alias("mapped"),
                    map_splits("the_split", F.lit(None).cast("string")).alias("plain"))


@register("slice_rows", """
SELECT doc_id, idx FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents)
WHERE idx >= 2 AND idx < 5
""")
def slice_rows_q(spark, sf):
    """The rows at positions 2 to 4 of every dataset (the slice is the feature)."""
    d = read_table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset_name"))
    return slice_rows(with_lineage(d, "doc_id"), 2, 5).select("doc_id", "idx")


# ------------------------------------------------------------------ lookups
@register("used_templates", f"""
WITH d AS (SELECT doc_id, source || coalesce('_' || nullif(nullif({_CFG}, 'None'), ''), '') AS task, lang FROM documents)
SELECT task || '_' || lang AS task_template, task, lang AS template, CASE WHEN lang <> 'de' THEN 'Use ' || lang END AS template_str FROM d
GROUP BY task, lang
""")
def used_templates_q(spark, sf):
    """Template strings of the mixture paths, keyed by task and template; German ones have none."""
    # grouped: the path is then a column, not an expression repeated in every use of it
    p = _paths(spark, sf).groupBy("path", "lang").agg(F.max("doc_id").alias("ordinal"))
    k = N.parse_task_path(F.col("path"))
    tpl = p.where("lang <> 'de'").select(k["task"].alias("task"), F.col("lang").alias("template"),
                                         F.concat(F.lit("Use "), F.col("lang")).alias("template_str")).distinct()
    return used_templates(p.select("path", "ordinal"), tpl, fail=False).select(
        "task_template", "task", "template", "template_str")


@register("audit_templates", """
SELECT doc_id, lang AS template, lang = 'en' AS original, lang = 'es' AS missing FROM documents
""")
def audit_templates_q(spark, sf):
    """Audit rows of plain, configured and anli datasets to their original flag."""
    d = read_table(spark, sf, "documents")
    n = F.substring("source", 4, 10).cast("int")
    task = F.when(n % 3 == 0, F.concat("source", F.lit("/ARC-Easy"))).when(n % 3 == 1, F.lit("anli")).otherwise(F.col("source"))
    name = F.when(n % 3 == 0, F.concat_ws("_", "source", F.lit("ARC_Easy"), "lang")).when(
        n % 3 == 1, F.concat(F.lit("anli_"), F.col("lang"), F.lit("_r2"))).otherwise(F.concat_ws("_", "source", "lang"))
    rows = d.select("doc_id", task.alias("task"), F.concat(name, F.lit("_score_eval")).alias("dataset"))
    flags = d.where("lang <> 'es'").select(task.alias("task"), F.col("lang").alias("template"),
                                           (F.col("lang") == "en").alias("original_task")).distinct()
    report, missing = audit_templates(rows.select("task", "dataset").distinct(), flags)
    gone = missing.distinct().withColumn("missing", F.lit(True))
    return (rows.join(report, ["task", "dataset"]).join(gone, ["task", "template"], "left")
            .select("doc_id", "template", "original", F.coalesce("missing", F.lit(False)).alias("missing")))


@register("transpose_prompts", f"""
WITH {_PAIRS_SQL}
SELECT pair_id, 'a:' || "user" || '|b:' || assistant AS prompts FROM pairs
""")
def transpose_prompts_q(spark, sf):
    """The prompts of one position side by side across templates."""
    p = _pairs(spark, sf)
    rows = p.select("pair_id", F.lit("b").alias("t"), F.col("assistant").alias("x")).unionByName(
        p.select("pair_id", F.lit("a").alias("t"), F.col("user").alias("x")))
    out = transpose_prompts(rows, "pair_id", "t", "x")
    return out.select("pair_id", F.array_join(F.transform("prompts", lambda z: F.concat(z["template"], F.lit(":"), z["input"])), "|").alias("prompts"))


@register("first_paths", f"""
WITH p AS (SELECT DISTINCT source, {_PATH} AS path FROM documents)
SELECT source, path FROM p QUALIFY dense_rank() OVER (PARTITION BY source ORDER BY path) <= 3
""")
def first_paths_q(spark, sf):
    """The first three paths of every dataset (the limit is the feature)."""
    return first_paths(_paths(spark, sf).select("source", "path").distinct(), 3, "source").select("source", "path")


# --------------------------------------------------------------- evaluation
@register("tail_perplexity", "WITH " + _lp_sql() + """
SELECT doc_id, choice_idx, round(exp(-avg(logp)), 6) AS ppl FROM lp WHERE pos >= 1 GROUP BY doc_id, choice_idx
""")
def tail_perplexity_q(spark, sf):
    """A5: perplexity of the last two of three positions."""
    r = tail_perplexity(_logp(spark, sf), ["doc_id", "choice_idx"], 2)
    return r.select("doc_id", "choice_idx", F.round("ppl", 6).alias("ppl"))


@register("compare_accuracy", _MODES_SQL + """
SELECT b.template_name, round(b.accuracy, 6) AS accuracy_before, round(a.accuracy, 6) AS accuracy_after,
       round(a.accuracy - b.accuracy, 6) AS delta
FROM acc b JOIN acc a USING (template_name)
WHERE b.prompt_mode = 'original' AND a.prompt_mode = 'ic_dpr_full_prompt'
""")
def compare_accuracy_q(spark, sf):
    """Accuracy of two prompt modes side by side."""
    from ..operators.rank import accuracy
    a = accuracy(_predictions(spark, sf, MODES), ["template_name", "prompt_mode"])
    r = compare_accuracy(a.where("prompt_mode = 'original'"), a.where("prompt_mode = 'ic_dpr_full_prompt'"), ["template_name"])
    return r.select("template_name", *[F.round(c, 6).alias(c) for c in ("accuracy_before", "accuracy_after", "delta")])


_TRIVIA = ("list_filter(list_filter(string_split_regex(regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~‘’´`_]', ' ', 'g'), '"
           + WS + "'), lambda t: length(t) > 0), lambda t: t NOT IN ('a', 'an', 'the'))")


@register("metric_trivia_qa", f"""
WITH {_PAIRS_SQL},
t AS (SELECT pair_id, {_TRIVIA.format(c='assistant')} AS g, {_TRIVIA.format(c='"user"')} AS p FROM pairs),
pc AS (SELECT pair_id, item, count(*) AS a FROM (SELECT pair_id, unnest(p) AS item FROM t) GROUP BY ALL),
gc AS (SELECT pair_id, item, count(*) AS b FROM (SELECT pair_id, unnest(g) AS item FROM t) GROUP BY ALL),
cm AS (SELECT pair_id, sum(least(a, b))::DOUBLE AS c FROM pc JOIN gc USING (pair_id, item) GROUP BY pair_id),
s AS (SELECT CASE WHEN array_to_string(p, ' ') = array_to_string(g, ' ') THEN 1.0 ELSE 0.0 END AS em,
             CASE WHEN len(p) = 0 OR len(g) = 0 THEN CASE WHEN len(p) = len(g) THEN 1.0 ELSE 0.0 END
                  WHEN c IS NULL THEN 0.0 ELSE 2 * (c / len(p)) * (c / len(g)) / (c / len(p) + c / len(g)) END AS f1
      FROM t LEFT JOIN cm USING (pair_id))
SELECT round(avg(em), 6) AS exact_match, round(avg(f1), 6) AS f1 FROM s
""")
def metric_trivia_qa_q(spark, sf):
    """Exact match and token F1 with TriviaQA's normaliser, over all pairs."""
    p = _pairs(spark, sf).select("pair_id", F.array("assistant").alias("answers"), F.col("user").alias("prediction"))
    r = M.REGISTRY["Trivia QA"](p, [], "pair_id")
    return r.select(F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"))


# ---------------------------------------------------------------- composite
@register("retrieval_log", f"""
WITH {embed_sql('documents', 'doc_id', 'text', '')},
r AS (SELECT q.doc_id AS query_id, c.doc_id, c.doc_id % 2 AS shard_ord, {_dist('q.embedding', 'c.embedding')} AS score,
             row_number() OVER (PARTITION BY q.doc_id, c.doc_id % 2 ORDER BY score, c.doc_id) AS rank
      FROM emb q JOIN emb c ON TRUE QUALIFY rank <= 2)
SELECT d.doc_id AS row_id, d.lang AS template_name, d.lang AS target,
       string_agg(r.doc_id::VARCHAR, ',' ORDER BY r.shard_ord, r.rank) AS retrieved_idx,
       string_agg(x.source, ',' ORDER BY r.shard_ord, r.rank) AS names
FROM documents d JOIN r ON r.query_id = d.doc_id JOIN documents x ON x.doc_id = r.doc_id
GROUP BY ALL
""")
def retrieval_log_q(spark, sf):
    """A log record for every prompt, with what was retrieved for it as text."""
    v = document_vectors(spark, sf)
    rows = prompted_documents(spark, sf)
    cand = knn_join(v, v, 2, query_key="row_id", corpus_key="row_id", shard_col="shard")
    log = retrieval_log(rows, nest_candidates(cand, rows))

    def text(c):
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")

    return log.select("row_id", "template_name", "target", text("retrieved_idx").alias("retrieved_idx"),
                      text("retrieved_dataset_name").alias("names"))


@register("chosen_index", _augment_sql(3, True, f"""
ci AS (SELECT c_idx AS id, any_value(c_in) AS inp FROM ranked GROUP BY c_ds, c_tpl, c_idx),
{embed_sql('ci', 'id', 'inp', '_c')},
near AS (SELECT q.doc_id AS row_id, c.id AS chosen_idx, row_number() OVER (
             PARTITION BY q.doc_id ORDER BY {_dist('q.embedding', 'c.embedding')}, c.id) AS rank
         FROM emb q CROSS JOIN emb_c c QUALIFY rank = 1)
SELECT row_id, chosen_idx FROM near"""))
def chosen_index_q(spark, sf):
    """The chosen examples of the K = 3 augmentation as a corpus of their own; every
    document's nearest of them."""
    v = document_vectors(spark, sf)
    index = chosen_index(_augmented(spark, sf, 3, True, v, keys=True))
    r = knn_join(v, index, 1, query_key="row_id", corpus_key="idx")
    return r.select(F.col("query_id").alias("row_id"), F.col("corpus_id").alias("chosen_idx"))


@register("omitted_demonstrations", _augment_sql(1, False, """done AS (SELECT 1)
SELECT query_id, CAST(pos AS INTEGER) AS pos, corpus_id FROM ranked""").replace(
    "WHERE NOT (c.dataset_name = q.dataset_name AND c.idx = q.idx)",
    "WHERE NOT (c.dataset_name = q.dataset_name AND c.idx = q.idx) AND NOT (c.template_name = 'en' AND c.dataset_name < 'src2')"))
def omitted_demonstrations_q(spark, sf):
    """The first demonstration when the English rows of some datasets are none."""
    rows = prompted_documents(spark, sf)
    omit = rows.where("dataset_name < 'src2' AND template_name = 'en'").select("dataset_name", "template_name").distinct()
    picked = rank_demonstrations(rows, _neighbours(spark, sf), rows, 1, omit_templates=omit)
    return picked.select("query_id", F.col("pos").cast("int").alias("pos"), "corpus_id")


@register("knowledge_set", f"""
WITH {_PAIRS_SQL},
k AS (SELECT pair_id, "user" || chr(10) || '[KiC]' || chr(10) || assistant || chr(10) || '[KiC]' || chr(10) AS x, conv_id FROM pairs)
SELECT pair_id, x AS inputs_pretokenized, ['even', 'odd'][conv_id % 2 + 1] AS targets_pretokenized,
       CAST(least(len(list_filter(string_split_regex(x, '{WS}'), lambda s: length(s) > 0)), 1024) AS INTEGER) AS n_inputs,
       2 AS n_targets
FROM k
""")
def knowledge_set_q(spark, sf):
    """Template, knowledge block, target check (a target outside the choices fails),
    tokens, masked labels."""
    gloss = F.create_map(F.lit("reply"), F.array(F.struct(F.array("assistant").alias("glosses"))))
    p = _pairs(spark, sf).select(F.col("pair_id").alias("row_id"), in_conversations("conversations").alias("dataset_name"), "user",
                                 (F.col("conv_id") % 2).cast("int").alias("parity"),
                                 F.to_json(F.struct(F.struct(gloss.alias("gloss")).alias("lexicon"))).alias("knowledge"))
    tpl = spark.createDataFrame([("conversations", "k", "{{user}}|||{{answer_choices[parity]}}", "even|||odd")],
                                "dataset_name string, template_name string, template_str string, answer_choices string")
    out = knowledge_set(p, tpl, fields=["user", "parity"])
    return out.select(F.col("row_id").alias("pair_id"), "inputs_pretokenized", "targets_pretokenized",
                      F.size("inputs").alias("n_inputs"), F.size("targets").alias("n_targets"))


@register("knn_global", f"""
WITH e AS (SELECT vec_id, embedding, vec_id % 2 AS shard_ord FROM embeddings),
r AS (SELECT q.vec_id AS query_id, c.vec_id AS corpus_id, c.shard_ord, {_dist('q.embedding', 'c.embedding')} AS score,
             row_number() OVER (PARTITION BY q.vec_id, c.shard_ord ORDER BY score, c.vec_id) AS rank
      FROM e q JOIN e c ON TRUE QUALIFY rank <= {K_RETRIEVE})
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, shard_ord, rank) AS INTEGER) AS pos, corpus_id
FROM r QUALIFY pos <= {K_RETRIEVE}
""")
def knn_global_q(spark, sf):
    """J3 (global_k): the nearest over all shards together."""
    from ..operators.knn import merged_order
    v = shard_vectors(spark, sf)
    r = knn_join(v, v, K_RETRIEVE, query_key="vec_id", corpus_key="vec_id", shard_col="shard")
    return merged_order(r, K_RETRIEVE).select("query_id", F.col("pos").cast("int").alias("pos"), "corpus_id")
