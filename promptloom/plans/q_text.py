"""Text, template, name and lookup queries (F1-F5, F7-F8, F10-F12, F14-F16, F19,
J10, A9, A14, P1, P5, P6, P14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..functions.templates import append_knowledge, apply_templates
from ..operators.augment import augment
from ..operators.filters import drop_omitted, keep_original, with_lineage
from ..operators.knn import knn_join
from ..operators.pad import pad_batch
from ..sources.tables import prompted_documents, read_table, shard_vectors
from .catalog import register
from .composite import nest_candidates
from .q_evaluate import _PAIRS_SQL, _pairs
from .q_retrieval import K_RETRIEVE, _augment_sql, _neighbours

WS = r"[ \t\n\x0B\f\r]+"
M_TRUNC = 64
TOKS = f"list_filter(string_split_regex(text, '{WS}'), lambda s: length(s) > 0)"


# ------------------------------------------------------------- truncation
@register("truncate_tokens", f"""
WITH t AS (SELECT doc_id, {TOKS} AS toks FROM documents)
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens,
       array_to_string(toks[greatest(len(toks) - {M_TRUNC} + 1, 1):], ' ') AS left_text,
       CASE WHEN len(toks) <= {M_TRUNC} THEN array_to_string(toks, ' ')
            ELSE array_to_string(toks[1:1] || toks[len(toks) - {M_TRUNC - 1} + 1:], ' ') END AS left_special_text,
       array_to_string(toks[1:{M_TRUNC}], ' ') AS right_text
FROM t
""")
def truncate_tokens_q(spark, sf):
    """Keep the last 64 tokens, first + last 63, or the first 64."""
    d = read_table(spark, sf, "documents").select("doc_id", T.whitespace_tokens("text").alias("toks"))
    return d.select("doc_id", F.size("toks").alias("n_tokens"),
                    F.array_join(T.truncate_left("toks", M_TRUNC), " ").alias("left_text"),
                    F.array_join(T.truncate_left("toks", M_TRUNC, special=True), " ").alias("left_special_text"),
                    F.array_join(T.truncate_right("toks", M_TRUNC), " ").alias("right_text"))


# ------------------------------------------------------------- templates
# fixed small template table of the 'conversations' dataset (a parameter)
CONV_TEMPLATES = (
    ("reply", "{{user}}\nReply:|||{{assistant}}", None),
    ("continue", "Conversation so far: {{ user }} |||  {{assistant}}  ", None),
    ("bad_split", "{{user}}|||{{assistant}}|||extra", None),
    ("no_target", "Say something about: {{user}}|||", None),
    ("typed", "Turn {{turn}}: {{ user }}|||{{answer_choices[parity]}}", "even ||| odd"),
)
CONV_FIELDS = ["user", "assistant", "turn", "parity"]
MARKS = " ||| {{assistant}} {{x}}"      # in a field this is plain text


def in_conversations(value):
    """A column of one value that the optimiser keeps as a join key (a literal would turn
    the equi-join with the templates into a nested loop)."""
    return F.when(F.col("conv_id").isNotNull(), F.lit(value))


def marked_pairs(spark, sf):
    """The (user, reply) pairs; every fifth conversation's user text holds template marks."""
    return _pairs(spark, sf).withColumns({
        "user": F.when(F.col("conv_id") % 5 == 0, F.concat("user", F.lit(MARKS))).otherwise(F.col("user")),
        "parity": (F.col("conv_id") % 2).cast("int"), "dataset_name": in_conversations("conversations")})


def conv_templates(spark, only=None):
    return spark.createDataFrame([("conversations", *t) for t in CONV_TEMPLATES if only is None or t[0] in only],
                                 "dataset_name string, template_name string, template_str string, answer_choices string")


def _tpl_values_sql() -> str:
    rows = []
    for name, tpl, _ in CONV_TEMPLATES:
        lit = " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in tpl.split("\n"))
        rows.append(f"('{name}', {lit})")
    return ", ".join(rows)


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
# a part is cut at its placeholders once; what is filled in is not read again
_FILL = """list_aggregate(list_transform(range(1, len(string_split_regex({x}, '\\{{\\{{.*?\\}}\\}}')) + 1), lambda i:
    string_split_regex({x}, '\\{{\\{{.*?\\}}\\}}')[i]
    || CASE coalesce(regexp_extract_all({x}, '\\{{\\{{\\s*(.*?)\\s*\\}}\\}}', 1)[i], '') WHEN 'user' THEN u WHEN 'assistant' THEN a
       WHEN 'turn' THEN turn::VARCHAR WHEN 'answer_choices[parity]' THEN ['even', 'odd'][conv_id % 2 + 1] ELSE '' END),
    'string_agg', '')"""


_APPLY_CTES = f"""{_PAIRS_SQL},
tp(template_name, template_str) AS (VALUES {_tpl_values_sql()}),
r AS (SELECT p.conv_id, p.turn, tp.template_name, string_split(tp.template_str, '|||') AS parts,
             p."user" || CASE WHEN p.conv_id % 5 = 0 THEN '{MARKS}' ELSE '' END AS u, p.assistant AS a
      FROM pairs p CROSS JOIN tp),
f AS (SELECT conv_id, turn, template_name, len(parts) AS n, {_STRIP.format(x=_FILL.format(x="parts[1]"))} AS x,
             {_STRIP.format(x=_FILL.format(x="coalesce(parts[2], '')"))} AS y FROM r),
o AS (SELECT conv_id, turn, template_name, CASE WHEN n = 2 THEN x ELSE '' END AS inputs_pretokenized,
             CASE WHEN n <> 2 THEN '' WHEN y = '' THEN '<NO LABEL>' ELSE y END AS targets_pretokenized
      FROM f)"""


@register("apply_templates", f"""
WITH {_APPLY_CTES}
SELECT * FROM o WHERE length(inputs_pretokenized) > 0 AND length(targets_pretokenized) > 0
""")
def apply_templates_q(spark, sf):
    """J10 + F2 + F20 + P9: every (user, reply) pair under every template of the
    conversations dataset; a template that does not split in two is dropped, marks
    inside fields are text, ``{{turn}}`` is an integer and one target an answer choice."""
    out = apply_templates(marked_pairs(spark, sf), conv_templates(spark), fields=CONV_FIELDS, keep=("conv_id", "turn"))
    return out.select("conv_id", "turn", "template_name", "inputs_pretokenized", "targets_pretokenized")


# ------------------------------------------------------------ knowledge
_KNOW_SQL = f"""
WITH {_PAIRS_SQL},
l AS (SELECT conv_id, turn, "user",
             [array_to_string(string_split(assistant, chr(10))[1:5], chr(10)),
              array_to_string(string_split("user", chr(10))[1:5], chr(10))]
             || string_split(assistant, chr(10))[1:5]
             || [string_split("user", '. ')[1]] AS lines
      FROM pairs)
SELECT conv_id, turn, "user" || chr(10) || '[KiC]' || chr(10) || array_to_string(lines, chr(10))
       || chr(10) || '[KiC]' || chr(10) AS inputs_pretokenized
FROM l
"""


@register("knowledge_block", _KNOW_SQL)
def knowledge_block_q(spark, sf):
    """a knowledge JSON per (user, reply) pair -- lexicon glosses per role,
    causal sentences of the reply, a JSON list of the user's sentences -- parsed
    back and appended to the input between [KiC] markers."""
    p = _pairs(spark, sf)
    gloss = F.create_map(
        F.lit("assistant"), F.array(F.struct(F.split("assistant", "\n").alias("glosses"))),
        F.lit("user"), F.array(F.struct(F.split("user", "\n").alias("glosses"))))
    causal = F.create_map(F.lit("reply"), F.transform(F.split("assistant", "\n"),
                                                       lambda s: F.struct(s.alias("sent"))))
    summary = F.create_map(F.lit("user"), F.array(F.struct(
        F.to_json(F.split("user", r"\. ")).alias("sentence_key"))))
    know = F.to_json(F.struct(F.struct(gloss.alias("gloss")).alias("lexicon"),
                              causal.alias("causal"), summary.alias("summary")))
    k = p.select("conv_id", "turn", "user", know.alias("knowledge"))
    return k.select("conv_id", "turn", append_knowledge(
        "user", "knowledge", ["lexicon", "causal", "summary"]).alias("inputs_pretokenized"))


# ----------------------------------------------------------------- names
_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_LANG = "nullif(regexp_extract(url, '^https?://[^/]+/([a-z][a-z])/', 1), '')"
_NORM_SQL = ("regexp_replace(regexp_replace(replace(translate({t}, '- /', '___'), '___', '_'), "
             "'[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}''\\s\\p{{Z}}\\x{{0B}}\\x{{85}}_]+', "
             "'', 'g'), '^_+|_+$', '', 'g')")


@register("name_normalise", f"""
WITH p AS (SELECT page_id, {_TITLE} AS title, {_HOST} AS host, {_LANG} AS lang FROM pages)
SELECT page_id, {_NORM_SQL.format(t='title')} AS template_name,
       regexp_replace(host || CASE WHEN lang IS NOT NULL THEN '_' || lang || '_' ELSE '_' END || title,
                      '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}._]+', '_', 'g') AS task,
       replace(replace(title, '/', ''), ' ', '_') AS file_name
FROM p
""")
def name_normalise_q(spark, sf):
    """Template name, task name and file name of every page title."""
    p = read_table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"),
        F.nullif(F.regexp_extract("url", "^https?://[^/]+/([a-z][a-z])/", 1), F.lit("")).alias("lang"))
    return p.select("page_id", N.normalise_template_name("title").alias("template_name"),
                    N.task_name("host", "lang", "title").alias("task"),
                    N.file_safe("title", slash="", space="_").alias("file_name"))


# -------------------------------------------------------- allow / omit
# fixed small task metadata (a parameter): originals of src0..src9 (none for the others), omit lists
def _allow_rows():
    return [(f"src{i}", [f"src{i}_en", f"src{i}_fr"] if i < 10 else []) for i in range(20)]


def _omit_rows():
    return [(f"src{i}", ["_d" if i % 2 == 0 else "_es"]) for i in range(20)]


def _basenames(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.col("source").alias("task"),
                    F.concat_ws("_", "source", "lang").alias("basename"))


@register("keep_original", "WITH a(task, basename) AS (VALUES " + ", ".join(
    f"('src{i}', 'src{i}_{l}')" for i in range(10) for l in ("en", "fr")) + """)
SELECT doc_id, source AS task, source || '_' || lang AS basename FROM documents d
WHERE EXISTS (SELECT 1 FROM a WHERE a.task = d.source AND a.basename = d.source || '_' || d.lang)
""")
def keep_original_q(spark, sf):
    """P5: keep a dataset only when its basename is an original of the task."""
    allow = spark.createDataFrame(_allow_rows(), "task string, original_dataset_name array<string>")
    return keep_original(_basenames(spark, sf), allow)


@register("omit_anti", "WITH o(task, pat) AS (VALUES " + ", ".join(
    f"('src{i}', '{'_d' if i % 2 == 0 else '_es'}')" for i in range(20)) + """)
SELECT doc_id, source AS task, source || '_' || lang AS basename FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.task = d.source AND contains(d.source || '_' || d.lang, o.pat))
""")
def omit_anti_q(spark, sf):
    """Drop datasets whose basename contains an omitted template string."""
    omit = spark.createDataFrame(_omit_rows(), "task string, omit_templates array<string>")
    return drop_omitted(_basenames(spark, sf), omit)


# ------------------------------------------------------ labels & lineage
@register("label_to_class", """
SELECT l.doc_id, CAST(coalesce(list_position(['en', 'fr', 'de'], d.lang) - 1, -1) AS INTEGER) AS class_id,
       list_contains(['en', 'fr', 'de'], d.lang) AS target_in_choices
FROM labels l JOIN documents d USING (doc_id)
""")
def label_to_class_q(spark, sf):
    """Class id of the label among fixed choices (-1 if absent)."""
    lab = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents"), "doc_id")
    ch = F.array(F.lit("en"), F.lit("fr"), F.lit("de"))
    return lab.select("doc_id", T.label_to_class(ch, "lang").alias("class_id"),
                      F.array_contains(ch, F.col("lang")).alias("target_in_choices"))


@register("with_lineage", """
SELECT doc_id, source AS dataset_name, lang AS template_name,
       row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS idx
FROM documents
""")
def with_lineage_q(spark, sf):
    """0-based position per (dataset, template, split) without
    sorting a whole group in one task."""
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("dataset_name"), F.col("lang").alias("template_name"),
        F.lit("train").alias("split"))
    return with_lineage(d, "doc_id").select("doc_id", "dataset_name", "template_name", "idx")


# ------------------------------------------------------------- padding
@register("pad_batch", f"""
WITH t AS (SELECT doc_id, doc_id // 8 AS batch_id, CAST(len({TOKS}) AS INTEGER) AS seq_len FROM documents),
p AS (SELECT *, CAST(ceil(max(seq_len) OVER (PARTITION BY batch_id) / 8) * 8 AS INTEGER) AS padded_len FROM t)
SELECT doc_id, batch_id, seq_len, padded_len, seq_len AS n_attention,
       CAST(padded_len - seq_len AS INTEGER) AS n_masked
FROM p
""")
def pad_batch_q(spark, sf):
    """A14 + F16: pad token ids of a batch of 8 to its longest row (multiple of 8),
    then mask the padding in the labels as -100."""
    d = read_table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") / 8).cast("long").alias("batch_id"),
        T.tokenize("text").alias("input_ids"))
    d = d.withColumn("seq_len", F.size("input_ids"))
    p = pad_batch(d, "batch_id", ids_col="input_ids", pad_to_multiple_of=8)
    masked = T.mask_labels("input_ids")
    return p.select("doc_id", "batch_id", "seq_len", F.size("input_ids").alias("padded_len"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attention"),
                    F.size(F.filter(masked, lambda x: x == T.LABEL_IGNORE_ID)).alias("n_masked"))


# ------------------------------------------------ nested candidates
@register("nest_candidates", f"""
WITH e AS (SELECT vec_id, embedding, CAST(vec_id % 2 AS INTEGER) AS shard_ord FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.shard_ord, c.vec_id AS corpus_id,
             list_sum(list_transform(range(1, len(q.embedding) + 1),
                      lambda i: (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) ^ 2)) AS score
      FROM e q JOIN e c ON TRUE),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, shard_ord ORDER BY score, corpus_id) AS rank FROM d
      QUALIFY rank <= {K_RETRIEVE})
SELECT query_id, CAST(count(*) AS INTEGER) AS n,
       string_agg(CAST(corpus_id AS VARCHAR), ',' ORDER BY shard_ord, rank) AS corpus_ids,
       string_agg(printf('%.6f', score), ',' ORDER BY shard_ord, rank) AS scores
FROM r GROUP BY query_id
""")
def nest_candidates_q(spark, sf):
    """Candidates of every query nested in shard order, scores as text."""
    v = shard_vectors(spark, sf)
    c = knn_join(v, v, K_RETRIEVE, query_key="vec_id", corpus_key="vec_id", shard_col="shard")
    nested = nest_candidates(c, v, corpus_key="vec_id", fields=("vec_id",))
    return nested.select(
        "query_id", F.size("scores").alias("n"),
        F.array_join(F.transform("retrieved_examples", lambda x: x["vec_id"].cast("string")), ",").alias("corpus_ids"),
        F.array_join(F.transform("scores", lambda x: F.format_string("%.6f", x)), ",").alias("scores"))


# ------------------------------------------- prompt styles
def _styled(spark, sf, style, exclude):
    rows = prompted_documents(spark, sf)
    a = augment(rows, _neighbours(spark, sf), rows, 3, max_length=1024, exclude_self=exclude, style=style)
    return a.select("row_id", "inputs_pretokenized")


def _style_sql(demo: str, exclude: bool) -> str:
    base = _augment_sql(3, False, f"""demos AS (SELECT query_id, list({demo} ORDER BY pos) AS ds
           FROM ranked GROUP BY query_id)
SELECT p.row_id,
       list_reduce(coalesce(d.ds, []::VARCHAR[]), lambda acc, x: rtrim(acc || x, chr(10)) || chr(10) || chr(10), '')
       || p.inp AS inputs_pretokenized
FROM p LEFT JOIN demos d ON d.query_id = p.row_id""")
    if not exclude:
        base = base.replace("WHERE NOT (c.dataset_name = q.dataset_name AND c.idx = q.idx)", "")
    return base


@register("augment_offline", _style_sql("rtrim(c_in, chr(10)) || chr(10) || ltrim(c_tgt, chr(10))", True))
def augment_offline_q(spark, sf):
    """offline prefix -- each demonstration appended, right-stripped, blank line."""
    return _styled(spark, sf, "offline", True)


@register("augment_online", _style_sql("c_in || c_tgt", False))
def augment_online_q(spark, sf):
    """online prefix -- input + target without separator, no self-exclusion."""
    return _styled(spark, sf, "online", False)
