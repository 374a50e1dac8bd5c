"""Evaluation queries: rank classification, perplexity, metrics (F17, F18, A1-A4,
A10, A15, L2, R1, R3, R4, C1, C2, E1-E14, F23).

The language model is replaced by a log-prob table that Spark derives from
the labelled documents: for every (document, choice in {low, high}, position
0..2) ``logp = -(((doc_id*7 + choice*13 + pos*3 + n_chars + mode) % 17) / 4)``
and position 2 of choice 0 is padding (mask 0).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.text import whitespace_tokens
from ..operators.perplexity import array_perplexity, template_wins
from ..operators.rank import (accuracy, choice_scores, confidence, expand_choices,
                              log_softmax_array, rank_classify, self_reference, summarise_results)
from ..sources.tables import read_table
from .catalog import register

WS = r"[ \t\n\x0B\f\r]+"
CHOICES = ("low", "high")
MODES = (("original", 0), ("ic_dpr_full_prompt", 5))


def _labelled(spark, sf):
    lab = read_table(spark, sf, "labels")
    doc = read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text")
    return lab.join(doc, "doc_id")


def _logp(spark, sf, modes=(("original", 0),)):
    base = _labelled(spark, sf).select("doc_id", F.col("lang").alias("template_name"), "n_chars")
    mode = F.explode(F.array(*[F.struct(F.lit(m).alias("prompt_mode"), F.lit(o).alias("off"))
                               for m, o in modes])).alias("m")
    x = (base.select("*", mode).select("*", "m.prompt_mode", "m.off").drop("m")
         .withColumn("choice_idx", F.explode(F.array(F.lit(0), F.lit(1))))
         .withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))))
    h = (F.col("doc_id") * 7 + F.col("choice_idx") * 13 + F.col("pos") * 3 + F.col("n_chars")
         + F.col("off")) % 17
    return (x.withColumn("logp", -(h.cast("double") / 4.0))
            .withColumn("mask", F.when(F.col("pos") < F.col("choice_idx") + 2, 1).otherwise(0))
            .drop("off"))


def _lp_sql(modes=(("original", 0),)) -> str:
    vals = ", ".join(f"('{m}', {o})" for m, o in modes)
    return f"""lp AS (
  SELECT l.doc_id, d.lang AS template_name, m.prompt_mode, c.choice_idx, p.pos,
         -(((l.doc_id * 7 + c.choice_idx * 13 + p.pos * 3 + d.n_chars + m.off) % 17)::DOUBLE / 4) AS logp,
         CASE WHEN p.pos < c.choice_idx + 2 THEN 1 ELSE 0 END AS mask
  FROM labels l JOIN documents d USING (doc_id)
  CROSS JOIN (VALUES {vals}) m(prompt_mode, off)
  CROSS JOIN (VALUES (0), (1)) c(choice_idx) CROSS JOIN (VALUES (0), (1), (2)) p(pos)),
sc AS (SELECT doc_id, template_name, prompt_mode, choice_idx,
              sum(CASE WHEN mask <> 0 THEN logp * mask ELSE 0.0 END) AS score
       FROM lp GROUP BY ALL),
pr AS (SELECT doc_id, template_name, prompt_mode,
              CAST(first(choice_idx ORDER BY score DESC, choice_idx) AS INTEGER) AS prediction,
              max(score) AS best_score, min(score) AS worst_score
       FROM sc GROUP BY ALL),
pt AS (SELECT pr.*, CAST(l.quality AS INTEGER) AS target_idx FROM pr JOIN labels l USING (doc_id))"""


def _predictions(spark, sf, modes=(("original", 0),)):
    keys = ["doc_id", "template_name", "prompt_mode"]
    pred = rank_classify(choice_scores(_logp(spark, sf, modes), keys), keys)
    tgt = read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("target_idx"))
    return pred.join(tgt, "doc_id")


@register("expand_choices", """
SELECT l.doc_id, c.choice_idx, c.choice,
       c.choice = CASE WHEN l.quality = 1 THEN 'high' ELSE 'low' END AS is_correct, 1.0::DOUBLE AS weight
FROM labels l CROSS JOIN (VALUES (0, 'low'), (1, 'high')) c(choice_idx, choice)
""")
def expand_choices_q(spark, sf):
    """one row per answer choice with the correctness flag."""
    lab = read_table(spark, sf, "labels").select(
        "doc_id", F.array(*[F.lit(c) for c in CHOICES]).alias("answer_choices"),
        F.when(F.col("quality") == 1, F.lit("high")).otherwise(F.lit("low")).alias("target"))
    return expand_choices(lab, "answer_choices", "target").select(
        "doc_id", "choice_idx", "choice", "is_correct", "weight")


@register("rank_classify", f"""
WITH {_lp_sql()}
SELECT doc_id, prediction, target_idx, round(best_score, 6) AS best_score FROM pt
""")
def rank_classify_q(spark, sf):
    """A2 + A3 + E14: masked log-prob sums, argmax with the lowest index on ties."""
    return _predictions(spark, sf).select("doc_id", "prediction", "target_idx",
                                          F.round("best_score", 6).alias("best_score"))


@register("accuracy", f"""
WITH {_lp_sql()}
SELECT template_name, count(*) AS n, round(avg(CASE WHEN prediction = target_idx THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM pt GROUP BY template_name
""")
def accuracy_q(spark, sf):
    """Accuracy per template, every template in one plan."""
    a = accuracy(_predictions(spark, sf), ["template_name"])
    return a.select("template_name", "n", F.round("accuracy", 6).alias("accuracy"))


_MODES_SQL = f"""
WITH {_lp_sql(MODES)},
acc AS (SELECT template_name, prompt_mode, count(*) AS n,
               avg(CASE WHEN prediction = target_idx THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM pt GROUP BY ALL)"""


@register("evaluate_modes", _MODES_SQL + """
SELECT template_name, prompt_mode, n, round(accuracy, 6) AS accuracy FROM acc
""")
def evaluate_modes_q(spark, sf):
    """Two prompt modes evaluated together, one row per (template, mode)."""
    a = accuracy(_predictions(spark, sf, MODES), ["template_name", "prompt_mode"])
    return a.select("template_name", "prompt_mode", "n", F.round("accuracy", 6).alias("accuracy"))


@register("summarise_results", _MODES_SQL + """
SELECT prompt_mode, count(*) AS n_templates, round(avg(accuracy), 6) AS mean_accuracy,
       round(min(accuracy), 6) AS min_accuracy, round(max(accuracy), 6) AS max_accuracy,
       round(quantile_cont(accuracy, 0.25), 6) AS p25_accuracy, round(quantile_cont(accuracy, 0.5), 6) AS p50_accuracy
FROM acc GROUP BY prompt_mode
""")
def summarise_results_q(spark, sf):
    """Mean, min and max accuracy over templates per prompt mode."""
    a = accuracy(_predictions(spark, sf, MODES), ["template_name", "prompt_mode"])
    out = summarise_results(a, ["prompt_mode"], (0.25, 0.5))
    return out.select("prompt_mode", "n_templates", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@register("self_reference", f"""
WITH {_lp_sql()},
conf AS (SELECT pt.*, best_score / worst_score AS confidence FROM pt),
pool AS (SELECT doc_id AS pool_doc,
                CAST(row_number() OVER (ORDER BY confidence DESC, doc_id) - 1 AS BIGINT) AS slot
         FROM conf ORDER BY confidence DESC, doc_id LIMIT 10),
np AS (SELECT count(*) AS n FROM pool),
pick AS (SELECT c.doc_id, (('0x' || substr(md5(CAST(c.doc_id AS VARCHAR) || '|0'), 1, 8))::BIGINT % np.n) AS slot
         FROM conf c CROSS JOIN np)
SELECT pick.doc_id, pool.pool_doc FROM pick JOIN pool USING (slot)
""")
def self_reference_q(spark, sf):
    """C1 + C2: confidence = best / worst score; every row draws one of the ten
    most confident predictions (hashed pick)."""
    pred = confidence(_predictions(spark, sf))
    docs = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("inputs_pretokenized"))
    pred = pred.join(docs, "doc_id").withColumn(
        "prediction_text", F.get(F.array(*[F.lit(c) for c in CHOICES]), F.col("prediction")))
    rows = pred.select("doc_id", "inputs_pretokenized")
    out = self_reference(rows, pred, key="doc_id", concat_num=1, pool_size=10)
    return out.select("doc_id", F.get(F.col("pool_keys"), 0).alias("pool_doc"))


# ------------------------------------------------------------- perplexity
_PPL_SQL = f"""
WITH p AS (SELECT doc_id, source, lang,
                  exp(-list_avg(list_transform(list_filter(string_split_regex(text, '{WS}'), lambda t: length(t) > 0),
                                               lambda t: -ln(1 + length(t))))) AS ppl
           FROM documents)"""


def _ppl(spark, sf):
    d = read_table(spark, sf, "documents")
    lp = F.transform(whitespace_tokens("text"), lambda t: -F.log(1 + F.length(t)))
    return d.select("doc_id", "source", "lang", array_perplexity(lp).alias("ppl"))


@register("perplexity_rerank", _PPL_SQL + """
SELECT doc_id, source, round(ppl, 6) AS ppl,
       CAST(row_number() OVER (PARTITION BY source ORDER BY round(ppl, 9), doc_id) AS INTEGER) AS rank
FROM p
""")
def perplexity_rerank_q(spark, sf):
    """A4 + L2: perplexity of every prompt, ranked inside its group (source)."""
    from ..operators.perplexity import rerank
    p = _ppl(spark, sf).withColumn("ppl9", F.round("ppl", 9))
    return rerank(p, "source", ppl_col="ppl9", pos_col="doc_id").select(
        "doc_id", "source", F.round("ppl", 6).alias("ppl"), "rank")


@register("template_wins", _PPL_SQL + """
SELECT lang, count(*) AS wins FROM (
  SELECT source, first(lang ORDER BY round(ppl, 9), doc_id) AS lang FROM p GROUP BY source)
GROUP BY lang
""")
def template_wins_q(spark, sf):
    """A10 + R3: first places per template (lang) across groups (source)."""
    p = _ppl(spark, sf).withColumn("ppl9", F.round("ppl", 9))
    return template_wins(p, "source", "lang", ppl_col="ppl9", pos_col="doc_id")


@register("log_softmax", """
SELECT vec_id, round(embedding[label + 1]::DOUBLE - (m + ln(s)), 6) AS logp FROM (
  SELECT vec_id, label, embedding, m,
         list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - m))) AS s
  FROM (SELECT *, list_max(embedding)::DOUBLE AS m FROM embeddings))
""")
def log_softmax_q(spark, sf):
    """log-softmax of each vector taken as logits, picked at its label."""
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(log_softmax_array("embedding", F.col("label")), 6).alias("logp"))


# ---------------------------------------------------------------- metrics
def _docs_pred(spark, sf):
    """Targets from labels, 'predictions' by a fixed rule on the document."""
    x = _labelled(spark, sf)
    return x.select("doc_id", "lang", "n_chars", "quality", "toxic",
                    (F.col("n_chars") >= 1000).cast("int").alias("pred"))


@register("metric_f1", """
SELECT d.lang, CAST(count_if(l.quality = 1 AND d.n_chars >= 1000) AS BIGINT) AS tp,
       CAST(count_if(l.quality <> 1 AND d.n_chars >= 1000) AS BIGINT) AS fp,
       CAST(count_if(l.quality = 1 AND d.n_chars < 1000) AS BIGINT) AS fn,
       round(CASE WHEN count_if(l.quality = 1 AND d.n_chars >= 1000) = 0 THEN 0.0 ELSE
             2.0 * count_if(l.quality = 1 AND d.n_chars >= 1000) /
             (2.0 * count_if(l.quality = 1 AND d.n_chars >= 1000) + count_if(l.quality <> 1 AND d.n_chars >= 1000)
              + count_if(l.quality = 1 AND d.n_chars < 1000)) END, 6) AS f1
FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang
""")
def metric_f1_q(spark, sf):
    """Binary F1 (quality vs a length rule) per template."""
    r = M.f1_binary(_docs_pred(spark, sf), ["lang"], target="quality", prediction="pred")
    return r.select("lang", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


_LANG_GUESS_SQL = ("CASE WHEN regexp_matches(text, '[ßäöü]') THEN 'de' "
                   "WHEN regexp_matches(text, '[ñ¿¡]') THEN 'es' "
                   "WHEN regexp_matches(text, '[éèêç]') THEN 'fr' ELSE 'en' END")


@register("metric_multiclass_f1", f"""
WITH x AS (SELECT source, lang AS target, {_LANG_GUESS_SQL} AS prediction FROM documents),
ev AS (SELECT source, target AS cls, CASE WHEN target = prediction THEN 'tp' ELSE 'fn' END AS kind FROM x
       UNION ALL
       SELECT source, prediction AS cls, CASE WHEN target = prediction THEN NULL ELSE 'fp' END AS kind FROM x),
per AS (SELECT source, cls, count_if(kind = 'tp') AS tp, count_if(kind = 'fp') AS fp, count_if(kind = 'fn') AS fn
        FROM ev GROUP BY source, cls)
SELECT source, round(avg(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2.0 * tp + fp + fn) END), 6) AS mean_f1,
       count(*) AS n_classes
FROM per GROUP BY source
""")
def metric_multiclass_f1_q(spark, sf):
    """E13 (cb-style): mean per-class F1 of a character-rule language guess, per source."""
    d = read_table(spark, sf, "documents")
    guess = (F.when(F.col("text").rlike("[ßäöü]"), "de").when(F.col("text").rlike("[ñ¿¡]"), "es")
             .when(F.col("text").rlike("[éèêç]"), "fr").otherwise("en"))
    x = d.select("source", F.col("lang").alias("target"), guess.alias("prediction"))
    r = M.mean_multiclass_f1(x, ["source"])
    return r.select("source", F.round("mean_f1", 6).alias("mean_f1"), "n_classes")


_RANK_SQL = """
WITH x AS (SELECT d.lang, d.n_chars::DOUBLE AS x, (l.quality + l.toxic)::DOUBLE AS y
           FROM labels l JOIN documents d USING (doc_id)),
r AS (SELECT lang, x, y, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0 AS ry
      FROM x)"""


@register("metric_correlation", _RANK_SQL + """
SELECT lang,
       round(CASE WHEN count(*) < 2 OR stddev_samp(x) = 0 OR stddev_samp(y) = 0 THEN NULL ELSE corr(x, y) END, 6) AS pearson,
       round(CASE WHEN count(*) < 2 OR stddev_samp(rx) = 0 OR stddev_samp(ry) = 0 THEN NULL ELSE corr(rx, ry) END, 6) AS spearman
FROM r GROUP BY lang
""")
def metric_correlation_q(spark, sf):
    """E3 + E4: Pearson and Spearman (average-tie ranks) of length vs labels."""
    x = _labelled(spark, sf).select("lang", F.col("n_chars").cast("double").alias("x"),
                                    (F.col("quality") + F.col("toxic")).cast("double").alias("y"))
    p = M.pearson(x, ["lang"], "x", "y")
    s = M.spearman(x, ["lang"], "x", "y")
    return p.join(s, "lang").select("lang", F.round("pearson", 6).alias("pearson"),
                                    F.round("spearman", 6).alias("spearman"))


@register("metric_auc", """
WITH x AS (SELECT d.lang, d.n_chars::DOUBLE AS s, l.quality AS y FROM labels l JOIN documents d USING (doc_id)),
h AS (SELECT lang, s, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM x GROUP BY lang, s),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY lang ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM h)
SELECT lang, round(CASE WHEN sum(pos) * sum(neg) = 0 THEN NULL ELSE sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg)) END, 6)::DOUBLE AS auc
FROM c GROUP BY lang
""")
def metric_auc_q(spark, sf):
    """ROC AUC of document length for the quality label, per template."""
    x = _labelled(spark, sf).select("lang", F.col("n_chars").cast("double").alias("s"), F.col("quality").alias("y"))
    return M.auc(x, ["lang"], "y", "s").select("lang", F.round("auc", 6).alias("auc"))


@register("metric_sequence_accuracy", """
SELECT d.lang, round(avg(CASE WHEN [l.quality, l.toxic] = [CAST(d.n_chars >= 1000 AS INTEGER), CAST(d.n_chars % 2 AS INTEGER)]
                         THEN 1.0 ELSE 0.0 END), 6) AS sequence_accuracy
FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang
""")
def metric_sequence_accuracy_q(spark, sf):
    """Whole label sequence equal."""
    x = _labelled(spark, sf).select(
        "lang", F.array("quality", "toxic").alias("t"),
        F.array((F.col("n_chars") >= 1000).cast("int"), (F.col("n_chars") % 2).cast("int")).alias("p"))
    r = M.sequence_accuracy(x, ["lang"], "t", "p")
    return r.select("lang", F.round("sequence_accuracy", 6).alias("sequence_accuracy"))


# ---------------------------------------------------- text-pair metrics
def _pairs(spark, sf):
    """(user turn, next assistant turn) pairs of every conversation."""
    c = read_table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant"))
    return (u.join(a, ["conv_id", "turn"])
            .withColumn("pair_id", F.col("conv_id") * 1000 + F.col("turn")))


_PAIRS_SQL = """pairs AS (
  SELECT u.conv_id, u.turn, u.conv_id * 1000 + u.turn AS pair_id, u.text AS "user", a.text AS assistant
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

_SQUAD_TOK = ("list_filter(list_filter(string_split_regex(regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~]', '', 'g'), "
              "'" + WS + "'), lambda t: length(t) > 0), lambda t: t NOT IN ('a', 'an', 'the'))")


@register("metric_squad", f"""
WITH {_PAIRS_SQL},
t AS (SELECT turn, pair_id, {_SQUAD_TOK.format(c='"user"')} AS pt, {_SQUAD_TOK.format(c='assistant')} AS gt FROM pairs),
pc AS (SELECT pair_id, item, count(*) AS a FROM (SELECT pair_id, unnest(pt) AS item FROM t) GROUP BY ALL),
gc AS (SELECT pair_id, item, count(*) AS b FROM (SELECT pair_id, unnest(gt) AS item FROM t) GROUP BY ALL),
cm AS (SELECT pair_id, sum(least(a, b)) AS common FROM pc JOIN gc USING (pair_id, item) GROUP BY pair_id),
s AS (SELECT t.turn, t.pair_id, len(pt) AS np, len(gt) AS ng, coalesce(cm.common, 0) AS common,
             CASE WHEN array_to_string(pt, ' ') = array_to_string(gt, ' ') THEN 1.0 ELSE 0.0 END AS em
      FROM t LEFT JOIN cm USING (pair_id))
SELECT turn, round(avg(em), 6) AS exact_match,
       round(avg(CASE WHEN np = 0 OR ng = 0 THEN CASE WHEN np = ng THEN 1.0 ELSE 0.0 END
                      WHEN common = 0 THEN 0.0
                      ELSE 2.0 * (common / np) * (common / ng) / ((common / np) + (common / ng)) END), 6) AS f1
FROM s GROUP BY turn
""")
def metric_squad_q(spark, sf):
    """SQuAD-normalised exact match and token F1 (user turn vs the reply), per turn."""
    p = _pairs(spark, sf).select("turn", "pair_id", F.array("assistant").alias("answers"),
                                 F.col("user").alias("prediction"))
    r = M.squad(p, ["turn"], "pair_id", "answers", "prediction")
    return r.select("turn", F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"))


def _ngram_sql(toks: str, n: int) -> str:
    return (f"list_transform(range(1, len({toks}) - {n} + 2), "
            f"lambda i: array_to_string({toks}[i:i + {n - 1}], ' '))")


def _bleu_sql() -> str:
    counts = []
    for n in range(1, 5):
        counts.append(f"""m{n} AS (SELECT sum(least(a, b)) AS m FROM
  (SELECT pair_id, g, count(*) AS a FROM (SELECT pair_id, unnest({_ngram_sql('h', n)}) AS g FROM t) GROUP BY ALL) x
  JOIN (SELECT pair_id, g, count(*) AS b FROM (SELECT pair_id, unnest({_ngram_sql('r', n)}) AS g FROM t) GROUP BY ALL) y
  USING (pair_id, g))""")
    tot = ", ".join(f"sum(greatest(len(h) - {n} + 1, 0)) AS t{n}" for n in range(1, 5))
    logs = " + ".join(f"ln(coalesce(m{n}.m, 0) / tt.t{n})" for n in range(1, 5))
    zero = " OR ".join(f"coalesce(m{n}.m, 0) = 0" for n in range(1, 5))
    return f"""
WITH {_PAIRS_SQL},
t AS (SELECT pair_id, list_filter(string_split_regex("user", '{WS}'), lambda s: length(s) > 0) AS h,
             list_filter(string_split_regex(assistant, '{WS}'), lambda s: length(s) > 0) AS r FROM pairs),
{", ".join(counts)},
tt AS (SELECT CAST(sum(len(h)) AS BIGINT) AS hyp_len, CAST(sum(len(r)) AS BIGINT) AS ref_len, {tot} FROM t)
SELECT round(CASE WHEN {zero} THEN 0.0 ELSE
         (CASE WHEN hyp_len >= ref_len THEN 1.0 ELSE exp(1.0 - ref_len / hyp_len) END) * exp(({logs}) / 4) * 100 END, 6) AS bleu,
       hyp_len, ref_len
FROM tt, m1, m2, m3, m4
"""


@register("metric_bleu", _bleu_sql())
def metric_bleu_q(spark, sf):
    """Corpus BLEU of user turns against the replies (whitespace tokens)."""
    p = _pairs(spark, sf)
    r = M.bleu(p, [], "pair_id", target="assistant", prediction="user")
    return r.select(F.round("bleu", 6).alias("bleu"), F.col("hyp_len").cast("long").alias("hyp_len"),
                    F.col("ref_len").cast("long").alias("ref_len"))


_ROUGE_TOK = ("list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), '" + WS + "'), "
              "lambda s: length(s) > 0)")


def _rouge_sql() -> str:
    parts = []
    for n in (1, 2):
        parts.append(f"""c{n} AS (SELECT pair_id, sum(least(a, b)) AS c FROM
  (SELECT pair_id, g, count(*) AS a FROM (SELECT pair_id, unnest({_ngram_sql('h', n)}) AS g FROM t) GROUP BY ALL) x
  JOIN (SELECT pair_id, g, count(*) AS b FROM (SELECT pair_id, unnest({_ngram_sql('r', n)}) AS g FROM t) GROUP BY ALL) y
  USING (pair_id, g) GROUP BY pair_id)""")

    def f(n):
        c = f"coalesce(c{n}.c, 0)"
        nh = f"greatest(len(h) - {n} + 1, 0)"
        nr = f"greatest(len(r) - {n} + 1, 0)"
        return (f"CASE WHEN {c} = 0 THEN 0.0 ELSE 2.0 * ({c} / {nh}) * ({c} / {nr}) / "
                f"(({c} / {nh}) + ({c} / {nr})) END")
    return f"""
WITH {_PAIRS_SQL},
t AS (SELECT turn, pair_id, {_ROUGE_TOK.format(c='"user"')} AS h, {_ROUGE_TOK.format(c='assistant')} AS r FROM pairs),
{", ".join(parts)}
SELECT turn, round(avg({f(1)}), 6) AS rouge1, round(avg({f(2)}), 6) AS rouge2
FROM t LEFT JOIN c1 USING (pair_id) LEFT JOIN c2 USING (pair_id) GROUP BY turn
"""


@register("metric_rouge", _rouge_sql())
def metric_rouge_q(spark, sf):
    """Mean ROUGE-1 / ROUGE-2 F-measure per turn."""
    p = _pairs(spark, sf)
    r = M.rouge_n(p, ["turn"], "pair_id", target="assistant", prediction="user")
    return r.select("turn", F.round("rouge1", 6).alias("rouge1"), F.round("rouge2", 6).alias("rouge2"))


ROUGE_L_SQL = f"""
WITH {_PAIRS_SQL},
t AS (SELECT turn, {_ROUGE_TOK.format(c='"user"')} AS h, {_ROUGE_TOK.format(c='assistant')} AS r FROM pairs),
l AS (SELECT turn, h, r, list_reduce(h, lambda last, x: list_reduce(range(1, len(r) + 1), lambda row, i: list_append(row,
          CASE WHEN r[i] = x THEN last[i] + 1 ELSE greatest(last[i + 1], row[len(row)]) END), [0::BIGINT]),
          list_transform(range(len(r) + 1), lambda i: 0::BIGINT))[len(r) + 1] AS l FROM t)
SELECT turn, round(avg(CASE WHEN l = 0 THEN 0.0 ELSE 2.0 * (l / len(h)) * (l / len(r)) / (l / len(h) + l / len(r)) END), 6) AS "rougeL"
FROM l GROUP BY turn
"""


@register("metric_rouge_l", ROUGE_L_SQL)
def metric_rouge_l_q(spark, sf):
    """Mean ROUGE-L F-measure per turn (longest common subsequences)."""
    r = M.rouge_l(_pairs(spark, sf), ["turn"], target="assistant", prediction="user")
    return r.select("turn", F.round("rougeL", 6).alias("rougeL"))


# levenshtein counts bytes in the oracle's engine: letters beyond ASCII become unused ASCII marks
_ONE_BYTE = "translate({c}, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', '!#$%&()*+-/0123456789')"


@register("metric_edit_distance", f"""
WITH {_PAIRS_SQL},
d AS (SELECT turn, levenshtein({_ONE_BYTE.format(c='assistant')}, {_ONE_BYTE.format(c='"user"')}) AS d FROM pairs)
SELECT turn, round(avg(d), 6) AS mean_edit, CAST(min(d) AS INTEGER) AS min_edit, CAST(max(d) AS INTEGER) AS max_edit,
       round(median(d), 6) AS median_edit
FROM d GROUP BY turn
""")
def metric_edit_distance_q(spark, sf):
    """Levenshtein distance of whole user and reply texts (characters), per turn."""
    r = M.edit_distance(_pairs(spark, sf), ["turn"], target="assistant", prediction="user")
    return r.select("turn", F.round("mean_edit", 6).alias("mean_edit"), "min_edit", "max_edit",
                    F.round("median_edit", 6).alias("median_edit"))
