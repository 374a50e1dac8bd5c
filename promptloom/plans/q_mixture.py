"""Mixture and bookkeeping queries.

A task registry and a template table are derived from ``documents`` with
Spark (one registry row per source, one template per (source, lang)):

* do_train by source number mod 4: BASE, GPT_EVAL, SGLUE, none;
* do_eval by source number mod 5: 0 -> BASE, 3 -> BIAS_FAIRNESS;
* task_by_convention 'bias_and_fairness' for source number mod 7 = 6;
* src19 is called anli (three evaluation rounds); every third source has a subset;
* train_size = number of documents of the source;
* original templates: en, fr; templates with answer choices: all but de.

The example cap is a parameter: 40 examples per dataset here (the reference
uses 500,000 on its own data), so both branches of the cap rule are live.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import task_name
from ..operators.filters import last_per_key, split_sizes
from ..operators.mixture import (check_registry, mix_sample, mixing_rates, mixtures,
                                 sample_n, task_caps, task_lists)
from ..sources.tables import read_table
from .catalog import register

MAX_EXAMPLES = 40
BLACKLIST = ("src1_en", "src13_fr")      # src13 is in the bias and fairness mixture
SKIP_EVAL = ("src8",)

_SRC_NUM = "CAST(substr(source, 4) AS INTEGER)"
_DATASET = "CASE source WHEN 'src19' THEN 'anli' ELSE source END"
_SUBSET = f"CASE WHEN {_SRC_NUM} % 3 = 0 THEN 'v' || {_SRC_NUM} % 2 END"
_REG_SQL = f"""reg AS (
  SELECT {_DATASET} AS HF_name, {_SUBSET} AS subset,
         CASE WHEN {_SRC_NUM} % 7 = 6 THEN 'bias_and_fairness' ELSE 'qa' END AS task_by_convention,
         CASE {_SRC_NUM} % 4 WHEN 0 THEN 'BASE' WHEN 1 THEN 'GPT_EVAL' WHEN 2 THEN 'SGLUE' ELSE '' END AS do_train,
         CASE {_SRC_NUM} % 5 WHEN 0 THEN 'BASE' WHEN 3 THEN 'BIAS_FAIRNESS' ELSE '' END AS do_eval,
         count(*) AS train_size
  FROM documents GROUP BY source),
tpl AS (
  SELECT DISTINCT {_DATASET} AS dataset, {_SUBSET} AS subset, lang AS template_name,
         lang IN ('en', 'fr') AS original_task, lang <> 'de' AS has_choices,
         CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS template_ord
  FROM documents),
nt AS (SELECT dataset, subset, count(*) AS n_templates FROM tpl GROUP BY dataset, subset),
caps AS (SELECT nt.dataset, nt.n_templates, reg.train_size,
                CAST(CASE WHEN reg.train_size > {MAX_EXAMPLES} THEN floor({MAX_EXAMPLES} / nt.n_templates)
                          ELSE reg.train_size END AS BIGINT) AS cap
         FROM nt JOIN reg ON reg.HF_name = nt.dataset AND reg.subset IS NOT DISTINCT FROM nt.subset
         WHERE reg.do_train <> '' OR reg.do_eval <> ''),
tasks AS (
  SELECT tpl.*, nullif(r.do_train, '') AS do_train, nullif(r.do_eval, '') AS do_eval, c.cap,
         tpl.dataset || coalesce('_' || tpl.subset, '') || '_' || tpl.template_name AS task_name,
         tpl.template_ord = min(CASE WHEN tpl.original_task THEN tpl.template_ord END)
             OVER (PARTITION BY tpl.dataset) AS first_original
  FROM tpl JOIN reg r ON r.HF_name = tpl.dataset JOIN caps c ON c.dataset = tpl.dataset WHERE tpl.dataset <> 'anli'
  UNION ALL
  SELECT tpl.*, NULL, CASE WHEN original_task THEN 'BASE' END, NULL,
         'anli_' || template_name || '_' || r.round, false
  FROM tpl CROSS JOIN (VALUES ('r1'), ('r2'), ('r3')) r(round) WHERE dataset = 'anli')"""


def _num():
    return F.substring("source", 4, 10).cast("int")


def _dataset():
    return F.when(F.col("source") == "src19", "anli").otherwise(F.col("source"))


def _subset():
    return F.when(_num() % 3 == 0, F.concat(F.lit("v"), (_num() % 2).cast("string")))


def _registry(spark, sf):
    d = read_table(spark, sf, "documents")
    n = _num()
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("train_size")).select(
        _dataset().alias("HF_name"), _subset().alias("subset"),
        F.when(_num() % 7 == 6, "bias_and_fairness").otherwise("qa").alias("task_by_convention"),
        F.coalesce(F.element_at(F.create_map(F.lit(0), F.lit("BASE"), F.lit(1), F.lit("GPT_EVAL"),
                                             F.lit(2), F.lit("SGLUE")), n % 4), F.lit("")).alias("do_train"),
        F.when(n % 5 == 0, "BASE").when(n % 5 == 3, "BIAS_FAIRNESS").otherwise("").alias("do_eval"),
        "train_size")


def _templates(spark, sf):
    d = read_table(spark, sf, "documents").select("source", "lang").distinct()
    return d.select(_dataset().alias("dataset"), _subset().alias("subset"),
                    F.col("lang").alias("template_name"),
                    F.col("lang").isin("en", "fr").alias("original_task"),
                    (F.col("lang") != "de").alias("has_choices"),
                    F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1)
                    .when(F.col("lang") == "es", 2).otherwise(3).alias("template_ord"))


@register("check_registry", f"""
WITH {_REG_SQL}
SELECT HF_name, CASE WHEN do_train = 'SGLUE' AND HF_name <> 'super_glue' THEN 'SGLUE outside super_glue'
                     ELSE 'BIAS_FAIRNESS outside bias_and_fairness' END AS violation
FROM reg WHERE (do_train = 'SGLUE' AND HF_name <> 'super_glue')
            OR (do_eval = 'BIAS_FAIRNESS' AND task_by_convention <> 'bias_and_fairness')
""")
def check_registry_q(spark, sf):
    """M5: registry rows that break the stage rules."""
    return check_registry(_registry(spark, sf)).select("HF_name", "violation")


@register("task_caps", f"""
WITH {_REG_SQL}
SELECT dataset, n_templates, train_size, cap FROM caps
""")
def task_caps_q(spark, sf):
    """Per-dataset template count, size and per-template cap."""
    return task_caps(_registry(spark, sf), _templates(spark, sf), MAX_EXAMPLES).select(
        "dataset", "n_templates", "train_size", "cap")


@register("task_lists", f"""
WITH {_REG_SQL}
SELECT task_name, do_train, do_eval, cap, coalesce(first_original, false) AS first_original
FROM tasks
""")
def task_lists_q(spark, sf):
    """One row per task with stages, cap and the first-original flag."""
    t = task_lists(_registry(spark, sf), _templates(spark, sf), MAX_EXAMPLES)
    return t.select("task_name", "do_train", "do_eval", "cap", "first_original")


def _mixture_sql() -> str:
    bl = ", ".join(f"'{b}'" for b in BLACKLIST)
    skip = " AND ".join(f"NOT contains(task_name || '_score_eval', '{s}')" for s in SKIP_EVAL)
    return f"""
WITH {_REG_SQL},
live AS (SELECT * FROM tasks WHERE task_name NOT IN ({bl})),
ne AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
all_se AS (SELECT *, task_name || '_score_eval' AS se_name,
                  CAST(least(coalesce(ne.n, 0), {MAX_EXAMPLES}) AS DOUBLE) AS se_rate
           FROM tasks LEFT JOIN ne ON ne.lang = tasks.template_name WHERE has_choices),
se AS (SELECT * FROM all_se WHERE task_name NOT IN ({bl})),
mix AS (
  SELECT 'train' AS mixture, task_name, cap::DOUBLE AS rate FROM live WHERE do_train = 'BASE'
  UNION ALL SELECT 'train_plus', task_name, cap::DOUBLE FROM live WHERE do_train IN ('BASE', 'GPT_EVAL')
  UNION ALL SELECT 'train_plus_plus', task_name, cap::DOUBLE FROM live WHERE do_train IN ('BASE', 'GPT_EVAL', 'SGLUE')
  UNION ALL SELECT 'train_one_original_prompt', task_name, cap::DOUBLE FROM live WHERE do_train = 'BASE' AND first_original
  UNION ALL SELECT 'train_all_original_prompts', task_name, cap::DOUBLE FROM live WHERE do_train = 'BASE' AND original_task
  UNION ALL SELECT 'eval_score_eval', se_name, se_rate FROM se WHERE do_eval = 'BASE' AND original_task
  UNION ALL SELECT 'train_score_eval', se_name, se_rate FROM se
            WHERE do_train = 'BASE' AND original_task AND {skip}
  UNION ALL SELECT 'bias_fairness_eval_score_eval', se_name, se_rate FROM all_se WHERE do_eval = 'BIAS_FAIRNESS'),
tot AS (SELECT mixture, sum(rate) AS t FROM mix GROUP BY mixture)
SELECT mixture, task_name, rate, round(CASE WHEN t > 0 THEN rate / t ELSE 0.0 END, 6) AS share
FROM mix JOIN tot USING (mixture)
"""


@register("mixture_rates", _mixture_sql())
def mixture_rates_q(spark, sf):
    """M3 + M4 + P7 + P8 + U2: the eight mixtures with their rates and shares."""
    t = task_lists(_registry(spark, sf), _templates(spark, sf), MAX_EXAMPLES)
    sizes = read_table(spark, sf, "documents").groupBy(F.col("lang").alias("template_name")).agg(
        F.count(F.lit(1)).alias("num_examples"))
    ex = t.join(sizes, "template_name").select(F.concat("task_name", F.lit("_score_eval")).alias("task_name"), "num_examples")
    m = mixtures(t, blacklist=BLACKLIST, skip_eval=SKIP_EVAL, num_examples=ex, max_examples=MAX_EXAMPLES)
    return mixing_rates(m).select("mixture", "task_name", "rate", F.round("share", 6).alias("share"))


@register("mix_sample", f"""
WITH {_REG_SQL},
ex AS (SELECT d.doc_id, d.source || '_' || d.lang AS task_name, c.cap
       FROM documents d JOIN caps c ON c.dataset = d.source)
SELECT doc_id, task_name FROM ex
QUALIFY row_number() OVER (PARTITION BY task_name ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) <= cap
""")
def mix_sample_q(spark, sf):
    """At most ``cap`` examples per task in md5(seed|key) order."""
    caps = task_caps(_registry(spark, sf), _templates(spark, sf), MAX_EXAMPLES)
    d = read_table(spark, sf, "documents")
    ex = d.select("doc_id", "source", task_name("source", F.lit(None).cast("string"), "lang").alias("task_name"))
    tc = ex.select("task_name", "source").distinct().join(
        caps.select(F.col("dataset").alias("source"), "cap"), "source").drop("source")
    return mix_sample(ex.drop("source"), tc, key_col="doc_id").select("doc_id", "task_name")


@register("sample_n", """
SELECT doc_id FROM documents ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100
""")
def sample_n_q(spark, sf):
    """100 documents without replacement, seeded hash order (a sample)."""
    return sample_n(read_table(spark, sf, "documents").select("doc_id"), 100, key_col="doc_id")


@register("split_sizes", """
SELECT source AS dataset_name, lang AS template_name, 'train' AS split, count(*) AS num_examples
FROM documents GROUP BY source, lang
""")
def split_sizes_q(spark, sf):
    """Examples per (dataset, template, split)."""
    d = read_table(spark, sf, "documents").select(
        F.col("source").alias("dataset_name"), F.col("lang").alias("template_name"),
        F.lit("train").alias("split"))
    return split_sizes(d, ("dataset_name", "template_name", "split"))


@register("last_per_key", """
SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id
""")
def last_per_key_q(spark, sf):
    """The last value per key (the later row wins)."""
    e = read_table(spark, sf, "events")
    return last_per_key(e, ["user_id"], "event_type", "event_id")
