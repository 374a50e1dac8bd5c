"""Task lists, caps and mixtures.

Inputs are DataFrames:

* ``registry``: ``HF_name, subset, task_by_convention, do_train, do_eval,
  train_size`` (``sources.io.read_registry``);
* ``templates``: ``dataset, subset, template_name, original_task,
  has_choices, template_ord`` -- one row per prompt template.

Everything is joins, aggregates and unions; the mixture names, black lists
and the 500,000 example cap are parameters; the cap's default is the
reference's value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import task_name as task_name_col
from ..session import bounded_broadcast
from .ordered import positions

# fixed value: the per-dataset example cap; mixture names are parameters (defaults below)
MAX_EXAMPLES_PER_DATASET = 500_000
MIXTURE_NAMES = (
    "train", "train_plus", "train_plus_plus", "eval_score_eval", "train_score_eval",
    "train_one_original_prompt", "train_all_original_prompts", "bias_fairness_eval_score_eval",
)
# fixed values: registry stage labels, ANLI rounds and the rank-classification suffix
TRAIN_STAGES = ("BASE", "GPT_EVAL", "SGLUE")
EVAL_STAGES = ("BASE", "BIAS_FAIRNESS")
ANLI_ROUNDS = ("r1", "r2", "r3")
SCORE_EVAL = "_score_eval"


def _key_join(left: DataFrame, right: DataFrame, how="inner") -> DataFrame:
    """Join on (dataset, subset) with a null-safe subset."""
    cond = (left["dataset"] == right["_ds"]) & left["subset"].eqNullSafe(right["_sub"])
    return left.join(right, cond, how).drop("_ds", "_sub")


def check_registry(registry: DataFrame) -> DataFrame:
    """M5: rows breaking the registry rules (must be empty)."""
    bad_train = (F.col("do_train") == "SGLUE") & (F.col("HF_name") != "super_glue")
    bad_eval = (F.col("do_eval") == "BIAS_FAIRNESS") & (F.col("task_by_convention") != "bias_and_fairness")
    return registry.where(bad_train | bad_eval).withColumn(
        "violation", F.when(bad_train, F.lit("SGLUE outside super_glue"))
        .otherwise(F.lit("BIAS_FAIRNESS outside bias_and_fairness")))


def task_caps(registry: DataFrame, templates: DataFrame,
              max_examples: int = MAX_EXAMPLES_PER_DATASET) -> DataFrame:
    """Per (dataset, subset): n_templates, train_size ('' -> 0) and cap
    (``max // n_templates`` above the maximum, else the whole train_size)."""
    n = templates.groupBy("dataset", "subset").agg(F.count(F.lit(1)).alias("n_templates"))
    if {"do_train", "do_eval"} <= set(registry.columns):     # a bare size table has no stages
        registry = registry.where(F.nullif(F.col("do_train"), F.lit("")).isNotNull() |
                                  F.nullif(F.col("do_eval"), F.lit("")).isNotNull())
    reg = registry.select(F.col("HF_name").alias("_ds"), F.col("subset").alias("_sub"),
                          F.coalesce(F.col("train_size").cast("long"), F.lit(0)).alias("train_size"))
    j = _key_join(n, reg)      # datasets outside the registry, or of neither stage, drop out (J11)
    cap = F.when(F.col("train_size") > max_examples,
                 F.floor(F.lit(max_examples) / F.col("n_templates"))).otherwise(F.col("train_size"))
    return j.withColumn("cap", cap.cast("long"))


def task_lists(registry: DataFrame, templates: DataFrame,
               max_examples: int = MAX_EXAMPLES_PER_DATASET) -> DataFrame:
    """M2: one row per task with its lineage, stages, cap and flags.

    Columns: task_name, dataset, subset, template_name, original_task,
    has_choices, do_train, do_eval, cap, first_original, split_suffix.
    ANLI gets three rounds (``_r1``..``_r3``, evaluation only, splits mapped).
    """
    reg = registry.select(F.col("HF_name").alias("_ds"), F.col("subset").alias("_sub"),
                          F.nullif(F.col("do_train"), F.lit("")).alias("do_train"),
                          F.nullif(F.col("do_eval"), F.lit("")).alias("do_eval"))
    non_anli = templates.where(F.col("dataset") != "anli")
    # datasets outside the registry, or of neither stage in it, drop out
    t = _key_join(non_anli, reg.where(F.col("do_train").isNotNull() | F.col("do_eval").isNotNull()))
    caps = task_caps(registry, templates, max_examples).select(
        F.col("dataset").alias("_ds"), F.col("subset").alias("_sub"), "cap")
    t = _key_join(t, caps, "left")
    t = t.withColumn("task_name", task_name_col("dataset", "subset", "template_name"))
    first = (t.where("original_task")
             .groupBy("dataset", "subset")
             .agg(F.min_by("task_name", "template_ord").alias("_first"))
             .select(F.col("dataset").alias("_ds"), F.col("subset").alias("_sub"), "_first"))
    t = _key_join(t, first, "left").withColumn(
        "first_original", F.coalesce(F.col("_first") == F.col("task_name"), F.lit(False))).drop("_first")
    t = t.withColumn("split_suffix", F.lit(None).cast("string"))
    anli = (templates.where(F.col("dataset") == "anli")
            .withColumn("split_suffix", F.explode(F.array(*[F.lit(r) for r in ANLI_ROUNDS])))
            .withColumn("task_name", F.concat(task_name_col("dataset", "subset", "template_name"),
                                              F.lit("_"), F.col("split_suffix")))
            .withColumn("do_train", F.lit(None).cast("string"))
            .withColumn("do_eval", F.when(F.col("original_task"), F.lit("BASE")))
            .withColumn("cap", F.lit(None).cast("long"))
            .withColumn("first_original", F.lit(False)))
    cols = ["task_name", "dataset", "subset", "template_name", "original_task", "has_choices",
            "do_train", "do_eval", "cap", "first_original", "split_suffix"]
    return t.select(*cols).unionByName(anli.select(*cols))


def map_splits(split_col, round_col) -> F.Column:
    """Logical split -> physical (``train_r1``, ``dev_r1``, ``test_r1``)."""
    s = F.col(split_col) if isinstance(split_col, str) else split_col
    r = F.col(round_col) if isinstance(round_col, str) else round_col
    phys = F.when(s == "validation", F.lit("dev")).otherwise(s)
    return F.when(r.isNull(), s).otherwise(F.concat(phys, F.lit("_"), r))


def exclude_tasks(tasks: DataFrame, exact=(), substrings=(), col: str = "task_name") -> DataFrame:
    """Drop tasks named exactly in ``exact`` or containing any ``substrings``."""
    out = tasks
    if exact:
        out = out.where(~F.col(col).isin(*exact))
    for s in substrings:
        out = out.where(~F.col(col).contains(s))
    return out


def mixtures(tasks: DataFrame, *, blacklist=(), score_eval_blacklist=(), skip_eval=(),
             num_examples: DataFrame | None = None,
             max_examples: int = MAX_EXAMPLES_PER_DATASET, names=MIXTURE_NAMES) -> DataFrame:
    """``mixture, task_name, rate`` for the eight mixtures.

    One pass over the task list: every task row lists the mixtures it joins
    (an array of structs) and is exploded -- no union of eight filtered plans.
    Training mixtures weigh a task by its cap; ``*_score_eval`` mixtures use
    ``min(num_examples, max_examples)`` of the rank-classification twin
    (``num_examples``: task_name, num_examples; without it the cap stands in, and
    ``max_examples`` where a task has no cap).  ``blacklist`` holds for all mixtures
    but the bias and fairness one, which stays whole.
    """
    n_train, n_plus, n_pp, n_eval_se, n_train_se, n_one, n_all, n_bias = names
    live = tasks.withColumn("se_name", F.concat("task_name", F.lit(SCORE_EVAL)))
    listed = F.col("task_name").isin(*blacklist) if blacklist else F.lit(False)
    if num_examples is not None:
        ex = num_examples.select(F.col("task_name").alias("se_name"), "num_examples")
        live = live.join(ex, "se_name", "left")
    else:
        live = live.withColumn("num_examples", F.coalesce("cap", F.lit(max_examples)))
    cap_rate = F.col("cap").cast("double")
    se_rate = F.least(F.coalesce(F.col("num_examples"), F.lit(0)), F.lit(max_examples)).cast("double")
    tr, ev, orig = F.col("do_train"), F.col("do_eval"), F.coalesce(F.col("original_task"), F.lit(False))
    choices = F.coalesce(F.col("has_choices"), F.lit(False))
    train_se_ok = choices & (tr == "BASE") & orig
    if score_eval_blacklist:
        train_se_ok = train_se_ok & ~F.col("se_name").isin(*score_eval_blacklist)
    for sub in skip_eval:
        train_se_ok = train_se_ok & ~F.col("se_name").contains(sub)

    def member(cond, name, task, rate, whole=False):
        return F.when(cond if whole else cond & ~listed, F.struct(F.lit(name).alias("mixture"), task.alias("task_name"), rate.alias("rate")))

    tn, se = F.col("task_name"), F.col("se_name")
    entries = F.array(
        member(tr == "BASE", n_train, tn, cap_rate),
        member(tr.isin("BASE", "GPT_EVAL"), n_plus, tn, cap_rate),
        member(tr.isin(*TRAIN_STAGES), n_pp, tn, cap_rate),
        member((tr == "BASE") & F.coalesce(F.col("first_original"), F.lit(False)), n_one, tn, cap_rate),
        member((tr == "BASE") & orig, n_all, tn, cap_rate),
        member(choices & (ev == "BASE") & orig, n_eval_se, se, se_rate),
        member(train_se_ok, n_train_se, se, se_rate),
        member(choices & (ev == "BIAS_FAIRNESS"), n_bias, se, se_rate, whole=True),
    )
    return (live.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("m"))
            .select("m.mixture", "m.task_name", "m.rate"))


def mixing_rates(mix: DataFrame) -> DataFrame:
    """M4: normalised drawing proportion per mixture (``rate / sum(rate)``)."""
    tot = mix.groupBy("mixture").agg(F.sum("rate").alias("_tot"))
    return mix.join(tot, "mixture").withColumn(
        "share", F.when(F.col("_tot") > 0, F.col("rate") / F.col("_tot")).otherwise(F.lit(0.0))).drop("_tot")


def hash_order(seed, key) -> F.Column:
    """Deterministic stand-in for seeded random order: ``md5(seed|key)``."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def mix_sample(examples: DataFrame, caps: DataFrame, *, task_col: str = "task_name",
               key_col: str = "idx", cap_col: str = "cap", seed: int = 42) -> DataFrame:
    """At most ``cap`` examples per task, drawn in md5(seed|key) order.

    Only task and key are ranked, by a running count over ranges of (task, hash): a
    task holding a third of all examples spreads over many ranges however large
    its cap.  Other columns, if there are any, join the drawn keys last.
    """
    slim = examples.select(task_col, key_col).withColumn("_h", hash_order(seed, F.col(key_col)))
    j = slim.join(bounded_broadcast(caps.select(task_col, cap_col)), task_col).where(F.col(cap_col) > 0)
    drawn = positions(j, [task_col], ["_h", key_col], "_r").where(F.col("_r") < F.col(cap_col))
    rest = [c for c in examples.columns if c not in (task_col, key_col)]
    if not rest:
        return drawn.select(task_col, key_col, cap_col)
    keys = drawn.groupBy(task_col, key_col).agg(F.max(cap_col).alias(cap_col))
    return examples.join(keys, [task_col, key_col])


def sample_n(df: DataFrame, n: int, *, key_col: str, seed: int = 42) -> DataFrame:
    """N rows without replacement in md5(seed|key) order (a top-n)."""
    return df.orderBy(hash_order(seed, F.col(key_col)), F.col(key_col)).limit(n)


def quotas(mix: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """M4: how many of ``n`` draws each task of a mixture gets: ``n * rate / sum(rate)`` rounded down,
    and one more for the largest remainders (ties by name) until they add up to ``n``.

    ``sizes``: task_name, size.  Tasks without rate or examples get none, as nothing can be
    drawn from them; a mixture of such tasks only has no rows.  One row per task."""
    live = mix.join(sizes.select("task_name", "size"), "task_name").where((F.col("rate") > 0) & (F.col("size") > 0))
    total = live.groupBy("mixture").agg(F.sum("rate").alias("_total"))
    exact = live.join(total, "mixture").withColumn("_x", F.lit(float(n)) * F.col("rate") / F.col("_total"))
    exact = exact.withColumn("_base", F.floor("_x").cast("long"))
    left = exact.groupBy("mixture").agg((F.lit(n) - F.sum("_base")).alias("_left"))
    w = Window.partitionBy("mixture").orderBy(F.desc(F.col("_x") - F.col("_base")), "task_name")     # a task a row
    return (exact.join(left, "mixture").withColumn("_r", F.row_number().over(w))
            .withColumn("quota", F.col("_base") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0))
            .where(F.col("quota") > 0).select("mixture", "task_name", "rate", "size", "quota"))


def draw(examples: DataFrame, mix: DataFrame, n: int, *, task_col: str = "task_name", key_col: str = "idx",
         seed: int = 42) -> DataFrame:
    """M4: exactly ``n`` examples per mixture, drawn in proportion to its rates and interleaved.

    A task whose quota exceeds its examples is passed several times: every epoch goes through all of
    them, the last one as far as the quota reaches, each from another place of the
    seeded hash order.  Draw number t of a task with quota q is placed at (t + 1/2) / q of the
    whole, so that every stretch of the result holds the tasks in proportion; equal places
    go by a hash.  Gives mixture, place (0 to n - 1), task, epoch and key; join the texts by key.

    Examples are numbered by ranges of (task, hash), so a task that holds a third of them is many
    tasks' work; a mixture is numbered in the same way."""
    slim = examples.select(F.col(task_col).alias("task_name"), F.col(key_col).alias("key"))
    sizes = slim.groupBy("task_name").agg(F.count(F.lit(1)).alias("size"))
    q = quotas(mix, sizes, n)
    wanted = slim.join(bounded_broadcast(q.select("task_name").distinct()), "task_name", "left_semi")
    ranked = positions(wanted.withColumn("_h", hash_order(seed, F.col("key"))), ["task_name"], ["_h", "key"], "_pos")
    drawn = ranked.join(bounded_broadcast(q.select("mixture", "task_name", "size", "quota")), "task_name")
    last = F.floor((F.col("quota") - 1) / F.col("size"))
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    # an epoch starts at a place of its own and goes round
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "task_name", "epoch")), 1, 8), 16, 10).cast("long")
    drawn = drawn.withColumn("t", F.col("epoch") * F.col("size") + F.pmod(F.col("_pos") + start, F.col("size"))).where("t < quota")
    at = (F.col("t") + 0.5) / F.col("quota")
    tie = F.md5(F.concat_ws("|", F.lit(seed), "mixture", "task_name", "t"))
    placed = drawn.select("mixture", "task_name", "epoch", "key", at.alias("_at"), tie.alias("_tie"))
    placed = positions(placed, ["mixture"], ["_at", "_tie"], "place")
    return placed.select("mixture", "place", "task_name", "epoch", "key")
