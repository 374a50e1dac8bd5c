"""Rank classification over a long-form log-prob table.

The language model is an *input*: a table ``choice_logp`` with one row per
(example, choice, position) and the token's log-prob and mask.  Everything
below is aggregates with map-side partial steps, so a hot example or
template is reduced inside each task before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_ws


def expand_choices(df: DataFrame, choices_col: str = "answer_choices",
                   target_col: str = "targets_pretokenized") -> DataFrame:
    """one row per answer choice with ``choice_idx``, ``choice``,
    ``is_correct`` (choice equals the stripped target) and weight 1.0."""
    return (df.select("*", F.posexplode(choices_col).alias("choice_idx", "choice"))
            .withColumn("choice_idx", F.col("choice_idx").cast("int"))
            .withColumn("is_correct", F.col("choice") == strip_ws(target_col))
            .withColumn("weight", F.lit(1.0)))


def choice_scores(logp: DataFrame, keys, *, choice_col: str = "choice_idx",
                  logp_col: str = "logp", mask_col: str | None = "mask") -> DataFrame:
    """A2: sequence log-prob of a choice = sum of mask * log p (no length norm)."""
    keys = list(keys)
    term = F.col(logp_col) if mask_col is None else \
        F.when(F.col(mask_col) != 0, F.col(logp_col) * F.col(mask_col)).otherwise(F.lit(0.0))
    return logp.groupBy(*keys, choice_col).agg(F.sum(term).alias("score"))


def rank_classify(scores: DataFrame, keys, *, choice_col: str = "choice_idx") -> DataFrame:
    """A3: the best-scored choice per example; equal scores -> lowest index."""
    keys = list(keys)
    best = F.max_by(F.col(choice_col), F.struct(F.col("score"), -F.col(choice_col)))
    return scores.groupBy(*keys).agg(best.cast("int").alias("prediction"),
                                     F.max("score").alias("best_score"),
                                     F.min("score").alias("worst_score"))


def second_scores(scores: DataFrame, predictions: DataFrame, keys, *, choice_col: str = "choice_idx") -> DataFrame:
    """predictions plus ``second_score``, the best score among the other choices (null where
    there is none): a maximum over what the first pass left, merged like the first."""
    keys = list(keys)
    left = scores.join(predictions.select(*keys, "prediction"), keys).where(F.col(choice_col) != F.col("prediction"))
    return predictions.join(left.groupBy(*keys).agg(F.max("score").alias("second_score")), keys, "left")


def accuracy(df: DataFrame, group_cols, *, prediction: str = "prediction",
             target: str = "target_idx") -> DataFrame:
    """Mean of (prediction == target) per group."""
    hit = (F.col(prediction) == F.col(target)).cast("double")
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def evaluate(choice_logp: DataFrame, targets: DataFrame, *,
             example_keys=("dataset_name", "dataset_config_name", "template_name",
                           "prompt_mode", "example_id"),
             group_cols=("dataset_name", "dataset_config_name", "template_name",
                         "prompt_mode")) -> DataFrame:
    """Log-probs -> choice scores -> argmax -> accuracy per template
    (and prompt mode: several modes are evaluated in one plan).

    ``targets`` carries ``example_keys`` + ``target_idx``.
    """
    s = choice_scores(choice_logp, example_keys)
    pred = rank_classify(s, example_keys)
    joined = pred.join(targets, list(example_keys))
    return accuracy(joined, group_cols)


def summarise_results(accuracies: DataFrame, group_cols, percentiles=(0.5,)) -> DataFrame:
    """Over the templates of a group: their number, mean, least, largest accuracy and
    percentiles (exact, one value per template)."""
    a = F.col("accuracy")
    return accuracies.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_templates"), F.avg(a).alias("mean_accuracy"), F.min(a).alias("min_accuracy"),
        F.max(a).alias("max_accuracy"), *[F.percentile(a, p).alias(f"p{round(100 * p)}_accuracy") for p in percentiles])


def compare_accuracy(before: DataFrame, after: DataFrame, group_cols) -> DataFrame:
    """Accuracy before and after self-reference side by side."""
    g = list(group_cols)
    b = before.select(*g, F.col("accuracy").alias("accuracy_before"))
    a = after.select(*g, F.col("accuracy").alias("accuracy_after"))
    return b.join(a, g, "full").withColumn("delta", F.col("accuracy_after") - F.col("accuracy_before"))


def log_softmax_array(logits, index) -> Column:
    """F23 on an array of logits: ``logit[index] - logsumexp(logits)`` (0-based index)."""
    a = F.col(logits) if isinstance(logits, str) else logits
    m = F.array_max(a)
    lse = m + F.log(F.aggregate(a, F.lit(0.0).cast("double"),
                                lambda acc, x: acc + F.exp(x.cast("double") - m)))
    idx = F.col(index) if isinstance(index, str) else index
    return F.get(a, idx).cast("double") - lse


def log_softmax_long(logits: DataFrame, keys, *, token_col: str = "token",
                     logit_col: str = "logit") -> DataFrame:
    """F23 on long-form logits (one row per vocabulary entry): adds ``logp``.

    The normaliser is a grouped aggregate joined back, not an unbounded window.
    """
    keys = list(keys)
    m = logits.groupBy(*keys).agg(F.max(logit_col).alias("_m"))
    z = (logits.join(m, keys)
         .groupBy(*keys).agg(F.first("_m").alias("_m"),
                             F.sum(F.exp(F.col(logit_col) - F.col("_m"))).alias("_s")))
    return (logits.join(z, keys)
            .withColumn("logp", F.col(logit_col) - (F.col("_m") + F.log("_s")))
            .drop("_m", "_s"))


def confidence(predictions: DataFrame, order: str = "ratio") -> DataFrame:
    """Best / worst sequence log-prob (``ratio``) or best minus
    second best (``margin``, over ``second_scores``; one choice only: null, the least confident)."""
    if order == "ratio":
        return predictions.withColumn("confidence", F.try_divide(F.col("best_score"), F.col("worst_score")))
    return predictions.withColumn("confidence", F.col("best_score") - F.col("second_score"))


def hashed_pick(key, j, n) -> Column:
    """Deterministic stand-in for ``random.choices``: md5-hashed index in [0, n)."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), j.cast("string"))), 1, 8),
               16, 10).cast("long")
    return F.pmod(h, n)


def self_reference(rows: DataFrame, predictions: DataFrame, *, key: str, concat_num: int = 1,
                   pool_size: int = 10, input_col: str = "inputs_pretokenized",
                   choice_col: str = "prediction_text") -> DataFrame:
    """The ``pool_size`` most confident predictions form a pool; every row
    draws ``concat_num`` of them (with replacement, hashed) and is prefixed by
    ``input + predicted choice``, right-stripped, plus a blank line (F5).
    ``pool_keys`` lists the drawn pool members."""
    ranked = (predictions.select(key, "confidence", input_col, choice_col)
              .orderBy(F.desc("confidence"), F.asc(key)).limit(pool_size))
    pool = ranked.select(F.col(key).alias("pool_key"),
                         F.concat(F.col(input_col), F.col(choice_col)).alias("pool_demo"),
                         F.col("confidence").alias("pool_conf"))
    # the pool is at most pool_size rows (a top-k), so it is broadcast
    n_pool = F.lit(min(pool_size, pool.count()) or 1)
    picks = rows.select(key, F.explode(F.sequence(F.lit(0), F.lit(concat_num - 1))).alias("j"))
    ordered = pool.withColumn("slot", F.row_number().over(
        Window.orderBy(F.desc("pool_conf"), F.asc("pool_key"))) - 1)
    picks = picks.withColumn("slot", hashed_pick(F.col(key), F.col("j"), n_pool))
    demos = (picks.join(F.broadcast(ordered), "slot")
             .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("j", "pool_demo", "pool_key"))).alias("_d")))
    prefix = F.aggregate(F.transform("_d", lambda x: x["pool_demo"]), F.lit(""),
                         lambda acc, d: F.concat(F.rtrim(F.concat(acc, d), F.lit("\n")),
                                                 F.lit("\n\n")))
    return (rows.join(demos, key, "left")
            .withColumn(input_col, F.concat(F.coalesce(prefix, F.lit("")), F.col(input_col)))
            .withColumn("pool_keys", F.transform("_d", lambda x: x["pool_key"]))
            .drop("_d"))
