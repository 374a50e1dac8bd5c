"""Lineage, allow / omit lists and small keyed lookups (P1, P5, P6, P11, P14, P17,
J8, J12, A7, A16, S14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast
from .ordered import positions

LINEAGE_GROUP = ("dataset_name", "template_name", "split")


def with_lineage(df: DataFrame, order_col: str, *, dataset_name=None, template_name=None,
                 group_cols=LINEAGE_GROUP, n_ranges: int | None = None) -> DataFrame:
    """Add ``dataset_name``/``template_name`` literals (when given)
    and ``idx``, the 0-based position of a row inside its (dataset, template,
    split) group in ``order_col`` order.

    The numbering does not sort a group inside one task: rows are range
    partitioned on (group, order), numbered inside each range partition by an
    Arrow pass over the sorted partition, and shifted by the sizes of the
    earlier ranges (a table of at most partitions x groups rows).
    """
    out = df
    if dataset_name is not None:
        out = out.withColumn("dataset_name", F.lit(dataset_name))
    if template_name is not None:
        out = out.withColumn("template_name", F.lit(template_name))
    g = [c for c in group_cols if c in out.columns]
    return positions(out, g, [order_col], "idx", n_ranges=n_ranges)


def train_or_all(df: DataFrame, source_col: str = "path", split_col: str = "split") -> DataFrame:
    """Per source, the ``train`` split if it has one, else every row."""
    has_train = (df.groupBy(source_col)
                 .agg(F.max((F.col(split_col) == "train").cast("int")).alias("_t")))
    return (df.join(has_train, source_col)
            .where((F.col("_t") == 0) | (F.col(split_col) == "train")).drop("_t"))


def keep_original(df: DataFrame, allow: DataFrame, *, task_col="task", basename_col="basename",
                  aliases: dict | None = None) -> DataFrame:
    """P5: keep rows whose basename is listed in the task's
    ``original_dataset_name``; a task that the metadata does not list fails, one listed
    without originals keeps nothing.

    ``allow``: (task, original_dataset_name array) -- the task metadata.
    ``aliases`` (P15): task -> metadata key, e.g. wiki_hop -> wiki_hop_original."""
    pairs = allow.select(F.col("task").alias("_meta_task"),
                         F.explode("original_dataset_name").alias("_base"))
    key = F.col(task_col)
    if aliases:
        amap = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))])
        key = F.coalesce(amap[F.col(task_col)], F.col(task_col))
    known = allow.select(F.col("task").alias("_known")).distinct()
    checked = df.join(bounded_broadcast(known), key == F.col("_known"), "left").where(
        F.col("_known").isNotNull() | F.raise_error(F.concat(F.lit("unknown task: "), key)).cast("boolean")).drop("_known")
    cond = (key == F.col("_meta_task")) & (F.col(basename_col) == F.col("_base"))
    return checked.join(bounded_broadcast(pairs), cond, "left_semi")


def drop_omitted(df: DataFrame, omit: DataFrame, *, task_col="task", basename_col="basename") -> DataFrame:
    """Drop rows whose basename *contains* one of the task's ``omit_templates``.

    Equality on the task plus a residual ``contains``: a broadcast hash join."""
    pats = omit.select(F.col("task").alias("_task"), F.explode("omit_templates").alias("_pat"))
    cond = (F.col(task_col) == F.col("_task")) & F.col(basename_col).contains(F.col("_pat"))
    return df.join(bounded_broadcast(pats), cond, "left_anti")


def allowed_templates(df: DataFrame, allow: DataFrame, keys=("dataset", "config", "template")) -> DataFrame:
    """Keep (dataset, config, template) rows on the allow list (null-safe config)."""
    a, b, c = keys
    al = allow.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.col(c).alias("_c"))
    cond = ((df[a] == al["_a"]) & df[b].eqNullSafe(al["_b"]) & (df[c] == al["_c"]))
    return df.join(bounded_broadcast(al), cond, "left_semi")


def unknown_pairs(df: DataFrame, allow: DataFrame, keys=("dataset", "config")) -> DataFrame:
    """P17 check: (dataset, config) pairs without any allowed template (must be empty)."""
    a, b = keys
    al = allow.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    cond = (F.col(a) == F.col("_a")) & F.col(b).eqNullSafe(F.col("_b"))
    return df.select(a, b).distinct().join(bounded_broadcast(al), cond, "left_anti")


def attach_template(df: DataFrame, templates: DataFrame, keys=("task", "template"), *, fail: bool = False):
    """Join to ``template_str``.  With ``fail`` a row without a template fails, as in
    the reference; else returns (joined, missing keys) for callers that report them."""
    keys = list(keys)
    if fail:
        j = df.join(bounded_broadcast(templates.withColumn("_has", F.lit(True))), keys, "left")
        named = F.concat_ws("/", *keys)
        return j.where(F.col("_has").isNotNull() | F.raise_error(
            F.concat(F.lit("no template: "), named)).cast("boolean")).drop("_has")
    joined = df.join(bounded_broadcast(templates), keys)
    missing = df.select(*keys).distinct().join(templates.select(*keys), keys, "left_anti")
    return joined, missing


def last_per_key(df: DataFrame, key_cols, value_col: str, ordinal_col: str) -> DataFrame:
    """The last value per key (dict fill order) by ``max_by``."""
    return df.groupBy(*key_cols).agg(F.max_by(value_col, ordinal_col).alias(value_col))


def split_sizes(df: DataFrame, cols=("dataset_name", "subset", "split")) -> DataFrame:
    """Examples per (dataset, subset, split)."""
    present = [c for c in cols if c in df.columns]
    return df.groupBy(*present).agg(F.count(F.lit(1)).alias("num_examples"))


def check_targets(df: DataFrame, *, target_col="targets_pretokenized",
                  choices_col="answer_choices", mode: str = "flag") -> DataFrame:
    """Target among the answer choices; ``fail`` raises inside the task,
    ``drop`` removes, ``flag`` adds ``target_in_choices``."""
    ok = F.array_contains(F.col(choices_col), F.col(target_col))
    if mode == "drop":
        return df.where(ok)
    if mode == "fail":
        # a filter predicate is always evaluated (a dropped column would be pruned)
        return df.where(F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("target not in answer choices: "), F.col(target_col)))))
    return df.withColumn("target_in_choices", ok)


def audit_key(task, dataset):
    """The template named by an audit row: the dataset name without its config and
    dataset prefixes and the score suffix (``ARC-*`` configs are spelled with ``_`` there)."""
    parts = F.split(task, "/")
    name, config = F.get(parts, 0), F.get(parts, 1)
    config = F.regexp_replace(config, "^ARC-(Challenge|Easy)$", "ARC_$1")
    body = F.when(config.isNotNull(), F.replace(dataset, F.concat(config, F.lit("_")), F.lit(""))).otherwise(dataset)
    body = F.replace(F.replace(body, F.concat(name, F.lit("_")), F.lit("")), F.lit("_score_eval"), F.lit(""))
    body = F.regexp_replace(body, "^_+|_+$", "")
    return F.when(task == "anli", F.regexp_replace(body, "_r[123]", "")).otherwise(body)


def audit_templates(tsv: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task, dataset) rows -> original flag; unmatched keys reported.

    ``flags``: (task, template, original_task), template names normalised (F10).
    Returns (report, missing)."""
    j = tsv.withColumn("template", audit_key(F.col("task"), F.col("dataset")))
    j = j.join(bounded_broadcast(flags.select("task", "template", "original_task")), ["task", "template"], "left")
    report = j.select("task", "dataset", "template", F.coalesce("original_task", F.lit(False)).alias("original"))
    missing = j.where(F.col("original_task").isNull()).select("task", "template")
    return report, missing


def used_templates(paths: DataFrame, templates: DataFrame, *, path_col: str = "path",
                   ordinal_col: str = "ordinal", fail: bool = True) -> DataFrame:
    """Training mixture paths -> (task, template) keys (P2) -> template string
    (J8), keyed by ``task_template``; the later path wins (A7).

    ``templates``: task, template (normalised, F10), template_str.  A path without a template
    fails; with ``fail=False`` it comes with a null ``template_str``."""
    from ..functions.names import normalise_template_name, parse_task_path
    keys = paths.select(ordinal_col, parse_task_path(F.col(path_col)).alias("k")).select(
        ordinal_col, F.col("k.task").alias("task"), normalise_template_name(F.col("k.template")).alias("template"))
    j = attach_template(keys, templates, fail=True) if fail else keys.join(bounded_broadcast(templates), ["task", "template"], "left")
    j = j.withColumn("task_template", F.concat_ws("_", "task", "template"))
    return j.groupBy("task_template").agg(F.max_by(F.struct("task", "template", "template_str"),
                                                     F.col(ordinal_col)).alias("v")).select("task_template", "v.*")


def slice_rows(df: DataFrame, start: int, stop: int, idx_col: str = "idx") -> DataFrame:
    """Positional slice ``[start, stop)`` on the lineage position (a pushed-down filter)."""
    return df.where((F.col(idx_col) >= start) & (F.col(idx_col) < stop))
