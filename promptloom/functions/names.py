"""Name handling: dataset paths, template and task names, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: config spellings that mean "no config"
NULL_CONFIGS = ("None", "none", "")
SCORE_EVAL_SUFFIX = "_score_eval"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_config(col) -> Column:
    """P4: 'None', 'none' and '' are the null config."""
    c = _c(col)
    return F.when(c.isin(*NULL_CONFIGS), F.lit(None).cast("string")).otherwise(c)


def task_full_name(dataset, config) -> Column:
    """``ds`` or ``ds_cfg`` (a null config is skipped)."""
    return F.concat_ws("_", _c(dataset), null_config(config))


def output_name(dataset, config, root: str, k: int) -> Column:
    """``ds__cfg__root__k-K`` with ``none`` for a null config."""
    return F.concat_ws("__", _c(dataset), F.coalesce(null_config(config), F.lit("none")),
                       F.lit(root), F.lit(f"k-{k}"))


def _trim_underscores(col: Column) -> Column:
    return F.regexp_replace(col, r"^_+|_+$", "")


def parse_task_path(path, strip_anli_round: bool = True) -> Column:
    """``.../{ds}__{cfg}__.../{task}_{template}[_score_eval]`` -> struct(task, template).

    The task is ``ds`` or ``ds_cfg`` from the directory; the template is the basename without
    ``{task}_`` and ``_score_eval``, wherever they stand in it, trimmed of ``_``; for ``anli`` the
    rounds ``_r1``, ``_r2`` and ``_r3`` go too.  ``audit_key`` has the same rule.
    """
    p = _c(path)
    parts = F.split(p, "/")
    n = F.size(parts)
    basename = F.element_at(parts, -1)
    directory = F.get(parts, n - 2)
    dir_parts = F.split(directory, "__")
    ds = F.get(dir_parts, 0)
    cfg = F.get(dir_parts, 1)
    task = task_full_name(ds, cfg)
    body = F.replace(F.replace(basename, F.concat(task, F.lit("_")), F.lit("")), F.lit(SCORE_EVAL_SUFFIX), F.lit(""))
    template = _trim_underscores(body)
    if strip_anli_round:
        template = F.when(ds == "anli", F.regexp_replace(template, r"_r[123]", "")).otherwise(template)
    return F.struct(task.alias("task"), template.alias("template"))


def _strip_prefix(col: Column, prefix: Column) -> Column:
    """``removeprefix``: drop ``prefix`` when ``col`` starts with it."""
    return F.when(F.startswith(col, prefix),
                  F.substr(col, F.length(prefix) + 1)).otherwise(col)


def template_from_basename(basename, dataset) -> Column:
    """Basename minus the dataset prefix (keeps the leading '_')."""
    return _strip_prefix(_c(basename), _c(dataset))


def normalise_template_name(col) -> Column:
    """'-', ' ', '/' -> '_'; '___' -> '_'; drop ``[^\\w\\d'\\s_]+``; trim '_'."""
    # fixed value: the characters that stay in a template name
    c = F.translate(_c(col), "- /", "___")
    c = F.replace(c, F.lit("___"), F.lit("_"))
    c = F.regexp_replace(c, r"(?U)[^\w\d'\s_]+", "")
    return _trim_underscores(c)


def task_name(dataset, subset, template) -> Column:
    """``ds[_cfg]_template`` with ``[^\\w\\d\\._]+`` -> '_' (Unicode aware)."""
    raw = F.concat(_c(dataset),
                   F.when(_c(subset).isNotNull(), F.concat(F.lit("_"), _c(subset), F.lit("_")))
                   .otherwise(F.lit("_")),
                   _c(template))
    # fixed value: the characters that stay in a task name
    return F.regexp_replace(raw, r"(?U)[^\w\d\._]+", "_")


def file_safe(col, slash: str = "_", space: str = "_") -> Column:
    """file-name forms: '/' and ' ' replaced (use '' to drop)."""
    return F.replace(F.replace(_c(col), F.lit("/"), F.lit(slash)), F.lit(" "), F.lit(space))


def result_name(dataset, config, prompt_mode, retrieve_num, concat_num) -> Column:
    """``results__{ds}__{cfg}__{mode}__ret-N_concat-M`` with '/' -> '_'."""
    name = F.concat_ws("__", F.lit("results"), _c(dataset),
                       F.coalesce(null_config(config), F.lit("none")), _c(prompt_mode),
                       F.concat(F.lit("ret-"), _c(retrieve_num).cast("string"),
                                F.lit("_concat-"), _c(concat_num).cast("string")))
    return F.replace(name, F.lit("/"), F.lit("_"))
