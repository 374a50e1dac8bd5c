"""Readers and writers.

Prompted datasets live in one Parquet table partitioned by
``dataset_name / template_name / split`` (or a ``shard`` column for corpora),
so the reference's directory-per-(task, template) layout becomes partition
pruning, and a manifest DataFrame of paths replaces globbing in a loop.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import null_config, parse_task_path, result_name as result_name_col
from ..session import bounded_broadcast
from .commit import require_committed, write_committed

REGISTRY_SCHEMA = ("HF_name string, subset string, task_by_convention string, "
                   "do_train string, do_eval string, train_size string")


SPLIT_BY_CONFIG = ("anli",)     # fixed value: its config names a split


def read_task(spark: SparkSession, root: str, dataset: str, config: str | None = None,
              split: str | None = None, *, prefer: str | None = None,
              split_by_config=SPLIT_BY_CONFIG) -> DataFrame:
    """One named dataset from the partitioned prompted table (pruned).

    A dataset of ``split_by_config`` takes its config as the split name.  ``prefer``
    (such as ``validation``): that split if the dataset has it, else all of them."""
    df = spark.read.parquet(root).where(F.col("dataset_name") == dataset)
    if dataset in split_by_config and config is not None:
        config, split = None, config
    if "dataset_config_name" in df.columns:
        df = df.where(null_config("dataset_config_name").eqNullSafe(F.lit(config)))
    if split is not None:
        df = df.where(F.col("split") == split)
    elif prefer is not None and not df.where(F.col("split") == prefer).isEmpty():
        df = df.where(F.col("split") == prefer)
    return df


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The task registry CSV (CRLF ok); '' subset -> null, '' train_size -> 0."""
    raw = spark.read.schema(REGISTRY_SCHEMA).option("header", True).csv(path)
    return raw.select(
        "HF_name", F.nullif(F.col("subset"), F.lit("")).alias("subset"),
        "task_by_convention",
        F.coalesce(F.col("do_train"), F.lit("")).alias("do_train"),
        F.coalesce(F.col("do_eval"), F.lit("")).alias("do_eval"),
        F.coalesce(F.nullif(F.col("train_size"), F.lit("")).cast("long"), F.lit(0)).alias("train_size"))


def read_audit_tsv(spark: SparkSession, path: str) -> DataFrame:
    """TSV whose header starts with ``category``; column 1 = task, 2 = dataset."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    if not raw.columns or raw.columns[0] != "category":
        raise ValueError("audit TSV header must start with 'category'")
    return raw.select(F.col(raw.columns[1]).alias("task"), F.col(raw.columns[2]).alias("dataset"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S3: JSON lines (give a schema in production: no inference pass)."""
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.json(path)


def read_json_object(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One multi-line JSON object (config, task metadata, results)."""
    r = spark.read.option("multiLine", True)
    if schema:
        r = r.schema(schema)
    return r.json(path)


def task_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``{task: {original_dataset_name: [...], omit_templates: [...]}}`` ->
    rows (task, original_dataset_name, omit_templates).

    A file holds one object over any number of lines, or, as Spark writes them, an object in
    every line."""
    raw = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", r"\n"), lambda x: F.length(F.trim(x)) > 0)
    each = F.forall(lines, lambda x: F.startswith(x, F.lit("{")) & F.endswith(F.rtrim(x), F.lit("}")))
    raw = raw.select(F.explode(F.when(each, lines).otherwise(F.array("value"))).alias("value"))
    m = F.from_json("value", "map<string,struct<original_dataset_name:array<string>,"
                             "omit_templates:array<string>>>")
    return raw.select(F.explode(m).alias("task", "meta")).select(
        "task", "meta.original_dataset_name", "meta.omit_templates")


def discover(manifest: DataFrame, prefixes: DataFrame, *, exact: bool = False,
             path_col: str = "path") -> DataFrame:
    """Manifest rows whose basename starts with a task prefix (``{task}*``);
    a path matched by two prefixes comes twice, as the glob loop did.
    ``exact`` instead requires the task parsed from the path (P2) to equal
    ``task``, so ``cos_e`` no longer picks up ``cos_e_v1.11`` directories.

    ``manifest``: one row per dataset directory; ``prefixes``: column ``task``.
    """
    base = F.element_at(F.split(F.col(path_col), "/"), -1)
    named = manifest.withColumn("basename", base)
    if exact:
        named = named.withColumn("task", parse_task_path(F.col(path_col))["task"])
    else:   # every prefix of a basename is a candidate: an equi-join, not a comparison of all pairs
        ends = F.when(F.length(base) > 0, F.sequence(F.lit(1), F.length(base)))
        named = named.withColumn("task", F.explode_outer(F.transform(ends, lambda n: F.substring(base, F.lit(1), n))))
    return named.join(bounded_broadcast(prefixes.select("task").distinct()), "task")


def write_once(df_fn, spark: SparkSession, path: str, *, fmt: str = "parquet",
               partition_by=(), **options) -> bool:
    """Skip the work when the output is there and whole.  ``df_fn`` builds the plan only
    when needed; an interrupted write is done again.  Returns True when it wrote."""
    def fill(folder: str) -> None:
        w = df_fn().write.format(fmt).options(**options)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(folder)

    return write_committed(spark, path, fill)


def save_shard(df: DataFrame, root: str, shard: str, *, key_name: str,
               dataset_paths: list[str] | None = None, extra: dict | None = None) -> str:
    """Write vectors + rows as a named shard and its config (a JSON row), both or neither."""
    path = f"{root.rstrip('/')}/{shard}"
    spark = df.sparkSession
    conf = {"key_name": key_name, "dataset_paths": dataset_paths or [], **(extra or {})}

    def fill(folder: str) -> None:
        df.write.parquet(f"{folder}/data")
        spark.createDataFrame([(json.dumps(conf),)], "config string").coalesce(1).write.text(f"{folder}/config")

    write_committed(spark, path, fill, replace=True)
    return path


def load_shard(spark: SparkSession, root: str, shard: str) -> tuple[DataFrame, dict]:
    """A shard by name; one whose write was not finished fails."""
    path = require_committed(spark, f"{root.rstrip('/')}/{shard}")
    conf = json.loads(spark.read.text(f"{path}/config").first()[0])
    return spark.read.parquet(f"{path}/data").withColumn("shard", F.lit(shard)), conf


def load_shards(spark: SparkSession, root: str, shards: list[str]) -> DataFrame:
    """Several named shards as one DataFrame with a ``shard`` column."""
    out = None
    for s in shards:
        df, _ = load_shard(spark, root, s)
        out = df if out is None else out.unionByName(df)
    return out


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines; each row carries its file name."""
    named = results.withColumn("result_name", result_name_col(
        "dataset_name", "dataset_config_name", "prompt_mode", "retrieve_num", "concat_num"))
    named.write.mode("overwrite").partitionBy("result_name").json(path)


def write_report(results: DataFrame, path: str, *, scores_only: bool = False) -> None:
    """TSV ``template<TAB>accuracy`` (or the scores alone), sorted by template.

    One row per template: the range sort's parts keep the order."""
    cols = ["accuracy"] if scores_only else ["template_name", "accuracy"]
    results.orderBy("template_name").select(*cols).write.mode("overwrite").option("sep", "\t").csv(path)


def write_epochs(results: DataFrame, path: str) -> None:
    """Per-epoch results as CSV with a header, in epoch order."""
    results.orderBy("epoch").write.mode("overwrite").option("header", True).csv(path)
