"""Dataset folders found in storage and read as one table.

``list_folders`` lists the files below the folders that match by Spark's own file index: the
prefixes are part of the path pattern, so the file system returns matching folders only, and
many folders are listed by tasks on the cluster.  No file is opened.  ``read_folders`` reads
many dataset folders in one scan, whose rows carry the folder they come from; before, the
schema of every folder is compared with the one expected.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import discover

FOLDERS = "task string, path string, basename string, n_files bigint, bytes bigint"
MAX_FOLDERS = 100_000          # a union of more datasets than that is not built in one call


def _plain(name: str) -> str:
    """A name as it stands in a path pattern."""
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", name)


def list_folders(spark: SparkSession, root: str, tasks=None, *, depth: int = 2, first: int | None = None,
                 exact: bool = False) -> DataFrame:
    """(task, path, basename, n_files, bytes): the folders ``depth`` levels below ``root`` whose name starts
    with a task of ``tasks`` (all folders, with a null task, when it is None).

    A folder matched by two tasks comes twice.  ``first`` keeps that many of each task, by path.
    ``exact`` asks for the task parsed from the path.  Names may be written ``column=name``, as
    partitioned writes do; the column is no part of the name."""
    root = root.rstrip("/")
    names = "*" if tasks is None else "{" + ",".join(f"{_plain(t)}*,*={_plain(t)}*" for t in sorted(set(tasks))) + "}"
    empty = spark.createDataFrame([], FOLDERS)
    if tasks is not None and not tasks:
        return empty
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .load(root + "/*" * (depth - 1) + "/" + names).select("path", "length"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return empty
        raise
    bare = re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "", root)
    inside = F.regexp_extract("path", re.escape(bare) + "/(" + "[^/]+/" * (depth - 1) + "[^/]+)/", 1)
    folders = files.groupBy(inside.alias("inside")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))
    folders = folders.where("inside <> ''").select(
        F.concat(F.lit(root + "/"), "inside").alias("path"), "n_files", "bytes",
        F.regexp_replace("inside", "(^|/)[^/=]+=", "$1").alias("name"))
    if tasks is None:
        found = folders.withColumn("task", F.lit(None).cast("string")).withColumn("basename", F.element_at(F.split("name", "/"), -1))
    else:
        found = discover(folders, spark.createDataFrame([(t,) for t in sorted(set(tasks))], "task string"), exact=exact, path_col="name")
    if first is not None:
        w = Window.partitionBy("task").orderBy("path")
        found = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= first)
    return found.select("task", "path", "basename", "n_files", "bytes")


def folder_paths(folders: DataFrame) -> list[str]:
    """The distinct paths in order, ``MAX_FOLDERS`` at most."""
    rows = folders.select("path").distinct().limit(MAX_FOLDERS + 1).collect()
    if len(rows) > MAX_FOLDERS:
        raise ValueError(f"more than {MAX_FOLDERS} dataset folders")
    return sorted(r["path"] for r in rows)


def check_schemas(spark: SparkSession, paths: list[str], schema: T.StructType) -> None:
    """Fails, naming each folder at fault, unless every folder has all columns of ``schema`` in
    their types.  One footer is read of each folder."""
    def faults(path: str) -> list[str]:
        have = {f.name: f.dataType for f in spark.read.option("recursiveFileLookup", "true").parquet(_plain(path)).schema}
        return [f"{path}: {f.name} is {have[f.name].simpleString() if f.name in have else 'missing'}, not {f.dataType.simpleString()}"
                for f in schema if have.get(f.name) != f.dataType]

    with ThreadPoolExecutor(16) as pool:
        found = [x for part in pool.map(faults, paths) for x in part]
    if found:
        raise ValueError("datasets break the schema contract: " + "; ".join(found))


def read_folders(spark: SparkSession, paths: list[str], schema: str | T.StructType, *, path_col: str = "path",
                 split_col: str | None = "split") -> DataFrame:
    """One scan over many dataset folders: the columns of ``schema``, the folder, and the split
    that a ``split=...`` folder inside it names (null without one)."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not paths:
        ddl = [*schema.fields, *(T.StructField(c, T.StringType()) for c in (path_col, split_col) if c)]
        return spark.createDataFrame([], T.StructType(ddl))
    check_schemas(spark, paths, schema)
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*map(_plain, paths))
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    out = df.select("*", file.alias("_file"))
    inside = F.regexp_replace("_file", "(/split=[^/]+)?/[^/]+$", "")
    bare = [re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "", p) for p in paths]
    root = bare[0][:max(0, len(_common(bare)))]
    store = paths[0][:len(paths[0]) - len(bare[0])]        # as the caller writes it
    out = out.withColumn(path_col, F.concat(F.lit(store), F.substr(inside, F.greatest(F.instr(inside, F.lit(root)), F.lit(1)))))
    if split_col:
        out = out.withColumn(split_col, F.nullif(F.regexp_extract("_file", "/split=([^/]+)/[^/]+$", 1), F.lit("")))
    return out.drop("_file")


def _common(paths: list[str]) -> str:
    """The first folders that all paths share."""
    parts = [p.split("/")[:-1] for p in paths]
    out = []
    for names in zip(*parts):
        if len(set(names)) > 1:
            break
        out.append(names[0])
    return "/".join(out)
