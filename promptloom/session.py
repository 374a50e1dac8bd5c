"""Session helpers: sane defaults for local tests and a checkpoint folder rule.

On a cluster the checkpoint folder is the shared one named by
``spark.checkpoint.dir``; only a local session without that setting gets a
scratch folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "promptloom",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: dict = {}


def ship_package(spark: SparkSession) -> str:
    """Zip this package once per process and ``addPyFile`` it, so executors
    on a cluster import the same code the driver plans with."""
    try:
        sc = spark.sparkContext
    except Exception:   # a session without a classic SparkContext: nothing to ship
        return ""
    key = id(sc)
    if key in _SHIPPED:
        return _SHIPPED[key]
    pkg = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="promptloom-pkg-")) / "promptloom.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(pkg.rglob("*.py")):
            z.write(f, f.relative_to(pkg.parent).as_posix())
    sc.addPyFile(str(out))
    _SHIPPED[key] = str(out)
    return str(out)


def _is_local(spark: SparkSession) -> bool:
    """One JVM (``local[...]``); a ``local-cluster`` has executors of its own."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder; set a scratch one only for local sessions."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: a cluster job needs a shared folder")
    path = tempfile.mkdtemp(prefix="promptloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                      max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when it is proven to hold at most ``max_rows`` rows and,
    written as JSON, ``max_bytes`` bytes.

    The one job reads ``max_rows + 1`` rows at most; beyond either bound the plain
    DataFrame is returned and Spark plans a shuffle join with the same result."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint"))
    n, b = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if n <= max_rows and (b or 0) <= max_bytes else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
