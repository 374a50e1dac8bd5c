"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full into Spark's ``noop`` sink (nothing is
collected to the driver) ``$BENCH_RUNS`` times (default 2) and the best time
is kept, so one-off JIT and Python-worker start-up do not decide the number;
the headline value is the sum over the headline operators.  Prints ONE JSON
line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ("knn_topk", "knn_multi_shard", "bm25_topk", "augment_k1", "augment_k3_dedup",
            "chosen_corpus", "rank_classify", "accuracy")


def _rows(sf_dir: str, name: str) -> int:
    import pyarrow.parquet as pq
    return pq.ParquetFile(f"{sf_dir}/{name}.parquet").metadata.num_rows


def _rates(sf_dir: str, times: dict) -> dict:
    n_vec = _rows(sf_dir, "embeddings")
    n_doc = _rows(sf_dir, "documents")
    n_q = _rows(sf_dir, "benchmark")
    n_lab = _rows(sf_dir, "labels")
    out = {}
    if times.get("knn_topk"):
        out["knn_join_pairs_per_s"] = round(n_vec * n_vec / times["knn_topk"])
    if times.get("bm25_topk"):
        out["bm25_queries_per_s"] = round(n_q / times["bm25_topk"], 2)
    for q in ("augment_k1", "augment_k3_dedup", "chosen_corpus"):
        if times.get(q):
            out[f"{q}_rows_per_s"] = round(n_doc / times[q], 1)
    if times.get("rank_classify"):
        out["rank_classify_choices_per_s"] = round(2 * n_lab / times["rank_classify"], 1)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    runs = max(1, int(os.environ.get("BENCH_RUNS", "2")))
    from promptloom.session import get_session
    from promptloom.plans.catalog import queries

    scratch = tempfile.mkdtemp(prefix="promptloom-bench-")
    spark = get_session(f"local[{cpus}]", app="promptloom-bench", shuffle_partitions=2 * cpus,
                        extra={"spark.driver.memory": "16g",
                               "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
                               "spark.local.dir": scratch})
    qs = queries()
    names = only or list(qs)
    # warm-up: JVM code paths and Python workers, not timed
    qs["log_softmax"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, errors = {}, {}
    for name in names:
        best = None
        try:
            for _ in range(runs):
                t0 = time.perf_counter()
                qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                best = dt if best is None else min(best, dt)
            times[name] = round(best, 3)
        except Exception as e:  # keep going; report the failure
            errors[name] = repr(e)[:300]
    head = [times[q] for q in HEADLINE if q in times]
    out = {"metric": "headline_seconds", "value": round(sum(head), 3), "unit": "sec",
           "queries": times, "sf": os.path.basename(sf_dir).replace("sf", ""),
           "total_seconds": round(sum(times.values()), 3), "cpus": cpus, "runs": runs,
           "rates": _rates(sf_dir, times)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
