"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if v is None:
        return "None"
    return str(v)


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sorted(sdf.columns)
    s_rows = sorted(tuple(_norm(r[c]) for c in s_cols) for r in sdf.collect())
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(s_rows), spark_s=round(t1 - t0, 2))
    rel = con.execute(sql)
    d_cols_raw = [d[0] for d in rel.description]
    d_types = {d[0]: str(d[1]) for d in rel.description}
    d_data = rel.fetchall()
    t2 = time.time()
    d_cols = sorted(d_cols_raw)
    idx = [d_cols_raw.index(c) for c in d_cols]
    d_rows = sorted(tuple(_norm(r[i]) for i in idx) for r in d_data)
    fam = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
           "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN"}
    type_diff = {}
    for f in sdf.schema.fields:
        st = fam.get(repr(f.dataType), repr(f.dataType))
        dt = d_types.get(f.name, "?")
        if st in fam.values() and st != dt:
            type_diff[f.name] = (st, dt)
    ok = s_cols == d_cols and s_rows == d_rows and not type_diff
    info = dict(name=name, ok=ok, rows=len(s_rows), oracle_rows=len(d_rows),
                spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))
    if type_diff:
        info["types"] = type_diff
    if not ok:
        info["cols"] = (s_cols, d_cols)
        diff_s = [r for r in s_rows if r not in set(d_rows)][:2]
        diff_d = [r for r in d_rows if r not in set(s_rows)][:2]
        info["only_spark"] = [tuple(x[:200] for x in r) for r in diff_s]
        info["only_oracle"] = [tuple(x[:200] for x in r) for r in diff_d]
    return info


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from promptloom.session import get_session
    from promptloom.plans.catalog import REGISTRY, _load_all
    _load_all()
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for name, (fn, sql) in REGISTRY.items():
        if names and name not in names:
            continue
        try:
            info = compare(spark, con, name, fn, sql, sf_dir)
        except Exception as e:  # report and go on
            info = dict(name=name, ok=False, error=repr(e)[:800])
        bad += info.get("ok") is False
        print(info, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
