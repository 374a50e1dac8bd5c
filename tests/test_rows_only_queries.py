"""Queries without a SQL oracle, checked against brute force at sf0.001."""

import numpy as np
import pyarrow.parquet as pq

from conftest import SF_SMALL
from promptloom.plans.catalog import queries


def table(name):
    return pq.read_table(f"{SF_SMALL}/{name}.parquet").to_pylist()


def pairs():
    conv = table("conversations")
    by = {(r["conv_id"], r["turn"]): r for r in conv}
    out = []
    for (c, t), r in by.items():
        nxt = by.get((c, t + 1))
        if r["role"] == "user" and nxt is not None and nxt["role"] == "assistant":
            out.append((t, r["text"], nxt["text"]))
    return out


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_edit_distance_query(spark):
    per = {}
    for t, u, a in pairs():
        per.setdefault(t, []).append(lev(u, a))
    got = {r["turn"]: r for r in queries()["metric_edit_distance"](spark, SF_SMALL).collect()}
    assert set(got) == set(per)
    for t, ds in per.items():
        assert abs(got[t]["mean_edit"] - round(sum(ds) / len(ds), 6)) < 1e-6
        assert got[t]["min_edit"] == min(ds) and got[t]["max_edit"] == max(ds)
        assert abs(got[t]["median_edit"] - float(np.median(ds))) < 1e-6
