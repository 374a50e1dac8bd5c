"""Physical-plan properties that keep the registered queries cluster-safe."""

import re

import pytest

from conftest import SF_SMALL
from promptloom.plans.catalog import queries


def plan(spark, name):
    return queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_knn_merge_limits_before_the_shuffle(spark):
    from promptloom.operators.knn import knn_join
    from promptloom.sources.tables import read_table
    v = read_table(spark, SF_SMALL, "embeddings")
    j = knn_join(v, v, 5, query_key="vec_id", corpus_key="vec_id", strategy="broadcast")
    p = j._jdf.queryExecution().executedPlan().toString()
    # a partial WindowGroupLimit sits below the exchange that feeds the final one
    assert re.search(r"Exchange hashpartitioning\(query_id.*\n.*WindowGroupLimit", p), p


def test_a_small_corpus_is_never_shuffled(spark):
    for name in ("knn_topk", "nearest_template"):
        p = plan(spark, name)
        assert "Window" not in p and p.count("Exchange") <= 1, p      # the one spreads a narrow scan


def test_scans_are_pruned(spark):
    p = plan(spark, "knn_topk")
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in p
    p = plan(spark, "label_to_class")
    doc_scans = [line for line in p.splitlines() if "FileScan" in line and "documents.parquet" in line]
    assert doc_scans
    for line in doc_scans:   # only the columns the query uses reach the scan
        cols = re.search(r"FileScan parquet \[([^\]]*)\]", line).group(1).split(",")
        assert "text" not in cols, line
