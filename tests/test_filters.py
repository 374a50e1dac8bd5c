import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from promptloom.operators.filters import (allowed_templates, attach_template, check_targets, drop_omitted,
                                          keep_original, train_or_all, unknown_pairs, with_lineage)
from promptloom.sources.io import discover


def test_omit_and_allow(spark):
    df = spark.createDataFrame([("t", "t_keep"), ("t", "t_omit_me"), ("u", "u_x")], "task string, basename string")
    omit = spark.createDataFrame([("t", ["omit"])], "task string, omit_templates array<string>")
    assert {r["basename"] for r in drop_omitted(df, omit).collect()} == {"t_keep", "u_x"}
    allow = spark.createDataFrame([("t", ["t_keep"])], "task string, original_dataset_name array<string>")
    with pytest.raises(Exception, match="unknown task: u"):        # the metadata must list every task
        keep_original(df, allow).collect()
    none = spark.createDataFrame([("t", ["t_keep"]), ("u", [])], allow.schema)
    assert {r["basename"] for r in keep_original(df, none).collect()} == {"t_keep"}


def test_with_lineage_matches_window(spark):
    rows = [(i, f"d{i % 3}", "t", "train" if i % 5 else "validation") for i in range(500)]
    df = spark.createDataFrame(rows, "key long, dataset_name string, template_name string, split string")
    got = {r["key"]: r["idx"] for r in with_lineage(df.repartition(7), "key", n_ranges=5).collect()}
    w = Window.partitionBy("dataset_name", "template_name", "split").orderBy("key")
    exp = {r["key"]: r["idx"] for r in df.withColumn("idx", F.row_number().over(w) - 1).collect()}
    assert got == exp


def test_train_or_all(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test")], "path string, split string")
    assert sorted(tuple(r) for r in train_or_all(df).select("path", "split").collect()) == \
        [("a", "train"), ("b", "test")]


def test_allow_list_and_template_lookup(spark):
    df = spark.createDataFrame([("glue", None, "t1"), ("glue", None, "t2"), ("x", "c", "t1")],
                               "dataset string, config string, template string")
    allow = spark.createDataFrame([("glue", None, "t1")], "dataset string, config string, template string")
    assert allowed_templates(df, allow).count() == 1
    assert [tuple(r) for r in unknown_pairs(df, allow).collect()] == [("x", "c")]
    tdf = spark.createDataFrame([("glue", "t1", "S")], "task string, template string, template_str string")
    rows = spark.createDataFrame([("glue", "t1"), ("glue", "zz")], "task string, template string")
    joined, missing = attach_template(rows, tdf)
    assert joined.count() == 1 and [tuple(r) for r in missing.collect()] == [("glue", "zz")]


def test_check_targets_modes(spark):
    df = spark.createDataFrame([("a", ["a", "b"]), ("z", ["a", "b"])],
                               "targets_pretokenized string, answer_choices array<string>")
    assert check_targets(df, mode="drop").count() == 1
    assert [r["target_in_choices"] for r in check_targets(df).orderBy("targets_pretokenized").collect()] == [True, False]
    import pytest
    with pytest.raises(Exception):
        check_targets(df, mode="fail").collect()


def test_discover_prefix_overmatch(spark):
    man = spark.createDataFrame([("/r/cos_e__v1__p/cos_e_v1_rationale",), ("/r/cos_e__none__p/cos_e_explain",),
                                 ("/r/other__none__p/other_x",)], "path string")
    pre = spark.createDataFrame([("cos_e_v1",), ("cos_e",)], "task string")
    assert discover(man, pre).count() == 3          # prefixes overlap: a row comes twice
    got = sorted((r["task"], r["basename"]) for r in discover(man, pre, exact=True).collect())
    assert got == [("cos_e", "cos_e_explain"), ("cos_e_v1", "cos_e_v1_rationale")]


def test_running_sum_multi_batch_and_null_groups(spark):
    from promptloom.operators.ordered import running_sum
    rows = [(i, None if i % 4 == 0 else f"g{i % 3}", float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, g string, w double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["k"]: (r["s"], r["c"]) for r in
               running_sum(df.repartition(5), ["g"], ["k"], {"s": "w", "c": None}, n_ranges=6).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    exp = {}
    for g in {r[1] for r in rows}:
        acc, cnt = 0.0, 0
        for k, gg, w in sorted(r for r in rows if r[1] == g):
            exp[k] = (acc, float(cnt))
            acc, cnt = acc + w, cnt + 1
    assert got == exp
