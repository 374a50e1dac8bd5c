import json

import pytest

from promptloom.functions.templates import append_knowledge, apply_templates


def test_apply_templates_rules(spark):
    rows = spark.createDataFrame([("ds", 1, "Q1", "A1"), ("ds", 2, "Q2", "")],
                                 "dataset_name string, id int, question string, answer string")
    tpl = spark.createDataFrame([
        ("ds", "plain", "{{ question }}|||{{answer}}", "yes|||no"),
        ("ds", "bad", "{{question}}|||{{answer}}|||x", None),
        ("other", "never", "{{question}}|||x", None),
    ], "dataset_name string, template_name string, template_str string, answer_choices string")
    out = {(r["id"], r["template_name"]): r for r in
           apply_templates(rows, tpl, fields=["question", "answer"], keep=("id",)).collect()}
    assert set(out) == {(1, "plain"), (2, "plain")}
    assert out[(1, "plain")]["inputs_pretokenized"] == "Q1"
    assert out[(1, "plain")]["targets_pretokenized"] == "A1"
    assert out[(2, "plain")]["targets_pretokenized"] == "<NO LABEL>"
    assert out[(1, "plain")]["answer_choices"] == ["yes", "no"]


def test_empty_render_dropped(spark):
    rows = spark.createDataFrame([("ds", "")], "dataset_name string, q string")
    tpl = spark.createDataFrame([("ds", "t", "{{q}}")], "dataset_name string, template_name string, template_str string")
    assert apply_templates(rows, tpl, fields=["q"]).count() == 0


def test_knowledge_block(spark):
    know = {
        "lexicon": {"gloss": {"empty": [], "w": [{"glosses": ["g1", "g2", "g3", "g4", "g5", "g6"]}]}},
        "causal": {"c": [{"sent": f"s{i}"} for i in range(5)]},
        "skipped": {"k": [{"sentence_key": json.dumps(["nope"])}]},
        "conceptnet": {"k": [{"sentence_key": json.dumps(["first.", "second."])}], "e": []},
    }
    df = spark.createDataFrame([("IN", json.dumps(know))], "i string, k string")
    got = df.select(append_knowledge("i", "k", ["lexicon", "causal", "conceptnet"]).alias("x")).first()["x"]
    expect = ("IN\n[KiC]\n" + "\n".join(["g1\ng2\ng3\ng4\ng5", "s0", "s1", "s2", "s3", "s4", "first."])
              + "\n[KiC]\n")
    assert got == expect


def test_marks_in_fields_are_text_and_types_are_rendered(spark):
    rows = spark.createDataFrame([("ds", None, "a ||| b {{label}}", 1, True), ("ds", "c", "x", 0, False)],
                                 "dataset string, config string, q string, label int, flag boolean")
    tpl = spark.createDataFrame([("ds", None, "t", "{{ q }} {{label}} {{flag}}|||{{answer_choices[label]}}", "no ||| yes {{q}}"),
                                 ("ds", "c", "t", "{{q}}|||{{ answer_choices[label] }}", "no|||yes")],
                                "dataset string, config string, template_name string, template_str string, answer_choices string")
    got = {r.config: r for r in apply_templates(rows, tpl, on=("dataset", "config")).collect()}
    assert got[None].inputs_pretokenized == "a ||| b {{label}} 1 true"
    assert got[None].targets_pretokenized == "yes a ||| b {{label}}"
    assert got[None].answer_choices == ["no", "yes a ||| b {{label}}"]
    assert got["c"].targets_pretokenized == "no"


def test_unknown_placeholder_fails(spark):
    rows = spark.createDataFrame([("ds", "x")], "dataset_name string, q string")
    tpl = spark.createDataFrame([("ds", "t", "{{nope}}|||{{q}}")], "dataset_name string, template_name string, template_str string")
    with pytest.raises(Exception, match="unknown placeholder"):
        apply_templates(rows, tpl).collect()


def test_both_joins_of_the_template_table_agree(spark, monkeypatch):
    from promptloom.functions import templates as M
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), (None, "3")], "dataset_name string, q string")
    tpl = spark.createDataFrame([(d, f"t{i}", "Q {{q}}|||T") for d in ("a", "b", None) for i in range(3)],
                                "dataset_name string, template_name string, template_str string")
    small = sorted(map(str, apply_templates(rows, tpl).collect()))
    monkeypatch.setattr(M, "bounded_broadcast", lambda df: df)
    large = apply_templates(rows, tpl)
    assert "BroadcastNestedLoop" not in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, large.collect())) == small and len(small) == 9


def test_broadcast_bound_counts_bytes(spark):
    from promptloom.session import bounded_broadcast
    df = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "i int, t string")
    hinted = [("broadcast" in bounded_broadcast(df, **b)._jdf.queryExecution().logical().toString().lower())
              for b in ({}, {"max_rows": 49}, {"max_bytes": 40_000})]
    assert hinted == [True, False, False]
