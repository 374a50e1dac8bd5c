import math


import pytest
from pyspark.sql import functions as F

from promptloom.operators.augment import augment, augment_stats
from promptloom.operators.filters import keep_original, used_templates
from promptloom.operators.mixture import map_splits
from promptloom.operators.perplexity import tail_perplexity, transpose_prompts
from promptloom.operators.rank import compare_accuracy
from promptloom.plans.composite import few_shot_set, knowledge_set, nest_candidates, retrieval_log, \
    template_augmented_set

PROMPTED = "row_id long, dataset_name string, template_name string, split string, idx long, " \
           "inputs_pretokenized string, targets_pretokenized string"


def test_overflow_counter_rules(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], []), ([1, 2], [])],
                               "inputs array<int>, chosen_examples array<int>")
    assert augment_stats(df, 1, 4).first()["n_exceed_max_length"] == 1
    assert augment_stats(df, 1, 4, old_rule=True).first()["n_exceed_max_length"] == 0


def test_map_splits(spark):
    df = spark.createDataFrame([("train", "r1"), ("validation", "r2"), ("test", None)], "s string, r string")
    assert [x[0] for x in df.select(map_splits("s", "r")).collect()] == ["train_r1", "dev_r2", "test"]


def test_tail_perplexity_and_transpose(spark):
    lp = spark.createDataFrame([(1, 0, -5.0), (1, 1, -1.0), (1, 2, -3.0)], "k long, pos int, logp double")
    assert math.isclose(tail_perplexity(lp, ["k"], 2).first()["ppl"], math.exp(2))
    t = spark.createDataFrame([(0, "b", "y"), (0, "a", "x")], "idx int, template string, input string")
    assert [p["template"] for p in transpose_prompts(t, "idx", "template", "input").first()["prompts"]] == ["a", "b"]


def test_used_templates_last_wins(spark):
    paths = spark.createDataFrame([("x/cos_e__v1__p/cos_e_v1_GPT-3 style", 1), ("y/cos_e__v1__p/cos_e_v1_GPT-3 style", 2)],
                                  "path string, ordinal int")
    tpl = spark.createDataFrame([("cos_e_v1", "GPT_3_style", "S")], "task string, template string, template_str string")
    r = used_templates(paths, tpl).collect()
    assert [(x["task_template"], x["template_str"]) for x in r] == [("cos_e_v1_GPT_3_style", "S")]


def test_alias_and_omit_templates(spark):
    df = spark.createDataFrame([("wiki_hop", "wiki_hop_a")], "task string, basename string")
    allow = spark.createDataFrame([("wiki_hop_original", ["wiki_hop_a"])], "task string, original_dataset_name array<string>")
    with pytest.raises(Exception, match="unknown task"):
        keep_original(df, allow).collect()
    assert keep_original(df, allow, aliases={"wiki_hop": "wiki_hop_original"}).count() == 1
    co = spark.createDataFrame([(1, "d", "bad", "train", 1, "x", "y"), (2, "d", "good", "train", 2, "u", "v")], PROMPTED)
    q = spark.createDataFrame([(9, "q", "t", "validation", 0, "q", "")], PROMPTED)
    c = spark.createDataFrame([(9, "0", 0, 1, 1, 0.1), (9, "0", 0, 2, 2, 0.2)],
                              "query_id long, shard string, shard_ord int, rank int, corpus_id long, score double")
    omit = spark.createDataFrame([("d", "bad")], "dataset_name string, template_name string")
    r = augment(q, c, co, 1, omit_templates=omit).first()
    assert [e["template_name"] for e in r["chosen_examples"]] == ["good"]


def test_template_modes(spark):
    rows = spark.createDataFrame([("t", "a", "in")], "task string, template_name string, inputs_pretokenized string")
    tpl = spark.createDataFrame([("t", "a", "A: {{x}}")], "task string, template_name string, template_str string")
    none = template_augmented_set(rows, tpl, mode="none").first()
    assert none["inputs_pretokenized"] == "in" and none["chosen_examples"] is None
    own = template_augmented_set(rows, tpl, mode="own").first()
    assert own["inputs_pretokenized"] == "A: {{x}}\n\nin" and own["chosen_examples"]["template_name"] == "a"
    train = spark.createDataFrame([("t2", "b", "A: {{x}}"), ("t3", "c", "something else entirely")],
                                  "task string, template_name string, template_str string")
    near = template_augmented_set(rows, tpl, mode="nearest", train_templates=train).first()
    assert near["chosen_examples"]["task_full_name"] == "t2"


def test_retrieval_log_and_compare(spark):
    co = spark.createDataFrame([(1, "d", "t", "train", 5, "x", "y")], PROMPTED)
    q = spark.createDataFrame([(9, "q", "t", "validation", 0, "q", "a")], PROMPTED)
    c = spark.createDataFrame([(9, "0", 0, 1, 1, 0.25)],
                              "query_id long, shard string, shard_ord int, rank int, corpus_id long, score double")
    log = retrieval_log(q, nest_candidates(c, co)).first()
    assert log["retrieved_idx"] == [5] and log["retrieval_scores"] == ["0.25"] and log["template_name"] == "t"
    b = spark.createDataFrame([("t", 0.5)], "template_name string, accuracy double")
    a = spark.createDataFrame([("t", 0.75)], "template_name string, accuracy double")
    assert compare_accuracy(b, a, ["template_name"]).first()["delta"] == 0.25


def test_knowledge_and_few_shot_sets(spark):
    import json
    rows = spark.createDataFrame([(1, "ds", "Q?", "yes", json.dumps({"causal": {"k": [{"sent": "because"}]}}))],
                                 "row_id long, dataset_name string, q string, a string, knowledge string")
    tpl = spark.createDataFrame([("ds", "t", "{{q}}|||{{a}}", "yes|||no")],
                                "dataset_name string, template_name string, template_str string, answer_choices string")
    k = knowledge_set(rows, tpl, fields=["q", "a"]).first()
    assert k["inputs_pretokenized"] == "Q?\n[KiC]\nbecause\n[KiC]\n"
    with pytest.raises(Exception, match="not in answer choices"):
        knowledge_set(rows.withColumn("a", F.lit("maybe")), tpl, fields=["q", "a"]).collect()
    assert k["targets"][-1] == 1
    fs = few_shot_set(rows.drop("knowledge"), tpl.drop("answer_choices"), 1, fields=["q", "a"]).first()
    assert fs["labels"][-1] == 1 and len(fs["input_ids"]) == 1
