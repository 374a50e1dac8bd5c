import math

from pyspark.sql import functions as F

from promptloom.operators.mixture import task_caps
from promptloom.operators.perplexity import array_perplexity, perplexity, template_wins
from promptloom.operators.rank import choice_scores, log_softmax_array, log_softmax_long, rank_classify
from promptloom.operators.filters import last_per_key


def test_masked_position_ignored_and_tie(spark):
    lp = spark.createDataFrame([
        (1, 0, 0, -1.0, 1), (1, 0, 1, -100.0, 0),     # choice 0: -1 (padding ignored)
        (1, 1, 0, -0.5, 1), (1, 1, 1, -0.5, 1),       # choice 1: -1 -> tie, lowest index wins
        (2, 0, 0, -3.0, 1), (2, 1, 0, -2.0, 1),
    ], "ex long, choice_idx int, pos int, logp double, mask int")
    s = choice_scores(lp, ["ex"])
    pred = {r["ex"]: r["prediction"] for r in rank_classify(s, ["ex"]).collect()}
    assert pred == {1: 0, 2: 1}


def test_perplexity(spark):
    lp = spark.createDataFrame([(1, -1.0), (1, -3.0)], "k long, logp double")
    assert math.isclose(perplexity(lp, ["k"]).first()["ppl"], math.exp(2))
    arr = spark.range(1).select(array_perplexity(F.array(F.lit(-1.0), F.lit(-3.0))).alias("p"))
    assert math.isclose(arr.first()["p"], math.exp(2))


def test_template_wins(spark):
    df = spark.createDataFrame([(0, "a", 2.0, 0), (0, "b", 1.0, 1), (1, "a", 1.0, 0), (1, "b", 1.0, 1)],
                               "idx int, template string, ppl double, pos int")
    w = {r["template"]: r["wins"] for r in template_wins(df, "idx", "template", pos_col="pos").collect()}
    assert w == {"a": 1, "b": 1}


def test_log_softmax_forms(spark):
    logits = [0.5, -1.0, 2.0]
    lse = math.log(sum(math.exp(x) for x in logits))
    v = spark.range(1).select(log_softmax_array(F.array(*[F.lit(x) for x in logits]), F.lit(2)).alias("x"))
    assert math.isclose(v.first()["x"], 2.0 - lse)
    long = spark.createDataFrame([(1, i, x) for i, x in enumerate(logits)], "k long, token int, logit double")
    got = {r["token"]: r["logp"] for r in log_softmax_long(long, ["k"]).collect()}
    assert math.isclose(got[0], 0.5 - lse)


def test_caps_golden(spark):
    reg = spark.createDataFrame([("big", None, 3_600_000), ("small", None, 400), ("none", None, None)],
                                "HF_name string, subset string, train_size long")
    tpl = spark.createDataFrame([("big", None, f"t{i}") for i in range(9)] +
                                [("small", None, f"t{i}") for i in range(5)] + [("none", None, "t")],
                                "dataset string, subset string, template_name string")
    caps = {r["dataset"]: r["cap"] for r in task_caps(reg, tpl).collect()}
    assert caps == {"big": 55555, "small": 400, "none": 0}


def test_last_wins(spark):
    df = spark.createDataFrame([("k", "first", 1), ("k", "later", 2)], "key string, v string, o int")
    assert last_per_key(df, ["key"], "v", "o").first()["v"] == "later"
