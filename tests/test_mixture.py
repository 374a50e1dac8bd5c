from promptloom.operators.mixture import check_registry, mix_sample, mixing_rates, mixtures, task_lists
from promptloom.sources.io import read_registry

CSV = ("HF_name,subset,task_by_convention,do_train,do_eval,train_size\r\n"
       "super_glue,rte,nli,SGLUE,,2490\r\n"
       "big,,qa,BASE,,900000\r\n"
       "gpt,,qa,GPT_EVAL,,100\r\n"
       "ev,,qa,,BASE,\r\n"
       "bias,,bias_and_fairness,,BIAS_FAIRNESS,\r\n"
       "wrong,,qa,SGLUE,,5\r\n"
       "idle,,qa,,,50\r\n"
       "anli,,nli,,BASE,\r\n")


def fixtures(spark, tmp_path):
    p = tmp_path / "datasets.csv"
    p.write_bytes(CSV.encode())
    reg = read_registry(spark, str(p))
    tpl = spark.createDataFrame([
        ("super_glue", "rte", "x", True, True, 0), ("big", None, "a", False, True, 0),
        ("big", None, "b", True, True, 1), ("big", None, "c", True, False, 2),
        ("gpt", None, "g", True, True, 0), ("ev", None, "e1", True, True, 0), ("ev", None, "e2", False, True, 1),
        ("bias", None, "bf", False, True, 0), ("anli", None, "can we infer", True, True, 0),
        ("unregistered", None, "u", True, True, 0), ("idle", None, "i", True, True, 0),
    ], "dataset string, subset string, template_name string, original_task boolean, has_choices boolean, template_ord int")
    return reg, tpl


def test_registry_and_lists(spark, tmp_path):
    reg, tpl = fixtures(spark, tmp_path)
    assert [r["HF_name"] for r in check_registry(reg).collect()] == ["wrong"]
    t = {r["task_name"]: r for r in task_lists(reg, tpl).collect()}
    assert "unregistered_u" not in t and "idle_i" not in t      # not registered, or of neither stage
    assert t["big_a"]["cap"] == 500000 // 3 and t["gpt_g"]["cap"] == 100 and t["ev_e1"]["cap"] == 0
    assert t["big_b"]["first_original"] and not t["big_c"]["first_original"]
    assert {"anli_can_we_infer_r1", "anli_can_we_infer_r2", "anli_can_we_infer_r3"} <= set(t)
    assert t["super_glue_rte_x"]["do_train"] == "SGLUE"


def test_mixtures(spark, tmp_path):
    reg, tpl = fixtures(spark, tmp_path)
    m = mixtures(task_lists(reg, tpl), blacklist=("big_c", "bias_bf"))
    by = {}
    for r in m.collect():
        by.setdefault(r["mixture"], set()).add(r["task_name"])
    assert by["train"] == {"big_a", "big_b"}
    assert by["train_plus"] == {"big_a", "big_b", "gpt_g"}
    assert by["train_plus_plus"] == {"big_a", "big_b", "gpt_g", "super_glue_rte_x"}
    assert by["train_one_original_prompt"] == {"big_b"}
    assert by["eval_score_eval"] == {"ev_e1_score_eval", "anli_can_we_infer_r1_score_eval",
                                        "anli_can_we_infer_r2_score_eval", "anli_can_we_infer_r3_score_eval"}
    assert by["bias_fairness_eval_score_eval"] == {"bias_bf_score_eval"}
    shares = mixing_rates(m).where("mixture = 'train'").collect()
    rate = {r["task_name"]: r["rate"] for r in m.where("mixture = 'eval_score_eval'").collect()}
    assert rate["anli_can_we_infer_r1_score_eval"] == 500_000      # no cap and no count: the maximum
    ex = spark.createDataFrame([("anli_can_we_infer_r1_score_eval", 7)], "task_name string, num_examples long")
    sized = mixtures(task_lists(reg, tpl), num_examples=ex).where("mixture = 'eval_score_eval'").collect()
    assert {r["task_name"]: r["rate"] for r in sized}["anli_can_we_infer_r1_score_eval"] == 7
    assert abs(sum(r["share"] for r in shares) - 1.0) < 1e-12


def test_mix_sample_caps(spark):
    ex = spark.createDataFrame([(f"t{i % 3}", i) for i in range(90)], "task_name string, idx long")
    caps = spark.createDataFrame([("t0", 5), ("t1", 50), ("t2", 0)], "task_name string, cap long")
    got = {r["task_name"]: r["count"] for r in mix_sample(ex, caps).groupBy("task_name").count().collect()}
    assert got == {"t0": 5, "t1": 30}


def test_mix_sample_keeps_other_columns_and_spreads_a_hot_task(spark):
    ex = spark.range(3000).selectExpr("if(id % 10 = 0, 'small', 'hot') as task_name", "id as idx", "id * 2 as twice")
    caps = spark.createDataFrame([("hot", 1000), ("small", 10)], "task_name string, cap long")
    got = mix_sample(ex, caps)
    rows = got.collect()
    assert {r.task_name: sum(x.task_name == r.task_name for x in rows) for r in rows} == {"hot": 1000, "small": 10}
    assert all(r.twice == 2 * r.idx for r in rows)
