from promptloom.functions import names as N


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first()["x"]


def test_parse_task_path(spark):
    r = one(spark, N.parse_task_path("p"), p="x/cos_e__v1.11__p__k-0/cos_e_v1.11_rationale")
    assert (r["task"], r["template"]) == ("cos_e_v1.11", "rationale")
    r = one(spark, N.parse_task_path("p"), p="x/anli__none__p/anli_can_we_infer_r2_score_eval")
    assert (r["task"], r["template"]) == ("anli", "can_we_infer")
    r = one(spark, N.parse_task_path("p"), p="x/anli__none__p/anli_can_r1_we_score_eval_infer_anli_r3_x")
    assert (r["task"], r["template"]) == ("anli", "can_we_infer_x")


def test_null_config(spark):
    for v in ("None", "none", ""):
        assert one(spark, N.null_config("c"), c=v) is None
    assert one(spark, N.null_config("c"), c="rte") == "rte"
    assert one(spark, N.task_full_name("d", "c"), d="glue", c="none") == "glue"
    assert one(spark, N.output_name("d", "c", "root", 3), d="glue", c="") == "glue__none__root__k-3"


def test_template_and_task_names(spark):
    assert one(spark, N.normalise_template_name("t"), t="GPT-3 style") == "GPT_3_style"
    assert one(spark, N.normalise_template_name("t"), t="true/false?") == "true_false"
    assert one(spark, N.task_name("d", "s", "t"), d="super_glue", s="wsc.fixed",
               t="p is/are r") == "super_glue_wsc.fixed_p_is_are_r"
    assert one(spark, N.task_name("d", "s", "t"), d="ds", s=None, t="été") == "ds_été"


def test_file_names(spark):
    assert one(spark, N.file_safe("t", slash="", space="_"), t="a b/c") == "a_bc"
    r = one(spark, N.result_name("d", "c", "m", "n", "k"), d="a/b", c="None", m="original", n="1", k="1")
    assert r == "results__a_b__none__original__ret-1_concat-1"
