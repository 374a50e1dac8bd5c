from pyspark.sql import functions as F

from promptloom.functions import text as T


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys())) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_demo_text(spark):
    assert one(spark, T.demo_text("i", "t"), i="Q\n\n", t="\n A") == "Q\n A"


def test_truncate_left_and_special(spark):
    a = F.array(*[F.lit(i) for i in range(1, 11)])
    assert one(spark, T.truncate_left(a, 4)) == [7, 8, 9, 10]
    assert one(spark, T.truncate_left(a, 4, special=True)) == [1, 8, 9, 10]
    short = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert one(spark, T.truncate_left(short, 4, special=True)) == [1, 2, 3]
    assert one(spark, T.truncate_left(short, 4)) == [1, 2, 3]
    assert one(spark, T.truncate_right(a, 4)) == [1, 2, 3, 4]
    empty = F.array().cast("array<int>")
    assert one(spark, T.truncate_left(empty, 4)) == []


def test_mask_and_eos(spark):
    a = F.array(F.lit(5), F.lit(0), F.lit(7), F.lit(0))
    assert one(spark, T.mask_labels(a)) == [5, -100, 7, -100]
    assert one(spark, T.mask_labels(a, append_eos_id=1)) == [5, -100, 7, -100, 1]
    assert one(spark, T.append_eos(F.array(F.lit(9)))) == [9, 1]


def test_label_to_class_absent_is_minus_one(spark):
    ch = F.array(F.lit("no"), F.lit("yes"))
    assert one(spark, T.label_to_class(ch, "l"), l=" yes ") == 1
    assert one(spark, T.label_to_class(ch, "l"), l="maybe") == -1


def test_no_label_and_strip(spark):
    assert one(spark, T.no_label("t"), t="") == "<NO LABEL>"
    assert one(spark, T.no_label("t"), t="x") == "x"
    assert one(spark, T.strip_ws("t"), t="  a b \n") == "a b"


def test_tokens_whole_text(spark):
    text = " ".join(f"w{i}" for i in range(30000))
    assert one(spark, F.size(T.whitespace_tokens("t")), t="  " + text + "\n") == 30000
    ids = one(spark, T.tokenize("t"), t="a b a")
    assert ids[0] == ids[2] and all(i >= 3 for i in ids)
