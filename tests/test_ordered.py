"""Running sums: every row, in every group, at more rows than one range sample sees."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from promptloom.operators.ordered import positions, running_sum


def test_positions_of_a_million_rows_with_payload(spark):
    n = 1_000_000
    df = spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 17)).alias("g"),
        F.md5(F.col("id").cast("string")).alias("h"), F.repeat(F.lit("x"), 20).alias("payload"))
    got = positions(df, ["g"], ["h", "id"], "p", n_ranges=13)
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")) - 1).select("id", "w")
    row = got.join(want, "id").agg(F.count("*"), F.sum((F.col("p") != F.col("w")).cast("int")), F.min("payload")).first()
    assert tuple(row) == (n, 0, "x" * 20)


def test_null_nan_and_long_keys(spark):
    big = 2 ** 53
    rows = [(k, d, s, i) for i in range(40) for k, d, s in
            ((None, 1.0, "a"), (big, float("nan"), None), (big + 1, float("nan"), None), (big + 1, None, "a"))]
    df = spark.createDataFrame(rows, "k long, d double, s string, i int")
    for ranges in (1, 7):
        got = running_sum(df, ["k", "d", "s"], ["i"], {"n": None, "t": "i"}, n_ranges=ranges).collect()
        assert len(got) == len(rows)
        assert all(r.n == r.i and r.t == r.i * (r.i - 1) / 2 for r in got)


def test_inclusive_sums_and_empty_input(spark):
    df = spark.createDataFrame([("a", 2, 1.5), ("a", 1, None), ("b", 1, 2.0)], "g string, i int, w double")
    got = {(r.g, r.i): r.n for r in running_sum(df, ["g"], ["i"], {"n": None}, inclusive=True).collect()}
    assert got == {("a", 1): 1, ("a", 2): 2, ("b", 1): 1}
    assert running_sum(df.limit(0), ["g"], ["i"], {"n": None}).count() == 0
