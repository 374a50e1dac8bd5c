import math


from promptloom.functions import metrics as M


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


PAIRS = [("the cat sat on the mat", "the cat is on the mat"), ("été à Paris", "été a Paris!"),
         ("", "x y"), ("a b c d", "d c b a")]


def df(spark):
    return spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(PAIRS)], "id long, target string, prediction string")


def test_edit_distance_brute_force(spark):
    r = M.edit_distance(df(spark), []).first()
    d = [lev(t, p) for t, p in PAIRS]
    assert math.isclose(r["mean_edit"], sum(d) / len(d)) and r["max_edit"] == max(d) and r["min_edit"] == min(d)


def test_rouge_l_brute_force(spark):
    import re
    def toks(s):
        return [t for t in re.sub(r"[^a-z0-9]+", " ", s.lower()).split() if t]
    fs = []
    for t, p in PAIRS:
        a, b = toks(p), toks(t)
        l = lcs(a, b)
        fs.append(0.0 if l == 0 else 2 * (l / len(a)) * (l / len(b)) / (l / len(a) + l / len(b)))
    assert math.isclose(M.rouge_l(df(spark), []).first()["rougeL"], sum(fs) / len(fs))


def test_squad_and_bleu_small(spark):
    s = spark.createDataFrame([(1, ["The cat!"], "cat"), (2, ["a dog", "the bird"], "bird")],
                              "id long, answers array<string>, prediction string")
    r = M.squad(s, [], "id").first()
    assert r["exact_match"] == 1.0 and r["f1"] == 1.0
    b = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "id long, target string, prediction string")
    assert math.isclose(M.bleu(b, [], "id").first()["bleu"], 100.0)


def test_auc_spearman_f1(spark):
    x = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4)], "target int, prediction double")
    # pairs (pos, neg): (0.9>0.1) (0.9>0.4) (0.4>0.1) (0.4=0.4 -> 1/2) = 3.5 / 4
    assert math.isclose(M.auc(x, []).first()["auc"], 0.875)
    y = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (4.0, 4.0)], "target double, prediction double")
    assert M.spearman(y, []).first()["spearman"] > 0.9
    f = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "target int, prediction int")
    assert math.isclose(M.f1_binary(f, []).first()["f1"], 0.5)
    c = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "target string, prediction string")
    # per class F1: a 2/3, b 0, c 1 -> mean 5/9
    assert math.isclose(M.mean_multiclass_f1(c, []).first()["mean_f1"], 5 / 9)


def test_ngrams_are_counted_where_the_tokens_lie(spark):
    """No n-gram is shuffled: not by (key, n, n-gram), nor for a join of two counts."""
    df = spark.createDataFrame([(1, "a b c d e", "a b c d f"), (2, "x y z w", "x y z w"), (2, "x y z w", "q")], "id long, target string, prediction string")
    r = M.bleu(df, [], "id")
    p = r._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in p and "item#" not in "".join(line for line in p.splitlines() if "Exchange" in line), p
    # rows of one key are one bag: 2 has x y z w once in its predictions and twice in its targets
    assert r.first()["hyp_len"] == 10 and r.first()["ref_len"] == 13
