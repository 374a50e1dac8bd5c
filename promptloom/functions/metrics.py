"""Metric registry (E1-E14) as grouped aggregates over (target, prediction) rows.

Every metric is ``metric(df, group_cols, ...) -> DataFrame`` with one row per
group.  Ranks for Spearman and AUC are built from the per-value histogram
(an aggregate with a partial step) and a running sum over distinct values,
so tied values get average ranks without sorting raw rows per group.
Text metrics tokenise whole texts; overlaps are counted with ``explode`` +
grouped counts + an equi-join on (pair, n-gram).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import whitespace_tokens

# fixed values: ASCII punctuation (Python's string.punctuation) and the
# English articles removed by the SQuAD answer normaliser
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
ARTICLES = ("a", "an", "the")
# fixed value: the marks that the TriviaQA normaliser adds to ASCII punctuation
TRIVIA_PUNCT = r"[!-/:-@\[-`{-~‘’´`_]"
ROUGE_NON_ALNUM = r"[^a-z0-9]+"


def _g(group_cols):
    return list(group_cols or [])


def accuracy(df, group_cols, target="target", prediction="prediction") -> DataFrame:
    """E1 (and 'Other')."""
    return df.groupBy(*_g(group_cols)).agg(
        F.avg((F.col(target) == F.col(prediction)).cast("double")).alias("accuracy"))


def sequence_accuracy(df, group_cols, target="target", prediction="prediction") -> DataFrame:
    """Whole token list equal."""
    return df.groupBy(*_g(group_cols)).agg(
        F.avg((F.col(target) == F.col(prediction)).cast("double")).alias("sequence_accuracy"))


def safe_corr(x, y) -> Column:
    """Pearson correlation that is NULL (not an ANSI error) for fewer than two
    rows or a constant column."""
    x, y = F.col(x).cast("double"), F.col(y).cast("double")
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def pearson(df, group_cols, x="target", y="prediction") -> DataFrame:
    """E3."""
    return df.groupBy(*_g(group_cols)).agg(safe_corr(x, y).alias("pearson"))


def average_ranks(df: DataFrame, group_cols, value: str, out: str) -> DataFrame:
    """1-based ranks with ties averaged, via the (group, value) histogram."""
    from ..operators.ordered import running_sum
    g = _g(group_cols)
    hist = df.groupBy(*g, value).agg(F.count(F.lit(1)).alias("_cnt"))
    hist = running_sum(hist, g, [value], {"_before": "_cnt"})
    hist = hist.select(*g, value, (F.col("_before") + (F.col("_cnt") + 1) / 2.0).alias(out))
    return df.join(hist, g + [value])


def spearman(df, group_cols, x="target", y="prediction") -> DataFrame:
    """Pearson of average-tie ranks."""
    g = _g(group_cols)
    r = average_ranks(df, g, x, "_rx")
    r = average_ranks(r, g, y, "_ry")
    return r.groupBy(*g).agg(safe_corr("_rx", "_ry").alias("spearman"))


def auc(df, group_cols, label="target", score="prediction") -> DataFrame:
    """ROC AUC by the rank-sum rule; tied scores count one half."""
    g = _g(group_cols)
    hist = df.groupBy(*g, score).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg"))
    from ..operators.ordered import running_sum
    hist = running_sum(hist, g, [score], {"_neg_before": "_neg"})
    return hist.groupBy(*g).agg(
        (F.sum(F.col("_pos") * (F.col("_neg_before") + F.col("_neg") / 2.0))
         ).alias("_num"), (F.sum("_pos") * F.sum("_neg")).alias("_den")).select(
        *g, F.try_divide("_num", "_den").alias("auc"))


def f1_binary(df, group_cols, target="target", prediction="prediction", positive=1) -> DataFrame:
    """E5 / E13 (mrpc, qqp): F1 of the positive class over all rows."""
    t = F.col(target) == positive
    p = F.col(prediction) == positive
    agg = df.groupBy(*_g(group_cols)).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    return agg.withColumn("f1", F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(
        2.0 * F.col("tp") / (2.0 * F.col("tp") + F.col("fp") + F.col("fn"))))


def mean_multiclass_f1(df, group_cols, target="target", prediction="prediction") -> DataFrame:
    """E13 (cb): mean over classes (seen as target or prediction) of per-class F1."""
    g = _g(group_cols)
    hit = F.col(target) == F.col(prediction)
    events = df.select(*g, F.explode(F.array(
        F.struct(F.col(target).alias("cls"), F.when(hit, F.lit("tp")).otherwise(F.lit("fn")).alias("kind")),
        F.struct(F.col(prediction).alias("cls"), F.when(hit, F.lit(None)).otherwise(F.lit("fp")).alias("kind")),
    )).alias("e")).select(*g, "e.cls", "e.kind")
    per = events.groupBy(*g, "cls").agg(
        F.count_if(F.col("kind") == "tp").alias("tp"), F.count_if(F.col("kind") == "fp").alias("fp"),
        F.count_if(F.col("kind") == "fn").alias("fn"))
    f1 = F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(
        2.0 * F.col("tp") / (2.0 * F.col("tp") + F.col("fp") + F.col("fn")))
    return per.groupBy(*g).agg(F.avg(f1).alias("mean_f1"), F.count(F.lit(1)).alias("n_classes"))


def edit_distance(df, group_cols, target="target", prediction="prediction") -> DataFrame:
    """Levenshtein distance, mean / min / max / median per group."""
    d = F.levenshtein(F.col(target), F.col(prediction))
    x = df.select(*_g(group_cols), d.alias("_d"))
    return x.groupBy(*_g(group_cols)).agg(
        F.avg("_d").alias("mean_edit"), F.min("_d").alias("min_edit"),
        F.max("_d").alias("max_edit"), F.median("_d").alias("median_edit"))


def squad_tokens(col) -> Column:
    """SQuAD normaliser: lower, drop ASCII punctuation, drop articles, split on whitespace."""
    c = F.col(col) if isinstance(col, str) else col
    toks = whitespace_tokens(F.regexp_replace(F.lower(c), PUNCT_CLASS, ""))
    arts = F.array(*[F.lit(a) for a in ARTICLES])
    return F.filter(toks, lambda t: ~F.array_contains(arts, t))


def trivia_tokens(col) -> Column:
    """TriviaQA normaliser: lower, punctuation to spaces, drop articles, split on whitespace."""
    c = F.col(col) if isinstance(col, str) else col
    toks = whitespace_tokens(F.regexp_replace(F.lower(c), TRIVIA_PUNCT, " "))
    return F.filter(toks, lambda t: ~F.array_contains(F.array(*[F.lit(a) for a in ARTICLES]), t))


def _bag_overlap(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Sum over shared items of min(count in a, count in b), per key."""
    ca = a.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("_a"))
    cb = b.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("_b"))
    return (ca.join(cb, keys + ["item"])
            .groupBy(*keys).agg(F.sum(F.least("_a", "_b")).alias("common")))


def squad(df, group_cols, id_col: str, answers="answers", prediction="prediction", *,
          normalise=squad_tokens) -> DataFrame:
    """E8 / E9 / E10 (``normalise``: the answer's tokens): exact match and token F1, max over the gold answers.

    ``answers`` is an array of gold strings.  Two empty token lists match
    (F1 = 1); one empty list scores 0.
    """
    g = _g(group_cols)
    base = df.select(*g, id_col, F.posexplode(answers).alias("ans_i", "gold"), prediction)
    base = base.select(*g, id_col, "ans_i", normalise("gold").alias("gt"),
                       normalise(prediction).alias("pt"))
    keys = [id_col, "ans_i"]
    pa_ = base.select(*keys, F.explode_outer("pt").alias("item")).where(F.col("item").isNotNull())
    ga_ = base.select(*keys, F.explode_outer("gt").alias("item")).where(F.col("item").isNotNull())
    common = _bag_overlap(pa_, ga_, keys)
    s = base.join(common, keys, "left").fillna(0, ["common"])
    np_, ng = F.size("pt"), F.size("gt")
    prec = F.col("common") / np_
    rec = F.col("common") / ng
    f1 = (F.when((np_ == 0) | (ng == 0), (np_ == ng).cast("double"))
          .when(F.col("common") == 0, F.lit(0.0))
          .otherwise(2 * prec * rec / (prec + rec)))
    em = (F.array_join("pt", " ") == F.array_join("gt", " ")).cast("double")
    per = s.groupBy(*g, id_col).agg(F.max(em).alias("em"), F.max(f1).alias("f1"))
    return per.groupBy(*g).agg(F.avg("em").alias("exact_match"), F.avg("f1").alias("f1"))


def span_tokens(col) -> Column:
    """The tokens that spans count: what is no letter, digit or underscore parts them."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_remove(F.split(c, r"(?U)\W+"), "")


def span_text(context, start, end) -> Column:
    """Tokens ``start`` to ``end`` (0-based, both included) of a context, joined by blanks; no tokens
    where a position is null or negative, or the span ends before it starts."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    good = (start >= 0) & (end >= start)
    cut = F.slice(span_tokens(context), F.when(good, start + 1).otherwise(1).cast("int"),
                  F.when(good, end - start + 1).otherwise(0).cast("int"))
    return F.array_join(F.coalesce(cut, F.array().cast("array<string>")), " ")


def span_squad(df, group_cols, id_col: str, answers="answers", context="context", start="start", end="end") -> DataFrame:
    """E8, span form: the prediction is a pair of token positions in a context; its text is cut from
    the context's tokens, so it holds no punctuation, and then scored as ``squad``."""
    cut = df.withColumn("_span", span_text(context, start, end))
    return squad(cut, group_cols, id_col, answers, "_span")


def ngram_items(tokens, n: int) -> Column:
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.when(F.size(t) >= n, F.transform(
        F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


PART_BYTES = 2 << 20


def _ngram_overlap(base: DataFrame, keys, id_col: str, ns) -> DataFrame:
    """(keys, n, common): the n-grams that ``h`` and ``r`` of a key have in common, each as often as both have it.

    Tokens are dealt by ``id_col``, one of the keys, ``PART_BYTES`` of them a part, before they multiply; n-grams are made, counted and
    compared there, and none is shuffled.  A null key has nothing in common."""
    size = base.agg(F.sum(F.octet_length(F.array_join("h", " ")) + F.octet_length(F.array_join("r", " ")))).first()[0] or 0
    least = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.dropna(subset=keys).repartition(max(least, -(-size // PART_BYTES)), id_col)

    def tag(n, side):
        return lambda g: F.struct(F.lit(n).alias("n"), g.alias("item"), F.lit(side).alias("side"))
    arr = F.flatten(F.array(*[F.transform(ngram_items(c, n), tag(n, i)) for n in ns for i, c in enumerate(("h", "r"))]))
    x = dealt.select(*keys, F.explode_outer(arr).alias("_x")).where(F.col("_x").isNotNull()).select(*keys, "_x.*")
    both = x.groupBy(*keys, "n", "item").agg(F.count_if(F.col("side") == 0).alias("_a"), F.count_if(F.col("side") == 1).alias("_b"))
    both = both.where((F.col("_a") > 0) & (F.col("_b") > 0))
    return both.groupBy(*keys, "n").agg(F.sum(F.least("_a", "_b")).alias("common"))


def bleu(df, group_cols, id_col: str, target="target", prediction="prediction",
         max_n: int = 4) -> DataFrame:
    """Corpus BLEU (whitespace tokens, no smoothing, x100).

    All n-gram orders go through one explode and one count where a pair's tokens
    lie; lengths and overlaps then meet in a union + aggregate."""
    g = _g(group_cols)
    if not g:  # one corpus: a constant group key
        df, g = df.withColumn("_corpus", F.lit(1)), ["_corpus"]
    ns = list(range(1, max_n + 1))
    base = df.select(*g, id_col, whitespace_tokens(prediction).alias("h"),
                     whitespace_tokens(target).alias("r"))
    keys = g + [id_col]
    common = _ngram_overlap(base, keys, id_col, ns)
    # per-pair lengths and per-order overlaps meet in one union + aggregate
    zero = F.lit(0).cast("long")
    lens = base.select(*g, F.size("h").cast("long").alias("hyp_len"), F.size("r").cast("long").alias("ref_len"),
                       *[F.greatest(F.size("h") - n + 1, F.lit(0)).cast("long").alias(f"t{n}") for n in ns],
                       *[zero.alias(f"m{n}") for n in ns])
    hits = common.select(*g, zero.alias("hyp_len"), zero.alias("ref_len"), *[zero.alias(f"t{n}") for n in ns],
                         *[F.when(F.col("n") == n, F.col("common")).otherwise(0).cast("long").alias(f"m{n}")
                           for n in ns])
    cols = ["hyp_len", "ref_len"] + [f"t{n}" for n in ns] + [f"m{n}" for n in ns]
    out = lens.unionByName(hits).groupBy(*g).agg(*[F.sum(c).alias(c) for c in cols])
    logs = [F.log(F.col(f"m{n}") / F.col(f"t{n}")) for n in ns]
    none = F.lit(False)
    for n in ns:
        none = none | (F.col(f"m{n}") == 0)
    bp = F.when(F.col("hyp_len") >= F.col("ref_len"), F.lit(1.0)).otherwise(
        F.exp(1.0 - F.col("ref_len") / F.col("hyp_len")))
    score = F.when(none, F.lit(0.0)).otherwise(bp * F.exp(sum(logs) / max_n) * 100.0)
    keep = [c for c in g if c != "_corpus"]
    return out.select(*keep, score.alias("bleu"), "hyp_len", "ref_len")


def rouge_tokens(col) -> Column:
    """ROUGE tokenisation: lower-case, non [a-z0-9] -> space, split."""
    c = F.col(col) if isinstance(col, str) else col
    return whitespace_tokens(F.regexp_replace(F.lower(c), ROUGE_NON_ALNUM, " "))


def rouge_n(df, group_cols, id_col: str, target="target", prediction="prediction",
            ns=(1, 2)) -> DataFrame:
    """Mean ROUGE-n F-measure per group (all orders in one pass)."""
    g = _g(group_cols)
    ns = list(ns)
    base = df.select(*g, id_col, rouge_tokens(prediction).alias("h"), rouge_tokens(target).alias("r"))
    keys = g + [id_col]
    common = _ngram_overlap(base, keys, id_col, ns)
    c = common.groupBy(*keys).pivot("n", ns).agg(F.first("common"))
    per = base.join(c, keys, "left")
    cols = []
    for n in ns:
        nh = F.greatest(F.size(F.col("h")) - n + 1, F.lit(0))
        nr = F.greatest(F.size(F.col("r")) - n + 1, F.lit(0))
        cn = F.coalesce(F.col(str(n)), F.lit(0))
        p, r_ = cn / nh, cn / nr
        cols.append(F.when(cn == 0, F.lit(0.0)).otherwise(2 * p * r_ / (p + r_)).alias(f"rouge{n}"))
    per = per.select(*keys, *cols)
    return per.groupBy(*g).agg(*[F.avg(f"rouge{n}").alias(f"rouge{n}") for n in ns])


_LCS_CELLS = 1 << 20


def lcs_lengths(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Longest common subsequence length of two token lists, row by row of a batch.

    Tokens become codes once for the batch; rows of like length are worked on together,
    so a step of the recurrence handles one position of many rows."""
    n = len(a)
    both = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode()
    codes = both.indices.to_numpy(zero_copy_only=False)
    la, lb = (np.asarray(x.value_lengths().fill_null(0), dtype=np.int64) for x in (a, b))
    at_a, at_b = np.cumsum(la) - la, len(codes) - lb.sum() + np.cumsum(lb) - lb
    out = np.zeros(n, np.int64)
    order = np.argsort(np.maximum(la, lb), kind="stable")
    order = order[(la[order] > 0) & (lb[order] > 0)]
    start = 0
    while start < len(order):
        width = np.maximum.accumulate(lb[order[start:]])
        stop = start + max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), _LCS_CELLS)))
        rows, start = order[start:stop], stop
        ja, jb = np.arange(la[rows].max()), np.arange(lb[rows].max())
        x = np.where(ja < la[rows, None], codes[np.minimum(at_a[rows, None] + ja, len(codes) - 1)], -1)
        y = np.where(jb < lb[rows, None], codes[np.minimum(at_b[rows, None] + jb, len(codes) - 1)], -2)
        last = np.zeros((len(rows), len(jb) + 1), np.int32)
        for j in range(len(ja)):
            match = np.where(y == x[:, j:j + 1], last[:, :-1] + 1, 0)
            last[:, 1:] = np.maximum.accumulate(np.maximum(match, last[:, 1:]), axis=1)
        out[rows] = last[np.arange(len(rows)), lb[rows]]
    return out


@F.arrow_udf(T.LongType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(lcs_lengths(a, b))


def rouge_l(df, group_cols, target="target", prediction="prediction") -> DataFrame:
    """Mean ROUGE-L F-measure per group (LCS in an Arrow-batched UDF)."""
    g = _g(group_cols)
    x = df.select(*g, rouge_tokens(prediction).alias("h"), rouge_tokens(target).alias("r"))
    lcs = lcs_length(F.col("h"), F.col("r"))
    x = x.withColumn("_l", lcs)
    p, r = F.try_divide(F.col("_l"), F.size("h")), F.try_divide(F.col("_l"), F.size("r"))
    f = F.when(F.col("_l") == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return x.groupBy(*g).agg(F.avg(f).alias("rougeL"))


def union_lcs_hits(reference: list[list[str]], summary: list[list[str]]) -> int:
    """Summary-level matches: per reference sentence the union of its common subsequences with
    every summary sentence; a token counts as often as both sides hold it."""
    left_r, left_s = (Counter(t for x in side for t in x) for side in (reference, summary))
    hits = 0
    for r in reference:
        found = set()
        for s in summary:
            found.update(_common_places(r, s))
        for i in sorted(found):
            if left_r[r[i]] > 0 and left_s[r[i]] > 0:
                left_r[r[i]] -= 1
                left_s[r[i]] -= 1
                hits += 1
    return hits


def _common_places(a: list[str], b: list[str]) -> list[int]:
    """The places in ``a`` of one longest common subsequence with ``b``, walked from the end: where two
    ways are as long, ``a`` is shortened."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif rows[i][j - 1] > rows[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


@F.arrow_udf(T.LongType())
def union_lcs(reference: pa.Array, summary: pa.Array) -> pa.Array:
    return pa.array([union_lcs_hits(r or [], s or []) for r, s in zip(reference.to_pylist(), summary.to_pylist())], pa.int64())


def rouge_l_sum(df, group_cols, target="target", prediction="prediction") -> DataFrame:
    """E12, summary level: mean F-measure of the union of common subsequences over the sentences
    (lines) of a text."""
    g = _g(group_cols)

    def sentences(c):
        return F.filter(F.transform(F.split(c, "\\n"), rouge_tokens), lambda t: F.size(t) > 0)

    x = df.select(*g, sentences(prediction).alias("h"), sentences(target).alias("r"))
    x = x.withColumn("_l", union_lcs(F.col("r"), F.col("h")))
    p, r = F.try_divide(F.col("_l"), F.size(F.flatten("h"))), F.try_divide(F.col("_l"), F.size(F.flatten("r")))
    return x.groupBy(*g).agg(F.avg(F.when(F.col("_l") == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))).alias("rougeLsum"))


def trivia_qa(df, group_cols, id_col: str, answers="answers", prediction="prediction") -> DataFrame:
    """As ``squad`` with TriviaQA's own normaliser."""
    return squad(df, group_cols, id_col, answers, prediction, normalise=trivia_tokens)


REGISTRY = {
    "Accuracy": accuracy, "Other": accuracy, "Sequence Accuracy": sequence_accuracy,
    "Pearson Correlation": pearson, "Spearman Correlation": spearman,
    "MultiRC": f1_binary, "AUC": auc, "Edit Distance": edit_distance,
    "Squad": squad, "Span Squad": span_squad, "Trivia QA": trivia_qa, "COQA F1": squad, "BLEU": bleu,
    "ROUGE": rouge_n, "F1": f1_binary, "Mean Multiclass F1": mean_multiclass_f1,
}
# fixed values: subsets whose own post-processing is not done, scored by plain accuracy
PLAIN_ACCURACY = (("super_glue", "wsc.fixed"), ("super_glue", "multirc"))


def metrics_for(dataset: str, subset: str | None, named: list[str]) -> list:
    """The metrics of a task: accuracy for PLAIN_ACCURACY, else those its template names."""
    return [accuracy] if (dataset, subset) in PLAIN_ACCURACY else [REGISTRY[n] for n in named]
