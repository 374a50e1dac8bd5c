"""Language identification by words first, then shorter and shorter n-grams.

A word of the vocabulary adds its log frequency in each language.  An unseen word is
scored by its known n-grams of the longest order at which it has any (5 letters down
to 1): the mean of their log frequencies, times the order's share of a word.  The
text's language has the largest sum; its score is the posterior over all sums.

``fit`` counts words and n-grams in Spark over a bounded sample of the labelled rows of each
language (about ``per_lang``, by a hash of the id; all of a language that has fewer), and keeps of
every order the most frequent entries of each language, as many for a rare one as for a
common one.  No language is left out.  What a language never showed has the same small
frequency in all of them, so that one learned from little text is not favoured.  A fifth of
the sample is not counted but scored: in all but one in a thousand of a language's own texts the
share of words that it is known to have is above its ``floor``.  ``predict`` reads whole texts;
``fit`` there is that share less the floor, a measure that does not grow with the length of a
text, where the posterior nears 1 for whichever language is best.  It is given for texts of
``FIT_WORDS`` words or more; a share of fewer says little.

Rows: a null or letterless text is ``und`` with score 0 (and no fit); ties between languages go to
the language with more labelled rows, then the smaller name; a model fitted on no
rows, or an empty table, says ``und`` for all; a null id or language is never trained on;
repeated rows of one id and text are trained on once and predicted each; extra columns pass
through; very long texts are read in pieces cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codepoints import Words, find, groups, sums
from .common import cut_lineage, free_name, slices

UNKNOWN = "und"
ORDERS = (5, 4, 3, 2, 1)
FIT_WORDS = 20


@dataclass
class LangModel:
    """Sorted hashes and log frequencies (entries x languages) by order; 0 is words.

    ``unseen``: the log frequency of a word that a language never showed.  ``floor``: by language,
    the share of known words that its own texts reach."""

    langs: list[str]
    keys: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]
    unseen: float = 0.0
    floor: np.ndarray | None = None

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: sums of log frequencies by language, and its number of words."""
        return self.judged(texts)[:2]

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: sums of log frequencies by language, its number of words, and how many of
        them each language is known to have."""
        w = Words(texts)
        k = len(self.langs)
        by_word = np.zeros((w.n, k))
        at = find(w.hashes(), self.keys[0])
        by_word[at >= 0] = self.logs[0][at[at >= 0]]
        known = by_word > self.unseen + 1e-3
        known[at < 0] = False
        open_ = at < 0
        for n in ORDERS:
            if not open_.any():
                break
            h, of = w.grams(n, open_)
            at = find(h, self.keys[n])
            h, of = at[at >= 0], of[at >= 0]
            hits = np.bincount(of, minlength=w.n)
            done = hits > 0
            got = sums(self.logs[n][h], of, w.n)[done] / hits[done, None]
            by_word[done] = got * (n / (n + 1))
            open_ &= ~done
        return sums(by_word, w.text, len(texts)), np.bincount(w.text, minlength=len(texts)), sums(known.astype(float), w.text, len(texts))


def training_rows(docs: DataFrame, allowed: Column, doc_id: str, text: str, lang: str, per_lang: int) -> tuple[DataFrame, list[str]]:
    """(lang, text, held) of about ``per_lang`` labelled rows of each language, chosen where they lie by
    a hash of the id, and the languages by number of labelled rows."""
    rows = docs.filter(allowed & F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    n = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(n, key=lambda x: (-n[x], x))
    if not langs:
        return rows.select("lang", "text", F.lit(False).alias("held")), langs
    share = F.element_at(F.create_map(*(F.lit(v) for x in langs for v in (x, min(1.0, per_lang / n[x])))), F.col("lang"))
    rows = rows.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share * (1 << 30))
    # one row of an id and text, however often it is repeated
    rows = rows.groupBy("_id", "lang", F.xxhash64("text").alias("_t")).agg(F.any_value("text").alias("text"))
    return rows.select("lang", "text", (F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(5)) == 0).alias("held")), langs


def _count(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    """(order, hash, language number, count), summed over each group of texts."""
    number = {x: i for i, x in enumerate(langs)}
    for b in batches:
        texts, of = b.column("text").to_pylist(), [number[x] for x in b.column("lang").to_pylist()]
        for rows, held in groups(texts):
            w = Words(held)
            lang = np.asarray(of)[rows][w.text]
            for order in (0, *ORDERS):
                h, word = (w.hashes(), np.arange(w.n)) if order == 0 else w.grams(order)
                for i in range(len(langs)):
                    keys, n = np.unique(h[lang[word] == i], return_counts=True)
                    if len(keys):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), order, np.int32)), pa.array(keys.view(np.int64)),
                             pa.array(np.full(len(keys), i, np.int32)), pa.array(n.astype(np.int64))],
                            ["o", "h", "l", "n"])


def _best_entries(counts: DataFrame, per: int) -> DataFrame:
    """(o, h) of about the ``per`` most frequent entries of each (order, language).

    How often each frequency occurs tells the least one that still has room, so no ranking of
    entries is needed; of those at that frequency the share that fits is taken by hash."""
    by_n = counts.groupBy("o", "l", "n").agg(F.count(F.lit(1)).alias("c"))       # few frequencies each
    w = Window.partitionBy("o", "l").orderBy(F.desc("n"))
    cut = by_n.withColumn("upto", F.sum("c").over(w)).filter(F.col("upto") - F.col("c") < per)
    cut = cut.groupBy("o", "l").agg(F.min("n").alias("least"), F.max("upto").alias("upto"), F.min_by("c", "n").alias("c"))
    room = (F.col("c") - F.greatest(F.col("upto") - per, F.lit(0))) / F.col("c")
    met = counts.join(F.broadcast(cut.select("o", "l", "least", room.alias("room"))), ["o", "l"])   # one row a language and order
    keep = (F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & (F.pmod("h", F.lit(1 << 30)) < F.col("room") * (1 << 30)))
    return met.filter(keep).select("o", "h").distinct()


def fit(docs: DataFrame, allowed: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        per_lang: int = 1_500, max_entries: int = 20_000, min_entries: int = 500) -> LangModel:
    """A model from the sampled rows where ``allowed``.

    The driver gets the entries of the languages: of each order ``max_entries`` dealt evenly to them, or
    ``min_entries`` each where they are many, with four bytes a language and entry."""
    rows, langs = training_rows(docs, allowed, doc_id, text, lang, per_lang)
    if not langs:
        return LangModel([], {}, {})
    rows = cut_lineage(rows)
    per = max(min_entries, max_entries // len(langs))
    counts = rows.filter("not held").mapInArrow(lambda bs: _count(bs, langs), "o int, h bigint, l int, n bigint")
    counts = cut_lineage(counts.groupBy("o", "h", "l").agg(F.sum("n").alias("n")))
    total = {(r[0], r[1]): r[2] for r in counts.groupBy("o", "l").agg(F.sum("n")).collect()}
    best = counts.join(_best_entries(counts, per), ["o", "h"]).toPandas()
    keys, logs, unseen = {}, {}, 0.0
    for order in (0, *ORDERS):
        part = best[best["o"] == order]
        h, row = np.unique(part["h"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        n = np.zeros((len(h), len(langs)))
        n[row, part["l"].to_numpy(int)] = part["n"].to_numpy(float)
        size = np.array([total.get((order, i), 1) for i in range(len(langs))], float)
        keys[order], logs[order] = h, np.log(n / size + 0.1 / size.max()).astype(np.float32)
        unseen = unseen if order else float(np.float32(np.log(0.1 / size.max())))
    model = LangModel(langs, keys, logs, unseen)
    # the least share that all but one in a thousand of a language's own held texts reach
    own = predict(rows.filter("held"), model, pred="p", score="s", fit="f").filter("p = lang and f is not null")
    found = own.groupBy("lang").agg(F.percentile_approx("f", 0.001).alias("f"), F.count(F.lit(1)).alias("n")).collect()
    floor = {r["lang"]: r["f"] for r in found if r["n"] >= 20}
    model.floor = np.array([floor.get(x, -np.inf) for x in langs])
    return model


def predict(docs: DataFrame, model: LangModel, text: str = "text", keep: list[str] | None = None,
            pred: str = "lang_pred", score: str = "score", fit: str | None = None) -> DataFrame:
    """docs (its columns ``keep``; all) plus the predicted language and its posterior,
    from the whole text alone; ``fit`` adds a column of that name, the share of known words less
    the language's floor (null for ``und`` and for texts of fewer than ``FIT_WORDS`` words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_entries
    keep = docs.columns if keep is None else keep
    pred = free_name(docs.columns, pred)
    score = free_name([*docs.columns, pred], score)
    more = [] if fit is None else [T.StructField(free_name([*docs.columns, pred, score], fit), T.DoubleType())]
    letters = free_name([*docs.columns, pred, score, *(f.name for f in more)], "_letters")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(pred, T.StringType()),
                           T.StructField(score, T.DoubleType()), *more])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.langs)
        floor = np.zeros(k) if m.floor is None else m.floor
        for b in slices(batches, text):
            total, words, known = np.zeros((b.num_rows, k)), np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, k))
            for rows, held in groups(b.column(text).to_pylist()) if k else ():
                got, n, own = m.judged(held)
                np.add.at(total, rows, got)
                np.add.at(words, rows, n)
                np.add.at(known, rows, own)
            some = (words > 0) & b.column(letters).to_numpy(zero_copy_only=False)
            if k:
                best = total.argmax(1)
                p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                share = known[np.arange(b.num_rows), best] / np.maximum(words, 1)
            out = [pa.array([m.langs[best[i]] if some[i] else UNKNOWN for i in range(b.num_rows)], pa.string()),
                   pa.array([float(p[i]) if some[i] else 0.0 for i in range(b.num_rows)], pa.float64())]
            if more:
                out.append(pa.array([float(share[i] - floor[best[i]]) if some[i] and words[i] >= FIT_WORDS else None
                                     for i in range(b.num_rows)], pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *out], schema.names)

    # words may consist of marks alone; a language needs a letter
    return docs.withColumn(letters, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(each, schema)
