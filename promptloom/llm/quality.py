"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins.  Boosting goes round the features in turn;
each step fits a shallow tree to the gradients of one feature and adds its leaves to
that feature's lookup table.  Then the feature pairs with the largest interaction
gain get two-dimensional tables the same way (one cut on each axis a step).  A score
is the logistic of the intercept plus one table entry per feature and per pair.

``fit`` learns from a bounded sample of labelled rows (``max_docs``); the features of
every text, in fitting and in scoring, are counted over the whole text.

Rows: a null text is an empty one and is scored like it; a model fitted on no rows
scores 0.5 and says so (``fitted``); null labels are not learned from; an id with
several label rows is learned from each; repeated rows are scored each; extra
columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, slices

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
STOPS = b".,;:?'\"()-"
SYMBOLS = bytes(b for b in range(33, 127) if b not in UPPER + LOWER + DIGITS + STOPS)
NAMES = ("log_words", "word_length", "upper", "digits", "stops", "symbols", "distinct_words", "top_word",
         "log_lines", "repeated_lines", "line_words", "repeated_sentences", "sentence_words", "short_words",
         "shouts", "bars", "non_ascii")


def _share(raw: bytes, chars: bytes) -> float:
    return len(raw) - len(raw.translate(None, chars))


def features(text: str | None) -> tuple[float, ...]:
    """The features of a whole text, in the order of NAMES."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    n, size = max(1, len(words)), max(1, len(raw))
    letters = max(1, _share(raw, UPPER + LOWER))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    sentences = [x for x in text.split(".") if x.strip()]
    return (
        np.log1p(len(words)), len(raw) / n, _share(raw, UPPER) / letters, _share(raw, DIGITS) / size,
        _share(raw, STOPS) / n, _share(raw, SYMBOLS) / n, len(counts) / n, max(counts.values(), default=0) / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)),
        1 - len(set(sentences)) / max(1, len(sentences)), len(words) / max(1, len(sentences)),
        sum(c for w, c in counts.items() if len(w) <= 3) / n, raw.count(b"!") / n, raw.count(b" | ") / n,
        (len(raw) - len(text)) / size,
    )


@dataclass
class Gam:
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)   # over bins // fold
    intercept: float = 0.0
    fold: int = 4
    fitted: bool = False

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) \
            if self.edges else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for i, j, t in self.pairs:
            out += t[b[:, i] // self.fold, b[:, j] // self.fold]
        return 1 / (1 + np.exp(-out))


def _cut_gain(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per cut between ordered bins: gain of splitting there."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    return gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf value of each bin, from a tree grown best cut first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((float(gain.max()), p, p[0] + int(gain.argmax()) + 1) for p in parts if p[1] - p[0] > 1
                    for gain in [_cut_gain(g[p[0]:p[1]], h[p[0]:p[1]], ridge)]), default=(0, None, 0))
        if best[0] <= 1e-9:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut on each axis at once: its gain, and the value of each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, c = cg[:-1, :-1], ch[:-1, :-1]
    quads = [(a, c), (cg[:-1, -1:] - a, ch[:-1, -1:] - c), (cg[-1:, :-1] - a, ch[-1:, :-1] - c),
             (cg[-1, -1] - cg[:-1, -1:] - cg[-1:, :-1] + a, ch[-1, -1] - ch[:-1, -1:] - ch[-1:, :-1] + c)]
    gain = sum(x ** 2 / (y + ridge) for x, y in quads)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    v = [x[i, j] / (y[i, j] + ridge) for x, y in quads]
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = v
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)), out


def fit_gam(x: np.ndarray, y: np.ndarray, max_bins: int = 32, rounds: int = 150, pair_rounds: int = 40,
            n_pairs: int = 6, leaves: int = 4, rate: float = 0.1, ridge: float = 5.0, fold: int = 4) -> Gam:
    """Cyclic boosting of one table per feature, then of ``n_pairs`` pair tables."""
    m = Gam(fold=fold)
    if not len(y):
        return m
    m.fitted, k = True, x.shape[1]
    m.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])) for j in range(k)]
    b = m.bins(x)
    mean = (y.sum() + 0.5) / (len(y) + 1)
    m.intercept = float(np.log(mean / (1 - mean)))
    m.tables = [np.zeros(max_bins) for _ in range(k)]
    total = np.full(len(y), m.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            g, h = gradients()
            step = rate * _tree(np.bincount(b[:, j], g, max_bins), np.bincount(b[:, j], h, max_bins), leaves, ridge)
            m.tables[j] += step
            total += step[b[:, j]]
    side = -(-max_bins // fold)
    cell = {(i, j): (b[:, i] // fold) * side + b[:, j] // fold for i in range(k) for j in range(i + 1, k)}

    def grid(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.bincount(c, v, side * side).reshape(side, side)

    g, h = gradients()
    gains = sorted(cell, key=lambda p: (-_cross(grid(g, cell[p]), grid(h, cell[p]), ridge)[0], p))[:n_pairs]
    m.pairs = [(i, j, np.zeros((side, side))) for i, j in gains]
    for _ in range(pair_rounds):
        for i, j, table in m.pairs:
            g, h = gradients()
            c = cell[i, j]
            step = rate * _cross(grid(g, c), grid(h, c), ridge)[1]
            table += step
            total += step.ravel()[c]
    return m


def _featured(df: DataFrame, text: str, keep: list[str], out: str) -> DataFrame:
    """``keep`` plus the features of ``text`` as an array, from Arrow batches."""
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            x = [features(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f.name) for f in fields), pa.array(x, pa.list_(pa.float64()))], schema.names)

    return df.mapInArrow(each, schema)


def sample_labelled(docs: DataFrame, labels: DataFrame, allowed: Column, doc_id: str, label: str,
                    text: str, max_docs: int) -> DataFrame:
    """(text, y) of at most ``max_docs`` label rows, those of smallest id hash."""
    pick = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("y"))
    pick = pick.filter(F.col("_id").isNotNull() & F.col("y").isNotNull())
    pick = pick.filter(allowed).orderBy(F.xxhash64("_id"), "_id", "y").limit(max_docs)
    src = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return src.join(F.broadcast(pick), "_id")     # max_docs rows of 16 bytes


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", max_docs: int = 20_000, **options) -> Gam:
    """A model from the label rows where ``allowed`` (over ``_id``); the driver gets
    ``max_docs`` feature rows at most."""
    rows = _featured(sample_labelled(docs, labels, allowed, doc_id, label, text, max_docs), "text",
                     ["_id", "y"], "x").collect()
    rows.sort(key=lambda r: (r["_id"], r["y"], r["x"]))
    return fit_gam(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]), **options)


def score(docs: DataFrame, model: Gam, text: str = "text", keep: list[str] | None = None,
          out: str = "score") -> DataFrame:
    """docs (its columns ``keep``; all) plus the score of every whole text, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)   # a few KB
    out = free_name(docs.columns, out)
    keep = docs.columns if keep is None else keep
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.DoubleType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            x = np.array([features(t) for t in b.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(shared.value.score(x), pa.float64())],
                                             schema.names)

    return docs.mapInArrow(each, schema)
