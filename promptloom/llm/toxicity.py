"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words (runs of letters, lower-cased) are cut into overlapping windows of
``WINDOW`` words, ``STRIDE`` apart.  A word's input is its own vector (known words)
and the mean vector of its letter trigrams.  A gated recurrent layer reads the window
in both directions, attention pools the states, and a logistic unit gives the window's
logit.  A text's score comes from its largest window logit and its number of windows.

``fit`` trains on a bounded sample of labelled rows (``max_docs``, half of each label where
both have as many; the score's constant undoes the changed share).  In every round Spark
reads all windows of each sampled text and sends the driver the one that now scores
highest, which stands for its text, and one picked at random.  A fifth of the sample is
kept to choose the round whose net is used (each a running mean of the steps) and for the final
calibration, on the highest of all windows and their number.
``score`` reads all windows of every whole text.

Rows: a null, empty or letterless text has one empty window and is scored like any
other; a model fitted on no rows scores 0; null labels are not learned from; repeated
rows are scored each; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codepoints import STEP, Words, find, mixed
from .common import cut_lineage, free_name, slices

WINDOW, STRIDE = 48, 32
HIDDEN, EMBED, ATTEND, BUCKETS = 8, 8, 8, 4096
GRAMS = (3,)             # letters
INIT = 0.1               # scale of the first input vectors: what was not learned says little


def letter_buckets(w: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of the picked words, word after word, and the word of each."""
    parts = [w.grams(n, pick) for n in GRAMS]
    g, of = (np.concatenate(x) for x in zip(*parts))
    by = np.argsort(of, kind="stable")
    return (g[by] & np.uint64(BUCKETS - 1)).astype(np.int32), of[by]


def mean_rows(table: np.ndarray, buckets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The mean row of ``table`` over each word's buckets (zeros where it has none)."""
    out = np.zeros((len(count), table.shape[1]), np.float32)
    some = count > 0
    if some.any():
        begin = (np.cumsum(count) - count)[some]
        out[some] = np.add.reduceat(table[buckets], begin) / count[some][:, None]
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def new_params(vocab: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    def w(*shape, scale=None):
        return (rng.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

    p = {"word": w(vocab + 1, EMBED, scale=INIT), "char": w(BUCKETS, EMBED, scale=INIT),
         "att": w(2 * HIDDEN, ATTEND), "att_v": w(ATTEND), "out": w(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {f"{d}W": w(2 * EMBED, 3 * HIDDEN), f"{d}U": w(HIDDEN, 3 * HIDDEN), f"{d}b": np.zeros(3 * HIDDEN, np.float32)}
    return p


def _run(gates: np.ndarray, index: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: list | None = None):
    """States (time, windows, HIDDEN) of one direction; ``gates`` are the words' input terms."""
    t_all, n = index.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((t_all, n, HIDDEN), np.float32)
    for t in range(t_all)[::-1 if back else 1]:
        x, hu = gates[index[t]], h @ u
        zr = _sigmoid(x[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
        new = c + z * (h - c)
        m = mask[t][:, None]
        if keep is not None:
            keep.append((t, h, z, r, c, hu[:, 2 * HIDDEN:]))
        h = new if m.all() else np.where(m, new, h)
        out[t] = h
    return out


def _scan(gates: np.ndarray, index: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, out: np.ndarray):
    """``_run`` for scoring, with windows in the last axis so that every operation runs
    along them; ``gates`` and ``u`` hold halved update and reset terms."""
    h = np.zeros((HIDDEN, index.shape[1]), np.float32)
    full = mask.all(1)
    for t in range(len(index))[::-1 if back else 1]:
        x, hu = gates.take(index[t], 1), u @ h
        zr = x[:2 * HIDDEN]
        zr += hu[:2 * HIDDEN]
        np.tanh(zr, zr)
        zr += 1
        zr *= 0.5
        c = x[2 * HIDDEN:]
        c += np.multiply(zr[HIDDEN:], hu[2 * HIDDEN:], hu[2 * HIDDEN:])
        np.tanh(c, c)
        new = h - c
        new *= zr[:HIDDEN]
        new += c
        h = new if full[t] else np.where(mask[t], new, h)
        out[t] = h


def _pool(p, states, mask):
    """Attention over time: weights, pooled states and tanh terms."""
    a = np.tanh(states @ p["att"])
    s = np.where(mask, a @ p["att_v"], np.float32(-1e9))
    e = np.exp(s - s.max(0))
    weight = e / e.sum(0)
    return weight, (weight[..., None] * states).sum(0), a


@dataclass
class ToxicModel:
    vocab: np.ndarray                       # sorted hashes of known words
    params: dict[str, np.ndarray]
    line: tuple[float, float, float]        # score: logistic of a * logit + b * log(windows) + c
    fitted: bool = True

    def inputs(self, w: Words) -> np.ndarray:
        """Input vectors of the distinct words, and each word's number among them."""
        h = w.hashes()
        _, first, number = np.unique(h, return_index=True, return_inverse=True)
        pick = np.zeros(w.n, bool)
        pick[first] = True
        word = self.params["word"][find(h[first], self.vocab)]           # -1: the last row, unknown
        buckets, of = letter_buckets(w, pick)
        rank = np.cumsum(pick) - 1                                       # number among picked, in text order
        vec = mean_rows(self.params["char"], buckets, np.bincount(rank[of], minlength=int(pick.sum())))
        return self.padded(word, vec[rank[first]]), number

    @staticmethod
    def padded(word: np.ndarray, vec: np.ndarray) -> np.ndarray:
        """The input rows of distinct words, and a last row for padding."""
        x = np.concatenate([word, vec], 1)
        return np.concatenate([x, np.zeros((1, 2 * EMBED), np.float32)])

    def logits(self, w: Words, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Per window: its logit. ``index``: word numbers by (time, window)."""
        x, number = self.inputs(w) if w.n else (np.zeros((1, 2 * EMBED), np.float32), np.zeros(0, np.int64))
        return self.scan(x, np.append(number, len(x) - 1), index, mask)

    def scan(self, x: np.ndarray, number: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows over words whose input rows are ``x[number]``."""
        p = self.params
        out = np.empty(index.shape[1], np.float32)
        # the logistic of v is (tanh(v / 2) + 1) / 2: the halves go into the weights
        half = np.repeat(np.float32([0.5, 0.5, 1]), HIDDEN)
        gates = {d: np.ascontiguousarray(((x @ p[f"{d}W"] + p[f"{d}b"]) * half).T) for d in "fb"}
        turn = {d: np.ascontiguousarray((p[f"{d}U"] * half).T) for d in "fb"}
        for i in range(0, index.shape[1], 1024):
            at, m = number[index[:, i:i + 1024]], mask[:, i:i + 1024]
            states = np.empty((len(at), 2 * HIDDEN, at.shape[1]), np.float32)
            for k, d in enumerate("fb"):
                _scan(gates[d], at, m, turn[d], d == "b", states[:, k * HIDDEN:(k + 1) * HIDDEN])
            s = (p["att_v"] @ np.tanh(p["att"].T @ states))
            s[~m] = -1e9
            e = np.exp(s - s.max(0))
            out[i:i + 1024] = (e * (p["out"] @ states)).sum(0) / e.sum(0) + p["out_b"]
        return out

    def calibrated(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        a, b, c = self.line
        return _sigmoid(a * best + b * np.log(n) + c)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words, side by side: word numbers by (time, window), the
    mask, and the text of each window.  The word number after the last one is padding."""
    n_win = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), n_win)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    begin = np.cumsum(counts) - counts
    inside = k * STRIDE + np.arange(WINDOW)[:, None]
    mask = inside < counts[text]
    return np.where(mask, begin[text] + inside, counts.sum()), mask, text


def parts(texts: list[str | None], step: int = STEP) -> Iterator[tuple[list[int], list[str]]]:
    """(row numbers, texts) of about ``step`` characters.  A longer text comes in pieces
    that overlap by whole windows, so that the windows of its pieces are its windows."""
    rows, held, size = [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        while True:
            piece, rest = (text, None) if len(text) <= step else _head(text, step)
            if held and size + len(piece) > step:
                yield rows, held
                rows, held, size = [], [], 0
            rows.append(i)
            held.append(piece)
            size += len(piece)
            if rest is None:
                break
            text = rest
    if held:
        yield rows, held


def _head(text: str, step: int) -> tuple[str, str | None]:
    """The first windows of a long text, and the text from the next window on."""
    import regex
    starts, ends = [], []
    for m in regex.finditer(r"[\p{L}\p{M}]+", text):
        starts.append(m.start())
        ends.append(m.end())
        if m.end() > step and len(ends) > WINDOW:
            break
    else:
        return text, None
    full = (len(ends) - 1 - WINDOW) // STRIDE + 1    # a word beyond them is left
    return text[:ends[(full - 1) * STRIDE + WINDOW - 1]], text[starts[full * STRIDE]:]


def window_logits(model: ToxicModel, held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all windows of some texts, and the text of each."""
    w = Words(held)
    index, mask, text = windows(np.bincount(w.text, minlength=len(held)))
    return model.logits(w, index, mask), text


# ---- training

def _backward(p, d, x_flat, index, mask, keep, d_states, u, grads, dx):
    """Gradients of one direction from d_states (time, windows, HIDDEN)."""
    dh = np.zeros_like(d_states[0])
    for t, h, z, r, c, hc in reversed(keep):
        m = mask[t][:, None]
        dh = dh + d_states[t]
        dn = np.where(m, dh, 0)
        dc = dn * (1 - z) * (1 - c * c)
        dz = dn * (h - c) * z * (1 - z)
        dr = dc * hc * r * (1 - r)
        dg = np.concatenate([dz, dr, dc], 1)
        dhu = np.concatenate([dz, dr, dc * r], 1)
        grads[f"{d}U"] += h.T @ dhu
        grads[f"{d}b"] += dg.sum(0)
        grads[f"{d}W"] += x_flat[index[t]].T @ dg
        np.add.at(dx, index[t], dg @ p[f"{d}W"].T)
        dh = np.where(m, dn * z + dhu @ u.T, dh)


def _step(p, batch, y, weight, grads):
    """Adds the gradients of the weighted logistic loss over a batch of windows."""
    words, chars, lens, index, mask = batch       # distinct words: id, flat buckets, bucket counts
    owner = np.repeat(np.arange(len(words)), lens)
    vec = np.zeros((len(words), EMBED), np.float32)
    np.add.at(vec, owner, p["char"][chars])
    scale = 1 / np.maximum(1, lens)[:, None].astype(np.float32)
    x = np.concatenate([p["word"][words], vec * scale], 1)
    keep = {"f": [], "b": []}
    states = np.concatenate([_run(x @ p[f"{d}W"] + p[f"{d}b"], index, mask, p[f"{d}U"], d == "b", keep[d])
                             for d in "fb"], 2)
    att, pooled, a = _pool(p, states, mask)
    prob = _sigmoid(pooled @ p["out"] + p["out_b"])
    d_logit = ((prob - y) * weight / len(y)).astype(np.float32)
    grads["out"] += pooled.T @ d_logit
    grads["out_b"] += d_logit.sum()
    d_pool = d_logit[:, None] * p["out"]
    d_states = att[..., None] * d_pool
    d_att = (states * d_pool).sum(2)
    d_s = att * (d_att - (att * d_att).sum(0))
    grads["att_v"] += np.einsum("tn,tna->a", d_s, a)
    d_a = d_s[..., None] * p["att_v"] * (1 - a * a)
    grads["att"] += np.einsum("tnh,tna->ha", states, d_a)
    d_states = d_states + d_a @ p["att"].T
    dx = np.zeros_like(x)
    _backward(p, "f", x, index, mask, keep["f"], d_states[..., :HIDDEN], p["fU"], grads, dx)
    _backward(p, "b", x, index, mask, keep["b"], d_states[..., HIDDEN:], p["bU"], grads, dx)
    np.add.at(grads["word"], words, dx[:, :EMBED])
    np.add.at(grads["char"], chars, (dx[:, EMBED:] * scale)[owner])
    return float(-(weight * np.where(y > 0, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))).mean())


class _Windows:
    """The training windows: word numbers of each, and the buckets of each distinct word.

    Read in groups of texts, so that only hashes and numbers are kept of all of them."""

    def __init__(self, texts: list[list[str]], max_vocab: int = 0, min_texts: int = 1, group: int = 100,
                 vocab: np.ndarray | None = None):
        self.of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        hashes, counts, seen, own, spelt = [], [], [], [], []
        known = np.empty(0, np.uint64)
        for i in range(0, len(texts), group):
            w = Words([x for t in texts[i:i + group] for x in t])
            h = w.hashes()
            hashes.append(h)
            n = sum(len(t) for t in texts[i:i + group])
            counts.append(np.bincount(w.text, minlength=n))
            keys, first, number = np.unique(h, return_index=True, return_inverse=True)
            of = np.repeat(np.arange(len(texts[i:i + group])), [len(t) for t in texts[i:i + group]])
            both = np.unique(number * group + of[w.text]) // group
            seen.append((keys, np.bincount(both, minlength=len(keys))))
            pick = np.zeros(w.n, bool)
            pick[first[find(keys, known) < 0]] = True
            buckets, word = letter_buckets(w, pick)
            rank = np.cumsum(pick) - 1
            own.append(h[pick])
            spelt.append((buckets, np.bincount(rank[word], minlength=int(pick.sum()))))
            known = np.union1d(known, keys)
        self.keys, h = known, np.concatenate(hashes)
        self.number = np.append(np.searchsorted(known, h), len(known)).astype(np.int32)
        in_texts = np.zeros(len(known), np.int64)
        for keys, n in seen:
            in_texts[np.searchsorted(known, keys)] += n
        order = np.lexsort((known, -in_texts))[:max_vocab]
        self.vocab = np.sort(known[order[in_texts[order] >= min_texts]]) if vocab is None else vocab
        self.ids = find(known, self.vocab)
        # buckets in the order of the distinct words
        met = np.searchsorted(known, np.concatenate(own))
        lens = np.concatenate([n for _, n in spelt])
        begin, flat = np.cumsum(lens) - lens, np.concatenate([b for b, _ in spelt])
        by = np.argsort(met)
        self.lens = lens[by]
        self.at = np.cumsum(self.lens) - self.lens
        self.buckets = flat[np.repeat(begin[by] - self.at, self.lens) + np.arange(len(flat))]
        counts = np.concatenate(counts)
        begin = np.cumsum(counts) - counts
        inside = np.arange(WINDOW)[:, None]
        self.mask = inside < counts
        self.index = np.where(self.mask, begin + inside, len(h)).astype(np.int32)

    def batch(self, pick: np.ndarray):
        m = self.mask[:, pick]
        number = self.number[self.index[:, pick]]
        own, index = np.unique(number, return_inverse=True)
        real = own[own < len(self.keys)]
        lens = self.lens[real]
        chars = self.buckets[np.repeat(self.at[real] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]
        pad = np.zeros(len(own) - len(real), np.int64)
        return np.append(self.ids[real], pad - 1), chars, np.append(lens, pad), index.reshape(number.shape), m


def chance(key: np.ndarray, number: np.ndarray | int, salt: int) -> np.ndarray:
    """Numbers from 0 to 1 that depend on key, number and salt alone."""
    odd = 0x9E3779B97F4A7C15
    h = mixed(np.asarray(key).view(np.uint64) + np.uint64((salt + 1) * odd % 2 ** 64))
    return (mixed(mixed(h + np.asarray(number, np.uint64) * np.uint64(odd))) >> np.uint64(11)) * 2.0 ** -53


def _searched(batches: Iterator[pa.RecordBatch], model: ToxicModel | None, turn: int) -> Iterator[pa.RecordBatch]:
    """Per sampled text, over all its windows: their number, the highest logit, its window
    and one picked at random (both are random without a model)."""
    for b in slices(batches, "text"):
        key = b.column("key").to_numpy(zero_copy_only=False)
        n = np.zeros(b.num_rows, np.int64)
        best = {c: np.full(b.num_rows, -np.inf) for c in ("top", "other")}
        words = {c: [""] * b.num_rows for c in best}
        for rows, held in parts(b.column("text").to_pylist()):
            w = Words(held)
            index, mask, of = windows(np.bincount(w.text, minlength=len(held)))
            at = np.asarray(rows)[of]                                  # in row order
            start = np.flatnonzero(np.diff(at, prepend=-1))
            count = np.diff(start, append=len(at))
            number = np.arange(len(at)) - np.repeat(start, count) + n[at]
            other = chance(key[at], number, 2 * turn)
            top = chance(key[at], number, 2 * turn + 1) if model is None else model.logits(w, index, mask)
            for c, rank in (("top", top), ("other", other)):
                for j in np.lexsort((rank, at))[start + count - 1].tolist():
                    if rank[j] > best[c][at[j]]:
                        best[c][at[j]], words[c][at[j]] = rank[j], _spelled(w, index[mask[:, j], j])
            n[at[start]] += count
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("y"), pa.array(n), pa.array(best["top"]), *(pa.array(words[c], pa.string()) for c in words)],
            ["key", "y", "n", "best", "top", "other"])


def _spelled(w: Words, numbers: np.ndarray) -> str:
    """Some successive words of ``w`` as a text."""
    if not len(numbers):
        return ""
    offset, length = w.offset[numbers], w.length[numbers]
    plain = w.letters[offset[0]:offset[-1] + length[-1]].astype(np.uint32).tobytes().decode("utf-32-le")
    return " ".join(plain[a:a + n] for a, n in zip((offset - offset[0]).tolist(), length.tolist()))


def _text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word hash, number of texts that have it, of toxic ones), summed over each batch."""
    for b in slices(batches, "text"):
        seen = []
        for rows, held in parts(b.column("text").to_pylist()):
            w = Words(held)
            seen.append(np.unique(np.stack([np.asarray(rows, np.uint64)[w.text], w.hashes()]), axis=1))
        both = np.unique(np.concatenate(seen, 1), axis=1)              # pieces of one text share words
        h, number, n = np.unique(both[1], return_inverse=True, return_counts=True)
        toxic = b.column("y").to_numpy(zero_copy_only=False)[both[0].astype(np.int64)] > 0
        foul = np.bincount(number, toxic, len(h)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(foul)], ["h", "n", "t"])


def fit_network(sample: DataFrame, rounds: int = 4, batch: int = 192, rate: float = 0.012,
                max_vocab: int = 2048, min_texts: int = 3, seed: int = 7, prior: float = 0.0,
                drop: float = 0.1, decay: float = 0.02) -> ToxicModel:
    """``sample``: (key, y, text) of each sampled text, stored; rows of one key are equal.
    ``prior``: log odds of being toxic among all rows less those in the sample.  ``max_vocab`` words of
    at least ``min_texts`` sampled texts get a vector of their own, those whose texts' labels differ most from
    the sample's; all other words are read by their spelling.  ``drop``: the share of known words that a
    step reads by spelling too.  ``decay`` draws input vectors to zero."""
    rng = np.random.default_rng(seed)
    classes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(classes) < 2:
        line = (0.0, 0.0, 30.0 if classes and min(classes) > 0 else -30.0)
        return ToxicModel(np.empty(0, np.uint64), new_params(0, rng), line, False)
    counts = sample.mapInArrow(_text_counts, "h bigint, n bigint, t bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    # the words whose texts' labels differ most from the sample's share, in standard deviations
    share = classes.get(1.0, 0) / sum(classes.values())
    odd = F.abs(F.col("t") - share * F.col("n")) / F.sqrt(F.col("n"))
    known = counts.filter(F.col("n") >= min_texts).orderBy(F.desc(F.round(odd, 9)), F.desc("n"), "h").limit(max_vocab).collect()
    vocab = np.sort(np.array([r["h"] for r in known], np.int64).view(np.uint64))

    def search(model: ToxicModel | None, turn: int) -> list:
        shared = sample.sparkSession.sparkContext.broadcast(model)    # under 1 MB
        got = sample.mapInArrow(lambda bs: _searched(bs, shared.value, turn),
                                "key bigint, y double, n bigint, best double, top string, other string").collect()
        shared.unpersist()
        return sorted(got, key=lambda r: r["key"])

    p = new_params(len(vocab), rng)
    model = ToxicModel(vocab, p, (1.0, 0.0, 0.0))
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    balance = min(4.0, (classes.get(0.0, 0) / max(1, classes.get(1.0, 0))) ** 0.5)
    n_steps, batch = 0, min(batch, max(16, sum(classes.values()) // 8))
    best, mean, weight = (-np.inf, model.params), {k: np.zeros_like(v) for k, v in p.items()}, 0
    for turn in range(rounds):
        # each text by its highest window, and by another one picked at random if it is clean
        found = search(model if turn else None, turn)
        y = np.array([r["y"] for r in found])
        held = chance(np.array([r["key"] for r in found], np.int64), 0, seed) < 0.2
        if turn:
            best = max(best, (_order(found, y, held), model.params), key=lambda x: x[0])
        own = np.flatnonzero(~held)
        more = own[(y[own] == 0) | (turn < 2)]
        if not len(own):
            break
        data = _Windows([[found[i]["top"]] for i in own] + [[found[i]["other"]] for i in more], vocab=vocab)
        label, pick = y[np.concatenate([own, more])], np.arange(len(own) + len(more))
        passes = max(2, -(-60 * batch // len(pick)))      # a small sample is passed more often
        for _ in range(min(passes, 40)):
            pick = rng.permutation(pick)
            for i in range(0, len(pick), batch):
                b = pick[i:i + batch]
                target = label[b].astype(np.float32)
                grads = {k: np.zeros_like(v) for k, v in p.items()}
                words, *rest = data.batch(b)
                words = np.where(rng.random(len(words)) < drop, -1, words)      # at times only the spelling is there
                _step(p, (words, *rest), target, np.where(target > 0, balance, 1).astype(np.float32), grads)
                n_steps += 1
                lr = rate * min(1, n_steps / 20) * (1 - 0.8 * turn / rounds)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g *= min(1, 1 / (norm + 1e-9))
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    p[k] -= lr * first[k] / (1 - 0.9 ** n_steps) / (np.sqrt(second[k] / (1 - 0.99 ** n_steps)) + 1e-7)
                    if k in ("word", "char"):
                        p[k] *= 1 - lr * decay
                weight = 0.98 * weight + 0.02
                for k in p:
                    mean[k] += 0.02 * (p[k] - mean[k])
        # what is searched and kept is the running mean of the steps, which swings less
        model = ToxicModel(vocab, {k: (v / weight).astype(np.float32) for k, v in mean.items()}, (1.0, 0.0, 0.0))
    found = search(model, rounds)
    if (last := _order(found, np.array([r["y"] for r in found]), held)) < best[0]:
        model = ToxicModel(vocab, best[1], (1.0, 0.0, 0.0))
        found = search(model, rounds)
    y, top, n = (np.array([r[c] for r in found], float) for c in ("y", "best", "n"))
    use = held if min((y[held] == 0).sum(), (y[held] == 1).sum()) >= 8 else np.ones(len(y), bool)
    a, b, c = _calibrate(top[use], np.log(n[use]), y[use])
    model.line = (a, b, c + prior)
    return model


def _order(found: list, y: np.ndarray, held: np.ndarray) -> float:
    """The share of (toxic, clean) pairs of held texts that the highest logits put in order; the
    later round wins a tie."""
    use = held if min((y[held] == 0).sum(), (y[held] == 1).sum()) >= 8 else np.ones(len(y), bool)
    top = np.array([r["best"] for r in found], float)[use]
    rank = np.empty(len(top))
    rank[np.argsort(top, kind="stable")] = np.arange(1, len(top) + 1)
    n = y[use].sum()
    return float((rank[y[use] > 0].sum() - n * (n + 1) / 2) / max(1, n * (len(top) - n)))


def _calibrate(top: np.ndarray, log_n: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge towards half the plain logit, by Newton steps
    that are halved until they lower the loss."""
    x = np.stack([top, log_n, np.ones(len(y))], 1)
    prior, ridge = np.array([0.5, 0.0, 0.0]), np.array([4.0, 4.0, 0.1])

    def loss(v):
        z = np.where(y > 0, -(x @ v), x @ v)
        return np.logaddexp(0, z).sum() + (ridge * (v - prior) ** 2).sum() / 2

    v = prior.copy()
    for _ in range(50):
        q = _sigmoid(np.clip(x @ v, -30, 30))
        grad = x.T @ (q - y) + ridge * (v - prior)
        hess = (x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge)
        step, t = np.linalg.solve(hess, grad), 1.0
        while t > 1e-4 and loss(v - t * step) > loss(v):
            t /= 2
        v = v - t * step
        if np.abs(t * step).max() < 1e-6:
            break
    return tuple(float(a) for a in v)


def sample_by_label(docs: DataFrame, labels: DataFrame, allowed: Column, doc_id: str, label: str,
                    text: str, max_docs: int) -> tuple[DataFrame, float]:
    """(_id, text, y) of at most ``max_docs`` label rows, of each label those of smallest id
    hash: half of each, more of one where the other has fewer.  And the log odds of being
    toxic among all label rows less those in the sample."""
    rows = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("y"))
    rows = rows.filter(F.col("_id").isNotNull() & F.col("y").isNotNull()).filter(allowed)
    toxic = F.col("y") > 0
    n = {r[0]: r[1] for r in rows.groupBy(toxic).count().collect()}
    n, half = {t: n.get(t, 0) for t in (True, False)}, max_docs // 2
    take = {t: min(n[t], max(half, max_docs - n[not t])) for t in n}
    clean, foul = (rows.filter(toxic == t).orderBy(F.xxhash64("_id"), "_id", "y").limit(take[t]) for t in (False, True))
    src = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    prior = np.log(n[True] / take[True]) - np.log(n[False] / take[False]) if all(take.values()) else 0.0
    return src.join(F.broadcast(clean.unionByName(foul)), "_id"), float(prior)     # max_docs rows of 16 bytes


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", max_docs: int = 4_000, **options) -> ToxicModel:
    """A model from the label rows where ``allowed`` (over ``_id``); the sampled texts are
    stored, and the driver gets two windows of each in every round."""
    rows, prior = sample_by_label(docs, labels, allowed, doc_id, label, text, max_docs)
    rows = rows.select(F.xxhash64("_id", "y", "text").alias("key"), "y", "text")
    rows = rows.repartition(docs.sparkSession.sparkContext.defaultParallelism, "key")
    return fit_network(cut_lineage(rows), prior=prior, **options)


def score(docs: DataFrame, model: ToxicModel, text: str = "text", keep: list[str] | None = None,
          out: str = "score") -> DataFrame:
    """docs (its columns ``keep``; all) plus the score of every whole text, over all its windows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)   # under 1 MB
    out = free_name(docs.columns, out)
    keep = docs.columns if keep is None else keep
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.DoubleType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, text):
            best, n = np.full(b.num_rows, -np.inf), np.zeros(b.num_rows)
            for rows, held in parts(b.column(text).to_pylist()):
                got, of = window_logits(m, held)
                at = np.asarray(rows)[of]
                np.maximum.at(best, at, got)
                np.add.at(n, at, 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(m.calibrated(best, n), pa.float64())], schema.names)

    return docs.mapInArrow(each, schema)
