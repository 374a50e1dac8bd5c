"""Source divergence audit: how each source's words differ from its language's other sources.

Partitions fold whole documents into stripes in memory: per (language, term) the number of
its documents and, per source, of its occurrences.  When a partition holds ``SPILL``
counts it hands all its stripes to the shuffle and starts anew.  The shuffle brings the
stripes of a term together, sorted, and one pass merges them; a term in fewer than
``min_docs`` documents of the language goes.  Merged stripes are stored, and from each of them,
given the totals of the sources, the divergence terms follow directly: no term ever meets
another, and a term's stripe is as long as its sources are many.

With count c of a term, N counts in the source and V kept terms, p = 1 + floor(10**9 *
(c + 1) / (N + V)), and a source's p against another's (or the language's) q adds
floor((p - q)**2 / q), in integers throughout.  A task sums its pairs of sources before it
hands them on; the reported terms are cut to ``top`` in two stages, so that no group of
many candidates is one task's.

Rows: null text, language and source count as empty; terms are runs of A-Z, a-z and
characters beyond ASCII, with A-Z lower-cased; a group without kept terms is still
compared (all its counts are 0), a language without kept terms has pairs of value 0, a
language of one source has no pairs; equal values go by the item's UTF-8 bytes; repeated
rows count each; an empty table gives no rows; extra columns are ignored; texts are read
whole.  The totals of all (language, source) groups are broadcast: more than ``max_groups`` of
them fail, as the pairs to report would be their square.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, slices, stored

SPILL = 400_000                  # counts held by a partition before it spills
ROWS = 20_000                    # stripes in an Arrow batch
CELLS = 1 << 20                  # (term, source) cells worked on at once
SALTS = 16
UNIT = 10 ** 9                   # the unit of p
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
STRIPE = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"
PART = "lang string, source string, part string, item string, value bigint"


def _batch(lang: pa.Array, term: pa.Array, docs: np.ndarray, offsets: np.ndarray, sources: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """Stripes from flat columns; ``offsets`` cut the counts and their sources into stripes."""
    at = pa.array(offsets.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [lang, term, pa.array(docs, pa.int64()), pa.ListArray.from_arrays(at, sources),
         pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], [c.split()[0] for c in STRIPE.split(", ")])


class Stripes:
    """The hash stripes of one partition: per language the documents of each term, and per
    (language, source) its occurrences."""

    def __init__(self):
        self.docs: dict[str, Counter] = {}
        self.counts: dict[str, dict[str, Counter]] = {}
        self.held = 0

    def add(self, lang: str, source: str, terms: list[str]) -> None:
        own = self.counts.setdefault(lang, {}).setdefault(source, Counter())
        self.held -= len(own)
        own.update(terms)
        self.held += len(own)
        self.docs.setdefault(lang, Counter()).update(set(terms))

    def spill(self) -> Iterator[pa.RecordBatch]:
        """All stripes, term by term; the tables are empty afterwards."""
        for lang, docs in self.docs.items():
            number = {t: i for i, t in enumerate(docs)}
            names, of = list(self.counts[lang]), list(self.counts[lang].values())
            term = np.concatenate([np.fromiter(map(number.__getitem__, c), np.int64, len(c)) for c in of])
            source = np.repeat(np.arange(len(of), dtype=np.int32), [len(c) for c in of])
            n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in of])
            by = np.argsort(term, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(docs)))])
            terms, seen = list(docs), np.fromiter(docs.values(), np.int64, len(docs))
            for i in range(0, len(terms), ROWS):
                j = min(i + ROWS, len(terms))
                part = by[ends[i]:ends[j]]
                own = pa.DictionaryArray.from_arrays(pa.array(source[part]), pa.array(names, pa.string())).cast(pa.string())
                yield _batch(pa.array([lang] * (j - i), pa.string()), pa.array(terms[i:j], pa.string()), seen[i:j],
                             ends[i:j + 1] - ends[i], own, n[part])
        self.__init__()


def fold_documents(batches: Iterator[pa.RecordBatch], spill: int = SPILL) -> Iterator[pa.RecordBatch]:
    """Stripes of the documents (lang, source, text) of one partition."""
    table = Stripes()
    for b in slices(batches, "text"):
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
            table.add(lang, source, TERM.findall(text))
            if table.held >= spill:
                yield from table.spill()
    yield from table.spill()


def merged(b: pa.RecordBatch, min_docs: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The stripes of rows sorted by (lang, term), one per term: all but the last that are in
    ``min_docs`` documents, and the last, which may go on."""
    lang, term = b.column("lang"), b.column("term")
    change = np.ones(b.num_rows, bool)
    for k, c in enumerate((lang, term)):
        differ = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        change[1:] = differ if k == 0 else change[1:] | differ
    start = np.flatnonzero(change)
    docs = np.add.reduceat(b.column("docs").to_numpy(), start)
    keep = docs >= min_docs
    keep[-1] = True
    number = np.cumsum(keep) - 1                                   # of the kept stripes
    row = np.cumsum(change) - 1
    lens = np.diff(b.column("sources").offsets.to_numpy())
    of = np.repeat(row, lens)
    live = keep[of]
    codes = b.column("sources").flatten().dictionary_encode()
    names = codes.dictionary
    at = number[of[live]] * len(names) + codes.indices.to_numpy()[live]
    n = b.column("counts").flatten().to_numpy()[live]
    by = np.argsort(at, kind="stable")
    at = at[by]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    own, n = at[first], np.add.reduceat(n[by], first)
    ends = np.concatenate([[0], np.cumsum(np.bincount(own // len(names), minlength=int(keep.sum())))])
    pick = pa.array(start[keep])
    out = _batch(lang.take(pick), term.take(pick), docs[keep], ends, names.take(pa.array(own % len(names))), n)
    return out.slice(0, out.num_rows - 1), out.slice(out.num_rows - 1)


def merge_sorted(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """One stripe per (lang, term) from rows sorted by them; those of ``min_docs`` documents or more."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        if last is not None:
            b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        done, last = merged(b, min_docs)
        if done.num_rows:
            yield done
    if last is not None and last.column("docs")[0].as_py() >= min_docs:
        yield last


def stripes(docs: DataFrame, min_docs: int = 3, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The merged stripes of the kept terms."""
    rows = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"),
                       fold(F.col(text)).alias("text"))
    partial = rows.mapInArrow(fold_documents, STRIPE)
    sorted_ = partial.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return sorted_.mapInArrow(lambda bs: merge_sorted(bs, min_docs), STRIPE)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total) by long division in steps of 1000, as the product
    may exceed 64 bits.  count < total < 9 * 10**15."""
    rest, out = count + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + out


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class Totals:
    """Per language: its sources in order, their counts N, the number V of kept terms."""

    def __init__(self, groups: list[tuple[str, str, int]], kept: dict[str, int]):
        by: dict[str, list] = {}
        for lang, source, n in sorted(groups):
            by.setdefault(lang, []).append((source, n))
        self.langs = {g: ([s for s, _ in x], np.array([n for _, n in x], np.int64), kept.get(g, 0)) for g, x in by.items()}
        self.at = {g: {s: i for i, s in enumerate(x[0])} for g, x in self.langs.items()}


def emit(batches: Iterator[pa.RecordBatch], totals: Totals) -> Iterator[pa.RecordBatch]:
    """From merged stripes: the value of every candidate term, and the task's sums over its
    terms for every pair of sources."""
    sums: dict[str, np.ndarray] = {}
    names = [c.split()[0] for c in PART.split(", ")]

    def part(lang, part, source, item, value):
        n = len(value)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()),
                                           pa.array([part] * n, pa.string()), pa.array(item, pa.string()),
                                           pa.array(value, pa.int64())], names)

    def block(lang, terms, rows):
        sources, totals_n, v = totals.langs[lang]
        at = totals.at[lang]
        c = np.zeros((len(terms), len(sources)), np.int64)
        for i, (own, counts) in enumerate(rows):
            c[i, [at[s] for s in own]] = counts
        p = share(c, totals_n + v)
        q = share(c.sum(1), totals_n.sum() + v)[:, None]
        t, s = np.nonzero((c > 0) & (p > q))
        if len(t):
            yield part(lang, "term", [sources[i] for i in s], [terms[i] for i in t], gap(p[t, s], q[t, 0]))
        if lang not in sums:
            sums[lang] = np.zeros((len(sources), len(sources)), np.int64)
        for i in range(len(sources)):
            sums[lang][i] += gap(p[:, i:i + 1], p).sum(0)
        if sum(x.size for x in sums.values()) > 8 * CELLS:
            yield from paired()

    def paired():
        for lang, m in sums.items():
            sources = totals.langs[lang][0]
            for i, s in enumerate(sources):
                others = [j for j in range(len(sources)) if j != i]
                if others:
                    yield part(lang, "pair", [s] * len(others), [sources[j] for j in others], m[i, others])
        sums.clear()

    for b in batches:
        lang_of = np.array(b.column("lang").to_pylist(), object)
        terms, own, counts = (b.column(c).to_pylist() for c in ("term", "sources", "counts"))
        for lang in dict.fromkeys(lang_of):
            pick = np.flatnonzero(lang_of == lang)
            step = max(1, CELLS // len(totals.langs[lang][0]))
            for i in range(0, len(pick), step):
                k = pick[i:i + step].tolist()
                yield from block(lang, [terms[j] for j in k], [(own[j], counts[j]) for j in k])
    yield from paired()


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, text: str = "text", lang: str = "lang",
          source: str = "source", max_groups: int = 1_000_000) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of a language's sources, and each
    source's ``top`` terms."""
    sc = docs.sparkSession.sparkContext
    kept = stored(stripes(docs, min_docs, text, lang, source), "divergence-stripes")
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    counted = counted.select("lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    seen = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.lit(0).cast("bigint").alias("n"))
    groups = counted.unionByName(seen).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = stored(groups, "divergence-groups")
    found = groups.limit(max_groups + 1).collect()
    if len(found) > max_groups:
        raise ValueError(f"more than {max_groups} groups of language and source")
    terms = {r[0]: r[1] for r in kept.groupBy("lang").count().collect()}       # a language has groups: as few at most
    totals = sc.broadcast(Totals([tuple(r) for r in found], terms))
    parts = kept.mapInArrow(lambda bs: emit(bs, totals.value), PART)
    # a language without kept terms has no stripes
    bare = groups.join(kept.select("lang").distinct(), "lang", "left_anti")
    bare = bare.mapInArrow(lambda bs: _bare(bs, totals.value), PART)
    parts = stored(parts.unionByName(bare), "divergence-parts")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = [F.desc("value"), F.asc("item")]
    group = Window.partitionBy("lang", "source").orderBy(*best)
    salt = Window.partitionBy("lang", "source", "salt").orderBy(*best)
    cut = parts.filter("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    cut = cut.withColumn("rank", F.row_number().over(salt)).filter(F.col("rank") <= top).drop("rank", "salt")
    cut = cut.withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(group)).unionByName(cut)


def _bare(batches: Iterator[pa.RecordBatch], totals: Totals) -> Iterator[pa.RecordBatch]:
    """The pairs of value 0 of sources whose language has no kept term."""
    for b in batches:
        for lang, source in zip(b.column("lang").to_pylist(), b.column("source").to_pylist()):
            others = [s for s in totals.langs[lang][0] if s != source]
            if others:
                n = len(others)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * n, "source": [source] * n, "part": ["pair"] * n,
                                                  "item": others, "value": pa.array([0] * n, pa.int64())})
