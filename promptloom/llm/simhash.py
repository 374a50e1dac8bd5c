"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has a bit set where over half of its shingles' XXH64 hashes
(seed 42) have it.  Two fingerprints link at ``max_bits`` or fewer differing bits.
The join walks a binary trie of all distinct fingerprints against itself: node pairs
are split bit by bit, their differing bits accumulate, and a pair is dropped as soon
as its error budget is exceeded.

Budget: of 3 differing bits, one half of the 64 has at most 1 (``max_bits // 2``).  So
the trie is walked twice, over the bits as they are and with the halves swapped, each
time with that smaller budget for the first half and the whole one after it.  That
keeps the node pairs near the top, which must meet in one task, at 1 + depth a node
instead of the sum of binomials.

Distribution: the first ``p`` bits (p grows with the logarithm of the number of
fingerprints) name a trie node.  A node's fingerprints go to its own task and to those
of the smaller nodes it can still pair with.  A node of more than ``node_rows`` is dealt
into tiles of bounded size that meet pairwise.  Within a task the walk is vectorised
over node pairs, in bounded pieces.  A task emits a spanning forest of the links it
found, fewer edges than it has fingerprints, and skips node pairs that lie in one
component already, so a large group of near copies does not become all its pairs.

Components: label rounds over the forests (large-star, small-star), each stored in
the checkpoint folder, until all edges are stars.  Rows that share a fingerprint join
their component through ``attach_facts``, so a fingerprint held by a third of the
rows is not shuffled into one task.

Rows: a null text is an empty one; a text of no words has fingerprint zero and links
like any other; one of fewer words than a shingle has its whole sequence as the one
shingle; repeated rows are kept each; a null id takes part with its row and is never
the smallest (a component of null ids only has a null id); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_facts, cut_lineage, log2_parts, slices, without
from .exact_dedup import content_key

SEED = 42
PIECE = 1 << 17           # shingles or node pairs handled at once


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of a whole text."""
    import xxhash
    tokens = (text or "").encode("utf-8", "replace").lower().split()   # bytes: A-Z and ASCII spaces only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(tokens))
    spans = zip(starts[:len(tokens) - k + 1].tolist(), ends[k - 1:].tolist())
    digest = xxhash.xxh64_digest
    n, ones = len(tokens) - k + 1, np.zeros(64, np.int64)
    hashed = [digest(joined[a:b], SEED) for a, b in spans]
    for i in range(0, n, PIECE):
        raw = np.frombuffer(b"".join(hashed[i:i + PIECE]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3,
                 key: Column | None = None) -> DataFrame:
    """(doc_id, fp) of every row, and ``key`` where given; fp is the fingerprint as a signed 64-bit integer."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *([key.alias("key")] if key is not None else []))
    kept = [f for f in src.schema.fields if f.name != "text"]
    names = [f.name for f in kept]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(fp.view(np.int64))], [*names, "fp"])

    return src.mapInArrow(each, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", fp bigint")


# ---- the walk inside a task

class Forest:
    """Links between numbered items, kept as a labelling; pending links are folded in."""

    def __init__(self, n: int):
        self.label, self.a, self.b, self.size = np.arange(n), [], [], 0
        self.change = None

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        keep = self.label[a] != self.label[b]
        if keep.any():
            self.a.append(a[keep])
            self.b.append(b[keep])
            self.size += int(keep.sum())

    def fold(self) -> None:
        if not self.size:
            return
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        self.a, self.b, self.size, self.change = [], [], 0, None
        label = self.label
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
        self.label = label

    def uniform(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Does each range of items have one label?"""
        if self.change is None:
            self.change = np.cumsum(np.diff(self.label, prepend=self.label[:1]) != 0)
        return self.change[lo] == self.change[hi - 1]


def walk(keys: np.ndarray, bits: int, first_bits: int, roots, budget: int, first_budget: int,
         forest: Forest, small: int = 48) -> None:
    """Links all pairs of ``keys`` that the ``roots`` node pairs hold within the budget.

    ``keys``: sorted; their lowest ``bits`` bits are compared, from the top.  A node is a
    range of keys that agree in the bits above.  ``roots``: arrays (a_lo, a_hi, b_lo, b_hi,
    differing bits so far).  ``first_bits`` of the bits belong to the first half."""
    stack = [(bits, tuple(np.asarray(x, np.int64) for x in roots))]
    mask = np.uint64((1 << bits) - 1)
    while stack:
        left, (al, ah, bl, bh, d) = stack.pop()
        if len(al) > PIECE:
            stack += [(left, tuple(x[i:i + PIECE] for x in (al, ah, bl, bh, d))) for i in range(0, len(al), PIECE)]
            continue
        if forest.size > PIECE:
            forest.fold()
        joined = (forest.label[al] == forest.label[bl]) & forest.uniform(al, ah) & forest.uniform(bl, bh)
        # one key with itself, or a pair of nodes in one component: no link can change it
        go = ~joined
        al, ah, bl, bh, d = (x[go] for x in (al, ah, bl, bh, d))
        if not len(al):
            continue
        size = (ah - al) * (bh - bl)
        leaf = (size <= small) | (left == 0)
        if leaf.any():
            _leaves(keys, mask, left, bits - first_bits, (x[leaf] for x in (al, ah, bl, bh, d)), budget,
                    first_budget, forest)
        go = ~leaf
        al, ah, bl, bh, d = (x[go] for x in (al, ah, bl, bh, d))
        if not len(al):
            continue
        bit = left - 1
        am, bm = _middle(keys, al, bit), _middle(keys, bl, bit)
        # a key at the border may belong to the next node: stay inside the range
        am, bm = np.clip(am, al, ah), np.clip(bm, bl, bh)
        same = (al == bl) & (ah == bh)
        most = first_budget if bits - bit <= first_bits else budget
        nxt = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1)]
        parts = [tuple(np.concatenate(x) for x in zip(*nxt, tuple(v[~same] for v in (am, ah, bl, bm, d + 1))))]
        for a0, a1, b0, b1, dd in parts:
            ok = (a1 > a0) & (b1 > b0) & (dd <= most)
            if ok.any():
                stack.append((bit, tuple(x[ok] for x in (a0, a1, b0, b1, dd))))
    forest.fold()


def _middle(keys: np.ndarray, lo: np.ndarray, bit: int) -> np.ndarray:
    """Where in each node the keys with ``bit`` set begin."""
    head = keys[lo] >> np.uint64(bit) | np.uint64(1)
    return np.searchsorted(keys, head << np.uint64(bit))


def _leaves(keys, mask, left, second_bits, pairs, budget, first_budget, forest) -> None:
    """Compares all keys of small node pairs, some pairs at a time."""
    al, ah, bl, bh, d = pairs
    size = (ah - al) * (bh - bl)
    order = np.cumsum(size)
    begin = 0
    while begin < len(al):
        base = order[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(order, base + 8 * PIECE, side="right")))
        s = slice(begin, end)
        n = size[s]
        of = np.repeat(np.arange(end - begin), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = (bh - bl)[s][of]
        i, j = al[s][of] + k // wide, bl[s][of] + k % wide
        below = np.uint64((1 << left) - 1)
        diff = (keys[i] ^ keys[j]) & mask & below
        total = np.bitwise_count(diff).astype(np.int64) + d[s][of]
        second = np.bitwise_count(diff & np.uint64((1 << second_bits) - 1)).astype(np.int64) if left > second_bits else None
        ok = (total <= budget) & (i != j)
        if second is not None:
            ok &= total - second <= first_budget
        forest.add(i[ok], j[ok])
        begin = end


# ---- dealing nodes to tasks

def _unit(node: np.ndarray, own: np.ndarray, fp: np.ndarray, p: int, budget: int, first_budget: int) -> np.ndarray:
    """Forest edges (two columns of fingerprints) of some tasks' rows.

    ``node``: number of the task; ``own``: the task's node; ``fp``: in the trie's bit order."""
    low = 64 - p
    prefix = fp >> np.uint64(low) if p else np.zeros(len(fp), np.uint64)
    _, seg = np.unique(node.astype(np.uint64) << np.uint64(p) | prefix, return_inverse=True)
    # the segment number takes the place of the first p bits, so all segments sort as one array
    keys = (seg.astype(np.uint64) << np.uint64(low) if p else np.zeros(len(fp), np.uint64)) | \
        (fp & np.uint64((1 << low) - 1))
    by = np.argsort(keys)
    keys, fp, seg, node, prefix, own = (x[by] for x in (keys, fp, seg, node, prefix, own))
    lo = np.flatnonzero(np.diff(seg, prepend=-1))
    hi = np.append(lo[1:], len(seg))
    home = prefix[lo] == own[lo]
    # each task's own segment meets itself and the task's other segments
    owner = {int(t): i for t, i in zip(node[lo][home], np.flatnonzero(home))}
    pairs = [(owner[int(t)], i, int(not h)) for i, (t, h) in enumerate(zip(node[lo], home)) if int(t) in owner]
    if not pairs:
        return np.empty((0, 2), np.uint64)
    a, b, d = (np.array(x) for x in zip(*pairs))
    forest = Forest(len(keys))
    walk(keys, low, 32 - p, (lo[a], hi[a], lo[b], hi[b], d), budget, first_budget, forest)
    linked = np.flatnonzero(forest.label != np.arange(len(keys)))
    return np.stack([fp[linked], fp[forest.label[linked]]], 1)


def _swap(fp: np.ndarray) -> np.ndarray:
    return fp << np.uint64(32) | fp >> np.uint64(32)


def _joined(batches: Iterator[pa.RecordBatch], p: int, budget: int, unit_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (task, order, own, fp) sorted by task -> forest edges."""
    held, size = [], 0

    def emit(rows):
        task, own, fp, turned = (np.concatenate(x) for x in zip(*rows))
        _, number = np.unique(task, return_inverse=True)
        step = max(1, (1 << p) // (p + 1))      # tasks whose segments p bits can number
        for order in (0, 1):
            for i in range(0, int(number.max()) + 1, step):
                m = (turned == order) & (number >= i) & (number < i + step)
                if not m.any():
                    continue
                got = _unit(number[m] - i, own[m], _swap(fp[m]) if order else fp[m], p, budget, budget // 2)
                u, v = (np.ascontiguousarray(_swap(x) if order else x).view(np.int64) for x in got.T)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        rows = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("task", "own", "fp", "turned"))
        rows = (rows[0], rows[1].astype(np.uint64), np.ascontiguousarray(rows[2]).view(np.uint64), rows[3])
        cut = np.flatnonzero(np.diff(rows[0])) + 1
        if size + len(rows[0]) > unit_rows and len(cut):
            at = int(cut[-1])
            held.append(tuple(x[:at] for x in rows))
            yield from emit(held)
            held, size, rows = [], 0, tuple(x[at:] for x in rows)
        held.append(rows)
        size += len(rows[0])
    if size:
        yield from emit(held)


def links(fps: DataFrame, max_bits: int = 3, node_rows: int = 50_000, per_node: int = 2048,
          max_depth: int = 30) -> DataFrame:
    """Edges (u, v) whose components are those of all links between distinct ``fp``.

    ``fps``: stored, one row per distinct fingerprint."""
    n = fps.count()
    p = min(max_depth, max(6, log2_parts(n, per_node)))
    unsigned = F.col("fp")
    turned = F.shiftleft(unsigned, 32).bitwiseOR(F.shiftrightunsigned(unsigned, 32))
    both = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("turned"))
    both = both.withColumn("node", F.shiftrightunsigned(F.when(F.col("turned") == 0, unsigned).otherwise(turned), 64 - p))
    # a node pairs with itself and, within the first half's budget, with nodes of one other bit
    assert max_bits in (2, 3), "the first half's budget is one bit"
    bits = F.array(*(F.lit(1 << i).cast("bigint") for i in range(p)))
    partners = F.filter(F.transform(bits, lambda x: F.col("node").bitwiseXOR(x)), lambda o: o < F.col("node"))
    dealt = both.select("fp", "turned", F.explode(F.concat(F.array("node"), partners)).alias("own"))
    big = dealt.groupBy("turned", "own").count().filter(F.col("count") > node_rows)
    big = cut_lineage(big.select("turned", "own", F.ceil(F.col("count") / (node_rows // 2)).cast("int").alias("tiles")))
    if not big.isEmpty():
        # tile (i, j) gets blocks i and j of the node: every two blocks meet, in bounded tasks
        dealt = dealt.join(big, ["turned", "own"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        block = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        dealt = dealt.withColumn("block", block).select(
            "fp", "turned", "own", "block", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        tile = F.least("block", "other") * 65536 + F.greatest("block", "other")
    else:
        tile = F.lit(0)
    task = F.shiftleft(F.col("own") * 2 + F.col("turned"), 32) + tile
    rows = dealt.select(task.alias("task"), "own", "fp", "turned")
    rows = rows.repartition("task").sortWithinPartitions("task", "turned", "own")
    return rows.mapInArrow(lambda bs: _joined(bs, p, max_bits, node_rows), "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the smallest node it reaches.

    Alternates large-star (neighbours larger than a node are hung on its smallest
    neighbour) and small-star (the smaller ones are), each round stored; the edges end as
    stars."""
    edges = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        hung = small.groupBy("u").count()
        inner = hung.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        if hung.filter("count > 1").unionByName(inner).isEmpty():      # all edges are stars now
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = small


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3,
                    max_bits: int = 3, key: Column | None = None) -> DataFrame:
    """(doc_id, fp, component_id, root) per row: the smallest doc_id its fingerprint reaches, and the
    smallest fingerprint, which names the component also where ids are null or repeated.
    ``key``: a column of docs to carry along as ``key``."""
    rows = cut_lineage(fingerprints(docs, doc_id, text, words, key))
    facts = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    root = components(links(facts.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    rooted = facts.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut_lineage(rooted)
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("g"))
    n = facts.count()
    by_fp = attach_facts(rooted, cut_lineage(groups), "root", "g", n).select("fp", "n", "component_id", "root")
    total = rows.count()
    out = attach_facts(rows, cut_lineage(by_fp), "fp", "n", total)
    return out.select("doc_id", "fp", "component_id", "root", *(["key"] if key is not None else []))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3,
                         max_bits: int = 3) -> DataFrame:
    """docs with one row of each component: that of the smallest id (a null id is the largest),
    of equal ids that of the smallest text digest.  Texts do not move."""
    key = content_key(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))
    found = near_duplicates(docs, doc_id, text, words, max_bits, key)
    rows = cut_lineage(found.groupBy("root", "key", "doc_id").agg(F.count(F.lit(1)).alias("n")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("best")
    groups = cut_lineage(rows.groupBy("root").agg(best, F.count(F.lit(1)).alias("g")))
    total = rows.count()
    keys = attach_facts(rows, groups, "root", "g", total).filter("g > 1 or n > 1")
    keys = keys.select("key", "n", (F.col("key") == F.col("best")).alias("kept"))
    return without(docs, key, cut_lineage(keys), total)
