"""A Merkle manifest of a dataset, with an inclusion proof for every row by pointer jumping.

Every row is a leaf, the SHA-256 of its fields.  The leaves of a group ascend by id; runs
of ``arity`` successive nodes become one node, level by level, until one is left, the
group's subroot; the subroots, ordered by group, make a tree of the same kind, whose last
node is the root.  A level is one grouped aggregate over (tree, run) -- at most ``arity``
rows a key, whatever the size of a group -- and is stored.

A proof is the list of siblings on the way up.  Each node first holds a pointer to its
parent and the segment of its siblings below that parent; in every round the table of
pointers joins itself, so that a node takes over its ancestor's pointer and appends the
ancestor's segment, which doubles the distance, until all point at the root.  The leaves
of a run share everything above their run, so the table starts at the parents of leaves
and each leaf puts its own siblings before.  An ancestor at distance d is met by up to
``arity ** d`` nodes, but the nodes so far up are few: they are broadcast once their
count proves them small, and before that a key has few rows.

Digests are 32 bytes in tables; hashing reads them as lowercase hex text.

Rows: a null field is ``-``; a null group is a group of its own, before all others; null
ids come first in their group; rows of one id go by digest, equal rows in any order (their
results are the same); a group of one row has its leaf as subroot, a table of one
group its subroot as root; an empty table gives no rows; extra columns are ignored; texts are
hashed whole, of any length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.operators.ordered import positions

from .common import attach_facts, stored

ARITY = 16
BROADCAST_BYTES = 64 << 20
TOP = -1                        # the tree over the subroots
POINTERS = ("tree bigint, level int, pos bigint, up_tree bigint, up_level int, up_pos bigint, "
            "steps array<struct<at:int,run:array<binary>>>, subroot binary")


def field(value: Column) -> Column:
    """One field of a leaf: ``-``, or its UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def hexed(digests: Column) -> Column:
    """An array of digests as one lowercase hex text."""
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


def node_digest(digests: Column) -> Column:
    return F.unhex(F.sha2(hexed(digests), 256))


def group_key(group: Column) -> Column:
    """A text that is never null and orders as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _levels(nodes: DataFrame, arity: int, first: int, size: int, kind: str) -> tuple[list[DataFrame], DataFrame, int]:
    """Builds trees from ``nodes`` (tree, level, pos, n: nodes of that level, digest) at level
    ``first``, of ``size`` nodes at most in one tree.

    Gives the stored runs (tree, level and pos of the node they make, digests) of each level, the last
    nodes of all trees, and the number of the level above the highest."""
    runs, tops, level = [], [], first
    while size > 1:
        tops.append(nodes.filter("n = 1"))
        run = nodes.filter("n > 1").withColumn("run", F.floor(F.col("pos") / arity).cast("bigint"))
        run = run.groupBy("tree", "run", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("m"))
        run = stored(run.select("tree", F.lit(level + 1).alias("level"), F.col("run").alias("pos"),
                                F.ceil(F.col("n") / arity).cast("bigint").alias("n"), F.col("m.digest").alias("run")),
                     f"{kind}-{level}")
        runs.append(run)
        nodes = run.withColumn("digest", node_digest(F.col("run"))).drop("run")
        size, level = -(-size // arity), level + 1
    tops.append(nodes)
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return runs, out, level


def _pointers(runs: DataFrame, arity: int) -> DataFrame:
    """Each member of a run: a pointer to the node that the run makes, and the step to it."""
    member = runs.select("tree", "level", "pos", "run", F.posexplode("run").alias("at", "digest"))
    return member.select("tree", (F.col("level") - 1).alias("level"), (F.col("pos") * arity + F.col("at")).alias("pos"),
                         F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("pos").alias("up_pos"),
                         F.array(F.struct("at", "run")).alias("steps"), "digest")


def jump(pointers: DataFrame, depth: int, arity: int) -> DataFrame:
    """Doubles the distance until every pointer has reached the root, ``depth`` steps away at most."""
    distance = 1
    while distance < depth:
        # what lies ``distance`` above another node of the table
        upper = pointers.filter((F.col("tree") == TOP) | (F.col("level") > distance)).select(
            *(F.col(c).alias(f"_{c}") for c in pointers.columns))
        met = F.broadcast(upper) if upper.count() * distance * arity * 48 <= BROADCAST_BYTES else upper
        same = [F.col(f"up_{c}") == F.col(f"_{c}") for c in ("tree", "level", "pos")]
        both = pointers.join(met, same, "left")
        here = F.col("_tree").isNull()
        pointers = stored(both.select(
            "tree", "level", "pos", *(F.when(here, F.col(f"up_{c}")).otherwise(F.col(f"_up_{c}")).alias(f"up_{c}")
                                      for c in ("tree", "level", "pos")),
            F.when(here, F.col("steps")).otherwise(F.concat("steps", "_steps")).alias("steps"),
            F.coalesce("subroot", "_subroot").alias("subroot")), f"merkle-jump-{distance}")
        distance *= 2
    return pointers


def manifest(docs: DataFrame, leaf: Column, doc_id: str = "doc_id", group: str = "source",
             carry: Mapping[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """One row per row of docs: doc_id, the columns ``carry``, leaf, subroot and root (32 bytes each)
    and ``steps``, the proof: per level the hex text of the siblings ``before`` and ``after``."""
    carry = dict(carry or {})
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("_id"), group_key(F.col(group)).alias("_key"), leaf.alias("_leaf"),
                      *(c.alias(f"c_{n}") for n, c in carry.items()))
    own = stored(own.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    kept = F.struct(F.col("_pos").alias("pos"), F.col("_id").alias("id"), F.col("_leaf").alias("leaf"), *(f"c_{n}" for n in carry))
    numbered = positions(own, ["_key"], ["_id", "_leaf", "_row"], "_pos")
    homes = stored(numbered.groupBy("_key", F.floor(F.col("_pos") / arity).cast("bigint").alias("run"))
                   .agg(F.sort_array(F.collect_list(kept)).alias("m")), "merkle-homes")
    groups = homes.groupBy("_key").agg(F.sum(F.size("m")).alias("n"))
    groups = stored(positions(groups, [], ["_key"], "tree"), "merkle-groups")
    total, trees, largest = groups.agg(F.sum("n"), F.count(F.lit(1)), F.max("n")).first()
    homes = attach_facts(homes, groups, "_key", "n", total or 0)
    # the node a leaf hangs on: its run's, or the leaf itself where it is alone
    lone = F.col("n") == 1
    homes = stored(homes.select("tree", F.when(lone, 0).otherwise(1).alias("level"), F.col("run").alias("pos"),
                                F.ceil(F.col("n") / arity).cast("bigint").alias("n"), "m"), "merkle-homes")
    digest = F.when(F.col("level") == 0, F.col("m.leaf")[0]).otherwise(node_digest(F.col("m.leaf")))
    first = homes.select("tree", "level", "pos", "n", digest.alias("digest"))
    runs, tops, high = _levels(first, arity, 1, -(-(largest or 0) // arity), "merkle-level")
    tops = tops.select("tree", "level", "digest")
    over = tops.select(F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"),
                       F.lit(trees).cast("bigint").alias("n"), "digest")
    over_runs, last, over_high = _levels(stored(over, "merkle-subroots"), arity, 0, trees, "merkle-top")
    root = (last.first() or {"digest": None})["digest"]
    pointers = spark.createDataFrame([], POINTERS)
    none = F.lit(None).cast("binary").alias("subroot")
    for r in [*runs, *over_runs[1:]]:
        pointers = pointers.unionByName(_pointers(r, arity).withColumn("subroot", none).drop("digest"))
    for r in over_runs[:1]:
        # members are the last nodes of the groups' trees: their names are those there
        named = _pointers(r, arity).withColumnRenamed("digest", "subroot").drop("tree", "level")
        named = named.join(tops.select("tree", "level"), named["pos"] == tops["tree"]).withColumn("pos", F.lit(0).cast("bigint"))
        pointers = pointers.unionByName(named)
    pointers = jump(stored(pointers, "merkle-pointers"), high + over_high, arity)
    # texts once per run, before its leaves are told apart
    apart = F.transform(F.coalesce("steps", F.array().cast("array<struct<at:int,run:array<binary>>>")), lambda s: F.struct(
        hexed(F.slice(s["run"], 1, s["at"])).alias("before"), hexed(F.slice(s["run"], s["at"] + 2, arity)).alias("after")))
    whole = F.lit(bytes(root) if root is not None else None).cast("binary")
    up = pointers.select("tree", "level", "pos", "steps", "subroot")
    up = homes.drop("n").join(up, ["tree", "level", "pos"], "left").select(
        "level", "m", F.transform("m", lambda x: F.lower(F.hex(x["leaf"]))).alias("hex"), apart.alias("above"),
        F.coalesce("subroot", whole).alias("subroot"))
    leaves = up.select("*", F.posexplode("m").alias("at", "x"))
    step = F.struct(F.array_join(F.slice("hex", 1, F.col("at")), "").alias("before"),
                    F.array_join(F.slice("hex", F.col("at") + 2, arity), "").alias("after"))
    steps = F.when(F.col("level") == 0, F.col("above")).otherwise(F.concat(F.array(step), "above"))
    return leaves.select(F.col("x.id").alias("doc_id"), *(F.col(f"x.c_{n}").alias(n) for n in carry),
                         F.col("x.leaf").alias("leaf"), "subroot", whole.alias("root"), steps.alias("steps"))


def proof_digest(steps: Column) -> Column:
    """SHA-256 (hex) of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root (hex) that a leaf (hex) and the siblings of a proof give."""
    return F.aggregate(steps, leaf, lambda x, s: F.sha2(F.concat(s["before"], x, s["after"]), 256))
