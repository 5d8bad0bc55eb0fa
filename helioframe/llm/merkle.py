"""Merkle manifest of a dataset: one tree per group, one tree over the groups, a proof for every row.

A leaf is the hash of the row's fields.  Inside a group leaves stand in order; while several nodes remain, every ``ARITY``
consecutive ones become the hash of their digests.  The last node of each group is its subroot, and the subroots form a tree
of the same kind, whose last node is the root.

Checkpoint and recompute: of the levels only every ``STEP``-th is kept, as a table of aligned subtrees (one row holds the up to
ARITY**STEP nodes below one kept ancestor).  ``proofs`` goes down from the root: each subtree row meets the path of its ancestor
(one small row), regenerates the levels between from the nodes that it stores, writes the siblings on the way of each
node, and drops the levels again.  So a path is shipped once per subtree, never per row.

Leaves get their place by a range partitioning on (group, order): positions inside a part, plus the counts of the parts before
(one row per part and group).  A group with most of the rows is spread over many parts, and no window runs over its rows.
All digests are made by built-in functions; digests are lowercase hex text.

Defined cases: a null field hashes as ``-``; rows without a group are a group of their own that comes first; rows with equal
order stand by their leaf, null order first, and repeated rows keep a leaf each; a group of one row has the leaf as its subroot and
no siblings; an empty table gives no rows; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ARITY = 8
STEP = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Hash of ``-`` for a null, else UTF-8 byte count, colon and value, of every field in turn."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return digest(F.concat(*map(value, fields)))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends the position of a row among those of its group in a sorted part."""
    group, n = None, 0
    for batch in batches:
        place = []
        for g in batch.column(0).to_pylist():
            group, n = (g, n + 1) if g == group else (g, 0)
            place.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])


def numbered(nodes: DataFrame) -> DataFrame:
    """(grp, idx, node, data): the rows of (grp, ord, node, data) counted from 0 inside each group, in the order of (ord, node)."""
    parts = nodes.repartitionByRange("grp", "ord", "node").sortWithinPartitions("grp", "ord", "node").select("grp", "node", "data", F.spark_partition_id().alias("part"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    parts = cut_lineage(parts.mapInArrow(_places, f"{kind}, place long"), "places")
    counts = parts.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a part
    base = cut_lineage(counts.select("grp", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    return parts.join(base, ["grp", "part"]).select("grp", (F.col("base") + F.col("place")).alias("idx"), "node", "data")


def subtrees(nodes: DataFrame, step: int = STEP) -> DataFrame:
    """(grp, sub, rise, nodes): aligned subtrees of (grp, idx, node, data) and the levels that they climb."""
    wide = ARITY**step
    counts = cut_lineage(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "counts")
    levels = F.lit(step)
    for up in reversed(range(step)):
        levels = F.when(F.col("n") <= ARITY**up, up).otherwise(levels)
    rows = F.array_sort(F.collect_list(F.struct("idx", "node", "data"))).alias("nodes")
    grouped = nodes.groupBy("grp", F.floor(F.col("idx") / wide).alias("sub")).agg(rows)
    return grouped.join(counts, "grp").select("grp", "sub", levels.alias("rise"), "nodes")


def _runs(level: Column) -> Column:
    """The digests of a level in runs of ARITY."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int")), lambda r: F.slice(level, r * ARITY + 1, F.lit(ARITY)))


def _parents(level: Column) -> Column:
    return F.transform(_runs(level), lambda run: digest(F.array_join(run, "")))


def _regenerated(trees: DataFrame, step: int = STEP) -> DataFrame:
    """Adds l0 to l<step>: the stored digests and the levels above them; past ``rise`` a level repeats its one node."""
    out = trees.withColumn("l0", F.transform("nodes", lambda x: x["node"]))
    for k in range(step):
        out = out.withColumn(f"l{k + 1}", F.when(F.col("rise") > k, _parents(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return out


class Tree:
    """The kept levels of one forest, lowest first, and its subroots (grp, node)."""

    def __init__(self, nodes: DataFrame, step: int = STEP) -> None:
        """``nodes``: (grp, ord, node, data), grp without nulls."""
        self.step, self.levels = step, []
        now = numbered(nodes)
        while True:
            self.levels.append(cut_lineage(subtrees(now, step), f"level{len(self.levels) * step}"))
            tops = _regenerated(self.levels[-1], step).select("grp", F.col("sub").alias("idx"), F.element_at(f"l{step}", 1).alias("node"), F.lit(None).cast("string").alias("data"))
            now = cut_lineage(tops, "tops")
            if (now.agg(F.max("idx")).first()[0] or 0) == 0:
                self.subroots = now.select("grp", "node")
                return

    def proofs(self, above: DataFrame) -> DataFrame:
        """(grp, node, data, path) of every lowest node; ``above`` has the path (grp, path) of each subroot.

        A path is an array of (left, right): the siblings before and after the node, level by level, each joined to one text."""
        paths = above.select("grp", F.lit(0).cast("long").alias("sub"), F.col("path").alias("up"))
        for depth, trees in reversed(list(enumerate(self.levels))):
            held = _regenerated(trees.join(paths, ["grp", "sub"]), self.step)
            runs = F.posexplode(_runs(F.col("nodes"))).alias("at", "run")
            held = held.select("grp", "rise", "sub", "up", *[f"l{k}" for k in range(1, self.step)], runs)
            over = [self._siblings(F.slice(F.col(f"l{k}"), F.floor(F.col("at") / ARITY**k).cast("int") * ARITY + 1, F.lit(ARITY)), F.floor(F.col("at") / ARITY ** (k - 1)) % ARITY, k) for k in range(1, self.step)]
            held = held.select("grp", "rise", "run", F.concat(*over, F.col("up")).alias("up"))
            held = held.select("grp", "rise", "run", "up", F.posexplode("run").alias("at", "x"))
            first = self._siblings(F.transform("run", lambda x: x["node"]), F.col("at"), 0)
            held = held.select("grp", "x", F.concat(first, F.col("up")).alias("path"))
            if depth:
                paths = cut_lineage(held.select("grp", F.col("x.idx").alias("sub"), F.col("path").alias("up")), "paths")
        return held.select("grp", "x.node", "x.data", "path")

    @staticmethod
    def _siblings(run: Column, spot: Column, level: int) -> Column:
        """The path entry of the node at ``spot`` of its run; none where the group has ended below this level."""
        spot = spot.cast("int")
        sides = F.struct(F.array_join(F.slice(run, F.lit(1), spot), "").alias("left"), F.array_join(F.slice(run, spot + 2, F.lit(ARITY)), "").alias("right"))
        return F.when(F.col("rise") > level, F.array(sides)).otherwise(F.array().cast("array<struct<left:string,right:string>>"))


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, node, lambda a, s: digest(F.concat(s["left"], a, s["right"])))


def manifest(rows: DataFrame, fields: list[str] = list(FIELDS), group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, step: int = STEP) -> DataFrame:
    """One row per input row: data (order and the columns ``carry``), leaf, subroot, root, path.

    ``fields`` are hashed in this order; ``carry`` columns are computed from the row and travel with the leaf."""
    data = F.struct(F.col(f"`{order}`").alias("order"), *[c.alias(n) for n, c in (carry or {}).items()])
    # the key orders as the group does, null first
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))
    leaves = rows.select(key.alias("grp"), F.col(f"`{order}`").alias("ord"), leaf([F.col(f"`{c}`") for c in fields]).alias("node"), data.alias("data"))
    tree = Tree(cut_lineage(leaves, "leaves"), step)
    top = Tree(tree.subroots.select(F.lit("").alias("grp"), F.col("grp").alias("ord"), "node", F.col("grp").alias("data")), step)
    none = F.array().cast("array<struct<left:string,right:string>>")
    heads = top.proofs(top.subroots.select("grp", none.alias("path"))).join(top.subroots.select("grp", F.col("node").alias("root")), "grp")
    heads = cut_lineage(heads.select(F.col("data").alias("grp"), F.col("node").alias("subroot"), "root", "path"), "heads")
    return tree.proofs(heads.select("grp", "path")).join(heads.select("grp", "subroot", "root"), "grp").select("data", F.col("node").alias("leaf"), "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, level by level from the leaf up, each level from left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))
