"""Embedding near-duplicates: int8 tile products with a rigorous error bound, full precision only where the bound is open.

A vector x of length 1 is stored as s * q + e, q whole numbers of -127..127 and s = max|x| / 127.  With a = |s q| and
d = |e| of either side, ``|cos - s1 s2 q1.q2| <= a1 d2 + a2 d1 + d1 d2`` (Cauchy-Schwarz), so a pair whose product plus this bound
stays under the threshold is no link; only the others are computed again in double precision.  Products of whole numbers
are exact: float32 holds sums under 2**24, and longer vectors are cut into pieces of 1,000 components.

Equal vectors of a label become one class first (a grouped minimum and count).  The classes of each (label, length) are
dealt to blocks of about ``tile`` by hash, and every pair of blocks is one tile, so a label of any size is spread over many
tasks of bounded memory.  A tile gives two rows a vector at most: links counted, and a spanning forest of its links (from
which ``components`` finds the same components as from all links); pairs inside a group never leave it.

Defined cases: null, empty and zero vectors, vectors with null or non-finite components and rows without a label link with
nothing; lengths differ: no link; rows without an id count as links of others but have no component of their own; rows that
share an id are judged one by one; empty tables give no rows; input columns travel inside ``row`` and cannot clash.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components

THRESHOLD = 0.98
TILE = 2048
EXACT = 1000
SLACK = 1e-9


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, step, length of the coded vector, length of the rest) of unit vectors; lengths rounded upwards."""
    step = np.abs(units).max(1) / 127
    codes = np.rint(units / step[:, None]).astype(np.int8)
    coded = codes * step[:, None]
    up = lambda v: np.linalg.norm(v, axis=1) * (1 + 1e-12) + 1e-15
    return codes, step, up(coded), up(units - coded)


def open_pairs(left, right, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that the codes and their error bounds do not rule out."""
    (q1, s1, a1, d1), (q2, s2, a2, d2) = left, right
    dot = np.zeros((len(q1), len(q2)), np.float64)
    for at in range(0, q1.shape[1], EXACT):
        dot += q1[:, at : at + EXACT].astype(np.float32) @ q2[:, at : at + EXACT].astype(np.float32).T
    dot *= s1[:, None]
    dot *= s2[None, :]
    dot += a1[:, None] * d2[None, :]
    dot += d1[:, None] * (a2 + d2)[None, :]
    return np.nonzero(dot >= threshold - SLACK)


def _tile(threshold: float, chunk: int = 512):
    def links(table: pa.Table) -> pa.Table:
        frame = table.to_pandas()
        x = np.stack(frame["vector"].to_numpy()).astype(np.float64)
        norms = np.sqrt((x * x).sum(1))
        units = x / norms[:, None]
        codes = quantise(units)
        side, node, times = frame["side"].to_numpy(), frame["node"].to_numpy(), frame["times"].to_numpy()
        rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == frame["other"].to_numpy()[0])
        same, count, root = len(np.unique(side)) == 1, np.zeros(len(frame), np.int64), np.arange(len(frame))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        forest = []
        for at in range(0, len(rows), chunk):
            mine = rows[at : at + chunk]
            i, j = open_pairs([c[mine] for c in codes], [c[columns] for c in codes], threshold)
            i, j = mine[i], columns[j]
            if same:
                i, j = i[i < j], j[i < j]
            for cut in range(0, len(i), 1 << 16):
                a, b = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
                linked = np.einsum("ij,ij->i", x[a], x[b]) / (norms[a] * norms[b]) >= threshold
                a, b = a[linked], b[linked]
                np.add.at(count, a, times[b])
                np.add.at(count, b, times[a])
                roots = np.array([find(k) for k in range(len(root))]) if len(a) else root
                differ = roots[a] != roots[b]
                for p, q in zip(a[differ].tolist(), b[differ].tolist()):
                    if (p0 := find(p)) != (q0 := find(q)):
                        root[max(p0, q0)] = min(p0, q0)
                        forest.append((node[p], node[q]))
        seen = np.flatnonzero(count)
        pairs = np.array(forest, np.int64).reshape(-1, 2)
        none = np.zeros(len(pairs), np.int64)
        return pa.table({"a": np.concatenate([node[seen], pairs[:, 0]]), "b": np.concatenate([node[seen], pairs[:, 1]]), "links": np.concatenate([count[seen], none])})

    return links


def valid(vector) -> F.Column:
    """A vector that can have links: not null or empty, all components finite and known, not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def linked(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: ``row`` (its columns but the embedding), n_links, component_id, kept."""
    keep = [c for c in vectors.columns if c != embedding]
    rows = vectors.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{vec_id}`").cast("long").alias("id"),
        F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    rows = rows.withColumn("vector", F.when(valid(F.col("vector")) & F.col("label").isNotNull(), F.col("vector")))
    # equal vectors have equal bytes once -0.0 is 0.0; the node of a class is its smallest id
    rows = rows.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))
    rows = cut_lineage(rows.withColumn("mark", F.when(F.col("vector").isNotNull(), F.sha2(F.concat_ws(",", "label", F.col("vector").cast("array<string>")).cast("binary"), 256))), "vectors")
    groups = rows.where("mark is not null").groupBy("mark").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    nodes = cut_lineage(groups.withColumn("node", F.xxhash64("mark")).withColumn("dim", F.size("vector")), "nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).alias("blocks"))
    dealt = nodes.join(cut_lineage(sizes, "sizes"), ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("mark", F.lit(1)), F.col("blocks")))
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("partner")
    tiles = dealt.select("label", "dim", "own", "node", "times", "vector", partner).select(
        "label", "dim", F.least("own", "partner").alias("low"), F.greatest("own", "partner").alias("high"),
        (F.col("own") > F.col("partner")).cast("int").alias("side"), (F.col("own") != F.col("partner")).cast("int").alias("other"), "node", "times", "vector")
    found = cut_lineage(tiles.groupBy("label", "dim", "low", "high").applyInArrow(_tile(threshold), "a long, b long, links long"), "tiles")
    links = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    same = components(found.where("links = 0").select("a", "b")).withColumnRenamed("id", "node").withColumnRenamed("component", "head")
    groups = nodes.select("mark", "node", "least", "times").join(links, "node", "left").join(same, "node", "left")
    groups = cut_lineage(groups.withColumn("head", F.coalesce("head", "node")), "groups")
    smallest = groups.groupBy("head").agg(F.min("least").alias("component_id"))
    groups = groups.join(smallest, "head").select("mark", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = rows.select("row", "id", "mark").join(groups, "mark", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
