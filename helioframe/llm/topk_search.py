"""Exact top-k inner-product search: distributed histogram selection over whole-number codes.

Every component x becomes floor(256 * x); a score is the inner product of two code vectors.  Queries and candidates of one
length are dealt to blocks by hash, and every (query block, candidate block) pair is one cogrouped task of bounded memory
that scores all its pairs.  No score leaves a task before it is known to matter:

1. Cauchy-Schwarz gives every query a range [low, high) that holds all its scores.  A round cuts it into ``bins`` bins; every
   task counts its scores by bin, from the top down to the bin where it alone reaches k.  Lower bins of that task cannot hold
   the global k-th score, so the summed counts are right wherever they are used.  The bin where the running sum over all
   tasks reaches k becomes the new range, and ``above`` the count over it.  After ceil(log_bins(range)) rounds (2 for
   unit vectors) the range is one whole number: the exact k-th score of the query.
2. The last pass sends the scores above it (fewer than k in all) and, of the scores equal to it, every task's k
   smallest ids.  One window a query ranks them: higher score first, then the smaller id.

Products run in float32 or float64 where the bound on every partial sum is under 2**24 or 2**53, so they are exact, else in
whole numbers.  Between rounds only (low, high, above) per query is kept, as a table in the shared folder.

Defined cases: null vectors and vectors with a null or non-finite component take no part, neither as query nor as candidate;
an empty vector scores 0 against other empty ones; vectors of different length are not compared; codes beyond 64 bits and
scores beyond 2**61 saturate; rows that share an id are rows of their own (each is a candidate for the others, and a query of its own);
a null id is no query and ranks last among ties; queries with no candidate give no rows; fewer than k candidates: all of them;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

K = 5
SCALE = 256
BINS = 1024
#: Components of one block of candidates or queries.
TILE = 1 << 19
#: Codes and scores saturate here, so that a range of scores fits into 64 bits.
EDGE = 1 << 61


def codes(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, null where the vector takes no part."""
    known = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(known, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def coded(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, vec_id, dim, small, large, norm): the vectors that take part; ``large`` only where a code needs over 16 bits."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), codes(F.col(f"`{embedding}`"), scale).alias("code")).where("code is not null")
    fits = F.forall("code", lambda c: (c >= -32768) & (c <= 32767))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.size("code").alias("dim"),
        F.when(fits, F.col("code").cast("array<smallint>")).alias("small"), F.when(~fits, F.col("code")).alias("large"),
        F.sqrt(F.aggregate("code", F.lit(0.0), lambda a, c: a + c.cast("double") * c)).alias("norm"))


def matrix(t: pa.Table) -> np.ndarray:
    """The code vectors of a block as int64 rows."""
    dim = t["dim"][0].as_py()
    out = np.zeros((t.num_rows, dim), np.int64)
    for name in ("small", "large"):
        column = t[name].combine_chunks()
        at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        if len(at) and dim:
            out[at] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
    return out


def products(q: np.ndarray, c: np.ndarray):
    """A function from a slice of queries to its exact scores against all of ``c``."""
    bound = q.shape[1] * int(np.abs(q.astype(float)).max(initial=0)) * int(np.abs(c.astype(float)).max(initial=0))
    if bound < 1 << 53:
        kind = np.float32 if bound < 1 << 24 else np.float64
        left, right = q.astype(kind), np.ascontiguousarray(c.T.astype(kind))
        return lambda s: (left[s] @ right).astype(np.int64)
    if bound < EDGE:
        return lambda s: q[s] @ c.T
    left, right = q.astype(object), c.T.astype(object)
    return lambda s: np.clip(left[s] @ right, -EDGE, EDGE).astype(np.int64)


def _tiles(rows: DataFrame, tile: int) -> DataFrame:
    """(dim, query blocks, candidate blocks, longest) per vector length."""
    per = F.greatest(F.lit(64), F.floor(F.lit(tile) / F.greatest("dim", F.lit(1))))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / per)).cast("int")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking"), F.max("norm").alias("longest"))
    return cut_lineage(sizes.select("dim", blocks(F.col("n")).alias("cblocks"), blocks(F.col("asking")).alias("qblocks"), "longest"), "blocks")


def _scored(state: DataFrame, rows: DataFrame, blocks: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel(queries, candidates)`` on every pair of a query block and a candidate block of one length."""
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = state.join(blocks, "dim").withColumn("qb", dealt("qblocks")).withColumn("cb", every("cblocks"))
    gives = rows.join(blocks, "dim").withColumn("cb", dealt("cblocks")).withColumn("qb", every("qblocks"))
    gives = gives.select(*[F.col(c).alias(c) for c in ("row", "vec_id", "dim", "small", "large", "qb", "cb")])  # new columns: both sides read one table
    return asks.groupBy("dim", "qb", "cb").cogroup(gives.groupBy("dim", "qb", "cb")).applyInArrow(kernel, schema)


def _each(q: pa.Table, c: pa.Table, chunk: int = 1 << 21):
    """(query position, its scores, itself left out) for every query of the block."""
    score = products(matrix(q), matrix(c))
    own = {r: i for i, r in enumerate(c["row"].to_pylist())}
    rows = q["row"].to_pylist()
    step = max(1, chunk // c.num_rows)
    for at in range(0, q.num_rows, step):
        for i, line in enumerate(score(slice(at, at + step)), at):
            me = own.get(rows[i])
            yield i, line, np.arange(len(line)) if me is None else np.delete(np.arange(len(line)), me)


def _histogram(k: int, bins: int):
    """Counts by bin of a query's range, from the top down to the bin where this block alone reaches k."""

    def count(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if q.num_rows and c.num_rows:
            rows, low, high = (q[n].to_numpy() for n in ("row", "low", "high"))
            for i, line, at in _each(q, c):
                s = line[at]
                s = s[(s >= low[i]) & (s < high[i])]
                if len(s) > k:
                    s = s[s >= s[np.argpartition(s, len(s) - k)[len(s) - k]] - _width(low[i], high[i], bins)]
                bin_, n = np.unique((s - low[i]) // _width(low[i], high[i], bins), return_counts=True)
                first = max(0, len(n) - int(np.searchsorted(np.cumsum(n[::-1]), k)) - 1)
                out.append((np.full(len(n) - first, rows[i]), bin_[first:], n[first:]))
        made = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (zip(*out) if out else ([], [], []))]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("row", "bin", "n"), made)})

    return count


def _width(low, high, bins: int) -> int:
    return max(1, -(-(int(high) - int(low)) // bins))


def _winners(k: int):
    """Scores above the k-th one, and the k smallest ids of those equal to it."""

    def take(q: pa.Table, c: pa.Table) -> pa.Table:
        asked, found, scores = [], [], []
        if q.num_rows and c.num_rows:
            low, ids = q["low"].to_numpy(), c["vec_id"].to_pandas().to_numpy(dtype=object)
            known = np.array([x is not None and x == x for x in ids])
            order = np.array([int(x) if ok else 0 for x, ok in zip(ids, known)], np.int64)
            for i, line, at in _each(q, c):
                s = line[at]
                over, ties = at[s > low[i]], at[s == low[i]]
                if len(over) > k:  # only where low is the end of the range, with fewer than k candidates above it in all
                    raise ValueError("more scores above the k-th one than k")
                ties = ties[np.lexsort((order[ties], ~known[ties]))[:k]]
                for j in (*over.tolist(), *ties.tolist()):
                    asked.append(i)
                    found.append(int(order[j]) if known[j] else None)
                    scores.append(int(line[j]))
        rows = q["row"].to_numpy()[asked] if asked else []
        return pa.table({"row": pa.array(rows, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.int64())})

    return take


def search(vectors: DataFrame, queries: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, bins: int = BINS, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` (a condition on ``vec_id``) holds, its k best others."""
    rows = coded(vectors, vec_id, embedding, scale).withColumn("asks", F.coalesce(queries, F.lit(False)))
    rows = cut_lineage(rows, "codes")
    blocks = _tiles(rows, tile)
    asking = rows.where("asks").join(blocks.select("dim", "longest"), "dim")
    reach = F.ceil(F.least(F.col("norm") * F.col("longest") * (1 + 1e-9) + 1, F.lit(float(EDGE)))).cast("long")
    asking = asking.select("row", F.col("vec_id").alias("query_id"), "dim", "small", "large", (-reach).alias("low"), (reach + 1).alias("high"), F.lit(0).cast("long").alias("above"))
    state = cut_lineage(asking.select("row", "low", "high", "above"), "ranges")
    asking = asking.drop("low", "high", "above")
    while (state.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0) > 1:
        counts = _scored(asking.join(state, "row"), rows, blocks, _histogram(k, bins), "row long, bin long, n long").groupBy("row", "bin").agg(F.sum("n").alias("n"))
        reached = counts.join(state, "row").withColumn("upto", F.col("above") + F.sum("n").over(Window.partitionBy("row").orderBy(F.desc("bin"))))
        there = reached.where(f"upto >= {k}").groupBy("row").agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("over")), "bin").alias("b"))
        width = F.expr(f"(high - low + {bins - 1}) div {bins}")
        low = F.col("low") + F.col("b.bin") * width
        # fewer than k candidates: the lowest end of the range lets all of them through
        state = cut_lineage(state.join(there, "row", "left").select(
            "row", F.coalesce(low, F.col("low")).alias("low"), F.when(F.col("b").isNull(), F.col("low") + 1).otherwise(F.least(low + width, F.col("high"))).alias("high"),
            F.coalesce(F.col("b.over"), F.col("above")).alias("above")), "ranges")
    won = _scored(asking.join(state, "row"), rows, blocks, _winners(k), "row long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = won.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
    return ranked.join(asking.select("row", "query_id"), "row").select("query_id", "rank", "vec_id", "score")
