"""Entropy, information and lag measures keyed by day or window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.stats import corr
from .periodicity import arrays_of


def equal_bins(value: str, bins: int, over) -> Column:
    """Equal-width bin of ``value`` between the group's minimum and maximum (constant groups: 0-based floor)."""
    x = F.col(value)
    lo, hi = F.min(x).over(over), F.max(x).over(over)
    scaled = F.when(hi > lo, (x - lo) / (hi - lo) * bins).otherwise(x)
    return F.least(F.greatest(F.floor(scaled), F.lit(0)), F.lit(bins - 1)).cast("bigint")


def mutual_information(df: DataFrame, keys, x: str, y: str, bins=16, least=10, out="mi") -> DataFrame:
    """Binned mutual information in bits.  After the first count at most bins^2 cells per key remain."""
    group = Window.partitionBy(*keys)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumn("_i", equal_bins(x, bins, group)).withColumn("_j", equal_bins(y, bins, group))
    cells = d.groupBy(*keys, "_i", "_j").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.withColumn("n", F.sum("c").over(group))
    cells = cells.withColumn("ci", F.sum("c").over(Window.partitionBy(*keys, "_i"))).withColumn("cj", F.sum("c").over(Window.partitionBy(*keys, "_j")))
    term = F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n") / (F.col("ci") * F.col("cj")))
    return cells.groupBy(*keys).agg(F.when(F.max("n") >= least, F.sum(term)).otherwise(0.0).alias(out))


def transfer_entropy(df: DataFrame, keys, source: str, target: str, k=1, bins=16, order="bin", least=10, out="te") -> DataFrame:
    """Transfer entropy source -> target in bits with history length k."""
    w = Window.partitionBy(*keys).orderBy(order)
    group = Window.partitionBy(*keys)
    d = df.withColumn("_next", F.lead(target, k).over(w)).where(F.col("_next").isNotNull() & F.col(source).isNotNull() & F.col(target).isNotNull())
    d = d.withColumn("_s", equal_bins(source, bins, group)).withColumn("_t", equal_bins(target, bins, group)).withColumn("_u", equal_bins("_next", bins, group))
    cells = d.groupBy(*keys, "_s", "_t", "_u").agg(F.count(F.lit(1)).alias("c"))
    over = lambda *extra: F.sum("c").over(Window.partitionBy(*keys, *extra))
    cells = cells.withColumn("n", over()).withColumn("st", over("_s", "_t")).withColumn("tu", over("_t", "_u")).withColumn("t", over("_t"))
    term = F.col("c") / F.col("n") * F.log2(F.col("c") / F.col("st") / (F.col("tu") / F.col("t")))
    return cells.groupBy(*keys).agg(F.when(F.max("n") >= least, F.sum(term)).otherwise(0.0).alias(out))


#: Candidate pairs that are compared at a time.
PAIRS = 1 << 21


def close_pairs(points: np.ndarray, r: float) -> int:
    """Number of pairs of rows closer than ``r`` in every coordinate.

    Equal rows are counted once with their multiplicity.  The others are sorted into cells of width ``r`` by the first
    coordinate and by the second one inside a cell, so the candidates of a row are two short runs that binary search finds;
    only they are compared, a bounded number at a time.  One coordinate needs the binary search alone.
    """
    rows, times = np.unique(points, axis=0, return_counts=True)
    total = int((times * (times - 1) // 2).sum())
    weight = np.concatenate(([0], np.cumsum(times)))
    if rows.shape[1] == 1:
        x = rows[:, 0]
        ends = np.searchsorted(x, x + r, "right")
        over = x[ends - 1] - x >= r  # the sum may round onto the next value
        while over.any():
            ends = ends - over
            over = x[ends - 1] - x >= r
        return total + int((times * (weight[ends] - weight[1:])).sum())
    cell = np.floor((rows[:, 0] - rows[0, 0]) / r).astype(np.int64)
    order = np.lexsort((rows[:, 1], cell))
    rows, times, cell = rows[order], times[order], cell[order]
    first = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
    last = np.append(first[1:], len(cell))
    slack = r * (1 + 1e-9)
    lows, highs, owners = [], [], []
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
        y = rows[a:b, 1]
        lows.append(np.arange(a + 1, b + 1))
        highs.append(a + np.searchsorted(y, y + slack, "right"))
        owners.append(np.arange(a, b))
        if k + 1 < len(first) and cell[first[k + 1]] == cell[a] + 1:
            c, d = int(first[k + 1]), int(last[k + 1])
            z = rows[c:d, 1]
            lows.append(c + np.searchsorted(z, y - slack))
            highs.append(c + np.searchsorted(z, y + slack, "right"))
            owners.append(np.arange(a, b))
    low, owner = np.concatenate(lows), np.concatenate(owners)
    size = np.maximum(np.concatenate(highs) - low, 0)
    upto = np.cumsum(size)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = size[at:end]
        i = np.repeat(owner[at:end], n)
        j = np.arange(n.sum()) + np.repeat(low[at:end] - np.cumsum(n) + n, n)
        near = np.ones(len(i), bool)
        for d in range(rows.shape[1]):
            near &= np.abs(rows[i, d] - rows[j, d]) < r
        total += int((times[i[near]] * times[j[near]]).sum())
        at = end
    return total


@F.pandas_udf(T.DoubleType())
def sample_entropy(arr: pd.Series, m: pd.Series, factor: pd.Series) -> pd.Series:
    """-ln(A/B) of template matches of length m+1 and m (Chebyshev distance < factor*std); 0 if undefined.

    One window at a time; matches are counted, never listed.
    """
    def one(x, m, factor):
        x = np.asarray(x, dtype=float)
        n, r = len(x), factor * x.std() if len(x) else 0.0
        if n < m + 5 or r < 1e-10:
            return 0.0
        b, a = (close_pairs(np.lib.stride_tricks.sliding_window_view(x, k)[: n - k], r) for k in (m, m + 1))
        return float(-np.log(a / b)) if a and b else 0.0

    return pd.Series([one(x, int(k), f) for x, k, f in zip(arr, m, factor)])


@F.pandas_udf(T.StructType([T.StructField("r", T.DoubleType()), T.StructField("lag", T.LongType())]))
def lag_scan(x: pd.Series, y: pd.Series, limit: pd.Series) -> pd.DataFrame:
    """Strongest standardised cross-correlation within +-limit samples; positive lag = x later than y.

    NULL for series shorter than twice the limit: too short to tell is not the same as uncorrelated."""
    out = []
    for a, b, m in zip(x, y, limit):
        a, b, m = np.asarray(a, dtype=float), np.asarray(b, dtype=float), int(m)
        n = min(len(a), len(b))
        if n < 2 * m or n == 0:
            out.append((None, None))
            continue
        a, b = a[:n], b[:n]
        a, b = (a - a.mean()) / (a.std() + 1e-10), (b - b.mean()) / (b.std() + 1e-10)
        r = [float(np.dot(a[k:], b[: n - k]) if k >= 0 else np.dot(a[: n + k], b[-k:])) / n for k in range(-m, m + 1)]
        best = int(np.argmax(np.abs(r)))
        out.append((r[best], best - m))
    return pd.DataFrame(out, columns=["r", "lag"]).astype({"r": "Float64", "lag": "Int64"})


def lag_table(df: DataFrame, keys, x: str, y: str, lags, order="bin") -> DataFrame:
    """corr(x(t), y(t+lag)) for every lag: (keys, lag, r, n).

    One window pass provides all shifted copies; the lag axis is a constant array, so each sample
    yields one row per lag inside its task and the sums combine there.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    shifted = df.select(*keys, F.col(x).alias("_x"), F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), F.lead(y, k).over(w).alias("_y")) if k >= 0
                        else F.struct(F.lit(k).cast("bigint").alias("lag"), F.lag(y, -k).over(w).alias("_y")) for k in lags]).alias("_s"))
    rows = shifted.select(*keys, "_x", F.inline("_s"))
    rows = rows.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    return rows.groupBy(*keys, "lag").agg(corr("_x", "_y").alias("r"), F.count(F.lit(1)).alias("n"))


def strongest_lag(table: DataFrame, keys) -> DataFrame:
    """Lag of the largest |r| (ties: smaller lag first)."""
    top = F.max(F.struct(F.abs("r").alias("a"), (-F.col("lag")).alias("n"), F.col("r").alias("r")))
    return table.where(F.col("r").isNotNull()).groupBy(*keys).agg(top.alias("_t")).select(*keys, F.col("_t.r").alias("r"), (-F.col("_t.n")).alias("lag"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("r", T.DoubleType()), T.StructField("lag", T.LongType())])))
def _windowed_lags(x: pd.Series, y: pd.Series, half: pd.Series, limit: pd.Series) -> pd.Series:
    """Best lag in the window around every sample: window sums of each lagged product by differences
    of running sums, so the cost is lags * samples and not lags * samples * window."""
    def one(a, b, half, limit):
        a, b, n = np.asarray(a, dtype=float), np.asarray(b, dtype=float), len(a)
        size, out = 2 * half + 1, [None] * n
        mid = np.arange(half, n - half)
        if len(mid) == 0:
            return out
        a, b = a - a.mean(), b - b.mean()
        run = lambda v: np.concatenate([[0.0], np.cumsum(v)])
        span = lambda c, lo, hi: c[hi + 1] - c[lo]
        ca, cb, caa, cbb = run(a), run(b), run(a * a), run(b * b)
        ma, mb = span(ca, mid - half, mid + half) / size, span(cb, mid - half, mid + half) / size
        va = np.maximum(span(caa, mid - half, mid + half) / size - ma * ma, 0)
        vb = np.maximum(span(cbb, mid - half, mid + half) / size - mb * mb, 0)
        best, lag = np.full(len(mid), -np.inf), np.zeros(len(mid), dtype=int)
        for k in range(-limit, limit + 1):
            prod = np.zeros(n)
            prod[max(k, 0): n + min(k, 0)] = a[max(k, 0): n + min(k, 0)] * b[max(-k, 0): n - max(k, 0)]
            lo, hi = mid - half + max(k, 0), mid + half + min(k, 0)
            cov = span(run(prod), lo, hi) - ma * span(cb, lo - k, hi - k) - mb * span(ca, lo, hi) + (size - abs(k)) * ma * mb
            r = cov / (np.sqrt(va * vb) * size + 1e-30)
            better = r > best + 1e-12
            best, lag = np.where(better, r, best), np.where(better, k, lag)
        varied = (va > 1e-12 * (a @ a) / n) & (vb > 1e-12 * (b @ b) / n)
        for i, r, k in zip(mid[varied], best[varied], lag[varied]):
            out[i] = {"r": float(r), "lag": int(k)}
        return out

    return pd.Series([one(*v) for v in zip(x, y, half, limit)])


def rolling_lag(df: DataFrame, x: str, y: str, half: int, max_lag: int, keys=("day",), good: str | None = None) -> DataFrame:
    """Best cross-correlation lag of x against y within +-half samples of every (good) row; NULL where the window is cut by the
    end of the series or one side does not vary."""
    arr = arrays_of(df, keys, [x, y])
    best = arr.select(*keys, F.posexplode(_windowed_lags(x, y, F.lit(half), F.lit(max_lag))).alias("bin", "b"))
    best = best.select(*keys, F.col("bin").cast("bigint").alias("bin"), F.col("b.r").alias("xcorr"), F.col("b.lag").alias("xcorr_lag"))
    if good is None:
        return best
    return best.join(df.where(F.col(good)).select(*keys, "bin"), [*keys, "bin"], "left_semi")


def over_days(days: DataFrame, measures, lag: str, digits=4) -> DataFrame:
    """One row: number of days, mean and deviation of each measure over the days, and the middle lag."""
    from .ranking import with_totals

    stats = days.agg(F.count(F.lit(1)).alias("days"), *[f(m).alias(f"{n}_{m}") for m in measures for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    stats = stats.select("days", *[F.round(F.col(f"{n}_{m}") + 1e-9, digits).alias(f"{n}_{m}") for m in measures for n in ("mean", "std")])
    half = F.floor((F.count(lag) - 1) * 0.5).cast("int")
    middle = days.agg(F.get(F.sort_array(F.collect_list(lag)), half).cast("bigint").alias(f"middle_{lag}"))  # one value a day
    return with_totals(stats, middle)
