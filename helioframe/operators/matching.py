"""Event-to-event and event-to-sample matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import sized
from .intervals import bucket_of

CLASS_RANK = {"A": 0, "B": 1, "C": 2, "M": 3, "X": 4}


def candidate_pairs(left: DataFrame, right: DataFrame, tol: int, lt: str, rt: str, on=()) -> DataFrame:
    """Pairs with |lt - rt| <= tol.  The left side visits its own and the two adjacent time buckets,
    which turns the range condition into a hash join; events are few, so pairs are too."""
    l = left.withColumn("_b", F.explode(F.array(*[bucket_of(lt, tol) + k for k in (-1, 0, 1)])))
    r = right.withColumn("_b", bucket_of(rt, tol))
    return l.join(r, ["_b", *on]).where(F.abs(F.col(lt) - F.col(rt)) <= tol).drop("_b")


def mutual_nearest(left: DataFrame, right: DataFrame, tol: int, lt="lt", rt="rt", lid="lid", rid="rid", on=()) -> DataFrame:
    """One-to-one pairs in which each side is the other's nearest (ties: earlier time, smaller id)."""
    pairs = candidate_pairs(left, right, tol, lt, rt, on)
    dt = F.abs(F.col(lt) - F.col(rt))
    wl = Window.partitionBy(lid).orderBy(dt, F.col(rt), F.col(rid))
    wr = Window.partitionBy(rid).orderBy(dt, F.col(lt), F.col(lid))
    ranked = pairs.withColumn("_rl", F.row_number().over(wl)).withColumn("_rr", F.row_number().over(wr))
    return ranked.where((F.col("_rl") == 1) & (F.col("_rr") == 1)).drop("_rl", "_rr").withColumn("dt", F.col(rt) - F.col(lt))


def chains(events: DataFrame, tol: float, day="day", time="time", out="chain") -> DataFrame:
    """Numbers the chains of events whose neighbours in time lie within ``tol``, over midnight too.

    Windows run inside a day; the table that carries the last time and the number of breaks from day to day has one row a day.
    """
    inside = Window.partitionBy(day).orderBy(time)
    e = events.withColumn("_gap", F.col(time) - F.lag(time).over(inside))
    e = e.withColumn("_break", F.coalesce((F.col("_gap") > tol).cast("long"), F.lit(0)))
    days = e.groupBy(day).agg(F.min(time).alias("_first"), F.max(time).alias("_last"), F.sum("_break").alias("_n"))
    order = Window.orderBy(day)
    days = days.withColumn("_open", F.coalesce((F.col("_first") - F.lag("_last").over(order) > tol).cast("long"), F.lit(1)))
    before = F.coalesce(F.sum(F.col("_n") + F.col("_open")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select(day, (before + F.col("_open")).alias("_base"))
    running = F.sum("_break").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return e.withColumn("_run", running).join(days, day).withColumn(out, F.col("_base") + F.col("_run")).drop("_gap", "_break", "_run", "_base")


def reachable(left: DataFrame, right: DataFrame, tol: float, rule="nearest", lt="lt", rt="rt", lid="lid", rid="rid") -> DataFrame:
    """(lid, time, rid, rtime): of the right events within ``tol`` of a left one, those that it can take in the end.

    A left event follows at most c - 1 others whose windows overlap its own and each of them takes one right event, so one of its c
    best candidates is still free and no other one matters.  Right events of one second differ by their id alone, so a
    second keeps its smallest ids first (as many as the largest c), and seconds that no left event reaches are dropped.
    """
    tol = int(tol)
    l = left.select(F.col(lid).alias("lid"), F.col(lt).cast("double").alias("time"))
    others = candidate_pairs(l, l.select(F.col("lid").alias("olid"), F.col("time").alias("otime")), 2 * tol, "time", "otime")
    first = (F.col("otime") < F.col("time")) | ((F.col("otime") == F.col("time")) & (F.col("olid") <= F.col("lid")))
    l = sized(others.where(first).groupBy("lid", "time").agg(F.count(F.lit(1)).alias("c")), "left-events")
    most = l.agg(F.max("c")).first()[0] or 0
    r = right.select(F.col(rid).alias("rid"), F.col(rt).cast("double").alias("rtime"))
    near = l.select(F.explode(F.array(*[bucket_of("time", tol) + k for k in (-1, 0, 1)])).alias("_k")).distinct()
    r = r.withColumn("_k", bucket_of("rtime", tol)).join(near, "_k", "left_semi").drop("_k")
    r = r.withColumn("_n", F.row_number().over(Window.partitionBy("rtime").orderBy("rid"))).where(F.col("_n") <= most).drop("_n")
    pairs = candidate_pairs(l, r, tol, "time", "rtime")
    order = [F.abs(F.col("rtime") - F.col("time"))] if rule == "nearest" else []
    turn = F.row_number().over(Window.partitionBy("lid", "time").orderBy(*order, "rtime", "rid"))
    return pairs.withColumn("_n", turn).where(F.col("_n") <= most).where(F.col("_n") <= F.col("c")).select("lid", "time", "rid", "rtime")


def greedy_pairs(left: DataFrame, right: DataFrame, tol: float, rule="nearest", lt="lt", rt="rt", lid="lid", rid="rid", day="day") -> DataFrame:
    """One-to-one matching in left order: each left event takes the nearest (or the first) right event
    still free within the tolerance; ties go to the earlier one.  ``day`` is the left event's.

    Sequential by definition, so each chain of left events with overlapping windows is one Arrow group.  It holds the candidates
    that ``reachable`` leaves: at most c rows a left event, however many right events there are.
    """
    events = sized(left.select(F.col(day).alias("day"), F.col(lid).alias("lid"), F.col(lt).cast("double").alias("time")), "left-events")
    linked = chains(events, 2 * tol, "day").select("lid", "time", "day", "chain")
    rows = reachable(left, right, tol, rule, lt, rt, lid, rid).join(linked, ["lid", "time"])
    schema = T.StructType([left.schema[day], T.StructField(lid, left.schema[lid].dataType), T.StructField(rid, right.schema[rid].dataType),
                           T.StructField("dt", T.DoubleType())])

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        far = (pdf["rtime"] - pdf["time"]).abs() if rule == "nearest" else 0.0
        pdf = pdf.assign(_far=far).sort_values(["time", "lid", "_far", "rtime", "rid"], kind="stable")
        taken, served, out = set(), set(), []
        for d, l, t, r, rtime in zip(pdf["day"], pdf["lid"], pdf["time"], pdf["rid"], pdf["rtime"]):
            if (l, t) not in served and (r, rtime) not in taken:
                served.add((l, t))
                taken.add((r, rtime))
                out.append((d, l, r, rtime - t))
        return pd.DataFrame(out, columns=[day, lid, rid, "dt"])

    return rows.groupBy("chain").applyInPandas(match, schema)


def merge_catalogs(soft: DataFrame, hard: DataFrame, pairs: DataFrame, high_class="C", lid="lid", rid="rid") -> DataFrame:
    """Soft events with a hard partner, soft events of a high class without one, then unmatched hard
    events labelled ``HXR``.  ``soft``/``hard`` carry (id, day, peak_t, peak_flux[, class])."""
    rank = F.coalesce(*[F.when(F.col("class").startswith(k), v) for k, v in CLASS_RANK.items()], F.lit(0))
    linked = pairs.select(lid, rid)
    hard_cols = hard.select(F.col(rid), F.col("peak_t").alias("hxr_peak_t"), F.col("peak_flux").alias("hxr_peak_flux"))
    joined = soft.join(linked, lid, "left").join(hard_cols, rid, "left")
    kept = joined.where(F.col(rid).isNotNull() | (rank >= CLASS_RANK[high_class]))
    first = kept.select("day", "peak_t", "peak_flux", "class", F.col(rid).isNotNull().cast("bigint").alias("has_hxr"),
                        F.coalesce("hxr_peak_flux", F.lit(0.0)).alias("hxr_peak_flux"), "hxr_peak_t", F.lit("swpc_peak").alias("method"))
    orphans = hard.join(linked.select(rid), rid, "left_anti").where(F.col("peak_flux") > 0)
    second = orphans.select("day", "peak_t", "peak_flux", F.lit("HXR").alias("class"), F.lit(1).cast("bigint").alias("has_hxr"),
                            F.col("peak_flux").alias("hxr_peak_flux"), F.col("peak_t").alias("hxr_peak_t"), F.lit("hxr_only").alias("method"))
    return first.unionByName(second)


def score_matches(n_left: DataFrame, n_right: DataFrame, pairs: DataFrame, by=("day",)) -> DataFrame:
    """tp / fp / fn, precision, recall and F1 per group from matched pairs (plain counts, unioned)."""
    part = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))
    stacked = part(n_left, "det").unionByName(part(n_right, "truth")).unionByName(part(pairs, "tp"))
    total = lambda name: F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0))
    counts = stacked.groupBy(*by).agg(total("tp").alias("tp"), (total("det") - total("tp")).alias("fp"), (total("truth") - total("tp")).alias("fn"))
    return with_prf(counts)


def with_prf(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    df = counts.withColumn("precision", tp / F.greatest(tp + fp, F.lit(1))).withColumn("recall", tp / F.greatest(tp + fn, F.lit(1)))
    return df.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-10)))


def peak_in_window(flares: DataFrame, samples: DataFrame, tol: int, fid="fid", peak="peak_t", t="t", value="v", on=()) -> DataFrame:
    """Largest sample in [peak - tol, peak + tol) per flare, with its time (NULL when there is none).

    Samples are first reduced to their maximum per second, so the join input is bounded by the clock
    and not by the raw row count.
    """
    per_second = samples.groupBy(*on, t).agg(F.max(value).alias("_v"))
    pairs = candidate_pairs(flares.select(*on, fid, peak), per_second, tol, peak, t, on)
    pairs = pairs.where(F.col(t) < F.col(peak) + tol)
    best = pairs.groupBy(fid).agg(F.max(F.struct(F.col("_v").alias("v"), (-F.col(t)).alias("nt"))).alias("_best"))
    return flares.join(best, fid, "left").withColumn("max_value", F.col("_best.v")).withColumn("max_t", -F.col("_best.nt")).drop("_best")


def first_covering(rows: DataFrame, events: DataFrame, t="t", start="start_t", end="end_t", width=3600, on=("day",), take=("class",)) -> DataFrame:
    """``in_event`` and the attributes of the earliest event covering each row."""
    from .intervals import cover_buckets

    ev = cover_buckets(events.select(*on, start, end, *take), start, end, width, "_b")
    order = F.struct(F.col(start).alias("s"), F.col(end).alias("e"), *[F.col(c).alias(c) for c in take])
    per = ev.groupBy(*on, "_b").agg(F.sort_array(F.collect_set(order)).alias("_ev"))
    joined = rows.withColumn("_b", bucket_of(t, width)).join(per, [*on, "_b"], "left")
    hit = F.try_element_at(F.filter("_ev", lambda e: (F.col(t) >= e["s"]) & (F.col(t) <= e["e"])), F.lit(1))
    joined = joined.withColumn("_hit", hit)
    return joined.select(*rows.columns, F.col("_hit").isNotNull().cast("bigint").alias("in_event"), *[F.col("_hit")[c].alias(c) for c in take])


def coincident_seconds(photons: DataFrame, max_gap: float, pixel="pix", micros="us", day="day") -> DataFrame:
    """Seconds in which a pixel fires again less than ``max_gap`` seconds after its previous photon.

    Photons collapse to (count, first, last) per (pixel, second) before any window: two photons of one
    second are always closer than ``max_gap`` (>= 1 s), so the reduction is exact, and a (pixel, day)
    window has at most 86,400 rows.
    """
    if max_gap < 1:
        raise ValueError("max_gap below one second needs photon-level lags")
    second = F.floor((F.col(micros) + 500000) / F.lit(1000000)).cast("bigint")
    cells = photons.groupBy(day, pixel, second.alias("second")).agg(
        F.count(F.lit(1)).alias("n"), F.min(micros).alias("first"), F.max(micros).alias("last"))
    w = Window.partitionBy(day, pixel).orderBy("second")
    near = (F.col("first") - F.lag("last").over(w)) < max_gap * 1e6
    hits = cells.withColumn("_near", F.coalesce(near, F.lit(False))).where((F.col("n") > 1) | F.col("_near"))
    return hits.groupBy(day, "second").agg(F.count(F.lit(1)).alias("pixels"))


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """Deterministic duplicate removal.  ``min_by`` combines map-side, so a key repeated in a third of
    all rows costs one row per map task, where a row_number window would pull it into one task."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
