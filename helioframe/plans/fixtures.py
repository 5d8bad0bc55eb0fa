"""How the driver tables play the roles of instrument data, in Spark and in SQL.

``events`` is the raw sample stream: event type = channel, binned to a 10-minute cadence (144 rows a
day).  ``view`` is the soft band, the other types are hard bands.  Window lengths below are the
instrument defaults scaled to that cadence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import TIE_NUDGE, tidy
from ..sources.lightcurve import light_curve, wide_curve
from ..sources.tables import table

CADENCE = 600
BINS = 86400 // CADENCE
CHANNELS = ["view", "click", "purchase", "signup", "error"]
SOFT, HARD = "view", "click"


#: The stand-in instrument reads out in steps of 0.001, on both sides alike: thresholds then meet the same values whatever
#: the order of summation.  Sources and operators do not round.
READOUT = 3


def lc(spark: SparkSession, sf: str) -> DataFrame:
    return light_curve(table(spark, sf, "events"), CADENCE).withColumn("v", tidy("v", READOUT))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    curve = wide_curve(table(spark, sf, "events"), CADENCE, CHANNELS)
    return curve.withColumns({c: tidy(c, READOUT) for c in CHANNELS})


# -- the same in SQL --------------------------------------------------------------------------------
LC = f"""binned AS (
  SELECT event_type AS channel, CAST(ts AS DATE) AS day,
         CAST(floor((CAST(floor(epoch(ts)) AS BIGINT) % 86400) / {CADENCE}) AS BIGINT) AS bin,
         round(avg(value) + {TIE_NUDGE}, 3) AS v, count(value) AS n, min(value) AS lo, max(value) AS hi
  FROM events GROUP BY 1, 2, 3),
lc AS (
  SELECT d.channel, d.day, s.bin, CAST(epoch(d.day) AS BIGINT) + s.bin * {CADENCE} AS t, b.v
  FROM (SELECT DISTINCT channel, day FROM binned) d
  CROSS JOIN (SELECT CAST(range AS BIGINT) AS bin FROM range({BINS})) s
  LEFT JOIN binned b ON b.channel = d.channel AND b.day = d.day AND b.bin = s.bin)"""

WIDE = LC + """,
wide AS (
  SELECT d.day, s.bin, CAST(epoch(d.day) AS BIGINT) + s.bin * %d AS t, %s
  FROM (SELECT DISTINCT day FROM binned) d
  CROSS JOIN (SELECT CAST(range AS BIGINT) AS bin FROM range(%d)) s
  LEFT JOIN binned b ON b.day = d.day AND b.bin = s.bin
  GROUP BY d.day, s.bin)""" % (
    CADENCE,
    ", ".join(f"max(CASE WHEN b.channel = '{c}' THEN b.v END) AS {c}" for c in CHANNELS),
    BINS,
)


def final(body: str, keys: str, doubles: str = "", ctes: str = "", digits: int = 6) -> str:
    """SELECT with integer keys as they are and doubles rounded the way the Spark side rounds them."""
    cols = [k.strip() for k in keys.split(",") if k.strip()]
    cols = ["CAST(day AS VARCHAR) AS day" if k == "day" else k for k in cols]
    cols += [
        f"CASE WHEN isnan(CAST({d} AS DOUBLE)) OR isinf(CAST({d} AS DOUBLE)) THEN NULL "
        f"ELSE round(CAST({d} AS DOUBLE) + {TIE_NUDGE}, {digits}) + 0.0 END AS {d}"
        for d in doubles.split()
    ]
    head = f"WITH {ctes}\n" if ctes else ""
    return f"{head}SELECT {', '.join(cols)} FROM ({body}) AS body"


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


DAYW = "OVER (PARTITION BY channel, day ORDER BY bin"
WIDEW = "OVER (PARTITION BY day ORDER BY bin"


def frame(size: int, part: str = "channel, day") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY bin ROWS BETWEEN {size // 2} PRECEDING AND {size - size // 2 - 1} FOLLOWING)"


def tail(size: int, part: str = "channel, day") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY bin ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"


def mad(value: str, source: str, name: str, part: str = "channel, day") -> str:
    """CTEs ``name`` = source + column sd (1.4826 * MAD of ``value`` per day)."""
    return f"""{name}_m AS (SELECT *, quantile_cont({value}, 0.5) OVER (PARTITION BY {part}) AS med_ FROM {source}),
{name} AS (SELECT *, 1.4826 * quantile_cont(abs({value} - med_), 0.5) OVER (PARTITION BY {part}) AS sd FROM {name}_m)"""
