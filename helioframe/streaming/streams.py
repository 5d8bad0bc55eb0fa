"""Live versions of the nowcast operators on Structured Streaming.

All state is keyed and expires with the watermark; late rows beyond it are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions.scalars import alert_level
from ..session import run_dir, use_utc

ALERT_SCHEMA = "channel string, t timestamp, previous string, alert string"


def live_samples(spark: SparkSession, folder: str, name: str = "events.parquet", schema=None, files_per_batch: int | None = 64) -> DataFrame:
    """A folder of Parquet files as a stream of (event_id, ts, channel, value)."""
    use_utc(spark)
    schema = schema or spark.read.parquet(f"{folder.rstrip('/')}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), "value")


def tumbling(samples: DataFrame, width="1 minute", late="2 minutes") -> DataFrame:
    """Rate statistics per channel and window."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", width), "channel").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top")).select("channel", F.col("window.start").alias("start"), "n", "mean", "top")


def hopping(samples: DataFrame, width="1 hour", hop="5 minutes", late="10 minutes") -> DataFrame:
    """Window features with mergeable aggregates only."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", width, hop), "channel").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi")
    ).select("channel", F.col("window.start").alias("start"), "n", "mean", "std", "lo", "hi")


def flare_sessions(samples: DataFrame, threshold: float, gap="60 seconds", late="10 minutes", min_rows=1) -> DataFrame:
    """Sessions of samples over the threshold that are at most ``gap`` apart."""
    hot = samples.where(F.col("value") > threshold).withWatermark("ts", late)
    s = hot.groupBy(F.session_window("ts", gap), "channel").agg(
        F.count("value").alias("n"), F.max("value").alias("peak"), F.max_by("ts", F.struct("value", "ts")).alias("peak_t"))
    return s.where(F.col("n") >= min_rows).select("channel", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n", "peak", "peak_t")


def window_peaks(samples: DataFrame, threshold: float, width="1 minute", late="10 minutes") -> DataFrame:
    """Windows whose maximum exceeds the threshold, as events (ts, start, peak) for further stateful steps."""
    w = samples.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.max("value").alias("peak"))
    return w.where(F.col("peak") > threshold).select(F.window_time("window").alias("ts"), F.col("window.start").alias("start"), "peak")


def coincidences(soft: DataFrame, hard: DataFrame, tol: int) -> DataFrame:
    """Soft and hard window peaks within ``tol`` seconds of each other.

    Both sides are window peaks, so at most tol/width partners exist per event however many samples
    arrive.  The soft side visits three adjacent time buckets, which gives the stream-stream join its
    equality key; both sides expire by watermark.
    """
    bucket = lambda c: F.floor(F.unix_seconds(c) / F.lit(tol))
    a = soft.select(F.col("ts").alias("sts"), F.col("start").alias("st"), F.col("peak").alias("sv"), F.explode(F.array(*[bucket("ts") + k for k in (-1, 0, 1)])).alias("sb"))
    b = hard.select(F.col("ts").alias("hts"), F.col("start").alias("ht"), F.col("peak").alias("hv"), bucket("ts").alias("hb"))
    span = F.expr(f"INTERVAL {tol} SECONDS")
    near = (F.col("hts") >= F.col("sts") - span) & (F.col("hts") <= F.col("sts") + span)
    return a.join(b, (F.col("sb") == F.col("hb")) & near).select("st", "ht", "sv", "hv")


def without_duplicates(samples: DataFrame, keys=("channel", "event_id"), late="10 minutes") -> DataFrame:
    return samples.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


#: Steps of one channel are ordered and judged in pieces of this many seconds.
PIECE = 3600


class AlertChanges(StatefulProcessor):
    """Emits a row whenever a channel's alert level differs from the previous one.

    Input frames, whose rows come in any order, only add their steps to the piece of time that they belong to (a map in the
    state store) and set an event-time timer at its start.  Steps arrive when the watermark has closed them, so the timers
    fire in the same batch and in the order of time: one piece at a time is loaded, ordered and judged, however long the
    channel's backlog is.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "alert string")
        self.pieces = handle.getMapState("pieces", "piece long", "steps string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            second = frame["t"].astype("datetime64[s]").astype("int64")
            for piece, part in frame.assign(second=second).groupby(second // PIECE):
                steps = ";".join(f"{t}={alert}" for t, alert in zip(part["second"], part["alert"]))
                name = (int(piece),)
                if self.pieces.containsKey(name):
                    steps = f"{self.pieces.getValue(name)[0]};{steps}"
                else:
                    self.handle.registerTimer(int(piece) * PIECE * 1000)
                self.pieces.updateValue(name, (steps,))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        name = (expiredTimerInfo.getExpiryTimeInMs() // (PIECE * 1000),)
        steps = sorted((int(t), alert) for t, _, alert in (s.partition("=") for s in self.pieces.getValue(name)[0].split(";")))
        self.pieces.removeKey(name)
        previous = [self.level.get()[0] if self.level.exists() else "GREEN", *(alert for _, alert in steps)]
        self.level.update((previous[-1],))
        changed = [(key[0], pd.Timestamp(t, unit="s"), p, alert) for (t, alert), p in zip(steps, previous) if alert != p]
        yield pd.DataFrame(changed, columns=["channel", "t", "previous", "alert"])

    def close(self) -> None:
        pass


def _level(full_scale: float, flare: float):
    return alert_level(F.col("top") / full_scale, F.col("top") / full_scale, F.col("top") > flare)


def alert_changes(samples: DataFrame, full_scale: float, flare: float, width="1 minute", late="10 minutes") -> DataFrame:
    """Alert level per channel and cadence step, reported on change.

    Samples collapse to one maximum per step before they reach the state, which keeps one level per
    channel; a step is judged when the watermark closes it.
    """
    steps = samples.withWatermark("ts", late).groupBy(F.window("ts", width), "channel").agg(F.max("value").alias("top"))
    scored = steps.select("channel", F.col("window.start").alias("t"), _level(full_scale, flare).alias("alert"))
    return scored.groupBy("channel").transformWithStateInPandas(AlertChanges(), ALERT_SCHEMA, "append", "eventTime")


def alert_changes_batch(samples: DataFrame, full_scale: float, flare: float, width: int = 60) -> DataFrame:
    """The same report over stored samples.

    After the reduction to one row per step, the predecessor comes from the (channel, day) window and,
    for the first step of a day, from the last level of the day before it.
    """
    step = F.floor(F.unix_seconds("ts") / F.lit(width)) * width
    d = samples.groupBy("channel", step.alias("s")).agg(F.max("value").alias("top"))
    d = d.select("channel", "s", F.floor(F.col("s") / F.lit(86400)).alias("_d"), _level(full_scale, flare).alias("alert"))
    last = d.groupBy("channel", "_d").agg(F.max_by("alert", "s").alias("_l"))
    last = last.withColumn("_before", F.lag("_l").over(Window.partitionBy("channel").orderBy("_d"))).drop("_l")
    d = d.withColumn("_in", F.lag("alert").over(Window.partitionBy("channel", "_d").orderBy("s"))).join(last, ["channel", "_d"])
    d = d.withColumn("previous", F.coalesce("_in", "_before", F.lit("GREEN"))).where(F.col("alert") != F.col("previous"))
    return d.select("channel", F.timestamp_seconds("s").alias("t"), "previous", "alert")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, label: str, base: str | None = None) -> DataFrame:
    """Drain what is available into Parquet files and read them back.

    Checkpoint and output live next to each other below ``base``; a query started again with the same ``base`` goes on where
    it stopped.  Without one a new folder of the shared folder is taken.  State is kept in RocksDB.
    """
    spark = stream.sparkSession
    base = base or run_dir(spark, f"stream-{label}")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKS)
    try:
        query = (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
