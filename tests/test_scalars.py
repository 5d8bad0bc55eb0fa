import math

import pytest
from pyspark.sql import functions as F

from helioframe.functions import scalars as sc


def one(spark, expr, schema="x double", row=(1.0,)):
    return spark.createDataFrame([row], schema).select(expr.alias("r")).first()["r"]


def test_clock(spark):
    assert one(spark, sc.met_to_mjd("x"), row=(0.0,)) == 40587
    assert one(spark, sc.met_to_mjd("x"), row=(86400.0,)) == 40588
    assert one(spark, sc.mjd_to_unix("x"), row=(40588.0,)) == 86400


def test_deadtime_is_monotone_and_solves_the_equation(spark):
    tau = 13.65e-6
    df = spark.createDataFrame([(x,) for x in (0.0, 100.0, 1000.0, 5000.0, 10000.0, 20000.0, 40000.0)], "x double")
    got = [r["n"] for r in df.select(sc.deadtime_true_rate("x", tau).alias("n")).collect()]
    assert got[0] == 0.0 and got[-1] is None
    rates = got[1:-1]
    assert rates == sorted(rates) and len(set(rates)) == 5
    assert rates[-1] > 20000 * 1.1
    assert all(abs(n * math.exp(-n * tau) - m) < 1e-6 * m for n, m in zip(rates, (100, 1000, 5000, 10000, 20000)))


@pytest.mark.parametrize("counts,letter", [(4100, "X"), (410, "M"), (41, "C"), (5, "B"), (1, "A")])
def test_class_boundaries(spark, counts, letter):
    assert one(spark, sc.event_class("x"), row=(float(counts),)) == letter


def test_class_text_roundtrip(spark):
    assert one(spark, sc.class_label("x", 1), row=(6.3e-5,)) == "M6.3"
    assert one(spark, sc.parse_class("x"), "x string", (" m6.3 ",)) == pytest.approx(6.3e-5)
    assert one(spark, sc.parse_class("x", standard=False), "x string", ("M6.3",)) == pytest.approx(7.3e-5)
    assert one(spark, sc.class_number("x"), "x string", ("X1.5",)) == pytest.approx(150.0)
    assert one(spark, sc.class_number("x"), "x string", ("?",)) is None


def test_ratios_and_missing(spark):
    assert one(spark, sc.clipped_ratio("x", F.lit(1e-9)), row=(5.0,)) == 1e3
    assert one(spark, sc.clipped_ratio("x", F.lit(0.0)), row=(5.0,)) is None
    assert one(spark, sc.zero_if_missing("x"), row=(float("nan"),)) == 0.0
    assert one(spark, sc.zero_if_missing("x"), row=(float("inf"),)) == 0.0


def test_temperature_is_quiet_below_limits(spark):
    assert one(spark, sc.ratio_temperature("x", F.lit(1e-6)), row=(1e-8,)) is None
    assert 3.0 <= one(spark, sc.ratio_temperature("x", F.lit(1e-5)), row=(1e-6,)) <= 50.0


@pytest.mark.parametrize("p,pre,now,level", [(0.95, 0, False, "RED"), (0.8, 0, False, "ORANGE"), (0.5, 0.7, False, "YELLOW"), (0.1, 0.1, False, "GREEN"), (0.1, 0.1, True, "FLARE NOW")])
def test_alert(spark, p, pre, now, level):
    got = one(spark, sc.alert_level("p", "q", "n"), "p double, q double, n boolean", (p, float(pre), now))
    assert got == level
