"""Query: the nested report of every day, read back from its JSON."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.output import present
from ..session import run_dir
from ..sources.sinks import nested_report
from .fixtures import BINS
from .q_pipeline import HOP, LOOKBACK
from .registry import ORACLES, QUERIES, query

#: section -> (the query that makes it, the columns it takes)
SECTIONS = {
    "data_quality": ("band_mismatch", ["coverage_h", "fewest", "most", "mismatch"]),
    "good_time": ("gti_coverage", ["intervals", "total", "dead_pct"]),
    "reference_comparison": ("day_scalars", ["xb_max", "xa_max", "ratio_head"]),
    "neupert_effect": ("neupert_integral", ["rho"]),
    "cross_correlation": ("lag_corr", ["r", "lag"]),
    "scaling": ("scalegram_slope", ["beta", "t_min"]),
    "red_noise": ("red_noise", ["r1"]),
    "spectral_evolution": ("dual_channel", ["mean_ratio", "median_a", "median_b"]),
    "wavelet": ("wavelet_bands", ["peak_period", "entropy"]),
    "complexity": ("sample_entropy", ["sampen"]),
    "information": ("mutual_information", ["mi"]),
    "causal_network": ("network_features", ["causal_network_density", "hxr_to_sxr_lag", "hxr_to_sxr_strength", "n_feedback_loops"]),
    "versions": ("version_consistency", ["versions", "consistent"]),
}
N_WINDOWS = (BINS - 1 - LOOKBACK) // HOP + 1


def report(spark, sf):
    """(day, report): thirteen sections, the flare catalog and the strongest periods."""
    parts = {name: QUERIES[q](spark, sf).select("day", *cols) for name, (q, cols) in SECTIONS.items()}
    flares = QUERIES["swpc_detect"](spark, sf).where(F.col("channel") == "view").select("day", "peak_t", "class", "duration", "peak_flux")
    periods = QUERIES["top_periods"](spark, sf).select("day", "rank", "period", "power")
    return nested_report(QUERIES["day_listing"](spark, sf), parts, {"flare_catalog": (flares, ["peak_t"]), "power_spectrum": (periods, ["rank"])}, ["day"])


def _sql() -> str:
    cols = [f"{name}.{c} AS {name}_{c}" for name, (_, cs) in SECTIONS.items() for c in cs]
    joins = [f"LEFT JOIN ({ORACLES[q]}) AS {name} ON {name}.day = d.day" for name, (q, _) in SECTIONS.items()]
    return f"""SELECT d.day, CAST({len(SECTIONS) + 2} AS BIGINT) AS sections, {', '.join(cols)}, coalesce(fl.n, 0) AS flares, coalesce(fl.classes, '') AS classes, coalesce(fl.peak, 0) AS highest, tp.period AS strongest, tp.n AS periods
FROM ({ORACLES['day_listing']}) AS d {' '.join(joins)}
LEFT JOIN (SELECT day, count(*) AS n, string_agg(class, ',' ORDER BY peak_t) AS classes, max(peak_flux) AS peak FROM ({ORACLES['swpc_detect']}) WHERE channel = 'view' GROUP BY day) AS fl ON fl.day = d.day
LEFT JOIN (SELECT day, arg_min(period, rank) AS period, count(*) AS n FROM ({ORACLES['top_periods']}) GROUP BY day) AS tp ON tp.day = d.day"""


@query("interpretation_report", _sql())
def _interpretation(spark, sf):
    """Written as one JSON document a day and read again with the schema that Spark infers for it."""
    path = run_dir(spark, "reports")
    report(spark, sf).select("day", "report").write.parquet(path)
    docs = spark.read.parquet(path)
    kinds = {q: {f.name: f.dataType for f in QUERIES[q](spark, sf).schema.fields} for q, _ in SECTIONS.values()}
    schema = T.StructType([T.StructField(name, T.StructType([T.StructField(c, kinds[q][c]) for c in cs])) for name, (q, cs) in SECTIONS.items()])
    entry = lambda *fields: T.StructType([T.StructField("total", T.LongType()), T.StructField("entries", T.ArrayType(T.StructType([T.StructField(n, k) for n, k in fields])))])
    schema = schema.add("flare_catalog", entry(("peak_t", T.LongType()), ("class", T.StringType()), ("duration", T.LongType()), ("peak_flux", T.DoubleType())))
    schema = schema.add("power_spectrum", entry(("rank", T.LongType()), ("period", T.DoubleType()), ("power", T.DoubleType())))
    r = docs.select("day", F.size(F.json_object_keys("report")).cast("bigint").alias("sections"), F.from_json("report", schema).alias("r"))
    cols = [F.col(f"r.{name}.{c}").alias(f"{name}_{c}") for name, (_, cs) in SECTIONS.items() for c in cs]
    flares, periods = F.col("r.flare_catalog"), F.col("r.power_spectrum")
    return present(r.select(
        "day", "sections", *cols, flares["total"].alias("flares"), F.array_join(F.transform(flares["entries"], lambda x: x["class"]), ",").alias("classes"),
        F.coalesce(F.array_max(F.transform(flares["entries"], lambda x: x["peak_flux"])), F.lit(0.0)).alias("highest"),
        F.get(periods["entries"], 0)["period"].alias("strongest"), F.when(periods["total"] > 0, periods["total"]).alias("periods")))
