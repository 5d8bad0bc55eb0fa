"""Queries: splits, scores, feature statistics, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.output import present
from ..operators import catalog as cg
from ..operators import learning as le
from ..operators import ranking as rk
from ..operators.intervals import flag_upcoming
from ..operators import windows as wi
from ..session import cut_lineage
from ..sources.tables import table
from .fixtures import BINS, CADENCE, CHANNELS, LC, WIDE, big, final, lc, wide
from .q_match import EV, TRUTH, truth
from .q_windows import BANDED, LOOK, STEP, features
from .registry import query

# -- scores and labels: documents joined with their labels; line items for large continuous scores ----------
SCORED = "sc AS (SELECT d.doc_id, l.quality AS label, n_chars / (n_chars + 600.0) AS score, lang FROM documents d JOIN labels l USING (doc_id))"
BIG = "sc AS (SELECT l_extendedprice / 110000.0 AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_linestatus AS grp FROM lineitem)"


def scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") / (F.col("n_chars") + 600.0)).alias("score"))
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("label")), "doc_id")


def line_scores(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_extendedprice") / 110000.0).alias("score"), (F.col("l_returnflag") == "R").cast("bigint").alias("label"), F.col("l_linestatus").alias("grp"))


_TH = "th AS (SELECT unnest([%s]) AS threshold)" % ", ".join(str(i / 100) for i in range(1, 100))
_SWEEP = SCORED + ", " + _TH + """, sw AS (SELECT lang, threshold, sum(CASE WHEN score >= threshold AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score >= threshold AND label = 0 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN score < threshold AND label = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN score < threshold AND label = 0 THEN 1 ELSE 0 END) AS tn FROM sc, th GROUP BY lang, threshold)"""


@query("confusion_sweep", final("SELECT * FROM sw", "lang, " + big("tp", "fp", "fn", "tn"), "threshold", _SWEEP))
def _sweep(spark, sf):
    return present(le.confusion_sweep(scored(spark, sf), "score", "label", by=("lang",)))


_SKILL = """sk AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, recall + specificity - 1 AS tss, (recall + specificity) / 2 AS balanced_accuracy,
  CASE WHEN (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn) > 0 THEN 2 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) ELSE 0 END AS hss,
  CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc,
  CASE WHEN 1 - pe > 0 THEN ((tp + tn) / (tp + fp + fn + tn) - pe) / (1 - pe) ELSE 0 END AS kappa FROM (
  SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS specificity,
   ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / pow(tp + fp + fn + tn, 2) AS pe FROM (SELECT lang, threshold, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn FROM sw)))"""
_SKILLS = "recall precision specificity tss balanced_accuracy f1 hss mcc kappa"


@query("skill_scores", final("SELECT * FROM sk", "lang", "threshold " + _SKILLS, _SWEEP + ", " + _SKILL))
def _skill(spark, sf):
    s = le.skill(le.confusion_sweep(scored(spark, sf), "score", "label", by=("lang",)))
    return present(s.select("lang", "threshold", *_SKILLS.split()))


@query("best_threshold", final("SELECT lang, threshold, tss FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(tss, 12) DESC, threshold) AS rn FROM sk) WHERE rn = 1", "lang", "threshold tss", _SWEEP + ", " + _SKILL))
def _best(spark, sf):
    return present(le.best_threshold(le.confusion_sweep(scored(spark, sf), "score", "label", by=("lang",)), ("lang",)))


_CURVE = """cv AS (SELECT grp, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM sc GROUP BY grp, score),
cu AS (SELECT *, sum(pos) OVER (PARTITION BY grp) AS P, sum(neg) OVER (PARTITION BY grp) AS N, coalesce(sum(neg) OVER (PARTITION BY grp ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
  sum(pos) OVER (PARTITION BY grp ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY grp ORDER BY score DESC) AS fp FROM cv)"""


@query("auc_scores", final("SELECT grp, max(P) AS positives, max(N) AS negatives, sum(pos * (nb + neg / 2.0)) / max(CAST(P AS DOUBLE) * N) AS auc_roc, sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / max(P) AS auc_pr FROM cu GROUP BY grp",
                           "grp, " + big("positives", "negatives"), "auc_roc auc_pr", BIG + ", " + _CURVE))
def _auc(spark, sf):
    return present(le.area_scores(line_scores(spark, sf), "score", "label", ("grp",)))


@query("curve_points", final("SELECT lang, score, tp, fp, tp / CAST(P AS DOUBLE) AS tpr, fp / CAST(N AS DOUBLE) AS fpr, tp / CAST(tp + fp AS DOUBLE) AS precision FROM cu", "lang, " + big("tp", "fp"), "score tpr fpr precision",
                             SCORED + ", " + _CURVE.replace("grp", "lang")))
def _curve(spark, sf):
    c = le.curve_points(scored(spark, sf), "score", "label", ("lang",))
    return present(c.select("lang", "score", "tp", "fp", "tpr", "fpr", "precision"))


@query("ensemble_stats", final("SELECT l_suppkey, avg(score) AS mean_score, stddev_pop(score) AS std_score, count(*) AS passes FROM (SELECT l_suppkey, l_discount * 10 AS score FROM lineitem) GROUP BY l_suppkey", "l_suppkey, passes", "mean_score std_score"))
def _ensemble(spark, sf):
    return present(le.ensemble(table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_discount") * 10).alias("score")), ["l_suppkey"]))


@query("exact_quantiles", final(
    "SELECT channel, q, quantile FROM (" + " UNION ALL ".join(f"SELECT event_type AS channel, {q} AS q, quantile_cont(value, {q}) AS quantile FROM events GROUP BY 1" for q in (0.01, 0.5, 0.9, 0.99, 0.999)) + ")", "channel", "q quantile"))
def _quantiles(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("channel"), "value")
    return present(rk.exact_quantiles(ev, ["channel"], "value", [0.01, 0.5, 0.9, 0.99, 0.999]))


@query("average_rank", final("SELECT l_linestatus AS grp, l_extendedprice AS value, count(*) AS n, min(r) + (count(*) - 1) / 2.0 AS rank FROM (SELECT l_linestatus, l_extendedprice, rank() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) AS r FROM lineitem) GROUP BY ALL", "grp, n", "value rank"))
def _ranks(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("grp"), F.col("l_extendedprice").alias("value"))
    return present(rk.average_rank(li, ["grp"], "value"))


# -- splits on hopping windows with labels ----------------------------------------------------------------------
LABELLED = BANDED + ", " + EV + f""",
lw AS (SELECT day, win, epoch(day) + (win * {STEP} + {LOOK}) * {CADENCE} AS t FROM (SELECT day, win FROM ve GROUP BY day, win HAVING count(*) >= 5)),
lb AS (SELECT lw.*, CASE WHEN EXISTS (SELECT 1 FROM ev WHERE channel = 'error' AND value >= {TRUTH} AND ev.t > lw.t AND ev.t <= lw.t + 7200) THEN 1 ELSE 0 END AS label, row_number() OVER (ORDER BY day, win) - 1 AS idx, count(*) OVER () AS n FROM lw)"""
NAMES = ["sxr_mean", "sxr_std", "sxr_max", "hxr_total_mean", "hxr_b0_max", "hxr_b3_mean", "hardness_ratio_mean", "sxr_rise_rate", "dhxr_dt_std"]


def labelled(spark, sf):
    f = wi.canonical(features(spark, sf), ["day", "win"], NAMES)
    f = f.withColumn("t", wi.window_end(CADENCE, STEP, LOOK))
    return flag_upcoming(f, truth(spark, sf).select(F.col("t").alias("te")), horizon=7200)


@query("chrono_split", final("SELECT day, win, label, idx, CASE WHEN idx < floor(n * 0.7) THEN 'train' WHEN idx < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM lb", "day, win, split, " + big("label", "idx"), "", LABELLED))
def _split(spark, sf):
    return present(le.chronological_split(labelled(spark, sf), "day", ["win"]).select("day", "win", "label", "idx", "split"))


@query("rolling_folds", final(
    """SELECT fold, CASE WHEN idx < hold THEN 'train' WHEN idx < stop THEN 'val' ELSE 'test' END AS role, count(*) AS n, min(idx) AS first, max(idx) AS last FROM (SELECT fold, idx, (fold + 1) * (n // 6) AS stop, (fold + 1) * (n // 6) - floor((fold + 1) * (n // 6) * 0.2) AS hold, n // 6 AS size FROM lb, (SELECT range AS fold FROM range(5))) WHERE idx < stop + size GROUP BY ALL""",
    "CAST(fold AS BIGINT) AS fold, role, n, first, last", "", LABELLED))
def _folds(spark, sf):
    r = le.rolling_origin(labelled(spark, sf).select("day", "win"), "day", ["win"])
    return present(r.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last")))


@query("standardise", final(
    "SELECT t.day, t.win, (sxr_mean - m) / s AS z FROM (SELECT day, win, idx, n, sxr_mean FROM lb JOIN (SELECT day, win, avg(soft) AS sxr_mean FROM ve GROUP BY day, win) USING (day, win)) t, (SELECT avg(sxr_mean) AS m, stddev_pop(sxr_mean) AS s FROM (SELECT day, win, avg(soft) AS sxr_mean FROM ve GROUP BY day, win) JOIN lb USING (day, win) WHERE idx < floor(n * 0.7))",
    "day, win", "z", LABELLED))
def _standardise(spark, sf):
    d = le.chronological_split(labelled(spark, sf), "day", ["win"])
    fitted = le.fit_scaler(d.where(F.col("split") == "train"), ["sxr_mean"])
    return present(le.scale(d, fitted).select("day", "win", F.col("sxr_mean").alias("z")))


@query("class_weight", final("SELECT sum(label) AS pos, sum(1 - label) AS neg, sum(1 - label) / greatest(sum(label), 1) AS weight FROM lb WHERE idx < floor(n * 0.7)", big("pos", "neg"), "weight", LABELLED))
def _weight(spark, sf):
    d = le.chronological_split(labelled(spark, sf), "day", ["win"])
    return present(le.class_weight(d.where(F.col("split") == "train"), "label"))


@query("gbt_scores")
def _gbt(spark, sf):
    d = cut_lineage(le.chronological_split(labelled(spark, sf), "day", ["win"]), "matrix")
    train = d.where(F.col("split") == "train")
    heavier = le.class_weight(train, "label").first().weight or 1.0
    train = train.withColumn("_w", F.when(F.col("label") == 1, heavier).otherwise(1.0))
    model = le.train_classifier(train, NAMES, "label", "gbt", weight="_w", maxIter=30, maxDepth=3)
    out = cut_lineage(le.score(model, d.where(F.col("split") != "train")).select("split", "score", "label"), "scores")
    return present(le.area_scores(out, "score", "label", ("split",)))


@query("rf_importance")
def _rf(spark, sf):
    model = le.train_classifier(cut_lineage(labelled(spark, sf), "matrix"), NAMES, "label", "rf", numTrees=12, maxDepth=4)
    return present(le.top_by(le.importances(model, NAMES, spark), (), F.col("importance"), 20, ["feature"]))


@query("walk_forward")
def _walk(spark, sf):
    """Rolling-origin evaluation: one model per fold, scores of all test parts."""
    folds = cut_lineage(le.rolling_origin(cut_lineage(labelled(spark, sf), "matrix"), "day", ["win"]), "folds")
    parts = None
    for k in range(5):
        fold = folds.where(F.col("fold") == k)
        model = le.train_classifier(fold.where(F.col("role") == "train"), NAMES, "label", "rf", numTrees=8, maxDepth=3)
        scored_part = le.score(model, fold.where(F.col("role") == "test")).select("fold", "score", "label")
        parts = scored_part if parts is None else parts.unionByName(scored_part)
    return present(le.area_scores(cut_lineage(parts, "scores"), "score", "label", ("fold",)))


# -- feature statistics ---------------------------------------------------------------------------------------------
def targeted(spark, sf):
    w = wide(spark, sf)
    return flag_upcoming(w, truth(spark, sf).select(F.col("t").alias("te")), horizon=3600)


TARGETED = WIDE + ", " + EV + f", tg AS (SELECT wide.*, CASE WHEN EXISTS (SELECT 1 FROM ev WHERE channel = 'error' AND value >= {TRUTH} AND ev.t > wide.t AND ev.t <= wide.t + 3600) THEN 1 ELSE 0 END AS label FROM wide)"
_LONG = "ul AS (SELECT label, feature, x FROM (UNPIVOT tg ON %s INTO NAME feature VALUE x))" % ", ".join(CHANNELS)


def _rank_sql(part, v):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {part}, {v}) - 1) / 2.0"


@query("spearman_targets", final(
    f"SELECT feature, 'label' AS target, count(*) AS n, corr(rx, ry) AS rho, corr(rx, ry) * sqrt((count(*) - 2) / (1 - pow(corr(rx, ry), 2))) AS t_stat FROM (SELECT feature, {_rank_sql('feature', 'x')} AS rx, {_rank_sql('feature', 'label')} AS ry FROM ul) GROUP BY feature HAVING count(*) >= 50",
    "feature, target, n", "rho t_stat", TARGETED + ", " + _LONG))
def _targets(spark, sf):
    return present(le.feature_target(targeted(spark, sf), CHANNELS, ["label"]))


_PAIRS = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i + 1:]]


@query("spearman_features", final(
    "SELECT a, b, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT a, b, " + _rank_sql("a, b", "x") + " AS rx, " + _rank_sql("a, b", "y") + " AS ry FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS) + ")) GROUP BY a, b",
    "a, b, n", "rho", WIDE))
def _features(spark, sf):
    return present(le.feature_feature(wide(spark, sf), CHANNELS).drop("t_stat"))


@query("top_features", final(
    f"SELECT feature, rho, rank FROM (SELECT *, row_number() OVER (ORDER BY abs(rho) DESC, feature) AS rank FROM (SELECT feature, corr(rx, ry) AS rho FROM (SELECT feature, {_rank_sql('feature', 'x')} AS rx, {_rank_sql('feature', 'label')} AS ry FROM ul) GROUP BY feature)) WHERE rank <= 3",
    "feature, rank", "rho", TARGETED + ", " + _LONG))
def _top(spark, sf):
    t = le.feature_target(targeted(spark, sf), CHANNELS, ["label"])
    return present(le.top_by(t, (), F.abs("rho"), 3, ["feature"]).select("feature", "rank", "rho"))


@query("feature_information", final(
    """SELECT feature, sum(c / n * log2(c * n / (ci * cj))) AS mi FROM (SELECT feature, i, label, CAST(c AS DOUBLE) AS c, CAST(sum(c) OVER (PARTITION BY feature) AS DOUBLE) AS n, CAST(sum(c) OVER (PARTITION BY feature, i) AS DOUBLE) AS ci, CAST(sum(c) OVER (PARTITION BY feature, label) AS DOUBLE) AS cj FROM (
  SELECT feature, label, least(floor((x - lo) / (hi - lo) * 16), 15) AS i, count(*) AS c FROM (SELECT *, min(x) OVER (PARTITION BY feature) AS lo, max(x) OVER (PARTITION BY feature) AS hi FROM ul) GROUP BY ALL)) GROUP BY feature""",
    "feature", "mi", TARGETED + ", " + _LONG))
def _information(spark, sf):
    return present(le.feature_information(targeted(spark, sf), CHANNELS, "label"))


@query("trimmed_histograms", final(
    """SELECT feature, label, cell, n, n / (sum(n) OVER (PARTITION BY feature, label) * (hi - lo) / 50) AS density FROM (SELECT feature, label, lo, hi, CAST(least(floor((x - lo) / (hi - lo) * 50), 49) AS BIGINT) AS cell, count(*) AS n FROM (
  SELECT *, quantile_cont(x, 0.01) OVER (PARTITION BY feature) AS lo, quantile_cont(x, 0.99) OVER (PARTITION BY feature) AS hi FROM ul) WHERE x >= lo AND x <= hi GROUP BY ALL)""",
    "feature, cell, n, " + big("label"), "density", TARGETED + ", " + _LONG))
def _histograms(spark, sf):
    return present(le.trimmed_histograms(targeted(spark, sf), CHANNELS, "label"))


@query("integrity_checks", final(
    f"""SELECT channel, day, c.name AS "check", expected, actual, CASE WHEN expected = actual THEN 1 ELSE 0 END AS ok FROM (SELECT channel, day, unnest([{{'name': 'row_count', 'expected': {BINS}, 'actual': count(*)}}, {{'name': 'unique_bins', 'expected': count(*), 'actual': count(DISTINCT bin)}}, {{'name': 'missing', 'expected': 0, 'actual': count(*) - count(v)}}]) AS c, c.expected AS expected, c.actual AS actual FROM lc GROUP BY channel, day)""".replace("c.expected AS expected, c.actual AS actual FROM", "1 AS dummy FROM").replace("expected, actual, CASE WHEN expected = actual", "c.expected AS expected, c.actual AS actual, CASE WHEN c.expected = c.actual"),
    'channel, day, "check", ' + big("expected", "actual", "ok"), "", LC))
def _checks(spark, sf):
    return present(le.checks(lc(spark, sf), ["channel", "day"], BINS, "v"))


@query("split_leakage", final("SELECT day, count(DISTINCT split) AS splits FROM (SELECT day, CASE WHEN idx < floor(n * 0.7) THEN 'train' WHEN idx < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM lb) GROUP BY day HAVING count(DISTINCT split) > 1", "day, splits", "", LABELLED))
def _leak(spark, sf):
    return present(le.leakage(le.chronological_split(labelled(spark, sf).select("day", "win"), "day", ["win"]), "day"))
