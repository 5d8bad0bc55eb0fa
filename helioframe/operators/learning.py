"""Splits, scaling, classifiers, scores and feature statistics."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ratio
from ..session import sized
from .ranking import exact_quantiles, global_index, ordered_counts, spearman, with_totals

THRESHOLDS = [i / 100 for i in range(1, 100)]


# -- splits ------------------------------------------------------------------------------------------------
def chronological_split(df: DataFrame, bucket: str, order, shares=(0.7, 0.15)) -> DataFrame:
    """``split`` = train / val / test by position in time."""
    d = global_index(df, bucket, order, "idx")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    d = with_totals(d, total)
    a, b = F.floor(F.col("_n") * shares[0]), F.floor(F.col("_n") * (shares[0] + shares[1]))
    return d.withColumn("split", F.when(F.col("idx") < a, "train").when(F.col("idx") < b, "val").otherwise("test")).drop("_n")


def rolling_origin(df: DataFrame, bucket: str, order, folds=5, val_share=0.2) -> DataFrame:
    """One copy of each row per fold that uses it: fold k trains on the first k+1 parts, holds out the
    last ``val_share`` of them for validation and tests on the next part."""
    d = global_index(df, bucket, order, "idx")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    d = with_totals(d, total)
    d = d.withColumn("_size", F.floor(F.col("_n") / F.lit(folds + 1)))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    end = (F.col("fold") + 1) * F.col("_size")
    hold = end - F.floor(end * val_share)
    role = F.when(F.col("idx") < hold, "train").when(F.col("idx") < end, "val").when(F.col("idx") < end + F.col("_size"), "test")
    return d.withColumn("role", role).where(F.col("role").isNotNull()).drop("_n", "_size")


def fit_scaler(train: DataFrame, columns) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the training rows: one aggregate row, two numbers a column."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in columns}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / (s if s > 0 else 1.0) for c, (m, s) in fitted.items()})


def class_weight(train: DataFrame, label: str) -> DataFrame:
    pos, neg = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    return train.agg(pos.alias("pos"), neg.alias("neg"), (neg / F.greatest(pos, F.lit(1))).alias("weight"))


# -- models ---------------------------------------------------------------------------------------------------
# Rounds, step and depth of the boosted trees, trees of the forest
DEFAULTS = {"gbt": {"maxIter": 1000, "stepSize": 0.05, "maxDepth": 8}, "rf": {"numTrees": 100}}


def train_classifier(train: DataFrame, features, label: str, kind="gbt", weight: str | None = None, **params):
    """Boosted trees or a random forest over an assembled feature vector; ``params`` replace the defaults of the kind."""
    model = {"gbt": GBTClassifier, "rf": RandomForestClassifier}[kind](featuresCol="_features", labelCol=label, seed=42, **(DEFAULTS[kind] | params))
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), model]).fit(train)


def score(model, df: DataFrame) -> DataFrame:
    """``score`` = probability of label 1; a forest trained on label 0 alone has no such class: 0."""
    out = model.transform(df)
    return out.withColumn("score", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))).drop("_features", "rawPrediction", "probability", "prediction")


def importances(model, features, spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


# -- scores ---------------------------------------------------------------------------------------------------
def confusion_sweep(df: DataFrame, score_col: str, label: str, thresholds=None, by=()) -> DataFrame:
    """tp / fp / fn / tn per threshold (score >= threshold is positive).

    A row is counted once, in the slot of the highest threshold it reaches; the confusion counts are
    running sums over at most one hundred slots.
    """
    by, thresholds = list(by), thresholds or THRESHOLDS
    grid = F.array(*[F.lit(t) for t in thresholds])
    slot = F.size(F.filter(grid, lambda t: t <= F.col(score_col)))
    pos, neg = F.when(F.col(label) == 1, 1).otherwise(0), F.when(F.col(label) == 1, 0).otherwise(1)
    per = df.groupBy(*by, slot.alias("_slot")).agg(F.sum(pos).alias("_p"), F.sum(neg).alias("_q"))
    # every slot present, so a threshold without own rows still reports
    totals = per.groupBy(*by).agg(F.sum("_p").alias("_P"), F.sum("_q").alias("_Q"), F.map_from_entries(F.collect_list(F.struct("_slot", F.struct("_p", "_q")))).alias("_m"))
    rows = totals.select(*by, "_P", "_Q", "_m", F.explode(F.sequence(F.lit(1), F.lit(len(thresholds)))).alias("_k"))
    reach = lambda name: F.aggregate(F.sequence(F.col("_k"), F.lit(len(thresholds))), F.lit(0).cast("bigint"), lambda a, s: a + F.coalesce(F.try_element_at("_m", s)[name], F.lit(0)))
    out = rows.select(*by, F.element_at(grid, F.col("_k")).alias("threshold"), reach("_p").alias("tp"), reach("_q").alias("fp"), "_P", "_Q")
    return out.select(*by, "threshold", "tp", "fp", (F.col("_P") - F.col("tp")).alias("fn"), (F.col("_Q") - F.col("fp")).alias("tn"))


def skill(counts: DataFrame) -> DataFrame:
    """Skill scores from confusion counts."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    d = counts.withColumn("recall", div(tp, tp + fn)).withColumn("precision", div(tp, tp + fp)).withColumn("specificity", div(tn, tn + fp))
    d = d.withColumn("tss", F.col("recall") + F.col("specificity") - 1).withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)
    d = d.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    d = d.withColumn("hss", div(2 * (tp * tn - fp * fn), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    d = d.withColumn("mcc", div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))))
    n = tp + fp + fn + tn
    chance = div((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return d.withColumn("kappa", div(div(tp + tn, n) - chance, 1 - chance))


def best_threshold(sweep: DataFrame, by=()) -> DataFrame:
    """Threshold with the highest TSS (ties: the lowest threshold)."""
    top = F.max(F.struct(F.col("tss").alias("v"), (-F.col("threshold")).alias("t")))
    return skill(sweep).groupBy(*by).agg(top.alias("_b")).select(*by, (-F.col("_b.t")).alias("threshold"), F.col("_b.v").alias("tss"))


def curve_points(df: DataFrame, score_col: str, label: str, by=()) -> DataFrame:
    """ROC / PR points per distinct score: tp, fp, tpr, fpr, precision at score >= s."""
    by = list(by)
    pos, neg = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.sum(F.when(F.col(label) == 1, 0).otherwise(1))
    c = ordered_counts(df, by, score_col, {"pos": pos, "neg": neg})
    t = c.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    d = c.join(t, by) if by else with_totals(c, t)
    d = d.withColumn("tp", F.col("_P") - F.col("pos_before")).withColumn("fp", F.col("_N") - F.col("neg_before"))
    d = d.withColumn("tpr", F.col("tp") / F.greatest("_P", F.lit(1))).withColumn("fpr", F.col("fp") / F.greatest("_N", F.lit(1)))
    return d.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))


def area_scores(df: DataFrame, score_col: str, label: str, by=()) -> DataFrame:
    """AUC-ROC by rank sums (ties count half) and average precision; NULL where a group lacks the class they need."""
    d = curve_points(df, score_col, label, by)
    auc = ratio(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)), F.max(F.col("_P").cast("double") * F.col("_N")))
    ap = ratio(F.sum(F.col("pos") * F.col("precision")), F.max("_P"))
    return d.groupBy(*by).agg(F.max("_P").alias("positives"), F.max("_N").alias("negatives"), auc.alias("auc_roc"), ap.alias("auc_pr"))


def ensemble(df: DataFrame, keys, score_col="score") -> DataFrame:
    """Mean and spread of repeated predictions per sample."""
    return df.groupBy(*keys).agg(F.avg(score_col).alias("mean_score"), F.stddev_pop(score_col).alias("std_score"), F.count(F.lit(1)).alias("passes"))


# -- feature statistics -------------------------------------------------------------------------------------
def to_long(df: DataFrame, ids, features) -> DataFrame:
    return df.unpivot([F.col(c) for c in ids], [F.col(c).cast("double").alias(c) for c in features], "feature", "x").where(F.col("x").isNotNull())


def feature_target(df: DataFrame, features, targets, least=50) -> DataFrame:
    """Spearman correlation of every feature with every target, at least ``least`` pairs."""
    long = to_long(df, list(targets), features)
    every = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets]))
    long = long.select("feature", "x", every.alias("_t")).select("feature", "x", "_t.target", "_t.y")
    return spearman(long, ["feature", "target"], "x", "y").where(F.col("n") >= least)


def feature_feature(df: DataFrame, features, least=50) -> DataFrame:
    """Spearman correlation of every feature pair (pairs come from the column list)."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    opts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])
    long = df.select(F.inline(opts))
    return spearman(long, ["a", "b"], "x", "y").where(F.col("n") >= least)


def top_by(df: DataFrame, by, value: Column, k: int, ties) -> DataFrame:
    """The k rows with the largest value per group of a bounded report table."""
    w = Window.partitionBy(*by).orderBy(value.desc(), *ties) if by else Window.orderBy(value.desc(), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def feature_information(df: DataFrame, features, label: str, bins=16) -> DataFrame:
    """Binned mutual information of each feature with the label, in bits.

    Bin edges need only each feature's range (one aggregate); afterwards a feature is at most
    ``bins`` x classes counts.
    """
    long = to_long(df, [label], features)
    span = sized(long.groupBy("feature").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi")), "ranges")
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    cells = long.join(span, "feature").groupBy("feature", cell.cast("bigint").alias("_i"), F.col(label).alias("_j")).agg(F.count(F.lit(1)).alias("c"))
    over = lambda *k: F.sum("c").over(Window.partitionBy("feature", *k))
    cells = cells.withColumn("n", over()).withColumn("ci", over("_i")).withColumn("cj", over("_j"))
    return cells.groupBy("feature").agg(F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n") / (F.col("ci") * F.col("cj")))).alias("mi"))


def trimmed_histograms(df: DataFrame, features, label: str, bins=50, trim=(0.01, 0.99)) -> DataFrame:
    """Density per (feature, label, bin) between the trimmed quantiles of the feature."""
    long = to_long(df, [label], features)
    q = exact_quantiles(long, ["feature"], "x", trim).groupBy("feature").agg(F.min("quantile").alias("_lo"), F.max("quantile").alias("_hi"))
    d = long.join(sized(q, "ranges"), "feature").where((F.col("x") >= F.col("_lo")) & (F.col("x") <= F.col("_hi")) & (F.col("_hi") > F.col("_lo")))
    cell = F.least(F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("bigint")
    c = d.groupBy("feature", F.col(label).alias("label"), "_lo", "_hi", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature", "label"))
    return c.select("feature", "label", "cell", "n", (F.col("n") / (total * (F.col("_hi") - F.col("_lo")) / bins)).alias("density"))


# -- integrity and increments -----------------------------------------------------------------------------------
def checks(df: DataFrame, keys, rows_expected: int, value: str) -> DataFrame:
    """(check, key..., expected, actual, ok): complete days and missing values."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(value).isNull(), 1)).alias("missing"), F.countDistinct("bin").alias("bins"))
    opts = F.array(
        F.struct(F.lit("row_count").alias("check"), F.lit(rows_expected).cast("bigint").alias("expected"), F.col("rows").alias("actual")),
        F.struct(F.lit("unique_bins").alias("check"), F.col("rows").alias("expected"), F.col("bins").alias("actual")),
        F.struct(F.lit("missing").alias("check"), F.lit(0).cast("bigint").alias("expected"), F.col("missing").alias("actual")))
    return per.select(*keys, F.inline(opts)).withColumn("ok", (F.col("expected") == F.col("actual")).cast("bigint"))


def leakage(df: DataFrame, day: str, split="split") -> DataFrame:
    """Days that appear in more than one split."""
    return df.groupBy(day).agg(F.countDistinct(split).alias("splits")).where(F.col("splits") > 1)


def pending_days(days: DataFrame, done: DataFrame) -> DataFrame:
    """Days not processed yet."""
    return days.join(done.select("day").distinct(), "day", "left_anti")
