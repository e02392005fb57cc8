"""Precision/recall and ROC curves and the numbers read off them, for many models in one job.

Input is a long table (model, y, prob). Rows are first counted per distinct score; the cumulative
counts then come from the two-level running sums, so no model's scores are sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardwatch.operators.running import range_chunks, running_sums
from cardwatch.runtime import ROWS_PER_RANGE, lookup_join, setting, stored
from cardwatch.schema import F1_EPSILON, HISTOGRAM_BINS


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.when(bottom != 0, bottom))


def long_scores(df: DataFrame, models: list[str], key: str = "trans_num", label: str = "is_fraud") -> DataFrame:
    """One column per model -> rows (key, y, model, prob)."""
    return df.select(key, F.col(label).alias("y"), *models).unpivot([key, "y"], models, "model", "prob")


def curve_points(scores: DataFrame) -> DataFrame:
    """One row per model and distinct score, with counts at this score and at or above it.

    Columns: pos, n (here); tp, flagged (at or above); n_pos, n_all (whole model); precision,
    recall, fpr, f1.
    """
    points = scores.groupBy("model", "prob").agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"), F.count("*").alias("n"))
    run = running_sums(points, ["model"], "prob", ["pos", "n"], descending=True).select(
        "model", F.col("prob").alias("threshold"), "pos", "n",
        F.col("run_pos").alias("tp"), F.col("run_n").alias("flagged"),
        F.col("all_pos").alias("n_pos"), F.col("all_n").alias("n_all"),
    )
    precision, recall = F.col("precision"), F.col("recall")
    return run.withColumns({
        "precision": F.col("tp") / F.col("flagged"),
        # without positives recall is 1 everywhere
        "recall": F.when(F.col("n_pos") == 0, F.lit(1.0)).otherwise(
            F.col("tp") / F.when(F.col("n_pos") != 0, F.col("n_pos"))),
        "fpr": _ratio(F.col("flagged") - F.col("tp"), F.col("n_all") - F.col("n_pos")),
    }).withColumn("f1", F.when(precision + recall == 0, F.lit(0.0)).otherwise(
        2 * precision * recall / (precision + recall + F.lit(F1_EPSILON))))


def pr_curve(points: DataFrame) -> DataFrame:
    """Precision and recall per threshold, closed by the end point (1, 0) that has no threshold."""
    ends = points.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return points.select("model", "threshold", "precision", "recall").unionByName(ends)


def f1_by_threshold(points: DataFrame) -> DataFrame:
    return points.select("model", "threshold", "f1")


def roc_curve(scores: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """False and true positive rate per threshold, opened by (0, 0) at infinity."""
    points = curve_points(scores) if points is None else points
    starts = points.select("model").distinct().select(
        "model", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.select("model", "threshold", "fpr", F.col("recall").alias("tpr")).unionByName(starts)


def curve_summary(points: DataFrame) -> DataFrame:
    """Per model: average precision, ROC area (ties count half), best-F1 threshold, prevalence."""
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    n_pos, n_all = F.first("n_pos"), F.first("n_all")
    at = F.max_by(F.struct("threshold", "f1", "tp", "flagged"),
                  F.struct("f1", -F.col("threshold"))).alias("at")  # of equals the lowest threshold
    return points.groupBy("model").agg(
        _ratio(F.sum(pos * F.col("precision")), n_pos).alias("pr_auc"),
        (F.sum(neg * (F.col("tp") - pos / 2)) / F.nullif(n_pos * (n_all - n_pos), F.lit(0))).alias("roc_auc"),
        (n_pos / n_all).alias("prevalence"),
        n_pos.alias("n_pos"), n_all.alias("n_rows"), at,
    ).withColumns({"threshold": F.col("at.threshold"), "best_f1": F.col("at.f1")})


def confusion(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """tn, fp, fn, tp per model at its threshold (table model, threshold)."""
    flagged = F.col("prob") >= F.col("threshold")
    # one row per model is broadcast, so four counters per model are all that is shuffled
    limits = stored(thresholds.select("model", "threshold"), "limits")
    total = lambda cond, name: F.count_if(cond).alias(name)
    return lookup_join(scores, limits, "model", "inner").groupBy("model", "threshold").agg(
        total(~flagged & (F.col("y") == 0), "tn"), total(flagged & (F.col("y") == 0), "fp"),
        total(~flagged & (F.col("y") == 1), "fn"), total(flagged & (F.col("y") == 1), "tp"),
    )


def add_rates(confused: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confused.withColumns({
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def class_report(confused: DataFrame) -> DataFrame:
    """Per model: precision, recall, F1, support of both classes, accuracy, macro and weighted means."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def entry(name, hit, false_alarm, missed):
        return F.struct(
            F.lit(name).alias("label"), _ratio(hit, hit + false_alarm).alias("precision"),
            _ratio(hit, hit + missed).alias("recall"),
            _ratio(2 * hit, 2 * hit + false_alarm + missed).alias("f1"), (hit + missed).alias("support"))

    base = confused.select(
        "model", entry("Non-Fraud", tn, fn, fp).alias("a"), entry("Fraud", tp, fp, fn).alias("b"),
        (tn + fp + fn + tp).alias("total"), _ratio(tn + tp, tn + fp + fn + tp).alias("acc"))

    def mean(name, weight_a, weight_b, total):
        part = lambda c: ((F.col(f"a.{c}") * weight_a + F.col(f"b.{c}") * weight_b) / total).alias(c)
        return F.struct(F.lit(name).alias("label"), part("precision"), part("recall"), part("f1"),
                        F.col("total").alias("support"))

    accuracy = F.struct(F.lit("accuracy").alias("label"), F.col("acc").alias("precision"),
                        F.col("acc").alias("recall"), F.col("acc").alias("f1"), F.col("total").alias("support"))
    rows = F.array("a", "b", accuracy, mean("macro avg", F.lit(1.0), F.lit(1.0), F.lit(2.0)),
                   mean("weighted avg", F.col("a.support"), F.col("b.support"), F.col("total")))
    return base.select("model", F.explode(rows).alias("r")).select("model", "r.*")


def compare_models(scores: DataFrame) -> DataFrame:
    """The comparison table: curve numbers and the rates at each model's best-F1 threshold.

    The counts at the chosen threshold are read off the curve, so the scores are passed once.
    """
    summary = curve_summary(curve_points(scores))
    tp, fp = F.col("at.tp"), F.col("at.flagged") - F.col("at.tp")
    fn = F.col("n_pos") - tp
    return add_rates(summary.select(
        "model", "pr_auc", "roc_auc", "threshold", "prevalence",
        (F.col("n_rows") - tp - fp - fn).alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp")))


def score_histogram(scores: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts per model, class and bin over that class's own score range; the last bin is closed.

    The few ranges are found first and broadcast; bins are then counted map-side.
    """
    groups = scores.groupBy("model", "y").agg(F.min("prob").alias("lo"), F.max("prob").alias("hi"))
    # one value only: the range opens by half a unit on each side
    flat = F.col("lo") == F.col("hi")
    groups = groups.select("model", "y", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                           F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    groups = stored(groups, "score-ranges")
    position = F.floor((F.col("prob") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    filled = lookup_join(scores, groups, ["model", "y"], "inner").withColumn(
        "bin", F.least(position, F.lit(bins - 1))).groupBy("model", "y", "bin").agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    every_bin = F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))
    grid = groups.select("model", "y", "lo", "hi", F.explode(every_bin).alias("bin"))
    return grid.join(filled, ["model", "y", "bin"], "left").select(
        "model", "y", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"))


def corner_points(points: DataFrame) -> DataFrame:
    """Thin a ROC curve for drawing: keep points where the step to the next one changes.

    Within a model the next point is found per score range; the first step of the following range
    is carried in from the table of range starts.
    """
    points = stored(points, "curve")
    per_range = setting(points.sparkSession, "rowsPerRange", ROWS_PER_RANGE)
    chunked = range_chunks(points, ["threshold", "model"], points.count(), per_range, "curve-ranges")
    step = F.struct("pos", "n")
    inside = W.partitionBy("model", "chunk").orderBy(F.desc("threshold"))
    starts = chunked.groupBy("model", "chunk").agg(F.max_by(step, "threshold").alias("first_step"))
    following = W.partitionBy("model").orderBy(F.desc("chunk"))
    starts = starts.select("model", "chunk", F.lead("first_step").over(following).alias("carried"))
    nxt = F.coalesce(F.lead(step).over(inside), F.col("carried"))
    return chunked.join(starts, ["model", "chunk"]).withColumn("next", nxt).where(
        F.col("next").isNull() | (F.col("next") != step)).drop("next", "carried", "chunk")
