"""Curves and reports on tied scores by hand, pruning against the definition."""

import random

import pytest
from pyspark.sql import functions as F

from cardwatch.operators import curve, select

# twelve rows with ties: (score, label)
ROWS = [(0.9, 1), (0.9, 0), (0.8, 1), (0.7, 0), (0.7, 1), (0.7, 0), (0.5, 0), (0.4, 1), (0.4, 0), (0.2, 0), (0.1, 0), (0.1, 0)]


def scores(spark, rows, model="m"):
    return spark.createDataFrame([(model, y, float(p)) for p, y in rows], "model string, y int, prob double")


def by_hand(rows):
    thresholds = sorted({p for p, _ in rows}, reverse=True)
    n_pos, points, last, ap = sum(y for _, y in rows), [], 0.0, 0.0
    for t in thresholds:
        flagged = [y for p, y in rows if p >= t]
        precision, recall = sum(flagged) / len(flagged), sum(flagged) / n_pos
        ap, last = ap + (recall - last) * precision, recall
        points.append((t, precision, recall, 2 * precision * recall / (precision + recall + 1e-9) if recall else 0.0))
    pairs = [(1.0 if p > q else 0.5 if p == q else 0.0) for p, y in rows if y for q, z in rows if not z]
    best = max(points, key=lambda r: (r[3], -r[0]))
    return points, ap, sum(pairs) / len(pairs), best


@pytest.mark.parametrize("per_range", [2, 1_000_000])
def test_curve_by_hand(spark, limits, per_range):
    limits(rowsPerRange=per_range)
    points, ap, auc, best = by_hand(ROWS)
    got = curve.curve_points(scores(spark, ROWS))
    rows = [(r["threshold"], r["precision"], r["recall"], r["f1"]) for r in got.orderBy(F.desc("threshold")).collect()]
    assert [pytest.approx(r) for r in points] == rows
    summary = curve.curve_summary(got).first()
    assert summary["pr_auc"] == pytest.approx(ap) and summary["roc_auc"] == pytest.approx(auc)
    assert (summary["threshold"], summary["best_f1"]) == (best[0], pytest.approx(best[3]))
    assert curve.pr_curve(got).where("threshold IS NULL AND precision = 1 AND recall = 0").count() == 1
    start = curve.roc_curve(None, got).orderBy(F.desc("threshold")).first()
    assert (start["threshold"], start["fpr"], start["tpr"]) == (float("inf"), 0.0, 0.0)


@pytest.mark.parametrize("per_range", [5, 1_000_000])
def test_large_curve_with_one_dominant_model(spark, limits, per_range):
    limits(rowsPerRange=per_range)
    rng = random.Random(2)
    big = [(round(rng.random(), 2), int(rng.random() < 0.1)) for _ in range(2_000)]
    df = scores(spark, big, "big").union(scores(spark, ROWS, "small"))
    got = {r["model"]: r for r in curve.compare_models(df).collect()}
    for name, rows in (("big", big), ("small", ROWS)):
        _, ap, auc, best = by_hand(rows)
        assert got[name]["pr_auc"] == pytest.approx(ap) and got[name]["roc_auc"] == pytest.approx(auc)
        assert got[name]["threshold"] == best[0]
        assert got[name]["tp"] == sum(y for p, y in rows if p >= best[0])
        assert got[name]["tn"] + got[name]["fp"] + got[name]["fn"] + got[name]["tp"] == len(rows)


def test_nothing_flagged_gives_zero(spark):
    at = spark.createDataFrame([("m", 2.0)], "model string, threshold double")
    row = curve.add_rates(curve.confusion(scores(spark, ROWS), at)).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (8, 0, 4, 0)
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_report_rows(spark):
    at = spark.createDataFrame([("m", 0.8)], "model string, threshold double")
    got = {r["label"]: r for r in curve.class_report(curve.confusion(scores(spark, ROWS), at)).collect()}
    assert got["Fraud"]["precision"] == pytest.approx(2 / 3) and got["Fraud"]["support"] == 4
    assert got["Non-Fraud"]["recall"] == pytest.approx(7 / 8)
    assert got["accuracy"]["f1"] == pytest.approx(9 / 12)
    assert got["macro avg"]["recall"] == pytest.approx((7 / 8 + 1 / 2) / 2)
    assert got["weighted avg"]["recall"] == pytest.approx((7 / 8 * 8 + 1 / 2 * 4) / 12)


def test_histogram_last_bin_is_closed_and_empty_bins_stay(spark):
    rows = [(0.0, 0), (0.25, 0), (1.0, 0), (0.6, 1)]
    got = curve.score_histogram(scores(spark, rows), bins=4)
    counts = {(r["y"], r["bin"]): r["n"] for r in got.collect()}
    assert [counts[0, b] for b in range(4)] == [1, 1, 0, 1]
    assert [counts[1, b] for b in range(4)] == [0, 0, 1, 0]  # one value: range opened to 0.1 .. 1.1


def test_corner_points_keep_changes_only(spark, limits):
    rows = [(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 0), (0.4, 1)]
    kept = [r["threshold"] for r in curve.corner_points(curve.curve_points(scores(spark, rows))).collect()]
    assert sorted(kept, reverse=True) == [0.7, 0.5, 0.4]


def prune_by_definition(names, weight, corr, limit=0.9):
    dropped = set()
    for j, name in enumerate(names):
        if name in dropped:
            continue
        for partner in names[:j]:
            if corr[name, partner] > limit and partner not in dropped:
                dropped.add(name if weight[name] < weight[partner] else partner)
    return [n for n in names if n not in dropped]


@pytest.mark.parametrize("seed", range(3))
def test_pruning(spark, seed):
    rng = random.Random(seed)
    base = [[rng.random() for _ in range(60)] for _ in range(2)]
    names = [f"f{i}" for i in range(7)]
    columns = [[v + rng.random() * (0.05 if i % 3 else 0.6) for v in base[i % 2]] for i in range(7)]
    df = spark.createDataFrame(list(zip(*columns)), names)
    weight = {n: round(rng.choice([0.1, 0.2, 0.3]), 1) for n in names}
    table = spark.createDataFrame(list(weight.items()), "feature string, importance double")
    kept = select.keep_important(table, kept=2.0)
    order = [r["feature"] for r in kept.orderBy("rank").collect()]
    assert order == sorted(names, key=lambda n: (-weight[n], n))
    pdf = df.toPandas().corr().abs()
    corr = {(a, b): pdf.loc[a, b] for a in names for b in names}
    got = [r["feature"] for r in select.prune_correlated(df, kept).orderBy("rank").collect()]
    assert got == prune_by_definition(order, weight, corr)


def test_keep_important_includes_the_row_that_reaches_the_share(spark):
    table = spark.createDataFrame([("a", 0.6), ("b", 0.395), ("c", 0.004), ("d", 0.001)], "feature string, importance double")
    assert [r["feature"] for r in select.keep_important(table).orderBy("rank").collect()] == ["a", "b"]


def test_constant_feature_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert select.correlation_matrix(df, ["a", "b"]).first()["r"] is None
