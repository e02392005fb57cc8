"""Ordered sums, medians, splits, statistics and encoding, also with one group that holds most rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.operators import encode, running, split, stats
from cardwatch.plans.features import FeatureStats, apply_features, fit_features
from cardwatch.runtime import HotKeys, one_row
from cardwatch.schema import UNSEEN
from cardwatch.sources import fixtures


def skewed(n=3_000, seed=5):
    rng = random.Random(seed)
    return [(rng.choice("aaaaaaab"), round(rng.expovariate(0.01), 1), rng.randrange(1, 5)) for _ in range(n)]


@pytest.mark.parametrize("per_range", [10, 1_000_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, limits, per_range, descending):
    limits(rowsPerRange=per_range)
    merged = defaultdict(int)
    for group, value, n in skewed():
        merged[group, value] += n
    points = spark.createDataFrame([(g, v, n) for (g, v), n in merged.items()], "g string, v double, n bigint")
    got = {(r["g"], r["v"]): (r["run_n"], r["all_n"]) for r in
           running.running_sums(points, ["g"], "v", ["n"], descending).collect()}
    for group in "ab":
        total, upto = sum(n for (g, _), n in merged.items() if g == group), 0
        for value in sorted((v for g, v in merged if g == group), reverse=descending):
            upto += merged[group, value]
            assert got[group, value] == (upto, total)


@pytest.mark.parametrize("per_range", [10, 1_000_000])
def test_exact_medians(spark, limits, per_range):
    limits(rowsPerRange=per_range)
    rows = skewed(1_501) + [("single", 4.5, 1), ("pair", 1.0, 1), ("pair", 2.0, 1)]
    df = spark.createDataFrame([(g, v) for g, v, _ in rows] + [("none", None)], "g string, v double")
    got = {r["g"]: r["m"] for r in running.exact_medians(df, ["g"], "v", "m").collect()}
    want = {g: float(np.median([v for h, v, _ in rows if h == g])) for g in {g for g, _, _ in rows}}
    assert got == pytest.approx(want)


def test_hash_cutoffs_match_a_full_sort(spark):
    df = spark.createDataFrame([(i % 7 == 0, f"k{i}") for i in range(900)], "g boolean, k string").withColumn(
        "key", running.hash_key(F.col("k"), 1))
    got = {r["g"]: r["cutoff"] for r in running.hash_cutoffs(df, ["g"], "key", F.lit(40)).collect()}
    for group in (True, False):
        keys = sorted(r["key"] for r in df.where(F.col("g") == group).collect())
        assert got[group] == keys[39]
    ranks = running.hash_rank(df, ["g"], "key", "k").collect()
    assert sorted(r["rank"] for r in ranks if r["g"]) == list(range(1, 130))


def cards(spark, n_cards, hot_rows=0):
    rows = [(f"c{i}", i * 100 + j, int((i + j) % 9 == 0)) for i in range(n_cards) for j in range(1 + i % 5)]
    rows += [("hot", 1_000_000 + j, int(j % 20 == 0)) for j in range(hot_rows)]
    return spark.createDataFrame(rows, "card_uid string, trans_num bigint, is_fraud int")


@pytest.mark.parametrize("n", [1, 2, 35, 101])
def test_holdout_takes_the_exact_share_of_cards(spark, n):
    df = split.group_holdout(cards(spark, n))
    sides = {r["card_uid"]: r["sides"] for r in
             df.groupBy("card_uid").agg(F.collect_set("split").alias("sides")).collect()}
    assert all(len(s) == 1 for s in sides.values())
    assert sum(s == ["test"] for s in sides.values()) == math.ceil(0.2 * n)
    split.assert_no_overlap(df)


def test_overlap_is_reported(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test")], "card_uid string, split string")
    with pytest.raises(ValueError, match="1 cards"):
        split.assert_no_overlap(df)


def test_folds(spark):
    df = cards(spark, 200)
    sums = [r["n"] for r in split.balanced_folds(df).groupBy("fold").agg(F.sum("n_rows").alias("n")).collect()]
    assert len(sums) == 3 and max(sums) - min(sums) <= 10
    for tagged in (split.with_balanced_fold(df), split.hash_fold(df)):
        assert tagged.count() == df.count()
        assert tagged.groupBy("card_uid").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0


def test_stratified_flag_and_sample(spark):
    df = cards(spark, 150, hot_rows=400)
    totals = Counter(r["is_fraud"] for r in df.collect())
    flagged = Counter((r["is_fraud"], r["v"]) for r in split.stratified_flag(df, 0.1, "v").collect())
    assert all(flagged[y, True] == math.ceil(0.1 * totals[y]) for y in (0, 1))
    sample = Counter(r["is_fraud"] for r in split.stratified_sample(df, 60).collect())
    assert sample == {1: 30, 0: 30}
    everything = split.stratified_sample(df, 10 * sum(totals.values()))
    assert everything.count() == df.count()


def test_subsample_keeps_cards_whole(spark):
    df = cards(spark, 200)
    n = df.count()
    part = split.subsample_cards(df, n // 2, n)
    sizes = {r["card_uid"]: r["count"] for r in df.groupBy("card_uid").count().collect()}
    assert all(sizes[r["card_uid"]] == r["count"] for r in part.groupBy("card_uid").count().collect())
    assert 0 < part.count() < n and split.subsample_cards(df, n, n).count() == n


@pytest.mark.parametrize("small", [True, False])
def test_vocabulary_and_codes(spark, limits, small):
    if not small:
        limits(broadcastRows=3, rowsPerRange=4)
    train = spark.createDataFrame([(v,) for v in ["b", "a", "Z", "9", None, "b"]], "job string")
    vocabulary = encode.fit_vocabulary(train, ["job"])
    codes = {r["value"]: r["code"] for r in vocabulary.collect()}
    assert codes == {v: i for i, v in enumerate(sorted(["b", "a", "Z", "9", "nan", UNSEEN]))}
    other = spark.createDataFrame([("a",), ("new",), (None,)], "job string")
    assert [r["job"] for r in encode.encode(other, vocabulary, ["job"]).orderBy("job").collect()] == sorted(
        [codes["a"], codes[UNSEEN], codes["nan"]])
    assert encode.unseen_counts(other, vocabulary, ["job"]).first()["n_unseen"] == 1


def test_category_smoothing_and_fallback(spark):
    train = spark.createDataFrame([("x", 10.0), ("x", 20.0), ("y", 60.0)], "category string, amt double")
    table = {r["category"]: r for r in stats.category_stats(train).collect()}
    assert table["x"]["cat_mean_amt"] == pytest.approx((30 + 10 * 30) / 12)
    assert table["y"]["cat_median_amt"] == 60.0
    new = stats.join_category(spark.createDataFrame([("z",)], "category string"), stats.category_stats(train)).first()
    assert new["cat_median_amt"] == 37.5


def test_one_row_train_has_a_floor(spark):
    train = spark.createDataFrame([(5.0, 0.0, 1)], "amt double, distance_km double, is_fraud int")
    row = stats.global_scalars(train.union(train)).first()
    assert row["global_amt_std"] == 1e-6 and row["dist_mean"] == 1e-6 and row["scale_pos_weight"] == 0.0


@pytest.mark.parametrize("hot", [False, True])
def test_location_join(spark, limits, hot):
    if hot:
        limits(hotKeyRows=2)
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0), ("a", 3.0, 5.0), ("b", 1.0, 1.0)],
                               "card_uid string, lat double, long double")
    joined = stats.join_location(df.union(spark.createDataFrame([("new", 0.0, 0.0)], df.schema)),
                                 stats.location_stats(df), HotKeys(df, "card_uid"))
    got = {r["card_uid"]: (r["uid_unique_locs"], round(r["uid_loc_std_lat"], 6)) for r in joined.collect()}
    assert joined.count() == 5 and got == {"a": (2, 1.154701), "b": (1, 0.0), "new": (1, 0.0)}


def test_test_rows_never_reach_the_statistics(spark, sf, tmp_path):
    df = fixtures.txn_split(spark, sf)
    fitted = fit_features(df.where("split = 'train'"))
    features = apply_features(df, fitted)
    assert features.count() == df.count()
    assert features.where("split = 'test' AND (uid_unique_locs <> 1 OR uid_loc_std_lat <> 0)").count() == 0
    louder = df.withColumn("amt", F.when(F.col("split") == "test", F.col("amt") * 9).otherwise(F.col("amt")))
    again = fit_features(louder.where("split = 'train'"))
    assert again.scalars.first() == fitted.scalars.first()
    fitted.save(str(tmp_path / "stats"))
    loaded = FeatureStats.load(spark, str(tmp_path / "stats"))
    assert loaded.vocabulary.exceptAll(fitted.vocabulary).count() == 0
    same = apply_features(df, loaded)
    assert same.exceptAll(features).count() == 0


def test_scalars_as_subquery_or_table(spark):
    train = spark.createDataFrame([(5.0, 1.0, 1), (7.0, 3.0, 0)], "amt double, distance_km double, is_fraud int")
    row = stats.add_population_features(train, one_row(stats.global_scalars(train))).orderBy("amt").first()
    assert row["amt_zscore_global"] == pytest.approx(-0.70710678) and row["distance_anomaly"] == 0.5
