"""Statistics fitted on the training rows, and the joins that put them onto any rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.functions.scalar import clip
from cardwatch.operators.running import exact_medians
from cardwatch.runtime import HotKeys, bounded, lookup_join, one_row
from cardwatch.schema import EPSILON, SMOOTHING_WEIGHT, TARGET

LOCATION_DEFAULTS = {"uid_unique_locs": 1, "uid_loc_std_lat": 0.0, "uid_loc_std_lon": 0.0}


def global_scalars(train: DataFrame) -> DataFrame:
    """All population-level numbers in one pass over the training rows."""
    positives = F.count_if(F.col(TARGET) == 1)
    negatives = F.count_if(F.col(TARGET) == 0)
    mean = F.avg("amt")
    return train.agg(
        mean.alias("seq_global_mean"),
        mean.alias("global_amt_mean"),
        F.greatest(F.stddev_samp("amt"), F.lit(EPSILON)).alias("global_amt_std"),
        F.greatest(F.avg("distance_km"), F.lit(EPSILON)).alias("dist_mean"),
        negatives.alias("n_negative"),
        positives.alias("n_positive"),
        (negatives / F.greatest(positives, F.lit(1))).alias("scale_pos_weight"),
    )


def location_stats(train: DataFrame, approximate: bool = False) -> DataFrame:
    """Per card: distinct latitudes and the spread of both coordinates (0 for one row)."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return train.groupBy("card_uid").agg(
        distinct(F.col("lat")).alias("uid_unique_locs"),
        F.coalesce(F.stddev_samp("lat"), F.lit(0.0)).alias("uid_loc_std_lat"),
        F.coalesce(F.stddev_samp("long"), F.lit(0.0)).alias("uid_loc_std_lon"),
    )


def category_stats(train: DataFrame, approximate: bool = False) -> DataFrame:
    """Per category: mean amount drawn towards the global mean, and the median.

    The median is exact without holding a category's values in one task; ``approximate`` saves
    its extra shuffle.
    """
    prior = train.agg(F.avg("amt").alias("m")).scalar()
    measures = [F.count("amt").alias("cat_count"), F.sum("amt").alias("cat_sum")]
    if approximate:
        measures.append(F.percentile_approx("amt", 0.5, 10_000).alias("cat_median_amt"))
    raw = train.groupBy("category").agg(*measures)
    if not approximate:
        raw = raw.join(exact_medians(train, ["category"], "amt", "cat_median_amt"), "category", "left")
    smoothed = (F.col("cat_sum") + F.lit(SMOOTHING_WEIGHT) * prior) / (F.col("cat_count") + F.lit(SMOOTHING_WEIGHT))
    return raw.where(F.col("category").isNotNull()).select(
        "category", "cat_count", "cat_sum", smoothed.alias("cat_mean_amt"), "cat_median_amt")


def category_fallback(categories: DataFrame) -> DataFrame:
    """What an unknown category gets: the medians over the category table (one row per category)."""
    return categories.agg(
        F.percentile("cat_mean_amt", F.lit(0.5)).alias("cat_mean_amt"),
        F.percentile("cat_median_amt", F.lit(0.5)).alias("cat_median_amt"),
    )


def join_location(df: DataFrame, stats: DataFrame, hot: HotKeys | None = None, fits: bool | None = None) -> DataFrame:
    """Cards without training rows get the defaults. The heavy cards' stats, one row each, are broadcast if their count
    allows; the rest joins by card, so a heavy card never lands in one task. ``fits`` tells that all stats may be broadcast."""
    if hot:
        joined = hot.rest(df).join(hot.rest(stats), "card_uid", "left").unionByName(
            hot.pick(df).join(bounded(hot.pick(stats), hot.count), "card_uid", "left"))
    elif fits is None:
        joined = lookup_join(df, stats, "card_uid")
    else:
        joined = df.join(F.broadcast(stats) if fits else stats, "card_uid", "left")
    return joined.fillna(LOCATION_DEFAULTS)


def join_category(df: DataFrame, categories: DataFrame, fallback: Column | None = None) -> DataFrame:
    table = categories.select("category", "cat_mean_amt", "cat_median_amt")
    default = one_row(category_fallback(categories)) if fallback is None else fallback
    return lookup_join(df, table, "category").withColumns({
        c: F.coalesce(F.col(c), default.getField(c)) for c in ("cat_mean_amt", "cat_median_amt")})


def zscore(scalars: Column) -> Column:
    return clip((F.col("amt") - scalars.getField("global_amt_mean")) / scalars.getField("global_amt_std"))


def anomaly(scalars: Column) -> Column:
    return clip(F.col("distance_km") / scalars.getField("dist_mean"))


def add_population_features(df: DataFrame, scalars: Column) -> DataFrame:
    return df.withColumns({"amt_zscore_global": zscore(scalars), "distance_anomaly": anomaly(scalars)})


def class_weight(df: DataFrame, scalars: Column, out: str = "w") -> DataFrame:
    return df.withColumn(
        out, F.when(F.col(TARGET) == 1, scalars.getField("scale_pos_weight")).otherwise(F.lit(1.0)))
