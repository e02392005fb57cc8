"""Splits that keep a card whole, and stratified row splits; all decided by a hash, so repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardwatch.operators.running import hash_cutoffs, hash_key, hash_rank
from cardwatch.runtime import lookup_join, stored
from cardwatch.schema import CALIBRATION_SHARE, CV_FOLDS, EARLY_STOP_SHARE, SEED, TARGET, TEST_SHARE

#: the label is a class, not a measure; more values than this are an error in the data
MAX_CLASSES = 100


def _card_cutoff(df: DataFrame, share: float, seed: int | None) -> str:
    """The hash of the last of the lowest ``ceil(share * n)`` cards."""
    cards = stored(
        df.select("card_uid").distinct().select(hash_key(F.col("card_uid"), seed).alias("key")), "cards")
    found = hash_cutoffs(cards, [], "key", F.ceil(F.lit(share) * F.col("group_rows"))).first()
    return found["cutoff"] if found else ""


def group_holdout(df: DataFrame, share: float = TEST_SHARE, seed: int | None = None) -> DataFrame:
    """Tag rows ``test`` for exactly ``ceil(share * cards)`` cards, ``train`` for the others.

    One hash limit is found up front; tagging is then a comparison, without a join or a shuffle.
    """
    is_test = hash_key(F.col("card_uid"), seed) <= F.lit(_card_cutoff(df, share, seed))
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def subsample_cards(df: DataFrame, max_rows: int, n_rows: int, seed: int = SEED) -> DataFrame:
    """Whole cards making up about ``max_rows`` rows; everything when there are fewer."""
    if n_rows <= max_rows:
        return df
    return df.where(hash_key(F.col("card_uid"), seed) <= F.lit(_card_cutoff(df, max_rows / n_rows, seed)))


def hash_fold(df: DataFrame, folds: int = CV_FOLDS) -> DataFrame:
    """Card-whole folds by hash alone; nothing is counted, sorted or joined."""
    number = F.conv(F.substring(F.md5("card_uid"), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", (number % folds).cast("int"))


def balanced_folds(df: DataFrame, folds: int = CV_FOLDS) -> DataFrame:
    """One row per card with its fold; folds get near equal row counts.

    Cards are dealt out by size, back and forth over the folds. The order by size comes from the
    few distinct sizes, and within one size from the hash.
    """
    cards = stored(
        df.groupBy("card_uid").agg(F.count("*").alias("n_rows")).withColumn("key", F.md5("card_uid")), "card-sizes")
    larger = W.orderBy(F.desc("n_rows")).rowsBetween(W.unboundedPreceding, -1)
    sizes = cards.groupBy("n_rows").agg(F.count("*").alias("cards")).select(
        F.col("n_rows").alias("size"), F.coalesce(F.sum("cards").over(larger), F.lit(0)).alias("ahead_cards"))
    ranked = hash_rank(cards, ["n_rows"], "key", "card_uid")
    turn = (F.col("ahead_cards") + F.col("rank") - 1) % (2 * folds)
    # distinct sizes are at most the root of twice the rows; most cards share a few of them
    return (
        lookup_join(ranked.withColumn("size", F.col("n_rows")), stored(sizes, "sizes"), "size", "inner")
        .select("card_uid", "n_rows",
                F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn).cast("int").alias("fold"))
    )


def with_balanced_fold(df: DataFrame, folds: int = CV_FOLDS) -> DataFrame:
    return lookup_join(df, balanced_folds(df, folds).select("card_uid", "fold"), "card_uid", "inner")


def _up_to(df: DataFrame, size: Column, key: str, seed: int, label: str) -> Column:
    """True for the first ``size`` rows of each class in hash order."""
    hashed = hash_key(F.col(key), seed)
    keys = stored(df.select(label, hashed.alias("_key")), "hash-keys")
    limits = hash_cutoffs(keys, [label], "_key", size).limit(MAX_CLASSES + 1).collect()
    if len(limits) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    taken = F.lit(False)
    for row in limits:
        taken = taken | ((F.col(label) == row[label]) & (hashed <= row["cutoff"]))
    return taken


def stratified_flag(df: DataFrame, share: float, out: str, key: str = "trans_num", seed: int = SEED,
                    label: str = TARGET) -> DataFrame:
    """Mark ``ceil(share * n)`` rows of each class true. One hash limit per class decides."""
    return df.withColumn(out, _up_to(df, F.ceil(F.lit(share) * F.col("group_rows")), key, seed, label))


def early_stop_flag(df: DataFrame) -> DataFrame:
    return stratified_flag(df, EARLY_STOP_SHARE, "is_validation")


def calibration_flag(df: DataFrame) -> DataFrame:
    """The calibration slice is cut first; the models are then fitted on the other rows only."""
    return stratified_flag(df, CALIBRATION_SHARE, "is_calibration", seed=SEED + 1)


def stratified_sample(df: DataFrame, size: int, key: str = "trans_num", seed: int = SEED,
                      label: str = TARGET) -> DataFrame:
    """At most ``size/2`` positives, filled up with negatives to ``size``, without replacement."""
    n = df.agg(F.count_if(F.col(label) == 1).alias("positives")).first()["positives"]
    positives = min(n, size // 2)
    wanted = F.least(F.col("group_rows"), F.when(F.col(label) == 1, positives).otherwise(size - positives))
    return df.where(_up_to(df, wanted, key, seed, label))


def first_rows(df: DataFrame, n: int, key: str = "trans_num") -> DataFrame:
    return df.orderBy(key).limit(n)


def overlapping_cards(df: DataFrame) -> DataFrame:
    """Cards found in both splits."""
    cards = lambda name: df.where(F.col("split") == name).select("card_uid")
    return cards("train").intersect(cards("test"))


def assert_no_overlap(df: DataFrame) -> None:
    shared = overlapping_cards(df).count()
    if shared:
        raise ValueError(f"{shared} cards are in both splits")
