"""Fit on the training rows, apply anywhere: one feature definition for every path."""

from __future__ import annotations

from dataclasses import dataclass, fields
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch.functions.scalar import add_drift, add_row_features
from cardwatch.operators import history, stats as fitted
from cardwatch.operators.clean import label_text
from cardwatch.operators.encode import encode, fit_vocabulary, vocabulary_facts
from cardwatch.runtime import HotKeys, fits_broadcast, literal_row, own_context, stored
from cardwatch.schema import RAW_COLUMNS


@dataclass
class Constants:
    """What is read from the statistics before rows are scored: one-row tables, vocabulary facts, table sizes."""

    scalars: Column
    fallback: Column
    codes: tuple[dict, dict]
    location_fits: bool

    @classmethod
    def of(cls, stats: FeatureStats) -> Constants:
        return cls(
            literal_row(stats.scalars), literal_row(fitted.category_fallback(stats.cat_agg)),
            vocabulary_facts(stats.vocabulary), fits_broadcast(stats.loc_stats),
        )


@dataclass
class FeatureStats:
    """Everything learned from the training rows, as tables."""

    scalars: DataFrame
    loc_stats: DataFrame
    cat_agg: DataFrame
    vocabulary: DataFrame
    constants: Constants | None = None

    def tables(self) -> list[str]:
        return [f.name for f in fields(self) if f.name != "constants"]

    def save(self, path: str) -> None:
        for name in self.tables():
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def prepared(self) -> FeatureStats:
        """The same statistics with what every batch needs read once: the scalars, the fallback, the codes' sizes, the counts."""
        return FeatureStats(self.scalars, self.loc_stats, self.cat_agg, self.vocabulary, Constants.of(self))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureStats:
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls) if f.name != "constants"})


def fit_features(train: DataFrame, approximate: bool = False) -> FeatureStats:
    """``train`` holds keyed, cleaned training rows, best a stored table: each fit reads it once.

    The fits do not depend on each other, so they are submitted side by side.
    """
    base = add_row_features(train)
    fits = {
        "scalars": lambda: fitted.global_scalars(base),
        "loc_stats": lambda: fitted.location_stats(base, approximate),
        "cat_agg": lambda: fitted.category_stats(base, approximate),
        "vocabulary": lambda: fit_vocabulary(base),
    }
    run = inheritable_thread_target(train.sparkSession)(own_context(lambda name: stored(fits[name](), name)))
    with ThreadPool(len(fits)) as pool:
        return FeatureStats(**dict(zip(fits, pool.map(run, fits))))


def population_features(df: DataFrame, stats: FeatureStats, hot: HotKeys | None = None) -> DataFrame:
    """Features that compare a row with the training population; needs history columns."""
    known = stats.constants or Constants.of(stats)
    df = history.fill_rolling(df, known.scalars.getField("seq_global_mean"))
    df = fitted.join_location(df, stats.loc_stats, hot, known.location_fits)
    df = fitted.join_category(df, stats.cat_agg, known.fallback)
    return add_drift(fitted.add_population_features(df, known.scalars))


def apply_features(df: DataFrame, stats: FeatureStats, strict_velocity: bool = False,
                   encoded: bool = True) -> DataFrame:
    """All features of keyed rows. Test cards never occur in the statistics, so they get defaults there."""
    base = add_row_features(df)
    hot = HotKeys(base, "card_uid")
    rows = history.with_history(base, hot)
    if strict_velocity:
        rows = rows.withColumns({c: F.col(f"{c}_strict") for c in history.VELOCITY})
    rows = population_features(rows.drop(*history.STRICT_COLUMNS), stats, hot).drop("uid_txn_1h")
    return encode(rows, stats.vocabulary, facts=stats.constants and stats.constants.codes) if encoded else rows


def export_table(features: DataFrame) -> DataFrame:
    """The hand-over table: features, split, label as number and as text; no identifying column."""
    return label_text(features.drop(*RAW_COLUMNS))
