"""The jobs a user runs: prepare, train and evaluate, export, evaluate on a second table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.base import Estimator
from pyspark.sql import DataFrame, functions as F

from cardwatch.learning.attribution import attribute
from cardwatch.learning.isotonic import calibrate, fit_isotonic
from cardwatch.learning.models import (
    Ensemble, attribution_base, check_reload, default_members, training_matrix,
)
from cardwatch.learning.tuning import tuned_members
from cardwatch.operators import select
from cardwatch.operators.clean import add_keys, clean, drop_junk_columns, keyed_rows, with_defaults
from cardwatch.operators.curve import compare_models, curve_points, curve_summary, long_scores
from cardwatch.operators.split import (
    assert_no_overlap, calibration_flag, group_holdout, hash_fold, stratified_sample, subsample_cards,
)
from cardwatch.plans.features import FeatureStats, apply_features, export_table, fit_features
from cardwatch.runtime import intermediates, stored
from cardwatch.schema import ALL_FEATURES, ATTRIBUTION_SAMPLE, CV_FOLDS, ENSEMBLE, TUNING_MAX_ROWS, TUNING_TRIALS
from cardwatch.sources import sinks


def prepare(raw: DataFrame, quarantine: str | None = None) -> DataFrame:
    """Cleaned rows with their split, written once; every later step reads that table.

    The split is a comparison added on reading. Rows without a card key are left out; they go to ``quarantine`` if given.
    """
    cleaned = stored(clean(raw), "clean")
    keyed, unkeyed = keyed_rows(cleaned)
    if quarantine:
        unkeyed.write.mode("overwrite").parquet(quarantine)
    rows = group_holdout(keyed)
    assert_no_overlap(rows)
    return rows


def key_report(raw: DataFrame) -> DataFrame:
    """Rows per outcome of cleaning: ``keyed`` ones go on, ``unkeyed`` ones are set aside."""
    outcome = F.when(F.col("card_uid").isNull(), "unkeyed").otherwise("keyed")
    return clean(raw).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def features_of(rows: DataFrame) -> tuple[DataFrame, FeatureStats]:
    """Features of all rows, with statistics from the train rows only."""
    stats = fit_features(rows.where(F.col("split") == "train"))
    return stored(apply_features(rows, stats), "features"), stats


def export(raw: DataFrame) -> DataFrame:
    return export_table(features_of(prepare(raw))[0])


def select_features(train: DataFrame, base_model, features: list[str] = ALL_FEATURES,
                    sample: int = ATTRIBUTION_SAMPLE) -> DataFrame:
    """Attribute a sample, keep what carries the importance, drop what repeats another feature."""
    rows = base_model.stages[0].transform(with_defaults(stratified_sample(train, sample), features))
    importances = select.mean_absolute(attribute(rows, base_model.stages[-1], features))
    return select.prune_correlated(train, select.keep_important(stored(importances, "importances")))


@dataclass
class Trained:
    ensemble: Ensemble
    thresholds: DataFrame
    scores: DataFrame
    comparison: DataFrame


def train_and_evaluate(features: DataFrame, selected: list[str], learners: dict[str, Estimator] | None = None,
                       calibrated: str = "model_a") -> Trained:
    """Fit the members, calibrate one of them, compare all on the test cards.

    Calibration and decision thresholds come from train rows that no member was fitted on, so the
    test rows are used for the comparison and nothing else.
    """
    learners = learners or default_members()
    train = calibration_flag(with_defaults(features.where(F.col("split") == "train"), selected))
    test = with_defaults(features.where(F.col("split") == "test"), selected)
    ensemble = Ensemble.fit(train.where(~F.col("is_calibration")), selected, learners)
    names = [*learners, ENSEMBLE]
    held_out = stored(ensemble.score(train.where("is_calibration"), keep=["trans_num", "is_fraud"]), "held-out")
    thresholds = curve_summary(curve_points(long_scores(held_out, names))).select("model", "threshold")
    model = fit_isotonic(held_out, calibrated)
    scored = calibrate(ensemble.score(test, keep=["trans_num", "is_fraud"]), model, calibrated, f"{calibrated}_cal")
    scores = long_scores(stored(scored, "scores"), [*names, f"{calibrated}_cal"])
    return Trained(ensemble, thresholds, scores, compare_models(scores))


def full_run(raw: DataFrame, out: str, version: str = "v1", trials: int = TUNING_TRIALS,
             spaces: dict[str, dict] | None = None, base: Estimator | None = None,
             tuning_rows: int = TUNING_MAX_ROWS, parallelism: int = CV_FOLDS) -> Trained:
    """Raw rows to saved artefacts: prepare, select, tune, train, evaluate, write, check.

    ``tuning_rows`` bounds the labelled rows of the search (whole cards); ``parallelism`` of its fits run side by side.
    Finished folds of the search are logged under ``out``: a run started again on the same rows goes on with the search where it stood.
    Intermediate tables are deleted at the end; what is returned reads the artefacts under ``out``.
    """
    with intermediates(raw.sparkSession):
        return _full_run(raw, out, version, trials, spaces, base, tuning_rows, parallelism)


def _full_run(raw: DataFrame, out: str, version: str, trials: int, spaces: dict[str, dict] | None, base: Estimator | None,
              tuning_rows: int, parallelism: int) -> Trained:
    spark = raw.sparkSession
    features, stats = features_of(prepare(raw, f"{out}/quarantine"))
    train = features.where(F.col("split") == "train")
    first = Ensemble.fit(with_defaults(train, ALL_FEATURES), ALL_FEATURES, {"base": base or attribution_base()})
    chosen = stored(select_features(train, first.members["base"]), "selected")
    selected = [r["feature"] for r in chosen.orderBy("rank").collect()]

    part = hash_fold(subsample_cards(train, tuning_rows, train.count()))
    matrix = training_matrix(with_defaults(part, selected), selected)
    learners, tried = tuned_members(matrix, trials, spaces, parallelism=parallelism, log=f"{out}/trial-log")
    done = train_and_evaluate(features, selected, learners)

    stats.save(f"{out}/preprocessing")
    done.ensemble.save(f"{out}/models")
    sinks.write_selected(chosen, f"{out}/selected_features")
    sinks.write_table(tried, f"{out}/trials")
    sinks.write_table(done.comparison, f"{out}/comparison")
    sinks.write_table(done.scores, f"{out}/scores", "parquet")
    sinks.write_table(done.thresholds, f"{out}/thresholds", "parquet")
    limits = {r["model"]: r["threshold"] for r in done.thresholds.collect()}
    files = {n: f"models/{n}" for n in learners}
    sinks.write_metadata(sinks.run_metadata(spark, version, selected, limits, files), f"{out}/metadata")
    missing = sinks.missing_artefacts(sinks.manifest(
        spark, out, ["preprocessing", "models", "selected_features", "trials", "comparison", "scores", "thresholds", "metadata"]))
    if missing:
        raise RuntimeError(f"artefacts not written: {missing}")
    reloaded = Ensemble.load(f"{out}/models", list(learners), selected)
    check_reload(spark, reloaded)
    comparison = spark.read.schema(done.comparison.schema).option("header", True).csv(f"{out}/comparison")
    return Trained(reloaded, *(spark.read.parquet(f"{out}/{n}") for n in ("thresholds", "scores")), comparison)


def evaluate_elsewhere(raw: DataFrame, stats: FeatureStats, ensemble: Ensemble,
                       strict_velocity: bool = False, quarantine: str | None = None) -> DataFrame:
    """Score a second table with stored statistics and models; nothing is fitted again.

    Rows without a card key are left out; they go to ``quarantine`` if given.
    """
    rows, unkeyed = keyed_rows(add_keys(drop_junk_columns(raw)))
    if quarantine:
        unkeyed.write.mode("overwrite").parquet(quarantine)
    ready = with_defaults(apply_features(rows, stats, strict_velocity), ensemble.features)
    scored = stored(ensemble.score(ready, keep=["trans_num", "is_fraud"]), "scores")
    return compare_models(long_scores(scored, [*ensemble.members, ENSEMBLE]))
