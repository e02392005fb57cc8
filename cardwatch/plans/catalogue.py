"""Every operator as a query over the given tables, with plain output types for comparison."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch.functions.scalar import add_calendar, add_drift, add_row_features, register_sql_functions
from cardwatch.learning import attribution, tuning
from cardwatch.learning.isotonic import calibrate, fit_isotonic
from cardwatch.learning.models import (
    Ensemble, answer, assembler, attribution_base, default_members, fit_members, training_matrix,
)
from cardwatch.operators import carry, clean, curve, decide, encode, history, select, split, stats
from cardwatch.plans import jobs
from cardwatch.plans.features import FeatureStats, apply_features, export_table, fit_features
from cardwatch.runtime import fresh_path, one_row, stored
from cardwatch.schema import ATTRIBUTION_SAMPLE, CATEGORICAL, ENSEMBLE, SELECTED_FEATURES, TARGET, TUNING_TRIALS
from cardwatch.sources import fixtures, readers, sinks
from cardwatch.sources.versions import latest, publish, read_all
from cardwatch.streaming.dedup import distinct_stream
from cardwatch.streaming.history import stream_history
from cardwatch.streaming.scoring import score_stream, stream_to_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SCORES = ["score_z", "score_rule", "score_distance"]
CORRELATED = ["amt", "log_amt", "amt_x_hour", "amt_per_txday", "amt_zscore_global", "distance_km",
              "distance_anomaly", "hour", "is_night", "age", "city_pop", "log_city_pop"]


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as bigint, doubles rounded, times as text."""
    casts = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "boolean": "bigint",
             "date": "string", "timestamp_ntz": "string", "timestamp": "string"}

    def column(name: str, kind: str) -> Column:
        if kind in ("double", "float"):
            return F.round(F.col(name).cast("double"), digits).alias(name)
        return F.col(name).cast(casts[kind]).alias(name) if kind in casts else F.col(name)

    return df.select(*[column(n, k) for n, k in df.dtypes])


def query(digits: int | None = 6):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn if digits is None else lambda spark, sf: plain(fn(spark, sf), digits)
        return fn
    return register


def _rows(spark, sf) -> DataFrame:
    return add_row_features(fixtures.txn(spark, sf))


def _split(spark, sf) -> DataFrame:
    return fixtures.txn_split(spark, sf, features=True)


def _train(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def _test(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "test")


def _population(df: DataFrame) -> DataFrame:
    return stats.add_population_features(df, one_row(stats.global_scalars(_train(df))))


def _scores(spark, sf) -> DataFrame:
    """Model-free scores of the test rows, so curves can be checked against SQL."""
    test = _test(_population(_split(spark, sf))).select("trans_num", TARGET, "amt", "amt_zscore_global",
                                                        "distance_anomaly")
    return curve.long_scores(test.withColumns({
        "score_z": F.round("amt_zscore_global", 2),
        "score_rule": decide.rule_score(F.col("amt")),
        "score_distance": F.round("distance_anomaly", 2),
    }), SCORES)


def _features(spark, sf) -> tuple[DataFrame, FeatureStats]:
    return jobs.features_of(stored(fixtures.txn_split(spark, sf), "txn"))


# --- sources -----------------------------------------------------------------------------------

@query()
def table_scan(spark, sf):
    path = fresh_path(spark, "table")
    fixtures.txn(spark, sf).withColumn("trans_num", F.col("trans_num").cast("string")).write.parquet(path)
    df = readers.read_transactions(spark, path)
    return df.select("trans_num", "unix_time", "cc_num", "merchant", "amt", "zip", "dob", TARGET)


@query()
def csv_scan(spark, sf):
    path = fresh_path(spark, "csv")
    fixtures.txn_dirty(spark, sf).write.option("header", True).csv(path)
    df = clean.drop_junk_columns(readers.read_csv(spark, path))
    return df.select(F.col("trans_num").cast("bigint").alias("trans_num"), "unix_time", "cc_num", "category",
                     "amt", "lat", "city_pop", "dob", TARGET)


def _request_lines(spark, sf) -> DataFrame:
    number = F.floor(F.col("trans_num") / 8)
    cycle = F.array(F.lit(ENSEMBLE), F.lit("model_a"), F.lit("model_b"), F.lit("nobody"), F.lit(None).cast("string"))
    return readers.build_requests(
        fixtures.txn(spark, sf), F.lpad(number.cast("string"), 12, "0"),
        F.get(cycle, (number % 5).cast("int")), F.when(number % 3 == 0, F.lit(True)))


@query()
def request_rows(spark, sf):
    rows = readers.request_rows(readers.parse_requests(_request_lines(spark, sf)))
    return rows.select("request_id", "pos", "model", "return_all", "cc_num", "amt", "unix_time", "dob")


@query()
def request_quarantine(spark, sf):
    """Requests damaged in a regular way: every seventh row loses its amount, every eleventh its dob."""
    rows = readers.request_rows(readers.parse_requests(_request_lines(spark, sf)))
    hurt = rows.withColumns({
        "amt": F.when(F.col("unix_time") % 7 != 0, F.col("amt")),
        "dob": F.when(F.col("unix_time") % 11 == 0, "not a date").otherwise(F.col("dob")),
    })
    good, bad = readers.accepted_rows(hurt)
    count = lambda df, name: df.groupBy(F.lit(name).alias("outcome")).agg(F.count("*").alias("n"))
    return count(good, "accepted").unionByName(count(bad, "rejected"))


# --- cleaning ----------------------------------------------------------------------------------

@query()
def clean_txn(spark, sf):
    df = clean.clean(fixtures.txn_dirty(spark, sf))
    return df.select("trans_num", "cc_num", "zip", "merchant_clean", "card_uid", "amt", TARGET)


@query()
def key_report(spark, sf):
    """Rows whose number, birth date or zip cannot be read are set aside."""
    return jobs.key_report(_damaged_keys(spark, sf))


def _damaged_keys(spark, sf) -> DataFrame:
    t = F.col("unix_time")
    return fixtures.txn_dirty(spark, sf).withColumns({
        "cc_num": F.when(t % 13 == 0, "no number").otherwise(F.col("cc_num")),
        "dob": F.when(t % 17 != 0, F.col("dob")), "zip": F.when(t % 19 != 0, F.col("zip")),
    })


@query()
def prepare_keyed(spark, sf):
    """The prepared rows of a damaged table: no row without a card, every card in one split."""
    return jobs.prepare(_damaged_keys(spark, sf)).select("trans_num", "card_uid")


@query()
def win_unkeyed(spark, sf):
    """Rows without a card have no history; the others keep theirs."""
    rows = fixtures.txn(spark, sf)
    lost = rows.withColumn("card_uid", F.when(F.col("trans_num") % 23 != 0, F.col("card_uid")))
    return history.with_history(lost).where("card_uid IS NULL").select("trans_num", *history.COLUMNS)


@query()
def dedup(spark, sf):
    dirty = clean.drop_junk_columns(clean.drop_empty_columns(fixtures.txn_dirty(spark, sf)))
    return clean.distinct_rows(dirty).agg(
        F.count("*").alias("n_rows"), F.sum("trans_num").alias("id_sum"), F.max("trans_num").alias("id_max"))


@query()
def prefix_count(spark, sf):
    return clean.count_prefixed(fixtures.txn(spark, sf))


@query()
def profile(spark, sf):
    return clean.profile(fixtures.txn_split(spark, sf), by=["split"])


@query()
def rows_per_card(spark, sf):
    return clean.rows_per_card(fixtures.txn(spark, sf))


@query()
def class_filter(spark, sf):
    return clean.rows_of_class(fixtures.txn(spark, sf), 1).select("trans_num", "card_uid", "amt")


# --- splits and samples ------------------------------------------------------------------------

@query()
def split_group_holdout(spark, sf):
    return fixtures.txn_split(spark, sf).select("trans_num", "card_uid", "split")


@query()
def split_overlap(spark, sf):
    return split.overlapping_cards(fixtures.txn_split(spark, sf)).agg(F.count("*").alias("n_shared"))


@query()
def split_group_kfold(spark, sf):
    return split.balanced_folds(fixtures.txn(spark, sf))


@query()
def split_hash_fold(spark, sf):
    return split.hash_fold(fixtures.txn(spark, sf)).groupBy("fold").agg(
        F.count("*").alias("n_rows"), F.count_distinct("card_uid").alias("n_cards"))


@query()
def split_stratified(spark, sf):
    return split.early_stop_flag(fixtures.txn(spark, sf)).select("trans_num", TARGET, "is_validation")


@query()
def split_calibration(spark, sf):
    return split.calibration_flag(fixtures.txn(spark, sf)).select("trans_num", TARGET, "is_calibration")


@query()
def sample_stratified(spark, sf):
    return split.stratified_sample(fixtures.txn(spark, sf), 1_000).select("trans_num", TARGET)


@query()
def sample_cards(spark, sf):
    df = fixtures.txn(spark, sf)
    return split.subsample_cards(df, 3_000, df.count()).groupBy("card_uid").agg(F.count("*").alias("n_rows"))


@query()
def sample_last_k(spark, sf):
    return history.last_rows_per_card(fixtures.txn(spark, sf), 3).select("card_uid", "trans_num", "recency")


@query()
def sample_first_rows(spark, sf):
    return split.first_rows(fixtures.txn(spark, sf), 100).select("trans_num", "amt")


# --- row features ------------------------------------------------------------------------------

@query()
def feat_calendar(spark, sf):
    return add_calendar(fixtures.txn(spark, sf)).select(
        "trans_num", "hour", "day_of_week", "month", "is_weekend", "is_night")


@query()
def feat_age(spark, sf):
    return _rows(spark, sf).select("trans_num", "age")


@query()
def feat_distance(spark, sf):
    return _rows(spark, sf).select("trans_num", "distance_km")


@query()
def feat_distance_sql(spark, sf):
    register_sql_functions(spark)
    return fixtures.txn(spark, sf).selectExpr(
        "trans_num", "haversine_km(lat, long, merch_lat, merch_long) AS distance_km")


@query()
def feat_logs(spark, sf):
    return _rows(spark, sf).select("trans_num", "log_amt", "log_city_pop")


@query()
def feat_interactions(spark, sf):
    df = _split(spark, sf)
    scalars = one_row(stats.global_scalars(_train(df)))
    filled = history.fill_rolling(history.with_history(df), scalars.getField("seq_global_mean"))
    return add_drift(filled).select("trans_num", "amt_x_hour", "amt_per_txday", "amt_vs_recent", "amt_change",
                                    "log_time_gap", "txn_ratio")


# --- card history ------------------------------------------------------------------------------

@query()
def win_gap(spark, sf):
    return history.with_history(fixtures.txn(spark, sf)).select("trans_num", "uid_time_since_last")


@query()
def win_prev_distance(spark, sf):
    return history.with_history(fixtures.txn(spark, sf)).select("trans_num", "uid_dist_from_prev")


@query()
def win_velocity(spark, sf):
    return history.with_history(fixtures.txn(spark, sf)).select("trans_num", *history.VELOCITY)


@query()
def win_velocity_strict(spark, sf):
    return history.with_history(fixtures.txn(spark, sf)).select("trans_num", *history.STRICT_COLUMNS)


@query()
def win_roll(spark, sf):
    df = fixtures.txn_split(spark, sf)
    mean = _train(df).agg(F.avg("amt").alias("m")).scalar()
    return history.fill_rolling(history.with_history(df), mean).select(
        "trans_num", "amt_roll_mean_3", "amt_roll_std_3")


@query()
def large_velocity(spark, sf):
    """Day-grain order lines: many rows share a second, so ties decide. Summed per card."""
    rows = history.with_history(fixtures.txn_large(spark, sf))
    return rows.groupBy("card_uid").agg(
        F.count("*").alias("n_rows"), F.sum("uid_time_since_last").alias("gaps"),
        *[F.sum(c).alias(c) for c in [*history.VELOCITY, *history.STRICT_COLUMNS]])


@query(digits=4)
def large_rolling(spark, sf):
    rows = history.with_history(fixtures.txn_large(spark, sf))
    return rows.groupBy("card_uid").agg(
        F.sum("prior_mean").alias("prior_mean"), F.sum("prior_std").alias("prior_std"))


@contextmanager
def _small_limits(spark):
    """Limits under which the large tables take the split paths, as far larger ones do under the defaults."""
    limits = {"hotKeyRows": "400", "rowsPerRange": "3000", "broadcastRows": "50"}
    for name, value in limits.items():
        spark.conf.set(f"spark.cardwatch.{name}", value)
    try:
        yield
    finally:
        for name in limits:
            spark.conf.unset(f"spark.cardwatch.{name}")


def _split_path(name: str) -> None:
    """The query once more, as ``<name>_split``, with its plan made under small limits."""
    def twin(spark, sf):
        with _small_limits(spark):
            return QUERIES[name](spark, sf)
    QUERIES[f"{name}_split"] = twin


# --- fitted statistics and joins ----------------------------------------------------------------

@query()
def agg_global(spark, sf):
    return stats.global_scalars(_train(_split(spark, sf)))


@query()
def agg_location(spark, sf):
    return stats.location_stats(_train(fixtures.txn_split(spark, sf)))


@query()
def join_location(spark, sf):
    df = fixtures.txn_split(spark, sf)
    return stats.join_location(df, stats.location_stats(_train(df))).select(
        "trans_num", "split", *stats.LOCATION_DEFAULTS)


@query()
def agg_category(spark, sf):
    return stats.category_stats(_train(fixtures.txn_split(spark, sf)))


@query()
def agg_category_fallback(spark, sf):
    return stats.category_fallback(stats.category_stats(_train(fixtures.txn_split(spark, sf))))


@query()
def join_category(spark, sf):
    """One category is renamed in the test rows, so the fallback is used."""
    df = fixtures.txn_split(spark, sf)
    table = stored(stats.category_stats(_train(df)), "cat-agg")
    moved = df.withColumn("category", F.when(
        (F.col("split") == "test") & (F.col("category") == "error"), "novel").otherwise(F.col("category")))
    return stats.join_category(moved, table).select("trans_num", "category", "cat_mean_amt", "cat_median_amt")


@query()
def large_category(spark, sf):
    """Category statistics of all order lines."""
    return stats.category_stats(fixtures.txn_large(spark, sf)).select("category", "cat_count", "cat_median_amt")


@query()
def feat_zscore_clip(spark, sf):
    return _population(_split(spark, sf)).select("trans_num", "amt_zscore_global")


@query()
def feat_distance_anomaly(spark, sf):
    return _population(_split(spark, sf)).select("trans_num", "distance_anomaly")


@query()
def class_weight(spark, sf):
    df = _split(spark, sf)
    train = _train(df)
    return stats.class_weight(train, one_row(stats.global_scalars(train))).groupBy(TARGET).agg(
        F.count("*").alias("n_rows"), F.max("w").alias("w"))


# --- encoding ----------------------------------------------------------------------------------

@query()
def encode_vocab(spark, sf):
    return encode.fit_vocabulary(_train(fixtures.txn_split(spark, sf)))


@query()
def encode_apply(spark, sf):
    df = fixtures.txn_split(spark, sf)
    vocabulary = stored(encode.fit_vocabulary(_train(df)), "vocabulary-codes")
    return encode.encode(df, vocabulary).select("trans_num", *CATEGORICAL)


@query()
def unseen_count(spark, sf):
    df = fixtures.txn_split(spark, sf)
    vocabulary = stored(encode.fit_vocabulary(_train(df)), "vocabulary-codes")
    return encode.unseen_counts(_test(df), vocabulary)


@query()
def export_features(spark, sf):
    """The whole preparation: split, history, statistics, joins, encoding, label text."""
    df = stored(fixtures.txn_split(spark, sf), "txn")
    features = apply_features(df, fit_features(_train(df)))
    return export_table(features.withColumn("row", F.col("trans_num")))


# --- selection ---------------------------------------------------------------------------------

@query()
def corr_matrix_nulls(spark, sf):
    """Pairs use the rows that hold both values."""
    rows = _train(_population(_split(spark, sf)))
    gaps = rows.withColumns({
        "amt": F.when(F.col("trans_num") % 5 != 0, F.col("amt")), "age": F.when(F.col("trans_num") % 7 != 0, F.col("age")),
        "hour": F.when(F.col("trans_num") % 3 != 0, F.col("hour"))})
    return select.correlation_matrix(gaps, CORRELATED).select("a", "b", "r")


@query()
def corr_matrix(spark, sf):
    return select.correlation_matrix(_train(_population(_split(spark, sf))), CORRELATED).select("a", "b", "r")


def _importances(train: DataFrame) -> DataFrame:
    """Rounded, so that features which are multiples of each other tie."""
    table = select.label_importance(train, CORRELATED)
    return stored(table.withColumn("importance", F.round("importance", 9)), "importances")


@query()
def importance_cum(spark, sf):
    train = _train(_population(_split(spark, sf)))
    return clean.feature_catalogue(select.cumulative_importance(_importances(train)))


@query()
def select_important(spark, sf):
    train = _train(_population(_split(spark, sf)))
    return select.keep_important(_importances(train)).select("feature", "rank")


@query()
def select_corr_prune(spark, sf):
    train = stored(_train(_population(_split(spark, sf))), "train")
    return select.prune_correlated(train, select.keep_important(_importances(train))).select("feature", "rank")


# --- decisions ---------------------------------------------------------------------------------

@query()
def rule_score(spark, sf):
    return decide.rule_response(fixtures.txn(spark, sf)).select(
        "trans_num", "fraud_probability", "is_fraud_predicted", "status", "threshold", "model_used")


def _chosen(spark, sf) -> DataFrame:
    """A score between 0 and 1 per row, answered in turn by the mean and by one member."""
    df = _population(_split(spark, sf))
    return df.withColumns({
        "fraud_probability": F.round((F.col("amt_zscore_global") + 5) / 10, 4),
        "model_used": F.when(F.col("trans_num") % 2 == 0, ENSEMBLE).otherwise("model_a"),
        "request_id": F.floor(F.col("trans_num") / 8),
        "pos": F.col("trans_num") % 8,
    })


@query()
def tiers(spark, sf):
    return decide.add_tiers(_chosen(spark, sf)).select("trans_num", "status", "is_fraud_predicted", "threshold")


@query()
def tiers_compat(spark, sf):
    return decide.add_tiers(_chosen(spark, sf), compat=True).select(
        "trans_num", "status", "is_fraud_predicted", "threshold")


@query()
def status_summary(spark, sf):
    return decide.status_summary(decide.add_tiers(_chosen(spark, sf)), by=["split"])


@query()
def display_status(spark, sf):
    """Scores sent as shares or as percentages, with and without a known status."""
    e, p = F.col("trans_num"), F.col("fraud_probability")
    df = decide.add_tiers(_chosen(spark, sf)).withColumns({
        "sent": F.when(e % 3 == 0, p * 100).otherwise(p * 1.4),
        "sent_status": F.when(e % 4 == 0, F.col("status")).when(e % 4 == 1, "Odd"),
        "sent_flag": F.when(e % 5 == 0, F.col("is_fraud_predicted")),
    })
    share = decide.normalised(F.col("sent"))
    return df.select("trans_num", share.alias("share"), decide.percent(share).alias("percent"),
                     decide.display_status(F.col("sent_status"), F.col("sent_flag"), F.col("sent")).alias("shown"))


@query()
def response_nested(spark, sf):
    nested = decide.nested_response(decide.add_tiers(_chosen(spark, sf)))
    return nested.select(
        "request_id", "n_transactions",
        F.array_join(F.transform("predictions", lambda r: r["status"]), ",").alias("statuses"),
        F.aggregate("predictions", F.lit(0.0), lambda a, r: a + r["fraud_probability"]).alias("total"))


# --- evaluation --------------------------------------------------------------------------------

@query()
def pr_curve(spark, sf):
    return curve.pr_curve(curve.curve_points(_scores(spark, sf)))


@query()
def roc_curve(spark, sf):
    return curve.roc_curve(_scores(spark, sf))


@query()
def roc_corners(spark, sf):
    return curve.corner_points(curve.curve_points(_scores(spark, sf))).select("model", "threshold", "tp", "flagged")


@query()
def f1_by_threshold(spark, sf):
    return curve.f1_by_threshold(curve.curve_points(_scores(spark, sf)))


@query()
def average_precision(spark, sf):
    return curve.curve_summary(curve.curve_points(_scores(spark, sf))).select("model", "pr_auc")


@query()
def roc_auc(spark, sf):
    return curve.curve_summary(curve.curve_points(_scores(spark, sf))).select("model", "roc_auc")


@query()
def best_f1(spark, sf):
    return curve.curve_summary(curve.curve_points(_scores(spark, sf))).select(
        "model", "threshold", "best_f1", "prevalence")


def _confused(spark, sf) -> DataFrame:
    scores = stored(_scores(spark, sf), "scores")
    return curve.confusion(scores, stored(curve.curve_summary(curve.curve_points(scores)).drop("at"), "summary"))


@query()
def confusion(spark, sf):
    return curve.add_rates(_confused(spark, sf))


@query()
def class_report(spark, sf):
    return curve.class_report(_confused(spark, sf))


@query()
def score_histogram(spark, sf):
    return curve.score_histogram(_scores(spark, sf))


@query()
def model_compare(spark, sf):
    return curve.compare_models(_scores(spark, sf))


@query()
def large_compare(spark, sf):
    """Evaluation over all order lines: is a line returned, judged by price, discount and quantity."""
    lines = fixtures.table(spark, sf, "lineitem").select(
        F.lit(0).alias("trans_num"), (F.col("l_returnflag") == "R").cast("int").alias(TARGET),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        F.col("l_quantity").alias("quantity"))
    return curve.compare_models(curve.long_scores(lines, ["price", "discount", "quantity"]))


# --- streaming ---------------------------------------------------------------------------------

def _quarters(rows: DataFrame) -> list[DataFrame]:
    """The rows in four slices of time."""
    quarter = rows.agg(F.percentile_approx("unix_time", F.lit([0.25, 0.5, 0.75]), 100).alias("q")).first()["q"]
    parts = []
    for low, high in zip([None, *quarter], [*quarter, None]):
        part = rows if low is None else rows.where(F.col("unix_time") > low)
        parts.append(part if high is None else part.where(F.col("unix_time") <= high))
    return parts


def _arrivals(spark, parts: list[DataFrame], through: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Parts written one after the other, each taken up by a stream; what the stream wrote."""
    source, out, checkpoint = (fresh_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 50).parquet(source)
        stream_to_table(through(stream), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query()
def stream_features(spark, sf):
    """All transactions through the keyed state, in four arrivals; equals the batch windows."""
    parts = _quarters(fixtures.txn(spark, sf))
    got = _arrivals(spark, parts, lambda rows: stream_history(rows, ("unix_time", "trans_num")))
    return got.select("trans_num", *history.COLUMNS)


@query()
def carry_features(spark, sf):
    """The four slices as days, each from the published carry before it and its own rows; equals the batch windows."""
    root, found = fresh_path(spark, "carry"), None
    for day, rows in enumerate(_quarters(fixtures.txn(spark, sf))):
        part = stored(carry.advance(spark, root, day, rows).select("trans_num", *history.COLUMNS), "day")
        found = part if found is None else found.unionByName(part)
    return found


@query()
def stream_carried(spark, sf):
    """A new stream over the second half of the time that starts from the carry of the first."""
    rows = fixtures.txn(spark, sf)
    first, last = rows.agg(F.min("unix_time"), F.max("unix_time")).first()
    middle, root = (first + last) // 2, fresh_path(spark, "carry")
    for day, (low, high) in enumerate([(first, (first + middle) // 2), ((first + middle) // 2 + 1, middle)]):
        carry.advance(spark, root, day, rows.where(F.col("unix_time").between(low, high)))
    start = latest(spark, root, carry.CARRY)
    later = rows.where(F.col("unix_time") > middle)
    got = _arrivals(spark, [later], lambda x: stream_history(x, ("unix_time", "trans_num"), carried=start))
    return got.select("trans_num", *history.COLUMNS)


@query()
def stream_distinct(spark, sf):
    """Transactions of which every fifth is sent again with a later arrival and a new number."""
    rows = fixtures.txn(spark, sf)
    again = rows.where(F.col("trans_num") % 5 == 0).withColumn("trans_num", F.col("trans_num") + 10_000_000)
    got = _arrivals(spark, [rows, again], lambda x: distinct_stream(x, "3650 days"))
    return got.agg(F.count("*").alias("n_rows"), F.sum("trans_num").alias("id_sum"), F.max("trans_num").alias("id_max"))


@query()
def published_batches(spark, sf):
    """Batches published twice, and one torn before its marker: readers see every batch once."""
    root = fresh_path(spark, "published")
    parts = [p.select("trans_num", "amt") for p in _quarters(fixtures.txn(spark, sf))]
    for batch, part in enumerate(parts):
        publish(part, root, batch)
        publish(part, root, batch)
    parts[0].write.parquet(f"{root}/data/version-9-torn")
    return read_all(spark, root, parts[0].schema)


def _scored_stream(spark, sf, lines: DataFrame | None = None, **models) -> tuple[str, str]:
    """Requests sent in two halves by number, each one batch, the later half once the earlier one is answered."""
    source, out, checkpoint = (fresh_path(spark, n) for n in ("requests", "responses", "stream-state"))
    sent = (_request_lines(spark, sf) if lines is None else lines).withColumn(
        "number", F.regexp_extract("value", r'"request_id":"(\d+)"', 1).try_cast("bigint"))
    sent = stored(sent, "lines")
    middle = sent.agg(F.percentile_approx("number", 0.5, 100)).first()[0]
    later = F.coalesce(F.col("number") > F.lit(middle).cast("bigint"), F.lit(True))
    for half in (~later, later):
        sent.where(half).select("value").write.mode("append").text(source)
        score_stream(spark, source, out, checkpoint, files_per_batch=1_000_000, **models).awaitTermination()
    return out, checkpoint


def _damaged_lines(spark, sf) -> DataFrame:
    """Requests whose rows with a time divisible by 7 lost their amount; beside every tenth one an empty request and a torn line."""
    whole = _request_lines(spark, sf)
    number = F.floor(F.col("trans_num") / 8)
    rows = fixtures.txn(spark, sf).withColumn("amt", F.when(F.col("unix_time") % 7 != 0, F.col("amt")))
    damaged = readers.build_requests(rows, F.lpad(number.cast("string"), 12, "0"), F.lit(None).cast("string"), F.lit(None).cast("boolean"))
    tenth = fixtures.txn(spark, sf).where(F.col("trans_num") % 80 == 0).select(number.cast("string").alias("n"))
    empty = tenth.select(F.concat(F.lit('{"request_id":"empty-'), "n", F.lit('","transactions":[]}')).alias("value"))
    torn = tenth.select(F.concat(F.lit('{"request_id":"torn-'), "n", F.lit('","transactions":[{')).alias("value"))
    return damaged.union(empty).union(torn).select(whole.columns)


def _answers(spark, out: str) -> DataFrame:
    """Per request: transactions sent, answers given, and how many of them were rejected."""
    entry = "array<struct<fraud_probability:double,is_fraud_predicted:boolean,status:string,model_used:string>>"
    responses = read_all(spark, out, f"request_id string, n_transactions bigint, predictions {entry}", "json")
    rejected = F.size(F.filter("predictions", lambda r: r["status"] == decide.REJECTED))
    scored = F.size(F.filter("predictions", lambda r: r["fraud_probability"].between(0, 1)))
    return responses.select(
        "request_id", "n_transactions", F.size("predictions").alias("n_answered"), scored.alias("n_scored"), rejected.alias("n_rejected"))


@query()
def stream_responses(spark, sf):
    """Requests through the stream, answered by the rule, as nested responses."""
    out, _ = _scored_stream(spark, sf)
    entry = ("array<struct<fraud_probability:double,is_fraud_predicted:boolean,status:string,"
             "threshold:double,model_used:string>>")
    responses = read_all(spark, out, f"request_id string, n_transactions bigint, predictions {entry}", "json")
    flagged = F.size(F.filter("predictions", lambda r: r["is_fraud_predicted"]))
    return responses.select("request_id", "n_transactions", flagged.alias("n_flagged"))


@query()
def stream_registry_size(spark, sf):
    _, checkpoint = _scored_stream(spark, sf)
    return sinks.registry_report(spark, checkpoint, SELECTED_FEATURES, []).select("card_registry_size")


@query()
def stream_scored(spark, sf):
    """Requests through the stream, answered by the fitted members: per request what was sent and how it was answered."""
    _, fitted, ensemble = _fitted(spark, sf, ["model_a", "model_b"])
    out, _ = _scored_stream(spark, sf, stats=fitted, ensemble=ensemble)
    return _answers(spark, out)


@query()
def stream_score_check(spark, sf):
    """Every row answered by the stream, with whether its probability is the batch's of the model that answered."""
    features, fitted, ensemble = _fitted(spark, sf, ["model_a", "model_b"])
    out, _ = _scored_stream(spark, sf, stats=fitted, ensemble=ensemble, nested=False)
    answers = read_all(spark, out, "request_id string, pos bigint, fraud_probability double, model_used string", "json")
    streamed = answers.select((F.col("request_id").cast("bigint") * 8 + F.col("pos")).alias("trans_num"), "fraud_probability", "model_used")
    batch = ensemble.score(clean.with_defaults(features, SELECTED_FEATURES), keep=["trans_num"])
    wanted = F.coalesce(*[F.when(F.col("model_used") == m, F.col(m)) for m in (ENSEMBLE, "model_a", "model_b")])
    return streamed.join(batch, "trans_num").select("trans_num", (F.abs(F.col("fraud_probability") - wanted) < 1e-9).alias("ok"))


@query()
def stream_requests(spark, sf):
    """Requests of which some rows are damaged, some are empty and some lines cannot be read: nothing goes missing."""
    out, _ = _scored_stream(spark, sf, lines=_damaged_lines(spark, sf))
    return _answers(spark, out)


@query()
def request_outcomes(spark, sf):
    rows = readers.judged_rows(readers.request_rows(readers.parse_requests(_damaged_lines(spark, sf))))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("request_id").alias("n_requests"))


@query()
def stream_reset(spark, sf):
    """A higher epoch clears the history of a card: the second half of the time starts anew."""
    rows = fixtures.txn(spark, sf)
    middle = rows.agg(((F.min("unix_time") + F.max("unix_time")) / 2).cast("bigint")).first()[0]
    marked = rows.withColumn("history_epoch", (F.col("unix_time") > middle).cast("bigint"))
    parts = [marked.where((F.col("history_epoch") == 1) == late) for late in (False, True)]
    got = _arrivals(spark, parts, lambda x: stream_history(x, ("unix_time", "trans_num")))
    return got.select("trans_num", "history_epoch", *history.COLUMNS)


# --- learning: full outputs (rows only), and beside them what SQL can say about them ---------------

#: artefacts of one session, by (application, table folder, name): every query reads the same default members
_RUNS: dict[tuple, object] = {}


def _once(spark, sf, name, make):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _RUNS:
        _RUNS[key] = make()
    return _RUNS[key]


def _fitted(spark, sf, names=("model_a", "model_b", "model_c")) -> tuple[DataFrame, FeatureStats, Ensemble]:
    """Features, statistics and the named members with their default settings, fitted once per session."""
    features, fitted = _once(spark, sf, "features", lambda: _features(spark, sf))
    matrix = lambda: training_matrix(clean.with_defaults(_train(features), SELECTED_FEATURES), SELECTED_FEATURES)
    learners = default_members()
    wanted = {n: learners[n] for n in names if (spark.sparkContext.applicationId, sf, n) not in _RUNS}
    found = fit_members(_once(spark, sf, "matrix", matrix), wanted) if wanted else {}
    members = {n: _once(spark, sf, n, lambda n=n: PipelineModel([assembler(SELECTED_FEATURES), found[n]])) for n in names}
    return features, fitted, Ensemble(SELECTED_FEATURES, members)


def _scored(spark, sf, names, keep=("trans_num", TARGET)) -> DataFrame:
    features, _, ensemble = _fitted(spark, sf, names)
    return ensemble.score(clean.with_defaults(_test(features), SELECTED_FEATURES), keep=list(keep))


@query()
def train_gbt(spark, sf):
    return _scored(spark, sf, ["model_a"])


@query()
def train_rf(spark, sf):
    return _scored(spark, sf, ["model_b"])


@query()
def ensemble_score(spark, sf):
    """Three members and their mean; the asked-for model is picked per row, then tiers apply."""
    members = ["model_a", "model_b", "model_c"]
    scored = _scored(spark, sf, members)
    asked = F.get(F.array(F.lit(ENSEMBLE), F.lit("model_b"), F.lit("nobody")), (F.col("trans_num") % 3).cast("int"))
    return answer(scored.withColumns({"model": asked, "return_all": F.col("trans_num") % 2 == 0}), members)


@query()
def score_check(spark, sf):
    """Every test row, with whether all members and their mean lie in [0, 1] and the mean is the members' average."""
    members = ["model_a", "model_b", "model_c"]
    scored = _scored(spark, sf, members)
    inside = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(False))
    average = sum((F.col(m) for m in members[1:]), F.col(members[0])) / len(members)
    ok = inside(members[0]) & inside(members[1]) & inside(members[2]) & inside(ENSEMBLE) & (F.abs(F.col(ENSEMBLE) - average) < 1e-12)
    asked = F.get(F.array(F.lit(ENSEMBLE), F.lit("model_b"), F.lit("nobody")), (F.col("trans_num") % 3).cast("int"))
    answered = answer(scored.withColumns({"model": asked, "return_all": F.lit(False)}), members)
    return answered.select("trans_num", TARGET, ok.alias("ok"), "model_used")


@query()
def trees_kept(spark, sf):
    """Trees of every default member; boosted ones stop by patience."""
    _, _, ensemble = _fitted(spark, sf)
    return spark.createDataFrame([(n, m.stages[-1].getNumTrees) for n, m in ensemble.members.items()], "model string, n_trees int")


@query()
def calibrate_isotonic(spark, sf):
    """Isotonic calibration of the rounded amount score, fitted on the train rows and applied to the test rows."""
    rows = _population(_split(spark, sf)).withColumn("score", F.round("amt_zscore_global", 1))
    model = fit_isotonic(_train(rows), "score")
    return calibrate(_test(rows).select("trans_num", "score"), model, "score", "calibrated")


@query()
def calibrate_model(spark, sf):
    """Isotonic calibration of the first member on train rows that no member was fitted on."""
    return _trained(spark, sf).scores.where("model = 'model_a_cal'")


def _trained(spark, sf) -> jobs.Trained:
    features, _ = _once(spark, sf, "features", lambda: _features(spark, sf))
    return _once(spark, sf, "trained", lambda: jobs.train_and_evaluate(features, SELECTED_FEATURES))


@query()
def train_compare(spark, sf):
    return _trained(spark, sf).comparison


def _search(spark, sf) -> DataFrame:
    """All trials of a search over the default space of the forest, on card-whole folds; as many folds side by side as cores and rows allow."""
    features, _ = _once(spark, sf, "features", lambda: _features(spark, sf))
    train = split.hash_fold(clean.with_defaults(_train(features), SELECTED_FEATURES))

    def run() -> DataFrame:
        matrix = training_matrix(train, SELECTED_FEATURES)
        return tuning.search(matrix, "forest", trials=TUNING_TRIALS, parallelism=tuning.side_by_side(matrix))

    return _once(spark, sf, "search", run)


@query()
def tune_random(spark, sf):
    return tuning.trial_means(_search(spark, sf))


@query()
def tune_grid(spark, sf):
    return _search(spark, sf).select("trial", "fold", F.col("error").isNull().alias("ok"), F.col("metric").between(0, 1).alias("inside"))


@query()
def tune_best(spark, sf):
    return tuning.best_trial(_search(spark, sf))


def _contributions(spark, sf, sample: int | None = None) -> DataFrame:
    """Contributions of all test rows, or of a balanced sample of the train rows."""
    features, _, ensemble = _fitted(spark, sf, ["model_a"])
    stages = ensemble.members["model_a"].stages
    given = _test(features) if sample is None else split.stratified_sample(_train(features), sample)
    rows = stages[0].transform(clean.with_defaults(given, SELECTED_FEATURES))
    return attribution.attribute(rows, stages[-1], SELECTED_FEATURES)


@query()
def attribution_rows(spark, sf):
    return _contributions(spark, sf)


@query()
def attribution_check(spark, sf):
    """Every test row, with whether its base and contributions add up to the model's output."""
    features, _, ensemble = _fitted(spark, sf, ["model_a"])
    stages = ensemble.members["model_a"].stages
    scored = stages[-1].transform(stages[0].transform(clean.with_defaults(_test(features), SELECTED_FEATURES)))
    output = scored.select("trans_num", vector_to_array("model_a_raw")[1].alias("raw"))
    sums = _contributions(spark, sf).groupBy("trans_num").agg(
        (F.max("base") + F.sum("contribution")).alias("total"), F.count("*").alias("n_features"))
    # a boosted model's raw prediction is twice its margin's scale or the margin itself; the trees' sum is the margin
    return output.join(sums, "trans_num").select("trans_num", "n_features", (F.abs(F.col("total") - F.col("raw")) < 1e-6).alias("ok"))


@query()
def attribution_global(spark, sf):
    return select.mean_absolute(_contributions(spark, sf, ATTRIBUTION_SAMPLE))


@query()
def attribution_select(spark, sf):
    """The selection chain from contributions: importance of a sample, features kept, correlated ones dropped."""
    features, _, ensemble = _fitted(spark, sf, ["model_a"])
    return jobs.select_features(_train(features), ensemble.members["model_a"], SELECTED_FEATURES).select("feature", "rank")


@query()
def base_select(spark, sf):
    """The selection chain as a full run takes it: from the contributions of the base model, fitted on all train rows."""
    def fit():
        features, _ = _once(spark, sf, "features", lambda: _features(spark, sf))
        ready = clean.with_defaults(_train(features), SELECTED_FEATURES)
        return Ensemble.fit(ready, SELECTED_FEATURES, {"base": attribution_base()}).members["base"]

    features, _ = _once(spark, sf, "features", lambda: _features(spark, sf))
    return jobs.select_features(_train(features), _once(spark, sf, "base", fit), SELECTED_FEATURES).select("feature", "rank")


@query()
def sink_round_trip(spark, sf):
    """Rows written by the feature sink in both formats and by the table sink, read again and summed."""
    rows = fixtures.txn_split(spark, sf).select("trans_num", "category", F.round("amt", 2).alias("amt"), "split")
    root, parts = fresh_path(spark, "sinks"), []
    for fmt in ("parquet", "csv"):
        sinks.write_features(rows, f"{root}/{fmt}", fmt)
        parts.append(spark.read.schema(rows.schema).option("header", True).format(fmt).load(f"{root}/{fmt}").withColumn("sink", F.lit(fmt)))
    sinks.write_table(rows, f"{root}/table")
    parts.append(spark.read.schema(rows.schema).option("header", True).csv(f"{root}/table").withColumn("sink", F.lit("table")))
    read = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return read.groupBy("sink", "split", "category").agg(F.count("*").alias("n_rows"), F.sum("trans_num").alias("id_sum"), F.sum("amt").alias("amt_sum"))


@query()
def artefact_round_trip(spark, sf):
    """Statistics, codes and models written, read again and applied: features as exported, scores as before."""
    features, fitted, ensemble = _fitted(spark, sf, ["model_b"])
    root = fresh_path(spark, "artefacts")
    fitted.save(f"{root}/preprocessing")
    ensemble.save(f"{root}/models")
    again = FeatureStats.load(spark, f"{root}/preprocessing")
    loaded = Ensemble.load(f"{root}/models", ["model_b"], SELECTED_FEATURES)
    rows = apply_features(stored(_test(fixtures.txn_split(spark, sf)), "txn"), again)
    score = lambda e, df, name: e.score(clean.with_defaults(df, SELECTED_FEATURES), keep=["trans_num"]).select(
        "trans_num", F.col("model_b").alias(name))
    return score(loaded, rows, "after").join(score(ensemble, _test(features), "before"), "trans_num").select(
        "trans_num", (F.abs(F.col("after") - F.col("before")) < 1e-12).alias("ok"))


@query()
def attribution_summary(spark, sf):
    rows = stored(_contributions(spark, sf), "contributions")
    return attribution.summary_data(rows, select.mean_absolute(rows))


@query()
def explain_one(spark, sf):
    return attribution.explain_one(stored(_contributions(spark, sf), "contributions"))


@query()
def zero_shot_eval(spark, sf):
    """Models and statistics of the events table, applied to order lines of other cards, read from CSV."""
    return _elsewhere(spark, sf)


def _elsewhere(spark, sf) -> DataFrame:
    _, fitted, ensemble = _fitted(spark, sf, ["model_a", "model_b"])
    path = fresh_path(spark, "second")
    fixtures.txn_elsewhere(spark, sf).drop("card_uid", "merchant_clean").write.option("header", True).csv(path)
    return jobs.evaluate_elsewhere(readers.read_csv(spark, path), fitted, ensemble)


@query()
def zero_shot_check(spark, sf):
    """How many rows and frauds each model was judged on."""
    return _elsewhere(spark, sf).select(
        "model", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_rows"), (F.col("fn") + F.col("tp")).alias("n_fraud"))


def _manifest(spark, sf) -> DataFrame:
    _, fitted, ensemble = _fitted(spark, sf, ["model_b"])
    root = fresh_path(spark, "artefacts")
    fitted.save(f"{root}/preprocessing")
    ensemble.save(f"{root}/models")
    metadata = sinks.run_metadata(spark, "v1", SELECTED_FEATURES, sinks.default_thresholds(["model_b"]),
                                  {"model_b": "models/model_b"})
    sinks.write_metadata(metadata, f"{root}/metadata")
    return sinks.manifest(spark, root, ["preprocessing", "models", "metadata", "scores"])


@query(digits=None)
def manifest(spark, sf):
    """Artefacts of a run, saved, listed and checked for completeness; one was never written."""
    return _manifest(spark, sf)


@query()
def manifest_check(spark, sf):
    return _manifest(spark, sf).select("artefact", "present")


@query(digits=None)
def threshold_report(spark, sf):
    """Best-F1 thresholds per score, kept in the run metadata as a map and read back out."""
    chosen = curve.curve_summary(curve.curve_points(_scores(spark, sf))).select("model", "threshold").collect()
    metadata = sinks.run_metadata(spark, "v1", SELECTED_FEATURES, {r["model"]: r["threshold"] for r in chosen}, {})
    return sinks.threshold_report(metadata)


for _name in ("large_velocity", "large_rolling", "large_category", "large_compare", "split_group_kfold", "encode_apply"):
    _split_path(_name)
