"""Cleaning, text, scalar features and decisions on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cardwatch.functions import scalar, text
from cardwatch.operators import clean, decide
from cardwatch.schema import SELECTED_FEATURES


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def results(df, expr):
    return [r[0] for r in df.select(expr.alias("x")).collect()]


def test_merchant_prefix_is_anchored(spark):
    df = column(spark, ["fraud_fraud_X", " fraud_Y", "fraud_Z ", None, "A fraud_B"])
    assert results(df, text.merchant_clean(F.col("v"))) == ["fraud_X", "fraud_Y", "Z", None, "A fraud_B"]
    assert results(df, text.merchant_clean(F.col("v"), anchored=False)) == ["X", "Y", "Z", None, "A B"]


def test_card_number_survives_a_double_and_bad_text(spark):
    assert results(column(spark, [4.17e15], "double"), text.card_number(F.col("v"))) == ["4170000000000000"]
    assert results(column(spark, ["4992346398065154184", "oops"]), text.card_number(F.col("v"))) == [
        "4992346398065154184", None]


def test_strip_removes_all_white_space(spark):
    assert results(column(spark, [" 01234\t\n"]), text.strip(F.col("v"))) == ["01234"]


def test_card_uid_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("1", dt.date(1980, 2, 29), "007"), ("1", None, "007")], "c string, d date, z string")
    assert results(df, text.card_uid(F.col("c"), F.col("d"), F.col("z"))) == ["1_1980-02-29_007", None]


def test_clip_keeps_null(spark):
    assert results(column(spark, [7.0, -9.0, None, 1.5], "double"), scalar.clip(F.col("v"))) == [5.0, -5.0, None, 1.5]


def test_distance(spark):
    rows = [(10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 180.0), (0.0, 0.0, None, 1.0), (0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = results(df, scalar.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    assert got[0] == 0.0 and got[2] is None
    assert got[1] == pytest.approx(3.141592653589793 * 6371.0)
    assert got[3] == pytest.approx(111.19492664)
    scalar.register_sql_functions(spark)
    assert [r[0] for r in df.selectExpr("haversine_km(a, b, c, d)").collect()] == [
        pytest.approx(g) if g is not None else None for g in got]


def test_calendar_and_age(spark):
    rows = [(dt.datetime(2024, 1, 7, 23, 5), dt.date(1980, 2, 29)), (dt.datetime(2024, 1, 8, 5, 59), dt.date(2024, 6, 1))]
    df = scalar.add_calendar(spark.createDataFrame(rows, "t timestamp_ntz, dob date"), "t").withColumn(
        "age", scalar.age_years(F.col("t"), F.col("dob")))
    a, b = df.orderBy("t").collect()
    assert (a["hour"], a["day_of_week"], a["month"], a["is_weekend"], a["is_night"], a["age"]) == (23, 6, 1, 1, 1, 43)
    assert (b["day_of_week"], b["is_weekend"], b["is_night"], b["age"]) == (0, 0, 1, 0)  # towards zero


def test_negative_gap_is_clamped(spark):
    df = spark.createDataFrame([(5.0, -10, 2.0, 1, 3)],
                               "amt double, uid_time_since_last bigint, amt_roll_mean_3 double, uid_txn_1h int, uid_txn_24h int")
    row = scalar.add_drift(df).first()
    assert row["log_time_gap"] == 0.0 and row["txn_ratio"] == 0.25 and row["amt_vs_recent"] == 3.0


def test_junk_and_empty_columns(spark):
    df = spark.createDataFrame([(1, 2, None, "x")], "`Unnamed: 0` int, `6006` int, void string, kept string")
    assert clean.drop_junk_columns(clean.drop_empty_columns(df)).columns == ["kept"]


def test_copies_keep_the_lowest_id(spark):
    df = spark.createDataFrame([(3, "a", "p"), (1, "a", "q"), (2, "b", "r")], "trans_num int, v string, first string")
    got = {(r["trans_num"], r["v"], r["first"]) for r in clean.distinct_rows(df).collect()}
    assert got == {(1, "a", "q"), (2, "b", "r")}


def test_narrow_types_spares_the_label(spark):
    df = spark.createDataFrame([(1.0, 2, 1)], "a double, b bigint, is_fraud bigint")
    assert dict(clean.narrow_types(df).dtypes) == {"a": "float", "b": "int", "is_fraud": "bigint"}


def test_defaults_strict_and_compat(spark):
    df = spark.createDataFrame([(None, 1)], "amt double, hour int")
    with pytest.raises(ValueError, match="month"):
        clean.with_defaults(df, ["amt", "hour", "month"])
    row = clean.with_defaults(df, ["amt", "hour", "month"], strict=False).first()
    assert (row["amt"], row["hour"], row["month"]) == (0.0, 1.0, 0.0)


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", "1980-13-01")], "trans_date_trans_time string, dob string")
    row = clean.parse_dates(df).first()
    assert row["trans_date_trans_time"] == dt.datetime(2024, 1, 1, 10) and row["dob"] is None


def test_label_text_and_catalogue(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "is_fraud int")
    assert [r["fraud_label"] for r in clean.label_text(df).collect()] == ["Non-Fraud", "Fraud", None]
    features = spark.createDataFrame([(f,) for f in SELECTED_FEATURES], "feature string")
    marked = {r["feature"] for r in clean.feature_catalogue(features).where("behavioural").collect()}
    assert marked == {"amt_zscore_global", "amt_roll_mean_3", "uid_txn_7d", "uid_txn_24h", "log_time_gap", "amt_change",
                      "amt_per_txday", "uid_time_since_last", "amt_vs_recent", "is_night", "txn_ratio"}


def test_tiers(spark):
    rows = [("ensemble", p) for p in (0.49, 0.55, 0.97)] + [("model_a", p) for p in (0.84, 0.85, 0.95)]
    df = spark.createDataFrame(rows, "model_used string, fraud_probability double")
    compat = [r["status"] for r in decide.add_tiers(df, compat=True).collect()]
    assert compat == ["Safe", "Fraud", "Fraud", "Safe", "Uncertain", "Fraud"]
    reachable = [r["status"] for r in decide.add_tiers(df).collect()]
    assert reachable == ["Safe", "Uncertain", "Fraud", "Safe", "Uncertain", "Fraud"]
    assert {r["threshold"] for r in decide.add_tiers(df, compat=True).collect()} == {0.97, 0.95}


def test_display_rules(spark):
    rows = [("Fraud", None, 0.1), ("odd", True, 0.1), (None, None, 95.0), (None, False, 0.75), (None, None, 0.2)]
    df = spark.createDataFrame(rows, "s string, f boolean, p double")
    shown = results(df, decide.display_status(F.col("s"), F.col("f"), F.col("p")))
    assert shown == ["Fraud", "Fraud", "Fraud", "Uncertain", "Safe"]
    assert results(column(spark, [1.7, -0.1, None], "double"), decide.percent(F.col("v"))) == [100.0, 0.0, None]


def test_rule_answer_always_has_a_status(spark):
    df = column(spark, [300.0, 300.01], "double").withColumnRenamed("v", "amt")
    got = [(r["fraud_probability"], r["status"], r["is_fraud_predicted"]) for r in decide.rule_response(df).collect()]
    assert got == [(0.05, "Safe", False), (0.85, "Fraud", True)]
