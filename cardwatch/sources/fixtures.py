"""Transactions derived from the given benchmark tables, by fixed integer rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardwatch.functions.scalar import add_row_features
from cardwatch.functions.text import card_uid, merchant_clean
from cardwatch.operators.split import group_holdout
from cardwatch.runtime import pin_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def transactions_from_events(events: DataFrame) -> DataFrame:
    """One transaction per event, with the full set of columns."""
    pin_utc(events.sparkSession)
    e, u = F.col("event_id"), F.col("user_id")
    hour = F.hour("ts")
    base = events.select(
        e.alias("trans_num"),
        F.col("ts").alias("trans_date_trans_time"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("unix_time"),
        u.cast("string").alias("cc_num"),
        F.concat(F.when(e % 3 == 0, "fraud_").otherwise(""), F.lit("M"), (e % 50).cast("string")).alias("merchant"),
        F.col("event_type").alias("category"),
        F.col("value").alias("amt"),
        F.when(u % 2 == 0, "M").otherwise("F").alias("gender"),
        F.concat(F.lit("C"), (u % 40).cast("string")).alias("city"),
        F.concat(F.lit("S"), (u % 25).cast("string")).alias("state"),
        F.lpad((u * 7919 % 100000).cast("string"), 5, "0").alias("zip"),
        (F.lit(25.0) + (u * 37 % 2500) / F.lit(100.0) + (e % 3) * F.lit(0.01)).alias("lat"),
        (F.lit(-120.0) + (u * 53 % 5000) / F.lit(100.0) + (e % 2) * F.lit(0.01)).alias("long"),
        (u * 7907 % 100000 + 100).cast("int").alias("city_pop"),
        F.concat(F.lit("J"), (u % 97).cast("string")).alias("job"),
        F.date_add(F.lit("1950-01-01").cast("date"), (u * 97 % 18000).cast("int")).alias("dob"),
        F.when(((F.col("value") > 120) & ((hour <= 5) | (hour >= 23))) | (e % 211 == 0), 1)
        .otherwise(0).alias("is_fraud"),
    )
    return base.withColumns({
        "merch_lat": F.col("lat") + (F.col("trans_num") * 13 % 200 - 100) / F.lit(100.0),
        "merch_long": F.col("long") + (F.col("trans_num") * 17 % 200 - 100) / F.lit(100.0),
        "card_uid": card_uid(F.col("cc_num"), F.col("dob"), F.col("zip")),
        "merchant_clean": merchant_clean(F.col("merchant")),
    })


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(table(spark, sf_dir, "events"))


def txn_split(spark: SparkSession, sf_dir: str, features: bool = False) -> DataFrame:
    df = group_holdout(txn(spark, sf_dir))
    return add_row_features(df) if features else df


def txn_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txn`` as a messy export: junk columns, padded zips, and copies of every fiftieth row."""
    base = txn(spark, sf_dir).drop("card_uid", "merchant_clean")
    copies = base.where(F.col("trans_num") % 50 == 0).withColumn("trans_num", F.col("trans_num") + 1_000_000)
    return base.unionByName(copies).withColumns({
        "zip": F.concat(F.lit(" "), "zip", F.lit("\t")),
        "Unnamed: 0": F.col("trans_num"),
        "6006": F.lit(1),
        "nothing": F.lit(None).cast("string"),
        "first": F.concat(F.lit("N"), F.col("trans_num").cast("string")),
    })


def txn_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second source: order lines as events of other cards, at a second of the day that the line's keys decide."""
    lines, orders = (table(spark, sf_dir, n) for n in ("lineitem", "orders"))
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint")
    kinds = F.array(*[F.lit(k) for k in ("view", "signup", "click", "error", "purchase")])
    start = F.col("l_shipdate").cast("timestamp_ntz")
    events = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        number.alias("event_id"), (F.col("o_custkey") + 1_000_000).cast("bigint").alias("user_id"),
        (start + F.make_dt_interval(secs=(number * 7919 % 86400).cast("decimal(18,6)"))).alias("ts"),
        (F.col("l_extendedprice") / 200).cast("double").alias("value"),
        F.get(kinds, (number % 5).cast("int")).alias("event_type"))
    return transactions_from_events(events)


def txn_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as card transactions: day-grain time, so a card has many rows per second value."""
    pin_utc(spark)
    lines, orders, parts = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return (
        lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
        .select(
            F.struct(*tie).alias("trans_num"),
            F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("unix_time"),
            F.col("o_custkey").cast("string").alias("card_uid"),
            F.col("l_extendedprice").alias("amt"),
            F.col("p_type").alias("category"),
            (F.col("o_custkey") % 90 + F.col("l_suppkey") % 7 * F.lit(0.01)).alias("lat"),
            (F.col("o_custkey") % 180 + F.col("l_suppkey") % 11 * F.lit(0.01)).alias("long"),
        )
    )
