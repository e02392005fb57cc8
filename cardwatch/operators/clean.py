"""Cleaning, projection and profile operators over a transactions table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.functions import text
from cardwatch.runtime import lookup_join, stored
from cardwatch.schema import (
    BEHAVIOURAL_FEATURES, FRAUD_LABELS, JUNK_COLUMNS, JUNK_PATTERN, MERCHANT_PREFIX,
    PERSONAL_COLUMNS, REQUIRED_FIELDS, TARGET,
)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that hold no value at all; one pass counts every column."""
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for c, n in zip(df.columns, filled) if n == 0])


def drop_junk_columns(df: DataFrame) -> DataFrame:
    junk = [c for c in df.columns if JUNK_PATTERN in c]
    return df.drop(*junk, *JUNK_COLUMNS)


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def narrow_types(df: DataFrame, keep: tuple[str, ...] = (TARGET,)) -> DataFrame:
    """Halve numeric width. Off by default: it costs precision and Spark spills instead."""
    smaller = {"double": "float", "bigint": "int"}
    return df.select(*[
        F.col(c).cast(smaller[t]).alias(c) if t in smaller and c not in keep else F.col(c)
        for c, t in df.dtypes
    ])


def distinct_rows(df: DataFrame, ignore: tuple[str, ...] = ("trans_num", *PERSONAL_COLUMNS),
                  keep: str = "trans_num") -> DataFrame:
    """Full-row distinct over the business columns; of a set of copies the lowest id stays.

    Only 128-bit digests of rows and their ids are shuffled: they give the ids of surplus copies, which leave by an anti-join, as a broadcast
    where they are counted few. So unique rows do not move.
    """
    business = [F.col(f"`{c}`") for c in df.columns if c not in ignore]
    marks = [F.xxhash64(F.lit(k), *[c.isNull() for c in business], *business).alias(f"mark{k}") for k in (1, 2)]
    marked, by = df.select("*", *marks), ["mark1", "mark2"]
    groups = marked.groupBy(by).agg(F.min(keep).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    copies = stored(groups.drop("n"), "copies")
    members = stored(lookup_join(marked.select(keep, *by), copies, by, "inner"), "members")
    gone = members.where(F.col(keep) != F.col("first")).select(keep, *by).distinct()
    left = lookup_join(marked, gone, [keep, *by], "left_anti")
    twice = members.where(F.col(keep) == F.col("first")).groupBy(keep, *by).count().where("count > 1").drop("count")
    if not twice.isEmpty():
        again = lookup_join(left, twice, [keep, *by], "left_semi").dropDuplicates()
        left = lookup_join(left, twice, [keep, *by], "left_anti").unionByName(again)
    return left.drop(*by)


def add_keys(df: DataFrame, anchored: bool = True) -> DataFrame:
    """Canonical card number, trimmed zip, merchant without the leaking prefix, and the card key."""
    return (
        df.withColumns({"cc_num": text.card_number(F.col("cc_num")), "zip": text.strip(F.col("zip"))})
        .withColumns({
            "merchant_clean": text.merchant_clean(F.col("merchant"), anchored),
            "card_uid": text.card_uid(F.col("cc_num"), F.col("dob"), F.col("zip")),
        })
    )


def keyed_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a card key, rows without one): an unreadable number, birth date or zip leaves no card to belong to."""
    return df.where(F.col("card_uid").isNotNull()), df.where(F.col("card_uid").isNull())


def clean(df: DataFrame, find_empty: bool = True) -> DataFrame:
    """The whole batch cleaning step. Rows without a card key stay in, with a null key; ``keyed_rows`` parts them."""
    trimmed = drop_junk_columns(drop_empty_columns(df) if find_empty else df)
    return add_keys(distinct_rows(drop_columns(trimmed, PERSONAL_COLUMNS).withColumn(
        "zip", text.strip(F.col("zip")))))


def parse_dates(df: DataFrame) -> DataFrame:
    """Timestamps and birth dates from text; text that cannot be read becomes null, not an error."""
    return df.withColumns({
        "trans_date_trans_time": F.expr("try_cast(trans_date_trans_time AS timestamp_ntz)"),
        "dob": F.expr("try_cast(dob AS date)"),
    })


def is_complete(df: DataFrame, fields: list[str] = REQUIRED_FIELDS) -> Column:
    """True where every required field that the table has is present."""
    whole = F.lit(True)
    for name in fields:
        if name in df.columns:
            whole = whole & F.col(name).isNotNull()
    return whole


def count_prefixed(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.startswith("merchant", F.lit(MERCHANT_PREFIX))).alias("n_prefixed"))


def label_text(df: DataFrame) -> DataFrame:
    out = F.lit(None).cast("string")
    for value, name in FRAUD_LABELS.items():
        out = F.when(F.col(TARGET) == value, F.lit(name)).otherwise(out)
    return df.withColumn("fraud_label", out)


def with_defaults(df: DataFrame, features: list[str], strict: bool = True) -> DataFrame:
    """The ordered model inputs, nulls as 0. A missing column is an error, or 0 when not strict."""
    missing = [f for f in features if f not in df.columns]
    if missing and strict:
        raise ValueError(f"features not computed: {missing}")
    return df.withColumns({
        f: F.lit(0.0) if f in missing else F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        for f in features
    })


def profile(df: DataFrame, by: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Rows, distinct card numbers and cards, and fraud rate."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n_rows"),
        distinct("cc_num").alias("n_cc_num"),
        distinct("card_uid").alias("n_cards"),
        F.avg(TARGET).alias("fraud_rate"),
    )


def feature_catalogue(importances: DataFrame) -> DataFrame:
    """Mark the behavioural features in a table with a ``feature`` column."""
    return importances.withColumn("behavioural", F.col("feature").isin(BEHAVIOURAL_FEATURES))


def rows_of_class(df: DataFrame, value: int) -> DataFrame:
    return df.where(F.col(TARGET) == value)


def rows_per_card(df: DataFrame) -> DataFrame:
    return df.groupBy("card_uid").agg(F.count("*").alias("n_rows"))
