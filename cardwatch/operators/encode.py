"""Label encoding with an explicit code for values never seen in training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cardwatch.functions.text import category_text
from cardwatch.operators.running import range_chunks, range_count
from cardwatch.runtime import BROADCAST_ROWS, ROWS_PER_RANGE, bounded, setting, stored
from cardwatch.schema import CATEGORICAL, UNSEEN


def long_values(df: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """(column, value) rows of all categorical columns from one scan."""
    return df.select(*[category_text(F.col(c)).alias(c) for c in columns]).unpivot(
        [], columns, "column", "value")


def fit_vocabulary(train: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """(column, value, code): the code is the rank of the value among the column's sorted values.

    A small vocabulary is ranked by a plain window. One too long for a task is range-partitioned
    and ranked by position in its range plus the rows of earlier ranges.
    """
    spark = train.sparkSession
    extra = spark.createDataFrame([(c, UNSEEN) for c in columns], "column string, value string")
    values = stored(long_values(train, columns).union(extra).distinct(), "vocabulary")
    n, limit = values.count(), setting(spark, "broadcastRows", BROADCAST_ROWS)
    per_column = W.partitionBy("column")
    if n <= limit:
        code = F.row_number().over(per_column.orderBy("value")) - 1
        return values.select("column", "value", code.cast("int").alias("code"))
    per_range = setting(spark, "rowsPerRange", ROWS_PER_RANGE)
    chunked = range_chunks(values, ["column", "value"], n, per_range, "vocabulary-ranges")
    ends = chunked.groupBy("column", "chunk").agg(F.count("*").alias("n")).select(
        "column", "chunk", F.coalesce(F.sum("n").over(
            per_column.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = W.partitionBy("column", "chunk").orderBy("value")
    return chunked.join(bounded(ends, range_count(n, per_range) + len(columns)), ["column", "chunk"]).select(
        "column", "value", (F.col("ahead") + F.row_number().over(inside) - 1).cast("int").alias("code"))


def vocabulary_facts(vocabulary: DataFrame) -> tuple[dict, dict]:
    """Per column the number of codes and the code of ``<unseen>``."""
    rows = vocabulary.groupBy("column").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("value") == UNSEEN, F.col("code"))).alias("unseen")).collect()
    return {r["column"]: r["n"] for r in rows}, {r["column"]: r["unseen"] for r in rows}


def encode(df: DataFrame, vocabulary: DataFrame, columns: list[str] = CATEGORICAL, suffix: str = "",
           facts: tuple[dict, dict] | None = None) -> DataFrame:
    """Replace each categorical value by its code; unknown values get the code of ``<unseen>``."""
    limit = setting(df.sparkSession, "broadcastRows", BROADCAST_ROWS)
    sizes, unseen = facts or vocabulary_facts(vocabulary)
    for name in columns:
        table = vocabulary.where(F.col("column") == name).select(
            F.col("value").alias("_value"), F.col("code").alias("_code"))
        df = df.withColumn("_value", category_text(F.col(name))).join(
            F.broadcast(table) if sizes[name] <= limit else table, "_value", "left"
        ).withColumn(name + suffix, F.coalesce("_code", F.lit(unseen[name]))).drop("_value", "_code")
    return df


def unseen_counts(df: DataFrame, vocabulary: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """Rows per column whose value is not in the vocabulary. Values are counted before the join."""
    counted = long_values(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    missing = counted.join(vocabulary.select("column", "value"), ["column", "value"], "left_anti")
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(
        missing.groupBy("column").agg(F.sum("n").alias("n_unseen")), "column", "left").fillna({"n_unseen": 0})
