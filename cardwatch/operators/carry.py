"""History from day to day: what later rows of a card still need, so that old days are never read again.

A carry holds the narrow rows of the last seven days and, of cards that were silent longer, the last three rows. It is made from the carry
before and one day's rows, published as a version of its own, and put before the next day's rows: the batch windows then give what they
would give over everything. The same rows start a stream's state. Rows without a card are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cardwatch.operators.history import with_history
from cardwatch.runtime import one_row
from cardwatch.schema import ROLLING_ROWS, WEEK_S, struct
from cardwatch.sources.versions import latest, publish

CARRY = struct("card_uid string, trans_num bigint, unix_time bigint, lat double, long double, amt double")


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CARRY)


def carried_on(carry: DataFrame, day: DataFrame) -> DataFrame:
    """The carry after ``day``, whose rows are not older than those carried.

    Recent rows are kept by a comparison in the scan; of the others only three rows per card and task reach the shuffle.
    """
    names = CARRY.fieldNames()
    rows = carry.select(*names).unionByName(day.select(*names)).where(F.col("card_uid").isNotNull())
    oldest = one_row(rows.agg((F.max("unix_time") - WEEK_S).alias("at")))["at"]
    newest = W.partitionBy("card_uid").orderBy(F.desc("unix_time"), F.desc("trans_num"))
    last = rows.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= ROLLING_ROWS).drop("place")
    return rows.where(F.col("unix_time") >= oldest).unionByName(last.where(F.col("unix_time") < oldest))


def day_history(carry: DataFrame, day: DataFrame) -> DataFrame:
    """``day`` with the history columns, from the carry and the day alone."""
    both = day.withColumn("_new", F.lit(True)).unionByName(carry.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    return with_history(both).where("_new").drop("_new")


def advance(spark: SparkSession, root: str, version: int, day: DataFrame) -> DataFrame:
    """History of one day's rows; the carry after it is published as ``version``. A repeated day changes nothing."""
    before = latest(spark, root, CARRY, below=version)
    carry = nothing(spark) if before is None else before
    publish(carried_on(carry, day), root, version)
    return day_history(carry, day)
