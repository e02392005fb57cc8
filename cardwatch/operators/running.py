"""Ordered sums, ranks and medians that never sort a whole group in one task.

All of them work in two levels. Rows get a chunk number that grows with the wanted order, from Spark's range partitioning or a hash prefix. The
chunk totals, few by construction, are accumulated across chunks; inside a chunk a window adds
the rest. The result is exact and a group of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardwatch.runtime import ROWS_PER_RANGE, setting, stored

def running_sums(points: DataFrame, group: list[str], order: str, sums: list[str],
                 descending: bool = False) -> DataFrame:
    """For rows unique in (group, order): ``run_<c>`` up to and with the row, ``all_<c>`` per group.

    The points are stored first: they are read several times and often stand for a long job.
    When they fit one task, a plain window does; otherwise the two-level form.
    """
    spark = points.sparkSession
    points = stored(points, "points")
    direction = F.desc if descending else F.asc
    upto = lambda keys: W.partitionBy(*keys).orderBy(direction(order)).rowsBetween(W.unboundedPreceding, 0)
    rows = points.count()
    if rows <= setting(spark, "rowsPerRange", ROWS_PER_RANGE):
        return points.withColumns({
            **{f"run_{c}": F.sum(c).over(upto(group)) for c in sums},
            **{f"all_{c}": F.sum(c).over(W.partitionBy(*group)) for c in sums},
        })
    chunked = range_chunks(points, [order, *group], rows, setting(spark, "rowsPerRange", ROWS_PER_RANGE), "ranges")
    ahead = W.partitionBy(*group).orderBy(direction("chunk")).rowsBetween(W.unboundedPreceding, -1)
    totals = (
        chunked.groupBy(*group, "chunk").agg(*[F.sum(c).alias(f"part_{c}") for c in sums])
        .select(
            *group, "chunk",
            *[F.coalesce(F.sum(f"part_{c}").over(ahead), F.lit(0)).alias(f"ahead_{c}") for c in sums],
            *[F.sum(f"part_{c}").over(W.partitionBy(*group)).alias(f"all_{c}") for c in sums],
        )
    )
    return (
        chunked.join(totals, [*group, "chunk"])
        .withColumns({f"run_{c}": F.col(f"ahead_{c}") + F.sum(c).over(upto([*group, "chunk"])) for c in sums})
        .drop("chunk", *[f"ahead_{c}" for c in sums])
    )


def exact_medians(df: DataFrame, group: list[str], column: str, out: str) -> DataFrame:
    """Median per group, also where one group holds most rows: no value list is kept in memory."""
    points = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("n"))
    ranked = running_sums(points, group, column, ["n"])
    low, high = F.floor((F.col("all_n") + 1) / 2), F.floor(F.col("all_n") / 2) + 1
    before = F.col("run_n") - F.col("n")
    hits = lambda pos: ((before < pos) & (pos <= F.col("run_n"))).cast("int")
    middle = ranked.withColumn("w", hits(low) + hits(high)).where("w > 0")
    return middle.groupBy(*group).agg((F.sum(F.col(column) * F.col("w")) / 2).alias(out))


def hash_key(column: Column, seed: int | None = None) -> Column:
    salted = column.cast("string") if seed is None else F.concat(F.lit(f"{seed}|"), column.cast("string"))
    return F.md5(salted)


def hex_digits(df: DataFrame) -> int:
    """Length of the hash prefixes that leave at most a range's rows in one prefix (hashes fill evenly)."""
    wanted = 2 * df.count() // setting(df.sparkSession, "rowsPerRange", ROWS_PER_RANGE)
    return max(1, -(-wanted.bit_length() // 4))


def _hash_totals(chunked: DataFrame, group: list[str]) -> DataFrame:
    """Rows per (group, hash prefix), rows in earlier prefixes, rows in the group."""
    over_group = W.partitionBy(*group)
    return (
        chunked.groupBy(*group, "chunk").agg(F.count("*").alias("part"))
        .select(
            *group, "chunk", "part",
            F.coalesce(F.sum("part").over(
                over_group.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
            F.sum("part").over(over_group).alias("group_rows"),
        )
    )


def hash_cutoffs(keyed: DataFrame, group: list[str], key: str, size: Column) -> DataFrame:
    """Per group the hash of its ``size``-th row in hash order; ``size`` may use ``group_rows``.

    Prefix counts show in which prefix the cut lies; only the rows of that prefix are then sorted, and prefixes are as long
    as the counted rows need. Taking the rows up to the cut is a comparison: the rows never move.
    """
    chunked = keyed.select(*group, key, F.substring(key, 1, hex_digits(keyed)).alias("chunk"))
    crossing = (
        _hash_totals(chunked, group).withColumn("size", size)
        .where((F.col("ahead") < F.col("size")) & (F.col("size") <= F.col("ahead") + F.col("part")))
        .select(*group, "chunk", "ahead", "size")
    )
    inside = W.partitionBy(*group, "chunk").orderBy(key)
    return (
        chunked.join(crossing, [*group, "chunk"])
        .withColumn("place", F.col("ahead") + F.row_number().over(inside))
        .where(F.col("place") == F.col("size")).select(*group, F.col(key).alias("cutoff"))
    )


def hash_rank(df: DataFrame, group: list[str], key: str, tie: str) -> DataFrame:
    """``rank`` (from 1) in hash order within a group.

    Hash prefixes fill evenly, so they serve as chunks without looking at the data.
    """
    chunked = df.withColumn("chunk", F.substring(key, 1, hex_digits(df)))
    totals = _hash_totals(chunked, group).select(*group, "chunk", "ahead")
    inside = W.partitionBy(*group, "chunk").orderBy(key, tie)
    return chunked.join(totals, [*group, "chunk"]).withColumn(
        "rank", F.col("ahead") + F.row_number().over(inside)).drop("chunk", "ahead")


def range_count(rows: int, rows_per_range: int) -> int:
    return max(2, -(-rows // rows_per_range))


def range_chunks(df: DataFrame, order: list[str], rows: int, rows_per_range: int, name: str) -> DataFrame:
    """Range-partition by the full order key and store the result with its range number.

    For orders over several columns. The stored table keeps the ranges fixed for every later use.
    """
    return stored(
        df.repartitionByRange(range_count(rows, rows_per_range), *order).withColumn("chunk", F.spark_partition_id()), name
    )
