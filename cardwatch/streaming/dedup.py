"""Rows that arrive again in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardwatch.schema import PERSONAL_COLUMNS


def distinct_stream(rows: DataFrame, late_after: str, ignore: tuple[str, ...] = ("trans_num", *PERSONAL_COLUMNS),
                    ts: str = "trans_date_trans_time") -> DataFrame:
    """The first of rows that agree in all business columns, as the batch's ``distinct_rows`` keeps one of them.

    State holds a row's columns until the watermark, ``late_after`` behind the newest time, has passed it, so a row that is sent again
    later than that counts as new, and state is bounded by what arrives in that time.
    """
    business = [c for c in rows.columns if c not in ignore]
    timed = rows.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late_after)
    return timed.dropDuplicatesWithinWatermark(business).drop("_at")
