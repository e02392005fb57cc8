"""Per-card history features: gap, distance, velocity, rolling amounts.

Ordinary cards take one shuffle by card and share its sort among all windows. Cards with more rows
than one task should hold are cut into ranges of (card, time, id) instead; what a range needs
from before it (a count and the last rows) is carried in from a small table of range ends.
Both ways give the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardwatch.functions.scalar import haversine_km
from cardwatch.operators.running import range_chunks, range_count
from cardwatch.runtime import ROWS_PER_RANGE, HotKeys, bounded, setting
from cardwatch.schema import DAY_S, HISTORY_ROWS, HOUR_S, ROLLING_ROWS, WEEK_S

VELOCITY = {"uid_txn_1h": HOUR_S, "uid_txn_24h": DAY_S, "uid_txn_7d": WEEK_S}
COLUMNS = ["uid_time_since_last", "uid_dist_from_prev", *VELOCITY, "prior_mean", "prior_std"]
STRICT_COLUMNS = [f"{c}_strict" for c in VELOCITY]

_ORDER = ["unix_time", "trans_num"]


def _card(*order):
    """By card; rows without one are parted by their id, so they share neither a task nor a history."""
    return W.partitionBy("card_uid", F.when(F.col("card_uid").isNull(), F.col("trans_num"))).orderBy(*order)


def _count_until(offset: int) -> Column:
    """Rows of the card at least ``offset`` seconds back. The frame only grows: one add per row."""
    return F.count("*").over(_card("unix_time").rangeBetween(W.unboundedPreceding, -offset))


def _windowed(df: DataFrame) -> DataFrame:
    rows = _card(*_ORDER)
    prior = rows.rowsBetween(-ROLLING_ROWS, -1)
    lag = lambda c: F.lag(c).over(rows)
    # window values first, each once; the arithmetic on them comes in a second step
    seen = df.withColumns({
        "_time": lag("unix_time"), "_lat": lag("lat"), "_long": lag("long"),
        "_rank": F.row_number().over(rows),
        "prior_mean": F.avg("amt").over(prior),
        "_std": F.stddev_samp("amt").over(prior),
        "_older_0": _count_until(1),
        **{f"_older_{s}": _count_until(s + 1) for s in VELOCITY.values()},
    })
    columns = {
        "uid_time_since_last": F.coalesce(F.col("unix_time") - F.col("_time"), F.lit(0)),
        "uid_dist_from_prev": F.coalesce(
            haversine_km(F.col("_lat"), F.col("_long"), F.col("lat"), F.col("long")), F.lit(0.0)),
        "prior_std": F.coalesce(F.col("_std"), F.lit(0.0)),
    }
    for name, seconds in VELOCITY.items():
        columns[name] = F.col("_rank") - 1 - F.col(f"_older_{seconds}")
        columns[f"{name}_strict"] = F.col("_older_0") - F.col(f"_older_{seconds}")
    return seen.withColumns(columns)


def _carried(chunked: DataFrame) -> DataFrame:
    """Per (card, range): rows before it and the last rows before it. At most ranges + hot cards rows."""
    inside = W.partitionBy("card_uid", "chunk").orderBy(*_ORDER)
    tail = F.collect_list(F.struct("unix_time", "lat", "long", "amt")).over(
        inside.rowsBetween(1 - ROLLING_ROWS, 0))
    ends = (
        chunked.withColumn("tail", tail).groupBy("card_uid", "chunk")
        .agg(F.count("*").alias("n"), F.max_by("tail", F.struct(*_ORDER)).alias("tail"))
    )
    across = W.partitionBy("card_uid").orderBy("chunk")
    return ends.select(
        "card_uid", "chunk",
        F.coalesce(F.sum("n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"),
        F.flatten(F.collect_list("tail").over(across.rowsBetween(-ROLLING_ROWS, -1))).alias("carry"),
    )


def _end_rows(n_rows: int, per_range: int, cards: int) -> int:
    """Each range and each heavy card starts at most one (card, range) pair."""
    return range_count(n_rows, per_range) + cards


def _last(rows: Column, n: int) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - (n - 1), F.lit(1)), n)


def _older_counts(hot: DataFrame, n_rows: int, per_range: int, cards: int) -> DataFrame:
    """Per (card, second): rows strictly before it, and before each window's start.

    Counts per second and one zero-weight marker per asked-for instant go through one ordered sum.
    A marker sorts ahead of the rows of its own second, so it sees only strictly older rows.
    """
    seconds = hot.groupBy("card_uid", "unix_time").agg(F.count("*").alias("n"))
    asked = F.array(
        F.struct(F.col("unix_time").alias("at"), F.lit(1).alias("kind"), F.col("n").alias("n")),
        *[F.struct((F.col("unix_time") - s).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"))
          for s in (0, *VELOCITY.values())],
    )
    events = seconds.select("card_uid", "unix_time", F.posexplode(asked).alias("slot", "e")).select(
        "card_uid", "unix_time", "slot", "e.at", "e.kind", "e.n")
    order = ["at", "kind", "unix_time", "slot"]
    n_events = n_rows * (2 + len(VELOCITY))
    chunked = range_chunks(events, ["card_uid", *order], n_events, per_range, "hot-seconds")
    ends = chunked.groupBy("card_uid", "chunk").agg(F.sum("n").alias("n")).select(
        "card_uid", "chunk",
        F.coalesce(F.sum("n").over(
            W.partitionBy("card_uid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
    )
    inside = W.partitionBy("card_uid", "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    older = chunked.join(bounded(ends, _end_rows(n_events, per_range, cards)), ["card_uid", "chunk"]).withColumn(
        "older", F.col("ahead") + F.sum("n").over(inside)).where("kind = 0")
    return older.groupBy("card_uid", "unix_time").agg(*[
        F.max(F.when(F.col("slot") == i + 1, F.col("older"))).alias(name)
        for i, name in enumerate(["older_0", *[f"older_{s}" for s in VELOCITY.values()]])
    ])


def _ranged(hot: DataFrame, n_rows: int, cards: int) -> DataFrame:
    per_range = setting(hot.sparkSession, "rowsPerRange", ROWS_PER_RANGE)
    chunked = range_chunks(hot, ["card_uid", *_ORDER], n_rows, per_range, "hot-rows")
    inside = W.partitionBy("card_uid", "chunk").orderBy(*_ORDER)
    near = F.collect_list(F.struct("unix_time", "lat", "long", "amt")).over(inside.rowsBetween(-ROLLING_ROWS, -1))
    rows = (
        chunked.join(bounded(_carried(chunked), _end_rows(n_rows, per_range, cards)), ["card_uid", "chunk"])
        .withColumn("prior", _last(F.concat("carry", near), ROLLING_ROWS))
        .withColumn("rank", F.col("rows_before") + F.row_number().over(inside))
    )
    amounts = F.filter(F.transform("prior", lambda r: r["amt"]), lambda x: x.isNotNull())
    size = F.size(amounts)
    add_up = lambda values: F.aggregate(values, F.lit(0.0), lambda total, x: total + x)
    rows = rows.withColumn("prev", F.get("prior", F.size("prior") - 1)).withColumn(
        "prior_mean", F.when(size > 0, add_up(amounts) / size))
    spread = add_up(F.transform(amounts, lambda x: (x - F.col("prior_mean")) * (x - F.col("prior_mean"))))
    columns = {
        "uid_time_since_last": F.coalesce(F.col("unix_time") - F.col("prev.unix_time"), F.lit(0)),
        "uid_dist_from_prev": F.coalesce(
            haversine_km(F.col("prev.lat"), F.col("prev.long"), F.col("lat"), F.col("long")), F.lit(0.0)),
        "prior_std": F.when(size > 1, F.sqrt(spread / (size - 1))).otherwise(0.0),
    }
    for name, seconds in VELOCITY.items():
        columns[name] = F.col("rank") - 1 - F.col(f"older_{seconds}")
        columns[f"{name}_strict"] = F.col("older_0") - F.col(f"older_{seconds}")
    joined = rows.join(_older_counts(hot, n_rows, per_range, cards), ["card_uid", "unix_time"])
    return joined.withColumns(columns).select(*hot.columns, "prior_mean", *columns)


def with_history(df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Add all history columns; ``prior_mean`` is null on a card's first row.

    Rows without a card key are strangers to each other: each is dealt out as a card of its own.
    """
    hot = HotKeys(df, "card_uid") if hot is None else hot
    wanted = [*df.columns, *COLUMNS, *STRICT_COLUMNS]
    plain = _windowed(hot.rest(df)).select(*wanted)
    if not hot:
        return plain
    return plain.unionByName(_ranged(hot.pick(df), hot.rows, hot.count).select(*wanted))


def fill_rolling(df: DataFrame, fill_mean: Column) -> DataFrame:
    """Rolling mean and deviation under their feature names; a first row gets the train mean."""
    return df.withColumns({
        "amt_roll_mean_3": F.coalesce(F.col("prior_mean"), fill_mean),
        "amt_roll_std_3": F.col("prior_std"),
    }).drop("prior_mean", "prior_std")


def last_rows_per_card(df: DataFrame, n: int = HISTORY_ROWS) -> DataFrame:
    """The newest ``n`` rows of each card; map tasks already drop all but ``n`` before the shuffle."""
    newest = _card(F.desc("unix_time"), F.desc("trans_num"))
    return df.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)
