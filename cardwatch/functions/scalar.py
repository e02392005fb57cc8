"""Row-level feature expressions; all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch.schema import CLIP_LIMIT, DAYS_PER_YEAR, EARTH_RADIUS_KM, EPSILON

_HAVERSINE_SQL = f"""
CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)
RETURNS DOUBLE
RETURN CASE WHEN lat1 + lon1 + lat2 + lon2 IS NOT NULL THEN {2 * EARTH_RADIUS_KM}D * asin(sqrt(least(1.0D,
    power(sin((radians(lat2) - radians(lat1)) / 2), 2)
    + cos(radians(lat1)) * cos(radians(lat2)) * power(sin((radians(lon2) - radians(lon1)) / 2), 2)))) END
"""


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``haversine_km`` callable from SQL as an inlined expression (no Python worker)."""
    spark.sql(_HAVERSINE_SQL)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    chord = F.sin(half_lat) * F.sin(half_lat) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    )
    # the clamp keeps antipodes from leaving asin's domain; alone it would turn null into a distance
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), chord))))


def clip(value: Column, limit: float = CLIP_LIMIT) -> Column:
    """Null stays null: greatest/least alone would turn it into the limit."""
    return F.when(value.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), value)))


def age_years(ts: Column, dob: Column) -> Column:
    return (F.datediff(ts.cast("date"), dob) / F.lit(DAYS_PER_YEAR)).cast("int")


def is_night(hour: Column) -> Column:
    return ((hour <= 5) | (hour >= 23)).cast("int")


def add_calendar(df: DataFrame, ts: str = "trans_date_trans_time") -> DataFrame:
    when, dow, hour = F.col(ts), F.weekday(ts), F.hour(ts)  # weekday: Monday is 0
    return df.withColumns({
        "hour": hour,
        "day_of_week": dow,
        "month": F.month(when),
        "is_weekend": (dow >= 5).cast("int"),
        "is_night": is_night(hour),
    })


def add_row_features(df: DataFrame, ts: str = "trans_date_trans_time") -> DataFrame:
    """Everything that one row decides by itself."""
    return add_calendar(df, ts).withColumns({
        "age": age_years(F.col(ts), F.col("dob")),
        "distance_km": haversine_km(F.col("lat"), F.col("long"), F.col("merch_lat"), F.col("merch_long")),
        "log_amt": F.log1p("amt"),
        "log_city_pop": F.log1p(F.col("city_pop").cast("double")),
        "amt_x_hour": F.col("amt") * F.hour(ts),
        "amt_per_txday": F.col("amt") / (F.weekday(ts) + 1),
    })


def add_drift(df: DataFrame) -> DataFrame:
    """Ratios over the card's history columns. A gap is never negative here, also for late rows."""
    gap = F.greatest(F.col("uid_time_since_last").cast("double"), F.lit(0.0))
    return df.withColumns({
        "amt_vs_recent": F.col("amt") - F.col("amt_roll_mean_3"),
        "amt_change": F.col("amt") / (F.col("amt_roll_mean_3") + F.lit(EPSILON)),
        "log_time_gap": F.log1p(gap),
        "txn_ratio": F.col("uid_txn_1h") / (F.col("uid_txn_24h") + 1),
    })
