"""Table contracts and fixed values shared by every job."""

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(),
    "array<bigint>": T.ArrayType(T.LongType()), "array<double>": T.ArrayType(T.DoubleType()),
}


def struct(spec: str) -> T.StructType:
    """A schema from "name type, name type"; unlike a DDL parse it needs no running session."""
    return T.StructType([
        T.StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in spec.split(","))])


# --- fixed values: they decide the results, so they are stated as they are ---
TARGET = "is_fraud"
SEED = 42
TEST_SHARE = 0.20
EARLY_STOP_SHARE = 0.10
CALIBRATION_SHARE = 0.20
CV_FOLDS = 3
TUNING_TRIALS = 50
TUNING_MAX_ROWS = 200_000
ATTRIBUTION_SAMPLE = 8_000
IMPORTANCE_KEPT = 0.99
CORRELATION_LIMIT = 0.90
SMOOTHING_WEIGHT = 10.0
CLIP_LIMIT = 5.0
EPSILON = 1e-6
F1_EPSILON = 1e-9
EARTH_RADIUS_KM = 6371.0
DAYS_PER_YEAR = 365.25
HOUR_S, DAY_S, WEEK_S = 3_600, 86_400, 604_800
ROLLING_ROWS = 3
HISTORY_ROWS = 50
HISTOGRAM_BINS = 50

UNSEEN = "<unseen>"
NULL_TEXT = "nan"
MERCHANT_PREFIX = "fraud_"
FRAUD_LABELS = {0: "Non-Fraud", 1: "Fraud"}
CATEGORICAL = ["merchant_clean", "category", "gender", "state", "job"]
JUNK_COLUMNS = ["6006"]
JUNK_PATTERN = "Unnamed"
PERSONAL_COLUMNS = ["first", "last", "street"]
RAW_COLUMNS = [
    "trans_date_trans_time", "dob", "cc_num", "zip", "lat", "long", "merch_lat", "merch_long",
    "unix_time", "city", "merchant", "first", "last", "street", "trans_num", "card_uid",
]
SELECTED_FEATURES = [
    "amt_zscore_global", "amt_roll_mean_3", "hour", "cat_median_amt", "amt", "cat_mean_amt",
    "log_amt", "uid_txn_7d", "category", "age", "uid_txn_24h", "log_time_gap", "amt_change",
    "amt_per_txday", "uid_time_since_last", "amt_vs_recent", "city_pop", "day_of_week", "state",
    "log_city_pop", "gender", "job", "is_night", "txn_ratio", "month",
]
BEHAVIOURAL_FEATURES = [
    "uid_time_since_last", "log_time_gap", "uid_txn_24h", "uid_txn_7d", "txn_ratio",
    "uid_dist_from_prev", "uid_unique_locs", "uid_loc_std_lat", "uid_loc_std_lon",
    "amt_roll_mean_3", "amt_roll_std_3", "amt_vs_recent", "amt_change", "amt_zscore_global",
    "distance_anomaly", "amt_x_hour", "amt_per_txday", "is_night",
]
# Decision tiers: (fraud at or above, uncertain at or above, threshold shown to the caller).
TIERS_ENSEMBLE = (0.50, 0.60, 0.97)
TIERS_SINGLE = (0.95, 0.85, 0.95)
RULE_AMOUNT, RULE_HIGH, RULE_LOW, RULE_THRESHOLD = 300.0, 0.85, 0.05, 0.5
DISPLAY_FRAUD, DISPLAY_UNCERTAIN = 0.9, 0.7
RULE_MODEL_NAME = "mock_no_models_loaded"
ENSEMBLE = "ensemble"
#: every model input, in matrix order; the velocity count of one hour only feeds ``txn_ratio``
ALL_FEATURES = [
    "category", "amt", "gender", "state", "city_pop", "job", "merchant_clean", "hour",
    "day_of_week", "month", "is_weekend", "age", "distance_km", "log_amt", "log_city_pop",
    "is_night", "uid_time_since_last", "uid_txn_24h", "uid_txn_7d", "uid_dist_from_prev",
    "amt_roll_mean_3", "amt_roll_std_3", "amt_vs_recent", "uid_unique_locs", "uid_loc_std_lat",
    "uid_loc_std_lon", "cat_mean_amt", "cat_median_amt", "amt_zscore_global",
    "distance_anomaly", "amt_x_hour", "amt_per_txday", "amt_change", "log_time_gap", "txn_ratio",
]

#: one row as a caller sends it (no id, no label)
REQUEST_ROW = struct(
    "trans_date_trans_time string, cc_num string, merchant string, category string, amt double, "
    "gender string, city string, state string, zip string, lat double, long double, "
    "city_pop int, job string, dob string, unix_time bigint, merch_lat double, merch_long double"
)
#: one stored transaction; naive timestamps, so results do not hang on a session time zone
TRANSACTION = struct(
    "trans_num string, trans_date_trans_time timestamp_ntz, unix_time bigint, cc_num string, "
    "merchant string, category string, amt double, first string, last string, gender string, "
    "street string, city string, state string, zip string, lat double, long double, "
    "city_pop int, job string, dob date, merch_lat double, merch_long double, is_fraud int"
)
# --- end of fixed values ---
REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("transactions", T.ArrayType(REQUEST_ROW)),
    T.StructField("model", T.StringType()),
    T.StructField("return_all", T.BooleanType()),
])
#: fields a scored row must carry; rows without them are set aside
REQUIRED_FIELDS = [f.name for f in REQUEST_ROW.fields]
