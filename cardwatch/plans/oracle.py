"""DuckDB SQL for every query that SQL can express, over the same tables.

Each statement is a chain of common table expressions that ends in one plain select.
"""

from __future__ import annotations


def _hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    dlat = f"sin((radians({lat2}) - radians({lat1})) / 2)"
    dlon = f"sin((radians({lon2}) - radians({lon1})) / 2)"
    return (f"12742.0 * asin(sqrt(least(1.0, {dlat} * {dlat} + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * {dlon} * {dlon})))")


_CTES = {
    "base": """
SELECT event_id AS trans_num, ts, epoch_us(ts) // 1000000 AS unix_time,
  CAST(user_id AS VARCHAR) AS cc_num,
  (CASE WHEN event_id % 3 = 0 THEN 'fraud_' ELSE '' END) || 'M' || CAST(event_id % 50 AS VARCHAR) AS merchant,
  'M' || CAST(event_id % 50 AS VARCHAR) AS merchant_clean,
  event_type AS category, value AS amt,
  CASE WHEN user_id % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
  'S' || CAST(user_id % 25 AS VARCHAR) AS state, 'J' || CAST(user_id % 97 AS VARCHAR) AS job,
  lpad(CAST(user_id * 7919 % 100000 AS VARCHAR), 5, '0') AS zip,
  25::DOUBLE + (user_id * 37 % 2500) / 100::DOUBLE + (event_id % 3) * 0.01::DOUBLE AS lat,
  (-120)::DOUBLE + (user_id * 53 % 5000) / 100::DOUBLE + (event_id % 2) * 0.01::DOUBLE AS long,
  user_id * 7907 % 100000 + 100 AS city_pop,
  DATE '1950-01-01' + CAST(user_id * 97 % 18000 AS INTEGER) AS dob,
  CASE WHEN (value > 120 AND (hour(ts) <= 5 OR hour(ts) >= 23)) OR event_id % 211 = 0 THEN 1 ELSE 0 END AS is_fraud
FROM events""",
    "keyed": """
SELECT *, lat + (trans_num * 13 % 200 - 100) / 100::DOUBLE AS merch_lat,
  long + (trans_num * 17 % 200 - 100) / 100::DOUBLE AS merch_long,
  cc_num || '_' || CAST(dob AS VARCHAR) || '_' || zip AS card_uid
FROM base""",
    "cards": """
SELECT card_uid, row_number() OVER (ORDER BY md5(card_uid)) AS place, count(*) OVER () AS n
FROM (SELECT DISTINCT card_uid FROM keyed)""",
    "txn": """
SELECT k.*, CASE WHEN c.place <= ceil(0.2::DOUBLE * c.n) THEN 'test' ELSE 'train' END AS split
FROM keyed k JOIN cards c USING (card_uid)""",
    "feat": f"""
SELECT *, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month,
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour(ts) <= 5 OR hour(ts) >= 23 THEN 1 ELSE 0 END AS is_night,
  CAST(trunc((CAST(ts AS DATE) - dob) / 365.25::DOUBLE) AS BIGINT) AS age,
  {_hav('lat', 'long', 'merch_lat', 'merch_long')} AS distance_km,
  ln(1 + amt) AS log_amt, ln(1 + city_pop::DOUBLE) AS log_city_pop,
  amt * hour(ts) AS amt_x_hour, amt / isodow(ts) AS amt_per_txday
FROM txn""",
    "hist": f"""
SELECT *, unix_time - coalesce(p_time, unix_time) AS uid_time_since_last,
  CASE WHEN p_lat IS NULL THEN 0.0 ELSE {_hav('p_lat', 'p_long', 'lat', 'long')} END AS uid_dist_from_prev
FROM (
  SELECT *, lag(unix_time) OVER o AS p_time, lag(lat) OVER o AS p_lat, lag(long) OVER o AS p_long,
    avg(amt) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prior_mean,
    coalesce(stddev_samp(amt) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0.0) AS prior_std,
    row_number() OVER o - 1 - count(*) OVER (s RANGE BETWEEN UNBOUNDED PRECEDING AND 3601 PRECEDING) AS uid_txn_1h,
    row_number() OVER o - 1 - count(*) OVER (s RANGE BETWEEN UNBOUNDED PRECEDING AND 86401 PRECEDING) AS uid_txn_24h,
    row_number() OVER o - 1 - count(*) OVER (s RANGE BETWEEN UNBOUNDED PRECEDING AND 604801 PRECEDING) AS uid_txn_7d,
    count(*) OVER (s RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS uid_txn_1h_strict,
    count(*) OVER (s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS uid_txn_24h_strict,
    count(*) OVER (s RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING) AS uid_txn_7d_strict
  FROM feat
  WINDOW o AS (PARTITION BY card_uid ORDER BY unix_time, trans_num),
         s AS (PARTITION BY card_uid ORDER BY unix_time)
)""",
    "scal": """
SELECT avg(amt) AS seq_global_mean, avg(amt) AS global_amt_mean,
  greatest(stddev_samp(amt), 1e-6) AS global_amt_std, greatest(avg(distance_km), 1e-6) AS dist_mean,
  count(*) FILTER (is_fraud = 0) AS n_negative, count(*) FILTER (is_fraud = 1) AS n_positive,
  count(*) FILTER (is_fraud = 0) / greatest(count(*) FILTER (is_fraud = 1), 1)::DOUBLE AS scale_pos_weight
FROM feat WHERE split = 'train'""",
    "loc": """
SELECT card_uid, count(DISTINCT lat) AS uid_unique_locs, coalesce(stddev_samp(lat), 0.0) AS uid_loc_std_lat,
  coalesce(stddev_samp(long), 0.0) AS uid_loc_std_lon
FROM txn WHERE split = 'train' GROUP BY card_uid""",
    "cat": """
SELECT category, count(amt) AS cat_count, sum(amt) AS cat_sum,
  (sum(amt) + 10 * (SELECT avg(amt) FROM txn WHERE split = 'train')) / (count(amt) + 10) AS cat_mean_amt,
  quantile_cont(amt, 0.5) AS cat_median_amt
FROM txn WHERE split = 'train' GROUP BY category""",
    "catfill": """
SELECT quantile_cont(cat_mean_amt, 0.5) AS cat_mean_amt, quantile_cont(cat_median_amt, 0.5) AS cat_median_amt
FROM cat""",
    "pop": """
SELECT f.*, greatest(-5.0, least(5.0, (amt - global_amt_mean) / global_amt_std)) AS amt_zscore_global,
  greatest(-5.0, least(5.0, distance_km / dist_mean)) AS distance_anomaly
FROM feat f, scal""",
    "vals": """
SELECT trans_num, split, "column", value FROM (
  SELECT trans_num, split, unnest(['merchant_clean', 'category', 'gender', 'state', 'job']) AS "column",
    unnest([merchant_clean, category, gender, state, job]) AS value FROM txn)""",
    "vocab": """
SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS code FROM (
  SELECT DISTINCT "column", value FROM vals WHERE split = 'train'
  UNION SELECT DISTINCT "column", '<unseen>' FROM vals)""",
    "scores": """
SELECT trans_num, is_fraud AS y, 'score_z' AS model, round(amt_zscore_global, 2) AS prob FROM pop WHERE split = 'test'
UNION ALL SELECT trans_num, is_fraud, 'score_rule', CASE WHEN amt > 300 THEN 0.85 ELSE 0.05 END::DOUBLE
FROM pop WHERE split = 'test'
UNION ALL SELECT trans_num, is_fraud, 'score_distance', round(distance_anomaly, 2) FROM pop WHERE split = 'test'""",
    "lines": """
SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, 'price' AS model, l_extendedprice AS prob FROM lineitem
UNION ALL SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, 'discount', l_discount FROM lineitem
UNION ALL SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, 'quantity', l_quantity FROM lineitem""",
    "chosen": """
SELECT *, round((amt_zscore_global + 5) / 10, 4) AS fraud_probability,
  CASE WHEN trans_num % 2 = 0 THEN 'ensemble' ELSE 'model_a' END AS model_used FROM pop""",
    "tiered": """
SELECT *, CASE WHEN fraud_probability >= hi THEN 'Fraud' WHEN fraud_probability >= lo THEN 'Uncertain' ELSE 'Safe' END
  AS status, fraud_probability >= hi AS flagged
FROM (SELECT *, CASE WHEN model_used = 'ensemble' THEN 0.6 ELSE 0.95 END::DOUBLE AS hi,
  CASE WHEN model_used = 'ensemble' THEN 0.5 ELSE 0.85 END::DOUBLE AS lo FROM chosen)""",
    "large": """
SELECT CAST(o_custkey AS VARCHAR) AS card_uid, epoch_us(l_shipdate) // 1000000 AS unix_time,
  l_extendedprice AS amt, p_type AS category, row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
    l_linestatus) AS place
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey""",
    "largehist": """
SELECT card_uid, unix_time - coalesce(lag(unix_time) OVER o, unix_time) AS gap,
  place - 1 - count(*) OVER (s RANGE BETWEEN UNBOUNDED PRECEDING AND 3601 PRECEDING) AS n1,
  place - 1 - count(*) OVER (s RANGE BETWEEN UNBOUNDED PRECEDING AND 86401 PRECEDING) AS n24,
  place - 1 - count(*) OVER (s RANGE BETWEEN UNBOUNDED PRECEDING AND 604801 PRECEDING) AS n7,
  count(*) OVER (s RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS s1,
  count(*) OVER (s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS s24,
  count(*) OVER (s RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING) AS s7,
  avg(amt) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m,
  coalesce(stddev_samp(amt) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0.0) AS sd
FROM large WINDOW o AS (PARTITION BY card_uid ORDER BY place), s AS (PARTITION BY card_uid ORDER BY unix_time)""",
    "messy": """
SELECT trans_num, cc_num, zip, merchant_clean, card_uid, amt, is_fraud FROM keyed
UNION ALL SELECT trans_num + 1000000, cc_num, zip, merchant_clean, card_uid, amt, is_fraud FROM keyed
WHERE trans_num % 50 = 0""",
}
# what each expression above is built on, in order
_CHAIN = ["base", "keyed", "cards", "txn", "feat"]
_HISTORY = [*_CHAIN, "hist"]
_POPULATION = [*_CHAIN, "scal", "pop"]
_SCORES = [*_POPULATION, "scores"]

_POINTS = {
    "points": """
SELECT model, prob, sum(y) AS pos, count(*) AS n FROM {src} GROUP BY model, prob""",
    "run": """
SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged, sum(pos) OVER m AS n_pos, sum(n) OVER m AS n_all
FROM points WINDOW w AS (PARTITION BY model ORDER BY prob DESC), m AS (PARTITION BY model)""",
    "curve": """
SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r + 1e-9::DOUBLE) END AS f1 FROM (
  SELECT *, tp / flagged AS p, CASE WHEN n_pos = 0 THEN 1.0 ELSE tp / n_pos END AS r,
    (flagged - tp) / nullif(n_all - n_pos, 0) AS fpr FROM (
    SELECT model, prob, pos::DOUBLE AS pos, n::DOUBLE AS n, tp::DOUBLE AS tp, flagged::DOUBLE AS flagged,
      n_pos::DOUBLE AS n_pos, n_all::DOUBLE AS n_all FROM run))""",
    "best": """
SELECT model, prob AS threshold, f1 AS best_f1, n_pos / n_all AS prevalence, tp, flagged - tp AS fp, n_pos - tp AS fn,
  n_all - n_pos - flagged + tp AS tn
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, prob) AS k FROM curve) WHERE k = 1""",
    "area": """
SELECT model, sum(pos * p) / max(n_pos) AS pr_auc,
  sum((n - pos) * (tp - pos / 2)) / (max(n_pos) * (max(n_all) - max(n_pos))) AS roc_auc FROM curve GROUP BY model""",
    "rates": """
SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, 2 * tp / (2 * tp + fp + fn) AS f1,
  CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS precision0,
  CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS recall0,
  CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2 * tn / (2 * tn + fp + fn) END AS f10 FROM best""",
}


def _sql(names: list[str], final: str, extra: dict[str, str] | None = None) -> str:
    parts = {n: _CTES[n] for n in names} | (extra or {})
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in parts.items()) + "\n" + final.strip()


def _curve(final: str, src: str = "scores", names: list[str] = _SCORES, tail: dict[str, str] | None = None) -> str:
    extra = {k: v.replace("{src}", src) for k, v in _POINTS.items()}
    return _sql(names, final, extra | (tail or {}))


def _r(names: str, digits: int = 6) -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"round({n}::DOUBLE, {digits}) AS {n}" for n in names.split())


def _i(names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names.split())


_COMPARE = f"""
SELECT model, {_r('pr_auc roc_auc threshold prevalence')}, {_i('tn fp fn tp')}, {_r('precision recall f1')}
FROM rates JOIN area USING (model)"""

_COUNTED = "SELECT {label}, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}|' || trans_num)) AS k, " \
           "count(*) OVER (PARTITION BY {label}) AS n, trans_num FROM keyed"


def _stratified(flag: str, share: str, seed: int) -> str:
    ranked = _COUNTED.format(label="is_fraud", seed=seed)
    return _sql(["base", "keyed"], f"""
SELECT trans_num, CAST(is_fraud AS BIGINT) AS is_fraud, CAST(k <= ceil({share}::DOUBLE * n) AS BIGINT) AS {flag}
FROM ({ranked})""")


_IMPORTANCES = ["amt", "log_amt", "amt_x_hour", "amt_per_txday", "amt_zscore_global", "distance_km",
                "distance_anomaly", "hour", "is_night", "age", "city_pop", "log_city_pop"]
_IMPORTANCE = {"imp": "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, round(abs(corr({f}::DOUBLE, is_fraud::DOUBLE)), 9) AS importance FROM pop WHERE split = 'train'"
    for f in _IMPORTANCES)} | {"ranked": """
SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank,
  sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) / sum(importance) OVER ()
  AS cum_share FROM imp"""}
_KEPT = _IMPORTANCE | {"kept": """
SELECT feature, importance, rank FROM (SELECT *, lag(cum_share, 1, 0.0) OVER (ORDER BY rank) AS before FROM ranked)
WHERE before < 0.99"""}
_BEHAVIOURAL = ("'amt_zscore_global', 'distance_anomaly', 'amt_x_hour', 'amt_per_txday', 'is_night'")
_PAIRS = "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}::DOUBLE, {b}::DOUBLE)) AS r FROM pop WHERE split = 'train'"
    for j, b in enumerate(_IMPORTANCES) for a in _IMPORTANCES[:j])


def _encoded(names: str) -> str:
    return ", ".join(
        f"CAST(coalesce((SELECT code FROM vocab v WHERE v.\"column\" = '{c}' AND v.value = t.{c}), "
        f"(SELECT code FROM vocab v WHERE v.\"column\" = '{c}' AND v.value = '<unseen>')) AS BIGINT) AS {c}"
        for c in names.split())


_ENCODED = _encoded("merchant_clean category gender state job")
_RAW_INTERACTIONS = f"""{_r('amt_x_hour amt_per_txday')},
  round(amt - coalesce(prior_mean, seq_global_mean), 6) AS amt_vs_recent,
  round(amt / (coalesce(prior_mean, seq_global_mean) + 1e-6::DOUBLE), 6) AS amt_change,
  round(ln(1 + uid_time_since_last::DOUBLE), 6) AS log_time_gap,
  round(uid_txn_1h / (uid_txn_24h + 1)::DOUBLE, 6) AS txn_ratio"""

ORACLE: dict[str, str] = {
    "table_scan": _sql(["base"], f"""
SELECT CAST(trans_num AS VARCHAR) AS trans_num, {_i('unix_time is_fraud')}, cc_num, merchant, {_r('amt')}, zip,
  CAST(dob AS VARCHAR) AS dob FROM base"""),
    "csv_scan": _sql(["base", "keyed"], f"""
SELECT {_i('trans_num unix_time city_pop is_fraud')}, cc_num, category, {_r('amt lat')}, CAST(dob AS VARCHAR) AS dob
FROM (SELECT * FROM keyed UNION ALL SELECT * REPLACE (trans_num + 1000000 AS trans_num) FROM keyed
      WHERE trans_num % 50 = 0)"""),
    "request_rows": _sql(["base", "keyed"], f"""
SELECT lpad(CAST(trans_num // 8 AS VARCHAR), 12, '0') AS request_id,
  row_number() OVER (PARTITION BY trans_num // 8 ORDER BY unix_time, trans_num) - 1 AS pos,
  CASE (trans_num // 8) % 5 WHEN 1 THEN 'model_a' WHEN 2 THEN 'model_b' WHEN 3 THEN 'nobody' ELSE 'ensemble' END
  AS model, CAST((trans_num // 8) % 3 = 0 AS BIGINT) AS return_all, cc_num, {_r('amt')}, {_i('unix_time')},
  CAST(dob AS VARCHAR) AS dob FROM keyed"""),
    "request_quarantine": _sql(["base"], """
SELECT CASE WHEN unix_time % 7 = 0 OR unix_time % 11 = 0 THEN 'rejected' ELSE 'accepted' END AS outcome,
  count(*) AS n FROM base GROUP BY 1"""),
    "clean_txn": _sql(["base", "keyed"], f"""
SELECT trans_num, cc_num, zip, merchant_clean, card_uid, {_r('amt')}, {_i('is_fraud')} FROM keyed"""),
    "dedup": _sql(["base", "keyed", "messy"], f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(id) AS BIGINT) AS id_sum, max(id) AS id_max
FROM (SELECT min(trans_num) AS id FROM messy GROUP BY trans_num % 1000000)"""),
    "prefix_count": _sql(["base"], "SELECT count(*) FILTER (starts_with(merchant, 'fraud_')) AS n_prefixed FROM base"),
    "profile": _sql(_CHAIN[:4], """
SELECT split, count(*) AS n_rows, count(DISTINCT cc_num) AS n_cc_num, count(DISTINCT card_uid) AS n_cards,
  round(avg(is_fraud), 6) AS fraud_rate FROM txn GROUP BY split"""),
    "rows_per_card": _sql(["base", "keyed"], "SELECT card_uid, count(*) AS n_rows FROM keyed GROUP BY card_uid"),
    "class_filter": _sql(["base", "keyed"], f"SELECT trans_num, card_uid, {_r('amt')} FROM keyed WHERE is_fraud = 1"),
    "split_group_holdout": _sql(_CHAIN[:4], "SELECT trans_num, card_uid, split FROM txn"),
    "split_overlap": _sql(_CHAIN[:4], """
SELECT count(*) AS n_shared FROM (SELECT card_uid FROM txn WHERE split = 'train'
  INTERSECT SELECT card_uid FROM txn WHERE split = 'test')"""),
    "split_group_kfold": _sql(["base", "keyed"], """
SELECT card_uid, n_rows, CAST(CASE WHEN t < 3 THEN t ELSE 5 - t END AS BIGINT) AS fold
FROM (SELECT *, (row_number() OVER (ORDER BY n_rows DESC, md5(card_uid)) - 1) % 6 AS t
  FROM (SELECT card_uid, count(*) AS n_rows FROM keyed GROUP BY card_uid))"""),
    "split_hash_fold": _sql(["base", "keyed"], """
SELECT CAST(('0x' || substr(md5(card_uid), 1, 8))::BIGINT % 3 AS BIGINT) AS fold, count(*) AS n_rows,
  count(DISTINCT card_uid) AS n_cards FROM keyed GROUP BY 1"""),
    "split_stratified": _stratified("is_validation", "0.1", 42),
    "split_calibration": _stratified("is_calibration", "0.2", 43),
    "sample_stratified": _sql(["base", "keyed"], f"""
SELECT trans_num, CAST(is_fraud AS BIGINT) AS is_fraud FROM (
  SELECT *, (SELECT least(count(*), 500) FROM keyed WHERE is_fraud = 1) AS p
  FROM ({_COUNTED.format(label='is_fraud', seed=42)}))
WHERE k <= CASE WHEN is_fraud = 1 THEN p ELSE 1000 - p END"""),
    "sample_cards": _sql(["base", "keyed"], """
SELECT card_uid, n_rows FROM (SELECT card_uid, count(*) AS n_rows,
  row_number() OVER (ORDER BY md5('42|' || card_uid)) AS k, count(*) OVER () AS n FROM keyed GROUP BY card_uid)
WHERE (SELECT count(*) FROM keyed) <= 3000
  OR k <= ceil((3000 / (SELECT count(*) FROM keyed)::DOUBLE) * n)"""),
    "sample_last_k": _sql(["base", "keyed"], """
SELECT card_uid, trans_num, recency FROM (SELECT *, row_number() OVER (
  PARTITION BY card_uid ORDER BY unix_time DESC, trans_num DESC) AS recency FROM keyed) WHERE recency <= 3"""),
    "sample_first_rows": _sql(["base"], f"SELECT trans_num, {_r('amt')} FROM base ORDER BY trans_num LIMIT 100"),
    "feat_calendar": _sql(_CHAIN, f"SELECT trans_num, {_i('hour day_of_week month is_weekend is_night')} FROM feat"),
    "feat_age": _sql(_CHAIN, f"SELECT trans_num, {_i('age')} FROM feat"),
    "feat_distance": _sql(_CHAIN, f"SELECT trans_num, {_r('distance_km')} FROM feat"),
    "feat_distance_sql": _sql(_CHAIN, f"SELECT trans_num, {_r('distance_km')} FROM feat"),
    "feat_logs": _sql(_CHAIN, f"SELECT trans_num, {_r('log_amt log_city_pop')} FROM feat"),
    "feat_interactions": _sql([*_HISTORY, "scal"], f"SELECT trans_num, {_RAW_INTERACTIONS} FROM hist, scal"),
    "win_gap": _sql(_HISTORY, f"SELECT trans_num, {_i('uid_time_since_last')} FROM hist"),
    "win_prev_distance": _sql(_HISTORY, f"SELECT trans_num, {_r('uid_dist_from_prev')} FROM hist"),
    "win_velocity": _sql(_HISTORY, f"SELECT trans_num, {_i('uid_txn_1h uid_txn_24h uid_txn_7d')} FROM hist"),
    "win_velocity_strict": _sql(
        _HISTORY, f"SELECT trans_num, {_i('uid_txn_1h_strict uid_txn_24h_strict uid_txn_7d_strict')} FROM hist"),
    "win_roll": _sql([*_HISTORY, "scal"], """
SELECT trans_num, round(coalesce(prior_mean, seq_global_mean), 6) AS amt_roll_mean_3,
  round(prior_std, 6) AS amt_roll_std_3 FROM hist, scal"""),
    "large_velocity": _sql(["large", "largehist"], """
SELECT card_uid, count(*) AS n_rows, CAST(sum(gap) AS BIGINT) AS gaps, CAST(sum(n1) AS BIGINT) AS uid_txn_1h,
  CAST(sum(n24) AS BIGINT) AS uid_txn_24h, CAST(sum(n7) AS BIGINT) AS uid_txn_7d,
  CAST(sum(s1) AS BIGINT) AS uid_txn_1h_strict, CAST(sum(s24) AS BIGINT) AS uid_txn_24h_strict,
  CAST(sum(s7) AS BIGINT) AS uid_txn_7d_strict FROM largehist GROUP BY card_uid"""),
    "large_rolling": _sql(["large", "largehist"], """
SELECT card_uid, round(sum(m), 4) AS prior_mean, round(sum(sd), 4) AS prior_std FROM largehist GROUP BY card_uid"""),
    "agg_global": _sql([*_CHAIN, "scal"], f"""
SELECT {_r('seq_global_mean global_amt_mean global_amt_std dist_mean scale_pos_weight')},
  {_i('n_negative n_positive')} FROM scal"""),
    "agg_location": _sql([*_CHAIN[:4], "loc"], f"""
SELECT card_uid, uid_unique_locs, {_r('uid_loc_std_lat uid_loc_std_lon')} FROM loc"""),
    "join_location": _sql([*_CHAIN[:4], "loc"], """
SELECT trans_num, split, coalesce(uid_unique_locs, 1) AS uid_unique_locs,
  round(coalesce(uid_loc_std_lat, 0.0), 6) AS uid_loc_std_lat,
  round(coalesce(uid_loc_std_lon, 0.0), 6) AS uid_loc_std_lon FROM txn LEFT JOIN loc USING (card_uid)"""),
    "agg_category": _sql([*_CHAIN[:4], "cat"], f"""
SELECT category, cat_count, {_r('cat_sum cat_mean_amt cat_median_amt')} FROM cat"""),
    "agg_category_fallback": _sql([*_CHAIN[:4], "cat", "catfill"], f"""
SELECT {_r('cat_mean_amt cat_median_amt')} FROM catfill"""),
    "join_category": _sql([*_CHAIN[:4], "cat", "catfill"], """
SELECT trans_num, m.category, round(coalesce(c.cat_mean_amt, f.cat_mean_amt), 6) AS cat_mean_amt,
  round(coalesce(c.cat_median_amt, f.cat_median_amt), 6) AS cat_median_amt
FROM (SELECT trans_num, CASE WHEN split = 'test' AND category = 'error' THEN 'novel' ELSE category END AS category
      FROM txn) m LEFT JOIN cat c ON m.category = c.category, catfill f"""),
    "large_category": _sql(["large"], """
SELECT category, count(amt) AS cat_count, round(quantile_cont(amt, 0.5), 6) AS cat_median_amt FROM large
WHERE category IS NOT NULL GROUP BY category"""),
    "feat_zscore_clip": _sql(_POPULATION, f"SELECT trans_num, {_r('amt_zscore_global')} FROM pop"),
    "feat_distance_anomaly": _sql(_POPULATION, f"SELECT trans_num, {_r('distance_anomaly')} FROM pop"),
    "class_weight": _sql([*_CHAIN, "scal"], """
SELECT CAST(is_fraud AS BIGINT) AS is_fraud, count(*) AS n_rows,
  round(max(CASE WHEN is_fraud = 1 THEN scale_pos_weight ELSE 1.0 END), 6) AS w
FROM feat, scal WHERE split = 'train' GROUP BY is_fraud"""),
    "encode_vocab": _sql([*_CHAIN[:4], "vals", "vocab"], f'SELECT "column", value, {_i("code")} FROM vocab'),
    "encode_apply": _sql([*_CHAIN[:4], "vals", "vocab"], f"SELECT trans_num, {_ENCODED} FROM txn t"),
    "unseen_count": _sql([*_CHAIN[:4], "vals", "vocab"], """
SELECT v."column", count(*) FILTER (o.code IS NULL) AS n_unseen
FROM vals v LEFT JOIN vocab o ON v."column" = o."column" AND v.value = o.value
WHERE v.split = 'test' GROUP BY v."column\""""),
    "export_features": _sql([*_HISTORY, "scal", "loc", "cat", "catfill", "vals", "vocab"], f"""
SELECT trans_num AS "row", split, {_i('is_fraud city_pop hour day_of_week month is_weekend is_night age')},
  {_r('amt distance_km log_amt log_city_pop')}, {_i('uid_time_since_last uid_txn_24h uid_txn_7d')},
  {_r('uid_dist_from_prev')}, {_RAW_INTERACTIONS},
  round(coalesce(prior_mean, seq_global_mean), 6) AS amt_roll_mean_3, round(prior_std, 6) AS amt_roll_std_3,
  coalesce(uid_unique_locs, 1) AS uid_unique_locs, round(coalesce(uid_loc_std_lat, 0.0), 6) AS uid_loc_std_lat,
  round(coalesce(uid_loc_std_lon, 0.0), 6) AS uid_loc_std_lon,
  round(coalesce(c.cat_mean_amt, f.cat_mean_amt), 6) AS cat_mean_amt,
  round(coalesce(c.cat_median_amt, f.cat_median_amt), 6) AS cat_median_amt,
  round(greatest(-5.0, least(5.0, (amt - global_amt_mean) / global_amt_std)), 6) AS amt_zscore_global,
  round(greatest(-5.0, least(5.0, distance_km / dist_mean)), 6) AS distance_anomaly,
  {_ENCODED}, CASE is_fraud WHEN 1 THEN 'Fraud' ELSE 'Non-Fraud' END AS fraud_label
FROM hist t LEFT JOIN loc USING (card_uid) LEFT JOIN cat c ON t.category = c.category, catfill f, scal"""),
    "corr_matrix": _sql(_POPULATION, f"SELECT a, b, {_r('r')} FROM ({_PAIRS})"),
    "importance_cum": _sql(_POPULATION, f"""
SELECT feature, {_r('importance')}, rank, {_r('cum_share')}, CAST(feature IN ({_BEHAVIOURAL}) AS BIGINT) AS behavioural
FROM ranked""", _IMPORTANCE),
    "select_important": _sql(_POPULATION, "SELECT feature, rank FROM kept", _KEPT),
    "rule_score": _sql(["base"], """
SELECT trans_num, CASE WHEN amt > 300 THEN 0.85 ELSE 0.05 END::DOUBLE AS fraud_probability,
  CAST(amt > 300 AS BIGINT) AS is_fraud_predicted, CASE WHEN amt > 300 THEN 'Fraud' ELSE 'Safe' END AS status,
  0.5::DOUBLE AS threshold, 'mock_no_models_loaded' AS model_used FROM base"""),
    "tiers": _sql([*_POPULATION, "chosen", "tiered"], """
SELECT trans_num, status, CAST(flagged AS BIGINT) AS is_fraud_predicted, hi AS threshold FROM tiered"""),
    "tiers_compat": _sql([*_POPULATION, "chosen"], """
SELECT trans_num, CAST(p >= f AS BIGINT) AS is_fraud_predicted,
  CASE WHEN p >= f THEN 'Fraud' WHEN p >= u THEN 'Uncertain' ELSE 'Safe' END AS status, t AS threshold
FROM (SELECT trans_num, fraud_probability AS p, CASE WHEN model_used = 'ensemble' THEN 0.5 ELSE 0.95 END::DOUBLE AS f,
  CASE WHEN model_used = 'ensemble' THEN 0.6 ELSE 0.85 END::DOUBLE AS u,
  CASE WHEN model_used = 'ensemble' THEN 0.97 ELSE 0.95 END::DOUBLE AS t FROM chosen)"""),
    "status_summary": _sql([*_POPULATION, "chosen", "tiered"], """
SELECT split, count(*) AS n_transactions, count(*) FILTER (status = 'Safe') AS n_safe,
  count(*) FILTER (status = 'Uncertain') AS n_uncertain, count(*) FILTER (status = 'Fraud') AS n_fraud,
  count(*) FILTER (flagged) AS n_flagged FROM tiered GROUP BY split"""),
    "display_status": _sql([*_POPULATION, "chosen", "tiered"], """
SELECT trans_num, round(share, 6) AS share, round(least(100.0, greatest(0.0, share * 100)), 6) AS percent,
  CASE WHEN trans_num % 4 = 0 THEN status WHEN trans_num % 5 = 0 AND flagged THEN 'Fraud'
       WHEN share >= 0.9 THEN 'Fraud' WHEN share >= 0.7 THEN 'Uncertain' ELSE 'Safe' END AS shown
FROM (SELECT *, CASE WHEN sent > 1 THEN sent / 100 ELSE sent END AS share FROM (
  SELECT *, CASE WHEN trans_num % 3 = 0 THEN fraud_probability * 100 ELSE fraud_probability * 1.4::DOUBLE END AS sent
  FROM tiered))"""),
    "response_nested": _sql([*_POPULATION, "chosen", "tiered"], """
SELECT trans_num // 8 AS request_id, count(*) AS n_transactions,
  string_agg(status, ',' ORDER BY trans_num) AS statuses, round(sum(fraud_probability), 6) AS total
FROM tiered GROUP BY 1"""),
    "pr_curve": _curve("""
SELECT model, round(prob, 6) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall FROM curve
UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM curve"""),
    "roc_curve": _curve("""
SELECT model, round(prob, 6) AS threshold, round(fpr, 6) AS fpr, round(r, 6) AS tpr FROM curve
UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM curve"""),
    "roc_corners": _curve(f"""
SELECT model, round(prob, 6) AS threshold, {_i('tp flagged')} FROM (
  SELECT *, lead(pos) OVER w AS next_pos, lead(n) OVER w AS next_n FROM curve
  WINDOW w AS (PARTITION BY model ORDER BY prob DESC))
WHERE next_n IS NULL OR next_pos <> pos OR next_n <> n"""),
    "f1_by_threshold": _curve("SELECT model, round(prob, 6) AS threshold, round(f1, 6) AS f1 FROM curve"),
    "average_precision": _curve(f"SELECT model, {_r('pr_auc')} FROM area"),
    "roc_auc": _curve(f"SELECT model, {_r('roc_auc')} FROM area"),
    "best_f1": _curve(f"SELECT model, {_r('threshold best_f1 prevalence')} FROM best"),
    "confusion": _curve(f"""
SELECT model, {_r('threshold')}, {_i('tn fp fn tp')}, {_r('precision recall f1')} FROM rates"""),
    "class_report": _curve(f"""
SELECT model, label, {_r('precision recall f1')}, {_i('support')} FROM (
  SELECT model, 'Fraud' AS label, precision, recall, f1, tp + fn AS support FROM rates
  UNION ALL SELECT model, 'Non-Fraud', precision0, recall0, f10, tn + fp FROM rates
  UNION ALL SELECT model, 'accuracy', (tn + tp) / (tn + fp + fn + tp), (tn + tp) / (tn + fp + fn + tp),
    (tn + tp) / (tn + fp + fn + tp), tn + fp + fn + tp FROM rates
  UNION ALL SELECT model, 'macro avg', (precision0 + precision) / 2, (recall0 + recall) / 2, (f10 + f1) / 2,
    tn + fp + fn + tp FROM rates
  UNION ALL SELECT model, 'weighted avg', (precision0 * (tn + fp) + precision * (tp + fn)) / (tn + fp + fn + tp),
    (recall0 * (tn + fp) + recall * (tp + fn)) / (tn + fp + fn + tp),
    (f10 * (tn + fp) + f1 * (tp + fn)) / (tn + fp + fn + tp), tn + fp + fn + tp FROM rates)"""),
    "score_histogram": _sql(_SCORES, """
SELECT g.model, CAST(g.y AS BIGINT) AS y, CAST(g.bin AS BIGINT) AS bin,
  round(lo + g.bin * ((hi - lo) / 50), 6) AS bin_start, coalesce(n, 0) AS n
FROM (SELECT * FROM ranges, (SELECT unnest(range(50)) AS bin)) g
LEFT JOIN (SELECT s.model, s.y, least(floor((prob - lo) / (hi - lo) * 50), 49) AS bin, count(*) AS n
  FROM scores s JOIN ranges r ON s.model = r.model AND s.y = r.y GROUP BY 1, 2, 3) f
ON g.model = f.model AND g.y = f.y AND g.bin = f.bin""", {"ranges": """
SELECT model, y, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi
FROM (SELECT model, y, min(prob) AS lo, max(prob) AS hi FROM scores GROUP BY model, y)"""}),
    "model_compare": _curve(_COMPARE),
    "large_compare": _curve(_COMPARE, "lines", ["lines"]),
    "stream_features": _sql(_HISTORY, f"""
SELECT trans_num, {_i('uid_time_since_last uid_txn_1h uid_txn_24h uid_txn_7d')},
  {_r('uid_dist_from_prev prior_mean prior_std')} FROM hist"""),
    "carry_features": _sql(_HISTORY, f"""
SELECT trans_num, {_i('uid_time_since_last uid_txn_1h uid_txn_24h uid_txn_7d')},
  {_r('uid_dist_from_prev prior_mean prior_std')} FROM hist"""),
    "stream_carried": _sql(_HISTORY, f"""
SELECT trans_num, {_i('uid_time_since_last uid_txn_1h uid_txn_24h uid_txn_7d')},
  {_r('uid_dist_from_prev prior_mean prior_std')} FROM hist WHERE unix_time > (SELECT (min(unix_time) + max(unix_time)) // 2 FROM hist)"""),
    "stream_score_check": _sql(["base"], "SELECT trans_num, 1::BIGINT AS ok FROM base"),
    "sink_round_trip": _sql(_CHAIN[:4], """
SELECT sink, split, category, count(*) AS n_rows, sum(trans_num)::BIGINT AS id_sum, round(sum(round(amt, 2)), 6) AS amt_sum
FROM txn, (SELECT unnest(['parquet', 'csv', 'table']) AS sink) GROUP BY ALL"""),
    "stream_distinct": _sql(["base"], "SELECT count(*) AS n_rows, sum(trans_num)::BIGINT AS id_sum, max(trans_num) AS id_max FROM base"),
    "published_batches": _sql(["base"], f"SELECT trans_num, {_r('amt')} FROM base"),
    "stream_responses": _sql(["base"], """
SELECT lpad(CAST(trans_num // 8 AS VARCHAR), 12, '0') AS request_id, count(*) AS n_transactions,
  count(*) FILTER (amt > 300) AS n_flagged FROM base GROUP BY 1"""),
    "stream_registry_size": _sql(["base", "keyed"], "SELECT count(DISTINCT card_uid) AS card_registry_size FROM keyed"),
    "threshold_report": _curve("SELECT model, threshold FROM best"),
}

_NULLED = {"amt": 5, "age": 7, "hour": 3}


def _holed(name: str) -> str:
    return f"(CASE WHEN trans_num % {_NULLED[name]} <> 0 THEN {name} END)" if name in _NULLED else name


_PAIRS_NULLS = "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({_holed(a)}::DOUBLE, {_holed(b)}::DOUBLE)) AS r FROM pop WHERE split = 'train'"
    for j, b in enumerate(_IMPORTANCES) for a in _IMPORTANCES[:j])
_DAMAGED = "(unix_time % 13 = 0 OR unix_time % 17 = 0 OR unix_time % 19 = 0)"
_PRUNE = _KEPT | {
    "paired": f"""
SELECT a, b, r FROM ({_PAIRS}) UNION ALL SELECT b, a, r FROM ({_PAIRS})""",
    "pairs": """
SELECT row_number() OVER (ORDER BY y.rank, x.rank) AS k, x.feature AS a, y.feature AS b, y.rank AS j,
  x.importance AS wa, y.importance AS wb
FROM kept x JOIN kept y ON x.rank < y.rank JOIN paired c ON c.a = x.feature AND c.b = y.feature WHERE c.r > 0.9""",
    "walk": """
SELECT 0::BIGINT AS k, []::VARCHAR[] AS gone, 0::BIGINT AS j, false AS skip
UNION ALL
SELECT n.k, CASE WHEN NOT n.skip AND NOT list_contains(n.gone, n.a)
  THEN list_append(n.gone, CASE WHEN n.wb < n.wa THEN n.b ELSE n.a END) ELSE n.gone END, n.j, n.skip
FROM (SELECT p.k, w.gone, p.j, CASE WHEN p.j <> w.j THEN list_contains(w.gone, p.b) ELSE w.skip END AS skip, p.a, p.b, p.wa, p.wb
      FROM walk w JOIN pairs p ON p.k = w.k + 1) n""",
}
_FIT = {
    "scored": "SELECT trans_num, split, is_fraud, round(amt_zscore_global, 1) AS score FROM pop",
    "points": """
SELECT score, sum(is_fraud)::DOUBLE AS s, count(*)::DOUBLE AS n FROM scored WHERE split = 'train' GROUP BY score""",
    "sums": """
SELECT score, sum(s) OVER w AS cs, sum(n) OVER w AS cn, sum(s) OVER w - s AS bs, sum(n) OVER w - n AS bn
FROM points WINDOW w AS (ORDER BY score)""",
    "best": """
SELECT a.score AS lo, b.score AS hi, (b.cs - a.bs) / (b.cn - a.bn) AS m FROM sums a JOIN sums b ON a.score <= b.score""",
    "least": """
SELECT lo, hi, min(m) OVER (PARTITION BY lo ORDER BY hi DESC) AS m FROM best""",
    "fit": """
SELECT x.score, max(l.m) AS y FROM points x JOIN least l ON l.lo <= x.score AND l.hi = x.score GROUP BY x.score""",
    "near": """
SELECT t.trans_num, t.score, (SELECT max(score) FROM fit WHERE score <= t.score) AS x0,
  (SELECT min(score) FROM fit WHERE score >= t.score) AS x1 FROM scored t WHERE t.split = 'test'""",
}
_ELSE = {"other": """
SELECT l_orderkey * 8 + l_linenumber AS id, l_extendedprice / 200 AS v, (l_orderkey * 8 + l_linenumber) * 7919 % 86400 // 3600 AS h
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""}
_EPOCHED = {"middle": "SELECT CAST(floor((min(unix_time) + max(unix_time)) / 2) AS BIGINT) AS m FROM feat"} | {
    "ephist": _CTES["hist"].replace("FROM feat\n", "FROM (SELECT *, CAST(unix_time > (SELECT m FROM middle) AS BIGINT) AS epoch FROM feat)\n")
    .replace("PARTITION BY card_uid", "PARTITION BY card_uid, epoch")}

ORACLE |= {
    "key_report": _sql(["base"], f"""
SELECT CASE WHEN {_DAMAGED} THEN 'unkeyed' ELSE 'keyed' END AS outcome, count(*) AS n FROM base GROUP BY 1"""),
    "prepare_keyed": _sql(["base", "keyed"], f"SELECT trans_num, card_uid FROM keyed WHERE NOT {_DAMAGED}"),
    "win_unkeyed": _sql(["base"], """
SELECT trans_num, 0::BIGINT AS uid_time_since_last, 0.0::DOUBLE AS uid_dist_from_prev, 0::BIGINT AS uid_txn_1h, 0::BIGINT AS uid_txn_24h,
  0::BIGINT AS uid_txn_7d, NULL::DOUBLE AS prior_mean, 0.0::DOUBLE AS prior_std FROM base WHERE trans_num % 23 = 0"""),
    "corr_matrix_nulls": _sql(_POPULATION, f"SELECT a, b, {_r('r')} FROM ({_PAIRS_NULLS})"),
    "request_outcomes": _sql(["base"], """
SELECT CASE WHEN unix_time % 7 = 0 THEN 'rejected' ELSE 'accepted' END AS outcome, count(*) AS n, count(DISTINCT trans_num // 8) AS n_requests
FROM base GROUP BY 1
UNION ALL SELECT 'empty', count(*), count(*) FROM base WHERE trans_num % 80 = 0
UNION ALL SELECT 'unreadable', count(*), 0 FROM base WHERE trans_num % 80 = 0"""),
    "stream_requests": _sql(["base"], """
SELECT lpad(CAST(trans_num // 8 AS VARCHAR), 12, '0') AS request_id, count(*) AS n_transactions, count(*) AS n_answered,
  count(*) FILTER (unix_time % 7 <> 0) AS n_scored, count(*) FILTER (unix_time % 7 = 0) AS n_rejected FROM base GROUP BY 1
UNION ALL SELECT 'empty-' || CAST(trans_num // 8 AS VARCHAR), 0, 0, 0, 0 FROM base WHERE trans_num % 80 = 0"""),
    "stream_scored": _sql(["base"], """
SELECT lpad(CAST(trans_num // 8 AS VARCHAR), 12, '0') AS request_id, count(*) AS n_transactions, count(*) AS n_answered,
  count(*) AS n_scored, 0::BIGINT AS n_rejected FROM base GROUP BY 1"""),
    "stream_reset": _sql(_CHAIN, f"""
SELECT trans_num, {_i('epoch uid_time_since_last uid_txn_1h uid_txn_24h uid_txn_7d').replace('AS epoch', 'AS history_epoch')},
  {_r('uid_dist_from_prev prior_mean prior_std')} FROM ephist""", _EPOCHED),
    "select_corr_prune": _sql(_POPULATION, """
SELECT feature, row_number() OVER (ORDER BY rank) AS rank FROM kept
WHERE NOT list_contains((SELECT gone FROM walk ORDER BY k DESC LIMIT 1), feature)""", _PRUNE).replace("WITH ", "WITH RECURSIVE ", 1),
    "score_check": _sql(_CHAIN[:4], """
SELECT trans_num, CAST(is_fraud AS BIGINT) AS is_fraud, 1::BIGINT AS ok, CASE trans_num % 3 WHEN 1 THEN 'model_b' ELSE 'ensemble' END AS model_used
FROM txn WHERE split = 'test'"""),
    "calibrate_isotonic": _sql(_POPULATION, f"""
SELECT trans_num, {_r('score')}, round(CASE WHEN x0 IS NULL THEN f1.y WHEN x1 IS NULL OR x0 = x1 THEN f0.y
  ELSE f0.y + (f1.y - f0.y) * (near.score - x0) / (x1 - x0) END, 6) AS calibrated
FROM near LEFT JOIN fit f0 ON f0.score = x0 LEFT JOIN fit f1 ON f1.score = x1""".replace("round(score::DOUBLE", "round(near.score::DOUBLE"), _FIT),
    "tune_grid": "SELECT t AS trial, f AS fold, 1::BIGINT AS ok, 1::BIGINT AS inside FROM (SELECT unnest(range(50)) AS t), (SELECT unnest(range(3)) AS f)",
    "attribution_check": _sql(_CHAIN[:4], "SELECT trans_num, 25::BIGINT AS n_features, 1::BIGINT AS ok FROM txn WHERE split = 'test'"),
    "artefact_round_trip": _sql(_CHAIN[:4], "SELECT trans_num, 1::BIGINT AS ok FROM txn WHERE split = 'test'"),
    "zero_shot_check": _sql([], """
SELECT m AS model, count(*) AS n_rows, count(*) FILTER ((v > 120 AND (h <= 5 OR h >= 23)) OR id % 211 = 0) AS n_fraud
FROM other, (SELECT unnest(['model_a', 'model_b', 'ensemble']) AS m) GROUP BY m""", _ELSE),
    "manifest_check": "SELECT * FROM (VALUES ('preprocessing', 1::BIGINT), ('models', 1), ('metadata', 1), ('scores', 0)) t(artefact, present)",
}
ORACLE |= {f"{n}_split": ORACLE[n] for n in (
    "large_velocity", "large_rolling", "large_category", "large_compare", "split_group_kfold", "encode_apply")}
