"""Per-card history: hand rows, brute force, the split path for heavy cards, and no look-ahead."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.operators import history
from cardwatch.runtime import HotKeys
from cardwatch.sources import fixtures

SCHEMA = "card_uid string, trans_num bigint, unix_time bigint, amt double, lat double, long double"


def rows_of(spark, rows):
    return spark.createDataFrame([(c, i, t, a, 10.0 + i, 20.0) for i, (c, t, a) in enumerate(rows)], SCHEMA)


def run(df):
    return {r["trans_num"]: r for r in history.with_history(df).collect()}


def test_first_rows_and_rolling(spark):
    got = run(rows_of(spark, [("A", 0, 10.0), ("A", 100, 20.0), ("A", 200, 40.0), ("A", 300, 5.0)]))
    assert (got[0]["uid_time_since_last"], got[0]["uid_dist_from_prev"], got[0]["prior_std"]) == (0, 0.0, 0.0)
    assert got[0]["prior_mean"] is None
    assert (got[1]["prior_mean"], got[1]["prior_std"]) == (10.0, 0.0)
    assert (got[2]["prior_mean"], got[2]["prior_std"]) == (15.0, pytest.approx(7.0710678))
    assert (got[3]["prior_mean"], got[3]["prior_std"]) == (pytest.approx(23.3333333), pytest.approx(15.2752523))
    filled = history.fill_rolling(history.with_history(rows_of(spark, [("A", 0, 10.0)])), F.lit(7.5)).first()
    assert filled["amt_roll_mean_3"] == 7.5


def test_window_edges_and_same_second(spark):
    got = run(rows_of(spark, [("A", 0, 1.0), ("A", 3600, 1.0), ("B", 0, 1.0), ("B", 3601, 1.0), ("C", 9, 1.0), ("C", 9, 1.0)]))
    assert got[1]["uid_txn_1h"] == 1 and got[3]["uid_txn_1h"] == 0
    assert (got[4]["uid_txn_1h"], got[5]["uid_txn_1h"]) == (0, 1)
    assert (got[4]["uid_txn_1h_strict"], got[5]["uid_txn_1h_strict"]) == (0, 0)


def test_cards_do_not_mix(spark):
    got = run(rows_of(spark, [("A", 0, 10.0), ("B", 1, 99.0), ("A", 2, 20.0)]))
    assert got[1]["prior_mean"] is None and got[2]["prior_mean"] == 10.0


def brute_force(rows):
    """Straight from the definitions, per row over all earlier rows."""
    out = {}
    for card in {r[0] for r in rows}:
        mine = sorted((t, i, a) for i, (c, t, a) in enumerate(rows) if c == card)
        for k, (t, i, _) in enumerate(mine):
            last = [a for _, _, a in mine[max(0, k - 3):k]]
            out[i] = {
                "uid_time_since_last": t - mine[k - 1][0] if k else 0,
                "prior_mean": float(np.mean(last)) if last else None,
                "prior_std": float(np.std(last, ddof=1)) if len(last) > 1 else 0.0,
                **{n: sum(1 for s, _, _ in mine[:k] if s >= t - w) for n, w in history.VELOCITY.items()},
                **{f"{n}_strict": sum(1 for s, _, _ in mine if t - w <= s < t) for n, w in history.VELOCITY.items()},
            }
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, limits, hot):
    """One card holds half the rows, many in the same second; both paths must match the definitions."""
    rng = random.Random(3)
    rows = [(rng.choice("AAAABCDE"), rng.choice([rng.randrange(0, 900_000), 5_000, rng.randrange(0, 9_000)]),
             float(rng.randrange(1, 500))) for _ in range(400)]
    if hot:
        limits(hotKeyRows=60, rowsPerRange=25)
    df = rows_of(spark, rows)
    assert bool(HotKeys(df, "card_uid")) == hot
    got, want = run(df), brute_force(rows)
    assert len(got) == len(rows)
    for i, expected in want.items():
        for name, value in expected.items():
            assert got[i][name] == (pytest.approx(value) if value is not None else None), (i, name)


def test_one_second_holds_a_heavy_card(spark, limits):
    limits(hotKeyRows=10, rowsPerRange=8)
    got = run(rows_of(spark, [("A", 77, float(i)) for i in range(50)]))
    assert [got[i]["uid_txn_1h"] for i in range(50)] == list(range(50))
    assert {got[i]["uid_txn_7d_strict"] for i in range(50)} == {0}
    assert got[49]["prior_mean"] == 47.0


def test_missing_amounts_are_skipped_in_both_paths(spark, limits):
    rows = [("A", i, None if i % 3 == 1 else float(i)) for i in range(30)]
    plain = run(rows_of(spark, rows))
    limits(hotKeyRows=5, rowsPerRange=7)
    ranged = run(rows_of(spark, rows))
    for i in plain:
        assert ranged[i]["prior_mean"] == pytest.approx(plain[i]["prior_mean"]) if i else ranged[i]["prior_mean"] is None
        assert ranged[i]["prior_std"] == pytest.approx(plain[i]["prior_std"])


def test_future_rows_change_nothing(spark, sf):
    df = fixtures.txn(spark, sf)
    cut = df.agg(F.percentile_approx("unix_time", 0.5)).first()[0]
    columns = ["trans_num", *history.COLUMNS]
    whole = history.with_history(df).where(F.col("unix_time") <= cut).select(*columns)
    part = history.with_history(df.where(F.col("unix_time") <= cut)).select(*columns)
    assert whole.exceptAll(part).count() == 0 and part.exceptAll(whole).count() == 0


def test_last_rows_per_card(spark):
    df = rows_of(spark, [("A", t, 1.0) for t in (5, 9, 7)] + [("B", 1, 1.0)])
    got = {(r["card_uid"], r["unix_time"], r["recency"]) for r in history.last_rows_per_card(df, 2).collect()}
    assert got == {("A", 9, 1), ("A", 7, 2), ("B", 1, 1)}
