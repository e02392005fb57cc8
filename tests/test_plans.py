"""Sources and sinks round trip, and the shape of physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from cardwatch import runtime
from cardwatch.operators import clean, history, split
from cardwatch.operators.running import hash_key
from cardwatch.plans import jobs
from cardwatch.plans.features import export_table
from cardwatch.sources import fixtures, readers, sinks


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_history_windows_share_one_shuffle_and_one_sort(spark, sf):
    plan = plan_of(history.with_history(fixtures.txn(spark, sf)))
    assert len(re.findall(r"Exchange hashpartitioning\(card_uid", plan)) == 1
    assert len(re.findall(r"\bSort \[", plan)) == 1


def test_holdout_needs_no_shuffle(spark, sf):
    plan = plan_of(fixtures.txn_split(spark, sf).select("trans_num", "split"))
    assert "Exchange" not in plan and "Join" not in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_last_rows_are_limited_before_the_shuffle(spark, sf):
    plan = plan_of(history.last_rows_per_card(fixtures.txn(spark, sf), 3))
    assert plan.count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark, sf, tmp_path):
    fixtures.txn(spark, sf).withColumn("trans_num", F.col("trans_num").cast("string")).write.parquet(str(tmp_path / "t"))
    df = readers.read_transactions(spark, str(tmp_path / "t")).where("amt > 100").select("amt", "category")
    plan = plan_of(df)
    assert "GreaterThan(amt,100.0)" in plan and "ReadSchema: struct<category:string,amt:double>" in plan


def test_lookup_join_broadcasts_only_counted_small_tables(spark):
    big, small = spark.range(100).withColumn("k", F.col("id") % 5), spark.range(5).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in plan_of(runtime.lookup_join(big, small, "k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan_of(runtime.lookup_join(big, small, "k", max_rows=4))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stratified_flag_moves_no_rows(spark, sf):
    plan = plan_of(split.stratified_flag(fixtures.txn(spark, sf), 0.1, "v"))
    assert "Exchange" not in plan and "Window" not in plan


def test_hash_is_stable(spark):
    assert spark.range(1).select(hash_key(F.lit("a"))).first()[0] == "0cc175b9c0f1b6a831c399e269772661"


def test_export_is_partitioned_by_split(spark, sf, tmp_path):
    features, _ = jobs.features_of(runtime.stored(fixtures.txn_split(spark, sf), "txn"))
    table = export_table(features)
    assert not {"card_uid", "cc_num", "trans_num", "merchant", "uid_txn_1h"} & set(table.columns)
    sinks.write_features(table, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == table.count()
    assert "PartitionFilters: [isnotnull(split" in plan_of(back.where("split = 'test'"))
    sinks.write_features(table, str(tmp_path / "c"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == table.count()


def test_csv_with_junk_columns(spark, sf, tmp_path):
    fixtures.txn_dirty(spark, sf).write.option("header", True).csv(str(tmp_path / "d"))
    raw = readers.read_csv(spark, str(tmp_path / "d"))
    kinds = dict(raw.dtypes)
    assert (kinds["amt"], kinds["cc_num"], kinds["zip"], kinds["unix_time"]) == ("double", "string", "string", "bigint")
    cleaned = clean.clean(raw)
    assert "6006" not in cleaned.columns and "nothing" not in cleaned.columns and "first" not in cleaned.columns
    assert cleaned.count() == fixtures.txn(spark, sf).count()


def test_prepare_job(spark, sf):
    rows = jobs.prepare(fixtures.txn_dirty(spark, sf))
    assert rows.count() == fixtures.txn(spark, sf).count()
    assert {r["split"] for r in rows.select("split").distinct().collect()} == {"train", "test"}


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())


def test_correlations_of_pairs_in_one_scan(spark, monkeypatch):
    """Many tasks and batches, nulls, constants, constants on a pair's rows, large offsets and columns without a value."""
    import numpy as np

    from cardwatch.operators import select

    monkeypatch.setattr(select, "FAN_IN", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        draw = np.random.default_rng(2)
        x = draw.normal(size=(400, 6))
        x[:, 1] = 1e9 + x[:, 0] + 0.1 * x[:, 1]
        x[:, 2] = 0.1
        x[draw.random((400, 6)) < 0.2] = np.nan
        x[:, 4] = np.where(np.isnan(x[:, 3]), x[:, 4], 7.7)
        x[:, 5] = np.nan
        names = list("abcdef")
        df = spark.createDataFrame([[None if v != v else float(v) for v in row] for row in x], ", ".join(f"{n} double" for n in names)).repartition(11)
        found = {(r["a"], r["b"]): r["r"] for r in select.correlation_matrix(df, names).collect()}
        assert len(found) == 15
        x[:, 1] -= 1e9
        for (a, b), r in found.items():
            both = x[~np.isnan(x[:, [names.index(a), names.index(b)]]).any(axis=1)][:, [names.index(a), names.index(b)]]
            steady = len(both) < 2 or (both == both[0]).all(axis=0).any()
            assert (r is None) == steady and (steady or abs(r - abs(np.corrcoef(both.T)[0, 1])) < 1e-9)
        assert {r["r"] for r in select.correlation_matrix(df.limit(0), names).collect()} == {None}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_distinct_rows_moves_only_digests(spark):
    from cardwatch.operators import clean

    rows = [(1, "a", 1.0), (2, "a", 1.0), (3, None, 1.0), (4, "", 1.0), (5, None, 1.0), (6, "b", None), (6, "b", None), (7, "b", 2.0), (7, "a", 1.0)]
    df = spark.createDataFrame(rows, "trans_num long, x string, y double")
    got = sorted(map(tuple, clean.distinct_rows(df).collect()), key=str)
    assert got == sorted([(1, "a", 1.0), (3, None, 1.0), (4, "", 1.0), (6, "b", None), (7, "b", 2.0)], key=str)
    assert clean.distinct_rows(df.limit(0)).count() == 0
