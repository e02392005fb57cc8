"""Attribution, ensemble, calibration, tuning and artefacts."""

import os
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cardwatch.learning import attribution, isotonic, models, tuning
from cardwatch.operators import clean
from cardwatch.plans import jobs
from cardwatch.runtime import stored
from cardwatch.schema import SELECTED_FEATURES
from cardwatch.sources import fixtures, sinks

FEATURES = ["amt", "hour", "distance_km", "age"]
QUICK = {"maxIter": 3, "numTrees": 3, "maxDepth": 3, "minInstancesPerNode": 5}


@pytest.fixture(scope="module")
def prepared(spark, sf):
    return jobs.features_of(stored(fixtures.txn_split(spark, sf), "txn"))


@pytest.fixture(scope="module")
def ensemble(prepared):
    train = clean.with_defaults(prepared[0].where("split = 'train'"), FEATURES)
    return models.Ensemble.fit(train, FEATURES, models.default_members(**QUICK))


def conditional(leaves, x, known):
    """Expected output when only the features in ``known`` are given."""
    total = 0.0
    for value, features, low, high, share in leaves:
        for f, lo, hi, s in zip(features, low, high, share):
            value = value * ((lo < x[f] <= hi) if f in known else s)
        total += value
    return total


def test_shapley_against_all_subsets(prepared, ensemble):
    leaves = attribution.tree_leaves(ensemble.members["model_a"].stages[-1])
    rows = prepared[0].select(*FEATURES).limit(6).toPandas().to_numpy(dtype=float)
    got, k = attribution.shapley(leaves, rows), len(FEATURES)
    for x, found in zip(rows, got):
        for i in range(k):
            others = [j for j in range(k) if j != i]
            want = sum(
                factorial(n) * factorial(k - n - 1) / factorial(k)
                * (conditional(leaves, x, {*s, i}) - conditional(leaves, x, set(s)))
                for n in range(k) for s in combinations(others, n))
            assert found[i] == pytest.approx(want, abs=1e-9)


def test_tables_are_made_once_for_all_batches_and_bounded(monkeypatch):
    made, plain = [], attribution.pattern_table
    monkeypatch.setattr(attribution, "pattern_table", lambda *a: made.append(1) or plain(*a))
    inf = np.inf
    leaves = [
        (0.5, [0, 2], np.array([-inf, 1.0]), np.array([2.0, inf]), np.array([0.25, 0.5])),
        (-1.5, [1], np.array([0.0]), np.array([3.0]), np.array([0.4])),
        (2.0, [], np.array([]), np.array([]), np.array([])),
    ]
    x = np.array([[1.0, 2.0, 3.0], [2.0, 0.0, 1.0], [np.nan, 4.0, inf], [5.0, np.nan, 0.0], [1.5, 3.0, 2.0]])
    want, tables = attribution.shapley(leaves, x), {}
    made.clear()
    for _ in range(3):
        assert np.array_equal(attribution.shapley(leaves, x, tables), want)
    assert len(made) == len(leaves)
    assert np.array_equal(attribution.shapley(leaves, x[:1], tables), want[:1])
    assert np.allclose(attribution.shapley(leaves, x[:1]), want[:1], atol=1e-12)  # too few rows for whole tables
    monkeypatch.setattr(attribution, "TABLE_CELLS", 8)
    small = {}
    assert np.array_equal(attribution.shapley(leaves, x, small), want) and set(small) == {0, 2}


@pytest.mark.parametrize("name", ["model_a", "model_b"])
def test_contributions_add_up_to_the_output(prepared, ensemble, name):
    stages = ensemble.members[name].stages
    rows = stages[0].transform(clean.with_defaults(prepared[0].where("split = 'test'"), FEATURES))
    out = F.col(f"{name}_raw") if name == "model_a" else F.col(f"{name}_prob")
    truth = stages[-1].transform(rows).select("trans_num", vector_to_array(out)[1].alias("out"))
    total = attribution.attribute(rows, stages[-1], FEATURES).groupBy("trans_num").agg(
        (F.sum("contribution") + F.first("base")).alias("total"))
    worst = total.join(truth, "trans_num").agg(F.max(F.abs(F.col("total") - F.col("out"))), F.count("*")).first()
    assert worst[0] < 1e-9 and worst[1] == rows.count()


def test_ensemble_is_the_mean_and_reloads(spark, prepared, ensemble, tmp_path):
    test = clean.with_defaults(prepared[0].where("split = 'test'"), FEATURES)
    scored = ensemble.score(test, keep=["trans_num"])
    gap = F.abs(F.col("ensemble") - (F.col("model_a") + F.col("model_b") + F.col("model_c")) / 3)
    assert scored.agg(F.max(gap)).first()[0] < 1e-12
    ensemble.save(str(tmp_path / "models"))
    loaded = models.Ensemble.load(str(tmp_path / "models"), list(ensemble.members), FEATURES)
    models.check_reload(spark, loaded)
    assert loaded.score(test, keep=["trans_num"]).exceptAll(scored).count() == 0


def test_mean_skips_absent_members(spark):
    df = spark.createDataFrame([(0.2, None, 0.4), (None, None, None)], "a double, b double, c double")
    got = [r[0] for r in df.select(models.mean_of_present([F.col(c) for c in "abc"])).collect()]
    assert got == [pytest.approx(0.3), None]


def test_answer_picks_or_falls_back(spark):
    rows = [("model_a", True, 0.96, 0.1, 0.5), ("nobody", False, 0.96, 0.1, 0.5), ("model_b", False, 0.96, None, 0.7)]
    df = spark.createDataFrame(rows, "model string, return_all boolean, model_a double, model_b double, ensemble double")
    a, b, c = models.answer(df, ["model_a", "model_b"]).collect()
    assert (a["model_used"], a["fraud_probability"], a["status"], a["model_a_score"]) == ("model_a", 0.96, "Fraud", 0.96)
    assert (b["model_used"], b["fraud_probability"], b["status"], b["model_a_score"]) == ("ensemble", 0.5, "Uncertain", None)
    assert (c["model_used"], c["fraud_probability"], c["status"]) == ("ensemble", 0.7, "Fraud")


def test_calibration_is_monotone(spark):
    rng = np.random.default_rng(1)
    rows = [(float(round(p, 2)), int(rng.random() < p * p)) for p in rng.random(500)]
    df = spark.createDataFrame(rows, "s double, is_fraud int")
    out = isotonic.calibrate(df, isotonic.fit_isotonic(df, "s"), "s", "c").orderBy("s").toPandas()
    assert out["c"].is_monotonic_increasing and out["c"].between(0, 1).all()


def test_search_scores_failures_as_zero_and_finds_the_best(spark, prepared):
    from cardwatch.operators.split import hash_fold

    matrix = models.training_matrix(
        hash_fold(clean.with_defaults(prepared[0].where("split = 'train'"), FEATURES)), FEATURES)
    good = tuning.search(matrix, "forest", 1, {"numTrees": (3, 3, False), "maxDepth": (3, 3, False)}, parallelism=3)
    bad = tuning.search(matrix, "forest", 1, {"maxDepth": (99, 99, False)})
    assert {r["metric"] for r in bad.collect()} == {0.0} and bad.where("error IS NULL").count() == 0
    trials = good.union(bad.withColumn("trial", F.lit(1)))
    best = tuning.best_trial(trials).first()
    assert (best["trial"], best["params"]) == (0, good.first()["params"]) and best["pr_auc"] > 0


def test_draws_are_seeded_and_in_range():
    assert tuning.draw(tuning.SEARCH_SPACE, 3) == tuning.draw(tuning.SEARCH_SPACE, 3)
    for trial in range(50):
        drawn = tuning.draw(tuning.SEARCH_SPACE, trial)
        for name, (low, high, _) in tuning.SEARCH_SPACE.items():
            assert low - 1e-3 <= float(drawn[name]) <= high + 1e-3


def test_selection_and_training_job(prepared, ensemble):
    train = prepared[0].where("split = 'train'")
    chosen = [r["feature"] for r in jobs.select_features(train, ensemble.members["model_a"], FEATURES, 200)
              .orderBy("rank").collect()]
    assert chosen and set(chosen) <= set(FEATURES)
    done = jobs.train_and_evaluate(prepared[0], chosen, models.default_members(**QUICK))
    names = {r["model"] for r in done.comparison.collect()}
    assert names == {"model_a", "model_b", "model_c", "ensemble", "model_a_cal"}


def test_artefacts(spark, prepared, tmp_path):
    root = str(tmp_path / "run")
    prepared[1].save(f"{root}/preprocessing")
    selected = spark.createDataFrame([(i + 1, f) for i, f in enumerate(SELECTED_FEATURES)], "rank int, feature string")
    sinks.write_selected(selected, f"{root}/selected")
    assert sinks.read_selected(spark, f"{root}/selected") == SELECTED_FEATURES
    metadata = sinks.run_metadata(spark, "v1", SELECTED_FEATURES, sinks.default_thresholds(["model_a"]), {"a": "b"})
    sinks.write_metadata(metadata, f"{root}/metadata")
    assert {tuple(r) for r in sinks.threshold_report(metadata).collect()} == {("ensemble", 0.5), ("model_a", 0.5)}
    found = sinks.manifest(spark, root, ["preprocessing", "selected", "metadata", "models"])
    assert sinks.missing_artefacts(found) == ["models"]
    assert found.where("present AND n_bytes > 0").count() == 3


def test_full_run(spark, sf, tmp_path):
    """Everything from messy rows to saved, reloaded and checked artefacts."""
    quick = {"maxDepth": (2, 3, False), "minInstancesPerNode": (5, 5, False)}
    done = jobs.full_run(
        fixtures.txn_dirty(spark, sf), str(tmp_path / "run"), trials=1,
        spaces={"boosted": {"maxIter": (2, 2, False), **quick}, "forest": {"numTrees": (2, 2, False), **quick}},
        base=models.attribution_base(maxIter=2, maxDepth=3, minInstancesPerNode=5))
    written = spark.read.json(str(tmp_path / "run" / "metadata")).first()
    assert written["n_features"] == len(sinks.read_selected(spark, str(tmp_path / "run" / "selected_features")))
    assert set(written["thresholds"].asDict()) == {"model_a", "model_b", "model_c", "ensemble"}
    table = spark.read.option("header", True).csv(str(tmp_path / "run" / "comparison"))
    assert table.count() == done.comparison.count() == 5


def pooled(points):
    """Pool-adjacent-violators over (score, label) pairs: score to fitted value."""
    blocks = []
    for score in sorted({s for s, _ in points}):
        own = [y for s, y in points if s == score]
        blocks.append([sum(own), len(own), [score]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            hits, n, scores = blocks.pop()
            blocks[-1] = [blocks[-1][0] + hits, blocks[-1][1] + n, blocks[-1][2] + scores]
    return {s: hits / n for hits, n, scores in blocks for s in scores}


@pytest.mark.parametrize("per_range, pools", [(1_000_000, 100_000), (7, 3)])
def test_isotonic_fit_by_ranges_equals_pooling(spark, limits, monkeypatch, per_range, pools):
    limits(rowsPerRange=per_range)
    monkeypatch.setattr(isotonic, "MERGED", 3)
    monkeypatch.setattr(isotonic, "POOLS", pools)
    draw = np.random.default_rng(3)
    scores = np.round(draw.normal(size=400), 2)
    labels = (draw.random(400) < 1 / (1 + np.exp(-2 * scores))).astype(int)
    rows = list(zip(scores.tolist(), labels.tolist()))
    df = spark.createDataFrame([*rows, (None, 1), (float("nan"), 1), (0.5, None)], "s double, is_fraud int")
    fitted = stored(isotonic.fit_isotonic(df, "s"), "pools")
    want, top = pooled(rows), max(scores)
    asked = spark.createDataFrame([(float(s),) for s in {*scores, -9.0, 9.0}] + [(None,), (float("nan"),)] * 2, "s double")
    got = [(r["s"], r["c"]) for r in isotonic.calibrate(asked, fitted, "s", "c").collect()]
    assert len(got) == asked.count() and sum(c is None for _, c in got) == 4
    for s, c in got:
        if s is not None and s == s:
            assert abs(c - want.get(s, want[min(scores)] if s < 0 else want[top])) < 1e-12
    edges = [(r["low"], r["high"], r["value"]) for r in fitted.orderBy("low").collect()]
    between = [(a[1] + b[0]) / 2 for a, b in zip(edges, edges[1:])]
    middle = isotonic.calibrate(spark.createDataFrame([(x,) for x in between], "s double"), fitted, "s", "c").orderBy("s").collect()
    assert np.allclose([r["c"] for r in middle], [(a[2] + b[2]) / 2 for a, b in zip(edges, edges[1:])])
    none = isotonic.fit_isotonic(df.limit(0), "s")
    assert none.count() == 0 and isotonic.calibrate(asked, none, "s", "c").where("c is not null").count() == 0


def test_a_lost_search_goes_on_where_it_stood(spark, monkeypatch):
    from cardwatch.runtime import fresh_path

    space, log, ran = {"numTrees": (2, 4, False), "maxDepth": (2, 3, False)}, fresh_path(spark, "trials"), []
    matrix = spark.range(3)
    score = lambda m, learner, fold: ran.append((learner.getNumTrees(), fold)) or 0.1 * learner.getNumTrees() + 0.01 * fold

    def lost(m, learner, fold):
        if len(ran) == 4:
            raise KeyboardInterrupt  # the driver goes; no fold catches it
        return score(m, learner, fold)

    monkeypatch.setattr(tuning, "fold_score", lost)
    with pytest.raises(KeyboardInterrupt):
        tuning.search(matrix, "forest", 3, space, log=log)
    assert len(ran) == 4 and tuning.logged(spark, log).count() == 4
    monkeypatch.setattr(tuning, "fold_score", score)
    found = tuning.search(matrix, "forest", 3, space, log=log, parallelism=3)
    assert len(ran) == 9 and sorted((r["trial"], r["fold"]) for r in found.collect()) == [(t, f) for t in range(3) for f in range(3)]
    again = tuning.search(matrix, "forest", 3, space, log=log)
    assert len(ran) == 9 and sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, found.collect()), key=str)
    assert tuning.search(matrix, "forest", 1, space, seed=7, log=log).count() == 3 and len(ran) == 12


def average_precision(y, margin):
    """Area under precision by recall, equal scores together."""
    found, hits, seen = 0.0, 0, 0
    for score in sorted(set(margin), reverse=True):
        own = [t for t, m in zip(y, margin) if m == score]
        hits, seen = hits + sum(own), seen + len(own)
        found += sum(own) * hits / seen
    return found / sum(y)


def test_trees_kept_by_average_precision_equal_refits(spark):
    """Every prefix of the trees is the model refitted with so many rounds; the best by average precision stays."""
    draw = np.random.default_rng(6)
    x = draw.normal(size=(600, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + draw.normal(size=600) > 1).astype(float)
    columns = [f"f{k}" for k in range(4)]
    df = spark.createDataFrame([(int(k), *map(float, r), float(t), 1.0, bool(k % 3 == 0)) for k, (r, t) in enumerate(zip(x, y))],
                               ["trans_num", *columns, "is_fraud", "w", "is_validation"])
    matrix = stored(models.assembler(columns).transform(df).select("trans_num", "features", "is_fraud", "w", "is_validation"), "matrix").coalesce(1)
    make = lambda n: models.boosted_trees("m", maxIter=n, maxDepth=3, minInstancesPerNode=5)
    train, apart = matrix.where("not is_validation"), matrix.where("is_validation")
    whole = make(6).fit(train)
    staged = models.staged_precision(whole, apart)
    want = []
    for n in range(1, 7):
        scored = make(n).fit(train).transform(apart).select("is_fraud", vector_to_array("m_raw")[1].alias("s")).collect()
        want.append(average_precision([r["is_fraud"] for r in scored], [round(r["s"], 12) for r in scored]))
    assert np.allclose(staged, want, atol=1e-9)
    kept = models.fit_member(matrix, make(6), patience=2)
    best = models.trees_to_keep([-a for a in want], 2)
    assert kept.getNumTrees == best
    short = models.first_trees(whole, 2)
    same = make(2).fit(train)
    scores = lambda m: [(r["s"], r["p"]) for r in m.transform(apart).orderBy("trans_num").select(
        vector_to_array("m_raw")[1].alias("s"), vector_to_array("m_prob")[1].alias("p")).collect()]
    assert short.getNumTrees == 2 and np.allclose(scores(short), scores(same))
    assert models.fit_member(matrix.withColumn("is_validation", F.lit(False)), make(3)).getNumTrees == 3


def test_margins_travel_in_blocks_and_ranges_change_nothing(spark, limits):
    """Rows of a batch with the same margin are one entry of a block; small ranges give the precisions of one range."""
    draw = np.random.default_rng(8)
    x = draw.integers(0, 6, size=(900, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] + draw.normal(size=900) > 7).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t), 1.0) for r, t in zip(x, y)], ["f0", "f1", "f2", "is_fraud", "w"])
    matrix = stored(models.assembler(["f0", "f1", "f2"]).transform(df).select("features", "is_fraud", "w"), "matrix").coalesce(1)
    model = models.boosted_trees("m", maxIter=5, maxDepth=3, minInstancesPerNode=5).fit(matrix)
    rows = matrix.collect()
    margins = models.margins(models.tree_tables(model), np.array([r["features"].toArray() for r in rows]))
    raw = [r["s"] for r in model.transform(matrix).select(vector_to_array("m_raw")[1].alias("s")).collect()]
    assert np.allclose(margins[-1], np.array(raw), atol=1e-9) or np.allclose(2 * margins[-1], np.array(raw), atol=1e-9)
    want = [average_precision([r["is_fraud"] for r in rows], list(m)) for m in margins]
    blocks = models.staged_blocks(model, matrix)
    assert blocks.count() == 5 and blocks.agg(F.sum("n")).first()[0] == 5 * 900  # not a row for every row and tree
    assert max(len(r["margins"]) // 8 for r in blocks.collect()) <= 6 ** 3
    assert np.allclose(models.staged_precision(model, matrix), want, atol=1e-12)
    limits(rowsPerRange=60)
    assert models.staged_blocks(model, matrix).select("part").distinct().count() > 5
    assert np.allclose(models.staged_precision(model, matrix), want, atol=1e-12)
    assert models.staged_precision(model, matrix.limit(0)) == []


def test_members_fitted_side_by_side_are_those_fitted_one_by_one(spark, monkeypatch):
    """Small matrices are fitted by several threads at once, larger ones by one; the models are the same."""
    import threading

    draw = np.random.default_rng(9)
    x = draw.normal(size=(400, 2))
    y = (x.sum(axis=1) + draw.normal(size=400) > 1).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t), 1.0, bool(k % 4 == 0)) for k, (r, t) in enumerate(zip(x, y))],
                               ["f0", "f1", "is_fraud", "w", "is_validation"])
    matrix = stored(models.assembler(["f0", "f1"]).transform(df).select("features", "is_fraud", "w", "is_validation"), "matrix")
    threads, plain = set(), models.fit_member
    monkeypatch.setattr(models, "fit_member", lambda *a: threads.add(threading.get_ident()) or plain(*a))
    learners = models.default_members(maxIter=3, numTrees=3, maxDepth=2, minInstancesPerNode=5)
    trees = lambda found: {n: m.toDebugString.split("\n", 1)[1] for n, m in found.items()}
    together = trees(models.fit_members(matrix, learners))
    assert list(together) == list(learners) and len(threads) == 3
    threads.clear()
    monkeypatch.setattr(models, "SIDE_BY_SIDE", 399)
    assert trees(models.fit_members(matrix, learners)) == together and threads == {threading.get_ident()}


def test_forests_keep_nodes_between_passes_and_grow_the_same_trees(spark):
    """Default and searched forests keep every row's node; the trees are those of a forest that walks from the roots."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * draw.normal(size=600) > 0).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t), 1.0 + float(t)) for r, t in zip(x, y)], ["f0", "f1", "f2", "is_fraud", "w"])
    matrix = stored(models.assembler(["f0", "f1", "f2"]).transform(df), "matrix")
    params = {"numTrees": 7, "maxDepth": 6, "minInstancesPerNode": 3}
    trees = lambda learner: learner.fit(matrix).toDebugString.split("\n", 1)[1]
    for learner in (models.random_forest("f"), models.default_members()["model_b"], models.random_forest("f", **tuning.draw(tuning.FOREST_SPACE, 0))):
        assert learner.getCacheNodeIds()
    assert trees(models.random_forest("f", **params)) == trees(models.random_forest("f", **params, cacheNodeIds=False))


def test_search_queries_run_every_trial_in_every_fold(spark, sf, monkeypatch):
    """As many trials as a whole run takes, over all train rows."""
    from cardwatch.plans import catalogue
    from cardwatch.schema import TUNING_TRIALS

    sizes, ran = set(), []

    def score(matrix, learner, fold):
        sizes.add(matrix)
        ran.append((learner.getNumTrees(), fold))
        return 0.5

    monkeypatch.setattr(tuning, "fold_score", score)
    monkeypatch.setattr(catalogue, "_RUNS", {})
    found = catalogue.QUERIES["tune_grid"](spark, sf).collect()
    assert sorted((r["trial"], r["fold"]) for r in found) == [(t, f) for t in range(TUNING_TRIALS) for f in range(3)]
    want = sorted((tuning.draw(tuning.FOREST_SPACE, t)["numTrees"], f) for t in range(TUNING_TRIALS) for f in range(3))
    assert sorted(ran) == want and len(sizes) == 1
    features, _ = catalogue._once(spark, sf, "features", None)
    assert sizes.pop().count() == features.where("split = 'train'").count()


def test_fitted_models_ask_for_their_trees_only_when_asked(spark):
    """Listing a model's parameters leaves its trees alone; they are there when asked for, and copies and scores work."""
    df = spark.createDataFrame([(float(k % 7), float(k % 5), float(k % 3 == 0), 1.0, k % 4 == 0) for k in range(80)],
                               ["f0", "f1", "is_fraud", "w", "is_validation"])
    matrix = stored(models.assembler(["f0", "f1"]).transform(df).select("features", "is_fraud", "w", "is_validation"), "matrix")
    for learner, n in ((models.random_forest("f", numTrees=4), 4), (models.boosted_trees("b", maxIter=3), 3)):
        model = learner.fit(matrix)
        scored = model.copy().transform(matrix).count()
        assert "trees" not in model.__dict__ and scored == 80
        assert model.getOrDefault("labelCol") == "is_fraud" and len(model.trees) == model.getNumTrees == n


def test_forests_above_the_limit_grow_in_batches_of_all_their_trees(spark, limits, tmp_path):
    """No fit holds more rows times trees than the limit; the joined forest has every tree, its parameters, and the mean of the trees' votes."""
    from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier

    df = spark.createDataFrame([(float(k % 7), float(k * k % 11), float(k % 3 == 0), 1.0) for k in range(90)], ["f0", "f1", "is_fraud", "w"])
    matrix = stored(models.assembler(["f0", "f1"]).transform(df).select("features", "is_fraud", "w"), "matrix")
    whole = models.random_forest("f", numTrees=10, maxDepth=3).fit(matrix)
    sizes, fit = [], RandomForestClassifier._fit_java

    def counted(self, dataset):
        sizes.append(self.getNumTrees())
        return fit(self, dataset)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(RandomForestClassifier, "_fit_java", counted)
        limits(treeRows=2 * 90 * 4)
        learner = models.random_forest("f", numTrees=10, maxDepth=3)
        learner.beside = 2
        model = learner.fit(matrix)
        assert sorted(sizes) == [3, 3, 4]
        limits(treeRows=1)
        assert models.random_forest("f", numTrees=3).fit(matrix).getNumTrees == 3 and sizes[3:] == [1, 1, 1]
    assert model.getNumTrees == len(model.trees) == model.getOrDefault("numTrees") == learner.getNumTrees() == 10
    assert len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) > 3
    for name in ("seed", "maxDepth", "labelCol", "probabilityCol", "weightCol", "cacheNodeIds"):
        assert model.getOrDefault(name) == whole.getOrDefault(name)
    rows = model.transform(matrix).select("features", "f_prob").distinct().collect()
    for row in rows[:5]:
        votes = [t.predictRaw(row["features"]).toArray() for t in model.trees]
        assert np.allclose(np.mean([v / v.sum() for v in votes], axis=0), row["f_prob"].toArray())
    model.write().save(f"{tmp_path}/forest")
    again = RandomForestClassificationModel.load(f"{tmp_path}/forest")
    assert again.getNumTrees == 10 and sorted(map(str, again.transform(matrix).select("f_prob").collect())) == sorted(
        map(str, model.transform(matrix).select("f_prob").collect()))


def test_a_fold_leaves_no_tables_behind(spark, monkeypatch):
    from cardwatch import runtime

    paths, fresh = [], runtime.fresh_path
    df = spark.createDataFrame([(float(k % 7), float(k % 3 == 0), 1.0, k % 2, k % 5 == 0) for k in range(80)], ["f0", "is_fraud", "w", "fold", "is_validation"])
    matrix = stored(models.assembler(["f0"]).transform(df).select("features", "is_fraud", "w", "fold", "is_validation"), "matrix")
    monkeypatch.setattr(runtime, "fresh_path", lambda *args: paths.append(fresh(*args)) or paths[-1])
    paths.clear()
    found = tuning.search(matrix, "forest", 1, {"numTrees": (2, 3, False)}, folds=2, parallelism=2).collect()
    assert [r["error"] for r in found] == [None, None] and len(paths) > 2
    assert not any(os.path.exists(p) for p in paths)
