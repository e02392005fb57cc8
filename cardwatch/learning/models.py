"""Weighted tree models, how many of their trees stay, and their mean."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cardwatch.operators.decide import add_tiers
from cardwatch.operators.split import early_stop_flag
from cardwatch.runtime import ROWS_PER_RANGE, at_most, fresh_path, lookup_join, own_context, setting, stored
from cardwatch.schema import ENSEMBLE, SEED, TARGET


#: trees without a better average precision after which boosting has ended (fixed value)
PATIENCE = 50
#: rows drawn for every range of margins
SAMPLED = 100
#: rows of a matrix up to which members are fitted side by side (three fits hold about 1.2 KB a row)
SIDE_BY_SIDE = 6_000_000
#: rows times trees of forests fitted at once: for each, Spark holds up to 16 bytes (draws, and nodes of three passes), on disk where memory ends
TREE_ROWS = 64_000_000


class _TreesOnDemand:
    """A fitted model lists its trees only when asked for them: else listing its parameters, as ``fit`` does, asks for all, several calls to the JVM a tree."""

    def _create_model(self, java_model):
        model = self.fitted.__new__(self.fitted)
        model.__dict__["trees"] = ()
        model.__init__(java_model)
        model.params  # noqa: B018 - kept by the model from here on
        del model.__dict__["trees"]
        return model


class BoostedTrees(_TreesOnDemand, GBTClassifier):
    fitted = GBTClassificationModel


class Forest(_TreesOnDemand, RandomForestClassifier):
    """Trees are grown in batches of equal size where rows times trees pass ``TREE_ROWS``, else every row carries numbers for all trees at once.

    Each batch has draws of its own, so the trees are others than in one batch, as many and drawn alike. ``beside``: fits that share the limit.
    """

    fitted, beside = RandomForestClassificationModel, 1

    def _fit_java(self, dataset: DataFrame):
        trees, seed = self.getNumTrees(), self.getSeed()
        at_once = setting(dataset.sparkSession, "treeRows", TREE_ROWS) // self.beside // max(dataset.count(), 1)
        batches = -(-trees // max(at_once, 1))
        if batches == 1:
            return super()._fit_java(dataset)
        grown = []
        for k in range(batches):
            own = random.Random(f"{seed}/{k}").getrandbits(63)
            size = (k + 1) * trees // batches - k * trees // batches
            grown.append(RandomForestClassifier._fit_java(self.copy({self.numTrees: size, self.seed: own}), dataset))
        self._transfer_params_to_java()
        return self._java_obj.copyValues(joined_forest(grown), self._empty_java_param_map())


def joined_forest(forests: list):
    """One forest (of the JVM) of the trees of several."""
    context = SparkContext._active_spark_context
    ends = np.cumsum([len(f.trees()) for f in forests]).tolist()
    ml = context._jvm.org.apache.spark.ml.classification
    trees = context._gateway.new_array(ml.DecisionTreeClassificationModel, ends[-1])
    for start, forest in zip([0, *ends], forests):
        own = forest.trees()
        context._jvm.java.lang.System.arraycopy(own, 0, trees, start, len(own))
    return ml.RandomForestClassificationModel(forests[0].uid(), trees, forests[0].numFeatures(), forests[0].numClasses())


def _named(learner, name: str):
    """Own output columns per member, so several members can score one table."""
    return (learner.setRawPredictionCol(f"{name}_raw").setProbabilityCol(f"{name}_prob")
            .setPredictionCol(f"{name}_label").setLabelCol(TARGET).setWeightCol("w"))


def boosted_trees(name: str, **params) -> GBTClassifier:
    chosen = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8,
              "featureSubsetStrategy": "0.8", "minInstancesPerNode": 50, "seed": SEED, **params}
    return _named(BoostedTrees(**chosen), name)


def random_forest(name: str, **params) -> RandomForestClassifier:
    """Every row's node in every tree is kept from pass to pass (a number a row and tree), else each pass walks all rows from the roots again; the trees are the same."""
    chosen = {"numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 10, "subsamplingRate": 0.8, "cacheNodeIds": True, "seed": SEED, **params}
    return _named(Forest(**chosen), name)


def attribution_base(**params) -> GBTClassifier:
    """The model whose contributions decide which features stay."""
    return boosted_trees("base", **{"maxIter": 300, **params})


def default_members(**params) -> dict[str, Estimator]:
    """Three different learners; ``params`` override a setting wherever the learner has it."""
    return {
        "model_a": boosted_trees("model_a", **{k: v for k, v in params.items() if k != "numTrees"}),
        "model_b": random_forest("model_b", **{k: v for k, v in params.items() if k not in ("maxIter", "stepSize")}),
        "model_c": boosted_trees("model_c", **{"maxDepth": 4, "stepSize": 0.1, "seed": SEED + 1,
                                               **{k: v for k, v in params.items() if k != "numTrees"}}),
    }


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def training_matrix(train: DataFrame, features: list[str]) -> DataFrame:
    """Vector, label, weight and validation flag, stored once because every learner reads it often."""
    counts = train.agg(F.count_if(F.col(TARGET) == 1).alias("p"), F.count_if(F.col(TARGET) == 0).alias("n")).first()
    weight = F.when(F.col(TARGET) == 1, F.lit(counts["n"] / max(counts["p"], 1))).otherwise(F.lit(1.0))
    flagged = early_stop_flag(train) if "is_validation" not in train.columns else train
    keep = [c for c in ("trans_num", "card_uid", "fold") if c in train.columns]
    return stored(assembler(features).transform(flagged.withColumn("w", weight)).select(
        *keep, "features", F.col(TARGET).cast("double").alias(TARGET), "w", "is_validation"), "matrix")


def fit_member(matrix: DataFrame, learner: Estimator, patience: int = PATIENCE):
    """Fit without the validation rows. Of a boosted model the first trees stay, as many as give the validation rows the best average precision."""
    model = learner.fit(matrix.where(~F.col("is_validation")))
    if not isinstance(model, GBTClassificationModel):
        return model
    found = staged_precision(model, matrix.where("is_validation"))
    if not any(found):  # nothing to judge by
        return model
    return first_trees(model, trees_to_keep([-x for x in found], patience))


def saved_nodes(model) -> dict[int, dict[int, dict]]:
    """Nodes by tree and number, from the model's own saved table; as many as the model has."""
    spark = SparkSession.active()
    path = fresh_path(spark, "model")
    model.save(path)
    nodes: dict[int, dict] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    return nodes


def tree_tables(model: GBTClassificationModel) -> list[tuple]:
    """Per tree its depth and by node: feature, limit, both children (a leaf's are itself) and weighted value."""
    tables, trees = saved_nodes(model), []
    for tree in sorted(tables):
        own = [tables[tree][k] for k in range(len(tables[tree]))]
        inner = np.array([n["leftChild"] >= 0 for n in own])
        left, right = (np.where(inner, [n[side] for n in own], np.arange(len(own))) for side in ("leftChild", "rightChild"))
        depth, level = 0, {0}
        while level := {c for k in level if inner[k] for c in (int(left[k]), int(right[k]))}:
            depth += 1
        trees.append((
            depth, np.array([max(n["split"]["featureIndex"], 0) for n in own]),
            np.array([(n["split"]["leftCategoriesOrThreshold"] or [0.0])[0] for n in own]),
            left, right, np.array([n["prediction"] for n in own]) * model.treeWeights[tree],
        ))
    return trees


def margins(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """Every row's margin under the first tree, the first two, and so on: trees by rows."""
    out, cells, starts = np.empty((len(trees), len(x))), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for k, (depth, feature, limit, left, right, value) in enumerate(trees):
        at = np.zeros(len(x), np.int64)
        for _ in range(depth):
            at = np.where(cells.take(starts + feature.take(at)) <= limit.take(at), left.take(at), right.take(at))
        out[k] = value.take(at)
    return np.cumsum(out, axis=0, out=out)


def staged_blocks(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """(trees, part, pos, n, margins, hits, counts): per batch, first trees and range of margins the distinct margins with their positives and rows.

    The ranges of each number of trees come from a sample of ``SAMPLED`` rows a range; it decides how evenly they fill and nothing else.
    """
    trees = tree_tables(model)
    narrow = rows.select(vector_to_array("features").alias("x"), F.coalesce(F.col(TARGET).cast("int"), F.lit(0)).alias("y"))
    n_rows, per_range = rows.count(), setting(rows.sparkSession, "rowsPerRange", ROWS_PER_RANGE)
    ranges, cuts = -(-n_rows // per_range), np.empty((len(trees), 0))
    if ranges > 1:
        drawn = narrow.select("x").sample(min(1.0, SAMPLED * ranges / n_rows), SEED).collect()
        if drawn:
            cuts = np.quantile(margins(trees, np.array([r["x"] for r in drawn], dtype=float)), np.arange(1, ranges) / ranges, axis=1).T
    at_once = max(1, 500_000 // len(trees))

    def blocks(batches):
        import pandas as pd

        for batch in batches:
            for start in range(0, len(batch), at_once):
                some = batch.iloc[start:start + at_once]
                found, hit = margins(trees, np.array(some["x"].tolist(), dtype=float).reshape(len(some), -1)), some["y"].to_numpy()
                made = []
                for k, own in enumerate(found):
                    values, at = np.unique(own, return_inverse=True)
                    counts, hits = np.bincount(at), np.bincount(at, weights=hit).astype(np.int64)
                    ends = [0, *np.searchsorted(values, cuts[k], side="right"), len(values)]
                    for part, (a, b) in enumerate(zip(ends, ends[1:])):
                        if a < b:
                            made.append((k + 1, part, int(hits[a:b].sum()), int(counts[a:b].sum()),
                                         values[a:b].tobytes(), hits[a:b].tobytes(), counts[a:b].tobytes()))
                yield pd.DataFrame(made, columns=["trees", "part", "pos", "n", "margins", "hits", "counts"])

    return narrow.mapInPandas(blocks, "trees int, part int, pos bigint, n bigint, margins binary, hits binary, counts binary")


def staged_precision(model: GBTClassificationModel, rows: DataFrame) -> list[float]:
    """Average precision under the first tree, the first two, and so on; empty without rows.

    Rows travel once, in blocks of distinct margins; a range of margins is ordered in one task, what lies above it comes from its totals.
    """
    kept = stored(staged_blocks(model, rows), "staged")
    above = W.partitionBy("trees").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    totals = stored(kept.groupBy("trees", "part").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).select(
        "trees", "part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"ahead_{c}") for c in ("pos", "n")],
        F.sum("pos").over(W.partitionBy("trees")).alias("n_pos")), "staged-totals")

    def area(rows):
        import pandas as pd

        joined = lambda c, kind: np.frombuffer(b"".join(rows[c]), kind)
        values, at = np.unique(joined("margins", np.float64), return_inverse=True)
        pos, n = (np.bincount(at, weights=joined(c, np.int64), minlength=len(values))[::-1] for c in ("hits", "counts"))
        first = rows.iloc[0]
        precision = (first["ahead_pos"] + np.cumsum(pos)) / (first["ahead_n"] + np.cumsum(n))
        return pd.DataFrame({"trees": [first["trees"]], "n_pos": [first["n_pos"]], "area": [float((pos * precision).sum())]})

    areas = lookup_join(kept.drop("pos", "n"), totals, ["trees", "part"], "inner").groupBy("trees", "part").applyInPandas(
        area, "trees int, n_pos bigint, area double")
    found = areas.groupBy("trees").agg(F.sum("area").alias("area"), F.first("n_pos").alias("n_pos")).collect()
    return [r["area"] / r["n_pos"] if r["n_pos"] else 0.0 for r in sorted(found, key=lambda r: r["trees"])]


def trees_to_keep(errors: list[float], patience: int) -> int:
    """Trees up to the lowest error seen before ``patience`` trees in a row bring no lower one; all without any error."""
    best = 0
    for at, error in enumerate(errors):
        if error < errors[best]:
            best = at
        elif at - best >= patience:
            break
    return best + 1 if errors and errors[best] == errors[best] else max(len(errors), 1)


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The boosted model cut to its first ``n`` trees, with the same columns: saved, cut as tables, and loaded again."""
    if n >= model.getNumTrees:
        return model
    spark = SparkSession.active()
    whole, short = fresh_path(spark, "model"), fresh_path(spark, "model")
    model.save(whole)
    spark.read.parquet(f"{whole}/data").where(F.col("treeID") < n).write.parquet(f"{short}/data")
    spark.read.parquet(f"{whole}/treesMetadata").where(F.col("_1") < n).write.parquet(f"{short}/treesMetadata")
    about = json.loads(spark.read.text(f"{whole}/metadata").first()[0]) | {"numTrees": n}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{short}/metadata")
    return GBTClassificationModel.load(short)


def fit_members(matrix: DataFrame, learners: dict[str, Estimator]) -> dict:
    """Fitted models by name. Up to ``SIDE_BY_SIDE`` rows are fitted side by side: a pass over few rows leaves cores idle; more rows one after the other, as each fit holds its own copy."""
    if len(learners) < 2 or not at_most(matrix, SIDE_BY_SIDE):
        return {n: fit_member(matrix, e) for n, e in learners.items()}
    with ThreadPool(len(learners)) as pool:
        one = inheritable_thread_target(matrix.sparkSession)(own_context(lambda learner: fit_member(matrix, learner)))
        return dict(zip(learners, pool.map(one, learners.values(), chunksize=1), strict=True))


@dataclass
class Ensemble:
    """Fitted members by name; names are the caller's choice."""

    features: list[str]
    members: dict[str, PipelineModel]

    @classmethod
    def fit(cls, train: DataFrame, features: list[str], learners: dict[str, Estimator]) -> Ensemble:
        matrix = training_matrix(train, features)
        fitted = {n: PipelineModel([assembler(features), m]) for n, m in fit_members(matrix, learners).items()}
        return cls(features, fitted)

    def score(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Add one probability column per member and the mean of those that are present."""
        keep = df.columns if keep is None else keep
        scored = assembler(self.features).transform(df)
        for model in self.members.values():
            scored = model.stages[-1].transform(scored)
        probabilities = {n: vector_to_array(F.col(f"{n}_prob"))[1] for n in self.members}
        return scored.select(*keep, *[p.alias(n) for n, p in probabilities.items()]).withColumn(
            ENSEMBLE, mean_of_present([F.col(n) for n in self.members]))

    def save(self, path: str) -> None:
        for name, model in self.members.items():
            model.write().overwrite().save(f"{path}/{name}")

    @classmethod
    def load(cls, path: str, names: list[str], features: list[str]) -> Ensemble:
        return cls(features, {n: PipelineModel.load(f"{path}/{n}") for n in names})


def mean_of_present(columns: list) -> F.Column:
    present = F.filter(F.array(*columns), lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(present) > 0, total / F.size(present))


def answer(scored: DataFrame, members: list[str], compat: bool = False) -> DataFrame:
    """Pick the asked-for model's score per row; an unknown or absent one falls back to the mean."""
    picked, used = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name in members:
        hit = (F.col("model") == name) & F.col(name).isNotNull()
        picked, used = F.when(hit, F.col(name)).otherwise(picked), F.when(hit, F.lit(name)).otherwise(used)
    chosen = scored.withColumns({
        "fraud_probability": F.coalesce(picked, F.col(ENSEMBLE)),
        "model_used": F.coalesce(used, F.lit(ENSEMBLE)),
        **{f"{n}_score": F.when(F.col("return_all"), F.col(n)) for n in members},
    })
    return add_tiers(chosen, compat)


def check_reload(spark: SparkSession, ensemble: Ensemble) -> None:
    """A zero row must give a two-class probability from every reloaded member."""
    zero = spark.createDataFrame([tuple(0.0 for _ in ensemble.features)], ensemble.features)
    for name, model in ensemble.members.items():
        probability = model.transform(zero).select(f"{name}_prob").first()[0]
        if len(probability) != 2:
            raise ValueError(f"{name} does not return two class probabilities")
