"""The corpus pipeline: quality, language, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. Models are learned anew from the rows a stage gets
(quality labels come from the ``labels`` table), never from rows another stage dropped.

Edges: null ids and texts pass as the operators say: a text without a letter goes at the language stage, rows with a null id are no
near-duplicates of others; extra columns stay up to mixing; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardwatch.llm import language, mixing, neardup, packing, quality
from cardwatch.llm.common import n_words, table
from cardwatch.runtime import stored

SEED = 42
#: learned rows per label
LEARN_ROWS = 3000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose line field scores at least the threshold of good quality."""
    model = quality.learn(docs, quality.allowed(table(spark, sf_dir, "labels")), learn_rows=LEARN_ROWS, seed=SEED)
    return quality.good_ones(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without a letter or between languages go."""
    model = language.learn(docs.select("doc_id", "text", "lang"), learn_rows=LEARN_ROWS, seed=SEED)
    return language.known_ones(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at 5, 2 and 1 by turn, 150% of all words, at most two epochs; a row per repetition, of whole documents."""
    whole = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    sizes = stored(whole.drop("row"), "pipeline-sizes")
    planned = mixing.by_code_points(sizes, seed=SEED)
    shared = mixing.shares(whole, planned, seed=SEED, cut_documents=False)
    return mixing.repeated(shared).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids along the curve."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage), ("language", language_stage), ("near_duplicates", dedup_stage), ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: the stages learn models, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
