"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets: every source aims at its weight's share of the budget but at no more than ``max_epochs`` times its own size; what is
above goes to the others by weight until none is above. Repetitions: a source whose target is 1.6 times its size takes every
document once and, by seeded hash, documents holding 0.6 of its words once more. Documents are dealt to ``BUCKETS`` hash buckets
per source; buckets below the cut are taken whole and the bucket in which the target falls is taken in part. Only sums per
(source, bucket) are shuffled, so a source holding most rows costs no more than a small one.

Edges: null or empty text has size 0 and is never cut; a null source is a source of its own; a null key is hashed like a value of
its own; equal rows get equal shares; an empty table gives an empty plan; a source without a weight (or below 0) gets target 0; a
column of the input named like an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardwatch.llm.common import WORD, n_words, table
from cardwatch.runtime import lookup_join, stored

BUCKETS = 1024


def targets(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): the water-filled level times weight, at most the cap.

    The level is refined by one-row aggregates; the table of sources itself never leaves the cluster. Every round but the last
    clamps at least one more source, so the rounds end.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    exact = weight.cast("decimal(28,9)")
    level: float | None = 0.0
    while True:
        free = cap > weight * F.lit(level)
        row = sources.agg(
            F.sum(F.when(~free, cap).otherwise(F.lit(0.0)).cast("decimal(28,3)")).cast("double").alias("held"),
            F.sum(F.when(free, exact)).cast("double").alias("weights"),
        ).first()
        if not row["weights"]:
            level = None
            break
        raised = (budget - (row["held"] or 0.0)) / row["weights"]
        if raised <= level:
            break
        level = raised
    filled = cap if level is None else F.least(cap, weight * F.lit(level))
    return sources.withColumn("target", F.when(weight > 0, filled).otherwise(F.lit(0.0)))


def hashed(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def hex_number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def plan(docs: DataFrame, weights: DataFrame, budget: float, *, max_epochs: float, seed: int, source: str = "source",
         key: str = "doc_id") -> DataFrame:
    """One row per source: source, weight, source_size, target, whole, cut, part.

    ``docs`` needs ``size``. ``whole`` repetitions go to every document, one more to buckets below ``cut``, and ``part`` of one
    more to the bucket ``cut`` itself.
    """
    bucket = (hex_number(hashed(F.col(key), seed), 1, 4) % BUCKETS).alias("bucket")
    dealt = stored(
        docs.groupBy(F.col(source).alias("source"), bucket).agg(F.sum("size").alias("size")), "mix-buckets"
    )
    sizes = dealt.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = weights.select(F.col("source").alias("__of"), "weight")
    sources = stored(sizes.join(named, F.col("source").eqNullSafe(F.col("__of")), "left").drop("__of"), "mix-sources")
    filled = targets(sources, budget, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(epochs + F.lit(1e-9))
    filled = filled.withColumn("whole", whole).withColumn(
        "extra", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    )
    before = F.sum("size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    running = dealt.withColumn("before", F.coalesce(before, F.lit(0)))
    crossing = (
        running.withColumnRenamed("source", "__of")
        .join(filled.select("source", "extra"), F.col("source").eqNullSafe(F.col("__of")))
        .where((F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("before") + F.col("size")))
        .select("__of", F.col("bucket").alias("cut"), ((F.col("extra") - F.col("before")) / F.col("size")).alias("part"))
    )
    done = filled.join(crossing, F.col("source").eqNullSafe(F.col("__of")), "left").select(
        "source", "weight", "source_size", "target", "whole",
        F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("part", F.lit(0.0)).alias("part"),
    )
    return stored(done, "mix-plan")


def shares(docs: DataFrame, planned: DataFrame, *, seed: int, source: str = "source", key: str = "doc_id",
           cut_documents: bool = True) -> DataFrame:
    """``docs`` (with ``size``) plus source_size, target, epochs (whole repetitions) and part_words (of one more).

    ``cut_documents`` gives each document of the crossing bucket a part of its words; otherwise such a document is taken
    whole once more with that probability.
    """
    digest = hashed(F.col(key), seed)
    bucket = hex_number(digest, 1, 4) % BUCKETS
    chance = hex_number(digest, 9, 8) / F.lit(float(1 << 32))
    known = planned.select(F.col("source").alias("__of"), "source_size", "target", "whole", "cut", "part")
    clash = [c for c in ("source_size", "target", "epochs", "part_words", "whole", "cut", "part") if c in docs.columns]
    # <=> is a hash join key in Spark, and the plan has one row per source
    flagged = docs.drop(*clash).withColumn("__source", F.col(source))
    joined = lookup_join(
        flagged.withColumn("__key", F.struct(F.col("__source"))), known.withColumn("__key", F.struct(F.col("__of"))), "__key"
    ).drop("__key")
    once = F.when(bucket < F.col("cut"), F.lit(1)).otherwise(F.lit(0))
    inside = bucket == F.col("cut")
    if cut_documents:
        words = F.when(inside, F.floor(F.col("size") * F.col("part") + chance)).otherwise(F.lit(0))
        epochs = F.col("whole") + once
    else:
        words = F.lit(0)
        epochs = F.col("whole") + F.when(inside & (chance < F.col("part")), F.lit(1)).otherwise(once)
    return (
        joined.withColumn("epochs", epochs.cast("long")).withColumn("part_words", words.cast("long"))
        .drop("__source", "__of", "whole", "cut", "part")
    )


def materialize(shared: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: one row per repetition, numbered ``copy`` from 0; a part is the text up to its last word taken."""

    def cut(batches):
        import itertools
        import re

        import pyarrow as pa

        word = re.compile(WORD)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            taken = zip(batch.column(at).to_pylist(), batch.column("part_words").to_pylist(), strict=True)
            heads = [t[:next(itertools.islice(word.finditer(t), n - 1, None)).end()] for t, n in taken]
            yield batch.set_column(at, batch.schema.field(at), pa.array(heads, batch.schema.field(at).type))

    clear = shared.drop("copy")
    whole = clear.where(F.col("epochs") > 0).withColumn("copy", F.explode(F.expr("sequence(0L, epochs - 1)")))
    parts = clear.where(F.col("part_words") > 0).withColumn("copy", F.col("epochs"))
    return whole.unionByName(parts.mapInArrow(cut, parts.schema)).drop("epochs", "part_words")


def code_point_weights(docs: DataFrame, cycle: tuple[float, ...], source: str = "source") -> DataFrame:
    """Weights by turn: sources in code point order, null last, take ``cycle`` again and again."""
    names = docs.select(F.col(source).alias("source")).distinct()
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return names.select("source", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")).alias("weight"))


def by_code_points(sizes: DataFrame, *, cycle: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
                   max_epochs: float = 2.0, seed: int = 42) -> DataFrame:
    """The plan for sizes (doc_id, source, size) with code-point weights and a budget of ``share`` of all sizes."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return plan(sizes, code_point_weights(sizes, cycle), share * total, max_epochs=max_epochs, seed=seed)


def repeated(shared: DataFrame) -> DataFrame:
    """The mix of whole documents: a row per repetition."""
    return shared.withColumn("copy", F.explode(F.expr("IF(epochs > 0, sequence(1L, epochs), array())"))).drop(
        "copy", "epochs", "part_words"
    )


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    taken = F.col("epochs") * F.col("size") + F.col("part_words")
    return shares(sized, by_code_points(sized), seed=42).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
b AS (SELECT *, ('0x' || substr(h, 1, 4))::BIGINT % 1024 AS bucket, ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE AS chance
      FROM d),
s AS (SELECT source, sum(size)::BIGINT AS size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
      FROM b GROUP BY source),
level AS (
    SELECT 0 AS k, 0.0::DOUBLE AS lam
    UNION ALL
    SELECT k + 1, (SELECT CASE WHEN sum(CASE WHEN cap > w * lam THEN w END) IS NULL THEN lam ELSE greatest(lam,
        (1.5::DOUBLE * sum(size)::DOUBLE - sum(CASE WHEN cap > w * lam THEN 0 ELSE cap END)) / sum(CASE WHEN cap > w * lam THEN w END)) END FROM s)
    FROM level WHERE k < 60),
t AS (SELECT source, size AS source_size, least(cap, w * (SELECT max(lam) FROM level)) AS target FROM s),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS whole FROM t),
x AS (SELECT *, greatest(target - whole * source_size, 0) AS extra FROM e),
g AS (SELECT source, bucket, sum(size) AS size FROM b GROUP BY ALL),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
      FROM g),
c AS (SELECT x.source, r.bucket AS cut, (x.extra - r.bef::DOUBLE) / r.size::DOUBLE AS part
      FROM x JOIN r ON x.source IS NOT DISTINCT FROM r.source WHERE r.bef <= x.extra AND x.extra < r.bef + r.size)
SELECT b.doc_id, b.source, b.size, x.source_size, x.target,
       (b.size * (x.whole + CASE WHEN b.bucket < coalesce(c.cut, 0) THEN 1 ELSE 0 END)
        + CASE WHEN b.bucket = coalesce(c.cut, 0) THEN floor(b.size * coalesce(c.part, 0) + b.chance) ELSE 0 END)::BIGINT AS taken
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source LEFT JOIN c ON b.source IS NOT DISTINCT FROM c.source
"""
