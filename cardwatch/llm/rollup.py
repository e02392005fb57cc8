"""Token counts as delta-maintained rollups.

Totals of documents and tokens by source, language and tokenizer version are sums of signed changes: an insert adds, a delete
subtracts, a revised count does both. A batch of changes is summed by key and written once to a folder named by its batch id, so
committing a batch again changes nothing, whether it was written before, in part, or by a run that died: a folder counts only with its
success mark, and a batch without one is overwritten. ``fold`` sums committed batches into one and remembers their ids.

Edges: null source, language or tokenizer are keys of their own; null text has 0 tokens; changes that cancel leave a row of zeros
that ``totals`` drops; repeated rows count as often as they occur; an empty batch commits and changes nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardwatch.llm.common import ByteBpe, n_words, table
from cardwatch.llm.packing import chunks, tokenizer_file
from cardwatch.runtime import fresh_path, lookup_join, stored

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["documents", "tokens"]
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


class Rollup:
    """Totals in a folder every executor reaches: one sub-folder of summed changes per batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def folder(self, batch: str) -> str:
        return f"{self.path}/batches/{hashlib.sha256(batch.encode()).hexdigest()[:32]}"

    def exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def committed(self, batch: str) -> bool:
        return self.exists(f"{self.folder(batch)}/_SUCCESS") or batch in self.folded()

    def folded(self) -> set[str]:
        """Ids of the batches in the base."""
        if not self.exists(f"{self.path}/base/_SUCCESS"):
            return set()
        return {r[0] for r in self.spark.read.text(f"{self.path}/base-ids").collect()}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add signed changes (KEYS, SUMS) under a batch id; False if that batch is in already."""
        if self.committed(batch):
            return False
        summed = changes.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
        summed.write.mode("overwrite").parquet(self.folder(batch))
        return True

    def totals(self, batches: Iterable[str]) -> DataFrame:
        """Totals over the base and the named batches that are committed."""
        inside = self.folded()
        paths = [self.folder(b) for b in sorted(set(batches) - inside) if self.committed(b)]
        if inside:
            paths.append(f"{self.path}/base")
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        summed = rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
        return summed.where((F.col("documents") != 0) | (F.col("tokens") != 0))

    def fold(self, batches: Iterable[str], into: str) -> Rollup:
        """A new rollup at ``into`` whose base holds all committed batches; the ids still count as committed there."""
        ids = sorted({b for b in batches if self.committed(b)} | self.folded())
        other = Rollup(self.spark, into)
        self.spark.createDataFrame([(b,) for b in ids], "value string").coalesce(1).write.mode("overwrite").text(f"{other.path}/base-ids")
        self.totals(ids).write.mode("overwrite").parquet(f"{other.path}/base")
        return other


def inserted(counts: DataFrame) -> DataFrame:
    """Changes that add documents: counts holds KEYS and tokens, one row per document and tokenizer."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("documents"), F.col("tokens").cast("long").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Changes that take documents away, with the counts they came with."""
    return inserted(counts).select(*KEYS, *[F.negative(c).alias(c) for c in SUMS])


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes from old to new counts of the same documents; either may also move to another key."""
    return deleted(before).union(inserted(after))


def bpe_counts(tokenizer_json: str, columns: list[str]):
    """mapInPandas function: token counts of text columns, as columns of the same names; null text stays null."""

    def count(batches):
        import pandas as pd

        bpe = ByteBpe(tokenizer_json, added=True)
        width = bpe.kind.itemsize
        for batch in batches:
            out = batch.copy()
            for c in columns:
                sizes = []
                for _, part in chunks(batch[c].fillna("").tolist()):
                    sizes += [len(x) // width for x in bpe.encode(part)]
                out[c] = pd.Series(sizes, index=batch.index, dtype="Int64").where(batch[c].notna())
            yield out

    return count


def op7_rollup(spark, sf_dir: str) -> DataFrame:
    """Three batches over all documents: all are inserted; exact copies, but for the smallest id, are deleted; of the others, those
    with repeated lines are revised to the text without them. The second batch is committed twice, as after a lost answer."""
    docs = table(spark, sf_dir, "documents")
    once = F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n")
    texts = docs.select(
        "doc_id", "source", "lang", F.sha2("text", 256).alias("digest"), F.col("text").alias("old"),
        F.when(once != F.col("text"), once).alias("new"),
    )
    names = ["doc_id", "source", "lang", "digest"]
    sized = texts.withColumn("words_old", n_words(F.col("old"))).withColumn(
        "words_new", F.when(F.col("new").isNotNull(), n_words(F.col("new")))
    )
    kinds = "source string, lang string, digest string, old long, new long, words_old long, words_new long"
    named = sized.select(F.col("doc_id").cast("string").alias("doc_id"), *names[1:], "old", "new", "words_old", "words_new")
    counted = stored(named.mapInPandas(bpe_counts(tokenizer_file(), ["old", "new"]), f"doc_id string, {kinds}"), "rollup-counts")
    counted = counted.withColumn("doc_id", F.col("doc_id").cast("long"))
    copies = counted.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = stored(lookup_join(counted, stored(copies, "rollup-copies"), "digest").withColumn(
        "copy", F.coalesce(F.col("doc_id") != F.col("first"), F.lit(False))
    ), "rollup-marked")

    def by_tokenizer(rows: DataFrame, which: str) -> DataFrame:
        versions = F.map_from_arrays(
            F.array(F.lit("words-1"), F.lit("byte-bpe-50k-1")),
            F.array(F.coalesce(f"words_{which}", F.lit(0)), F.coalesce(F.col(which), F.lit(0))),
        )
        return rows.select("source", "lang", F.explode(versions).alias("tokenizer", "tokens"))

    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    gone, changed = marked.where("copy"), marked.where(~F.col("copy") & F.col("new").isNotNull())
    rollup.commit("load", inserted(by_tokenizer(marked, "old")))
    for _ in range(2):
        rollup.commit("copies", deleted(by_tokenizer(gone, "old")))
    rollup.commit("lines", revised(by_tokenizer(changed, "old"), by_tokenizer(changed, "new")))
    return rollup.totals(["load", "copies", "lines"])
