"""Connected components: union-find inside partitions, then smallest labels over what is left, all on Spark."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from cardwatch.runtime import stored

#: links aimed at in one union-find task
LINKS_PER_TASK = 500_000


def collapse(batches: Iterator) -> Iterator:
    """mapInPandas function: the links of one partition as (node, root), root the smallest node it reaches here."""
    import pandas as pd

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in list(parent)]
    yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"]).astype("int64")


def spread(links: DataFrame, tasks: int) -> DataFrame:
    """Links dealt to tasks by both ends, so that a hub's links are too; union-find inside a task is right on any of them."""
    return links.repartition(tasks, "a", "b") if tasks > 1 else links.coalesce(1)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b): label is the smallest node reachable.

    Links with a null end and of a node with itself link nothing; repeated links count once; without links there are no rows.
    Every round hooks a node and its label to the smallest label next to them and then jumps to the label's label; labels
    only fall, so the rounds end, after about the logarithm of the longest chain.
    """
    kept = links.where(F.col("a") != F.col("b")).select(F.col("a").cast("long"), F.col("b").cast("long"))
    total = kept.count()
    tasks = max(1, -(-total // LINKS_PER_TASK))
    stars = stored(spread(kept, tasks).mapInPandas(collapse, "a long, b long"), "links")
    both = stars.select("a", "b").union(stars.select(F.col("b"), F.col("a")))
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        .select("node", F.least("node", "b").alias("label")), "labels",
    )
    while True:
        old = labels
        near = (
            both.join(old.select(F.col("node").alias("b"), F.col("label").alias("found")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("found").alias("found"))
        )
        hooked = old.join(near, "node")
        offers = hooked.select("node", F.least("label", "found").alias("label")).union(
            hooked.where(F.col("found") < F.col("label")).select(F.col("label").alias("node"), F.col("found").alias("label"))
        )
        lowest = offers.groupBy("node").agg(F.min("label").alias("label"))
        ahead = lowest.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        labels = stored(
            lowest.join(ahead, "label").select("node", F.least("label", "jump").alias("label")), "labels"
        )
        moved = labels.join(old.withColumnRenamed("label", "was"), "node").where(F.col("label") != F.col("was"))
        if moved.isEmpty():
            return labels
