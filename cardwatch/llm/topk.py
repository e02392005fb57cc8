"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt to blocks by hash, queries to groups; every group meets every block once. In a block the candidates stand in one
sorted list per dimension. A query walks down the lists of its dimensions together (from the top where its component is positive, from
the bottom where it is negative), scores what it meets in full, and stops when the sum of its components times the values at the
current depth, which no unseen candidate can exceed, is below its k-th best score. Depths grow by doubling. The blocks' best k are
then ranked per query. Memory: one block and its lists; what is shuffled: queries times blocks plus candidates times groups.

Edges: vectors that are null or hold null, NaN or infinite components, and rows without an id, take no part; shorter vectors count
as having zeros; ties go to the smaller id; equal query rows are one query, candidates are all rows with another id, repeated ones each;
fewer than k candidates give fewer rows; an empty table gives none; only the id and vector columns are read. Scores are exact whatever the size of
the components: where products may pass 64 bits, a block is searched with Python's integers. A score beyond a long is cut to it after its
block has ranked it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardwatch.llm.common import table

SCALE = 256
#: candidates of a block, blocks wanted of small tables too, queries of a group, first depth
BLOCK, BLOCKS, GROUP, DEPTH = 100_000, 32, 20_000, 16


def whole_components(vector: Column) -> Column:
    """floor(256 x) of every component, as a double that holds it exactly, or null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(vector, lambda x: F.lit(float(SCALE)) * x.cast("double"))
    # a double of 2**52 or more is whole; floor() itself would cut it to a long
    put = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), put)


class Lists:
    """The candidates of a block with one list of rows per dimension, by rising value."""

    def __init__(self, ids, values):
        import numpy as np

        self.ids, self.values, self.largest = ids, values, float(np.abs(values).max(initial=0))
        self.exact = values.astype(np.int64) if self.largest < 1 << 62 else None
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()  # (dimensions, rows)
        self.sorted = np.take_along_axis(values, self.order.T, axis=0).T.copy()

    def best(self, query_id: int, query, k: int):
        """(id, score) of the k best candidates with another id, by falling score and rising id."""
        import numpy as np

        if self.largest * float(np.abs(query).max(initial=0)) * len(query) >= 1 << 62 or self.exact is None:
            return self.best_of_large(query_id, query, k)
        query = query.astype(np.int64)
        rows, used = len(self.ids), np.flatnonzero(query)
        weight = query[used]
        down = weight > 0
        seen = self.ids == query_id
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, depth = 0, DEPTH
        while start < rows and len(used):
            stop = min(depth, rows)
            met = np.concatenate([
                self.order[used[down], rows - stop:rows - start].ravel(), self.order[used[~down], start:stop].ravel()
            ])
            fresh = np.zeros(rows, bool)
            fresh[met] = True
            fresh &= ~seen
            new = np.flatnonzero(fresh)
            seen |= fresh
            found, scores = np.concatenate([found, new]), np.concatenate([scores, self.exact[new] @ query])
            if len(found) > k:  # all that ties with the k-th stays
                stay = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                found, scores = found[stay], scores[stay]
            at = np.where(down, rows - stop, stop - 1)
            if len(found) >= k and int((weight * self.sorted[used, at].astype(np.int64)).sum()) < int(scores.min()):
                break
            start, depth = stop, depth * 2
        if not len(used):  # a query of zeros scores 0 everywhere
            found = np.flatnonzero(~seen)
            scores = np.zeros(len(found), np.int64)
        order = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found][order].tolist(), scores[order].tolist()


    def best_of_large(self, query_id: int, query, k: int):
        """``best`` with integers of any size."""
        import heapq

        import numpy as np

        rows, used = len(self.ids), np.flatnonzero(query).tolist()
        weight = [int(query[d]) for d in used]
        score = lambda row: sum(w * int(self.values[row, d]) for w, d in zip(weight, used, strict=True))
        own = [r for r in range(rows) if self.ids[r] == query_id]
        met, best, start, depth = set(own), [], 0, DEPTH
        while start < rows and used:
            stop, new = min(depth, rows), set()
            for w, d in zip(weight, used, strict=True):
                new.update((self.order[d, rows - stop:rows - start] if w > 0 else self.order[d, start:stop]).tolist())
            new -= met
            met |= new
            best = heapq.nsmallest(k, [*best, *((-score(r), int(self.ids[r])) for r in new)])
            bound = sum(w * int(self.sorted[d, rows - stop if w > 0 else stop - 1]) for w, d in zip(weight, used, strict=True))
            if len(best) == k and bound < -best[-1][0]:
                break
            start, depth = stop, depth * 2
        if not used:
            best = heapq.nsmallest(k, [(0, int(i)) for i in self.ids if i != query_id])
        longest = (1 << 63) - 1
        return [i for _, i in best], [max(-longest, min(longest, -s)) for s, _ in best]


def searcher(k: int):
    """mapInPandas function over rows sorted by cell, candidates first: (query_id, vec_id, score)."""

    def search(batches):
        import numpy as np
        import pandas as pd

        cell, ids, vectors, lists = None, [], [], None
        for batch in batches:
            rows = []
            for key, query, vec_id, vector in zip(
                batch["cell"].tolist(), batch["query"].tolist(), batch["vec_id"].tolist(), batch["vector"], strict=True
            ):
                if key != cell:
                    cell, ids, vectors, lists = key, [], [], None
                if not query:
                    ids.append(vec_id)
                    vectors.append(vector)
                    continue
                if not ids:
                    continue
                if lists is None:
                    values = np.zeros((len(ids), max(map(len, vectors))))
                    for row, own in enumerate(vectors):
                        values[row, :len(own)] = own
                    lists, vectors = Lists(np.array(ids, np.int64), values), []
                own = np.zeros(lists.values.shape[1])
                own[:len(vector)] = vector[:len(own)]
                rows += [(vec_id, i, s) for i, s in zip(*lists.best(vec_id, own, k), strict=True)]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return search


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int) -> DataFrame:
    """query_id, rank, vec_id, score; both tables hold vec_id and vector (array of whole numbers as double)."""
    vectors, queries = (x.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()) for x in (vectors, queries))
    queries = queries.dropDuplicates(["vec_id", "vector"])
    n, asked = vectors.count(), queries.count()
    blocks = max(1, -(-n // BLOCK), min(BLOCKS, n // 1000))
    groups = max(1, -(-asked // GROUP))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    place = lambda count: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(count)).cast("int")
    columns = ["block", "group", "query", "vec_id", "vector"]
    rows = vectors.select(place(blocks).alias("block"), every(groups).alias("group"), F.lit(False).alias("query"), "vec_id", "vector")
    asks = queries.select(every(blocks).alias("block"), place(groups).alias("group"), F.lit(True).alias("query"), "vec_id", "vector")
    cells = rows.select(columns).union(asks.select(columns)).withColumn("cell", F.col("block") * F.lit(groups).cast("long") + F.col("group"))
    ordered = cells.repartition(min(blocks * groups, 10_000), "cell").sortWithinPartitions("cell", "query")
    found = ordered.select("cell", "query", "vec_id", "vector").mapInPandas(searcher(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whole_components(F.col("embedding")).alias("vector"))
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


OP4_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.c, v.c)::BIGINT AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
