"""Merkle manifest of a table: one tree per group, their roots under one root, and a proof for every row.

1. Every row gives its leaf, the hash of its fields written with their lengths. Only ids, groups and digests go further.
2. Leaves are range-sorted by (group, key) and written. A row's place in its group is its place in its range plus the rows of the group in
   earlier ranges; the table of these starts has one row per range and group. Equal rows are told apart by a number, so no range is hot.
3. Slot pivot, level by level: conditional aggregates by (group, place / fanout) spread a parent's children into ``fanout`` columns; the
   columns concatenated hash it. A group that has one node left has its root. The roots, ordered by group, are the leaves of a last tree.
4. From the top down, a parent's columns without the own one are a child's siblings, put before the parent's own proof; levels are joined
   by (group, place). The leaves' payload rides in the lowest level's columns, so the widest join has rows / fanout rows.

What is shuffled: digests of 1 + 1/fanout + ... of the rows upwards, proofs of as many parents downwards; the driver gets one count and
the root. Levels are written tables, so lost executors repeat one level.

Edges: a null field is ``-``; null groups are a group, before all others, and apart from the empty string; rows with a null key stand
before others, those with equal keys in the order of their leaves; repeated rows are leaves each; a group of one row has its leaf as root, a table
of one row as the root of all; an empty table gives no rows; only the named fields are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardwatch.llm.common import table
from cardwatch.runtime import lookup_join, stored

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: bits that monotonically_increasing_id() leaves to the place in a partition
PLACE_BITS = 33


def sha256(*parts: Column) -> Column:
    """Lower-case hex digest of the parts, null parts left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, *, key: str, group: str, fields: tuple[str, ...], changed: dict[str, Column], where: Column) -> DataFrame:
    """tree (the group as an ordered string), node (digest, id, other) and a number of its own for every row.

    ``other`` is the leaf with the ``changed`` fields, for rows ``where`` holds; null in the others.
    """
    own = sha256(*[field(F.col(f)) for f in fields])
    other = F.when(where, sha256(*[field(changed.get(f, F.col(f))) for f in fields]))
    return docs.select(
        F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit("")).alias("tree"), F.col(key).alias("place"),
        F.struct(own.alias("digest"), F.col(key).alias("id"), other.alias("other")).alias("node"),
        F.monotonically_increasing_id().alias("number"),
    )


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """tree, at (place in the tree, from 0), size (rows of the tree), node."""
    by = ["tree", *order]
    ranged = stored(
        nodes.repartitionByRange(*by).sortWithinPartitions(*by).select("tree", "node", F.monotonically_increasing_id().alias("row")),
        "merkle-ordered",
    ).withColumn("range", F.shiftright("row", PLACE_BITS))
    runs = stored(ranged.groupBy("tree", "range").agg(F.min("row").alias("first"), F.count("*").alias("n")), "merkle-runs")
    tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stored(runs.select("tree", "range", "first", before.alias("before"), F.sum("n").over(tree).alias("size")), "merkle-starts")
    return lookup_join(ranged, starts, ["tree", "range"], "inner").select(
        "tree", (F.col("before") + F.col("row") - F.col("first")).alias("at"), "size", "node"
    )


def slots() -> list[Column]:
    return [F.col(f"slot{s}") for s in range(FANOUT)]


def risen(nodes: DataFrame) -> DataFrame:
    """The parents of nodes in trees of several: tree, at, size (of their level), node, slot0 to the last."""
    own = F.col("at") % FANOUT
    spread = [F.max(F.when(own == s, F.col("node"))).alias(f"slot{s}") for s in range(FANOUT)]
    parents = nodes.where(F.col("size") > 1).groupBy("tree", F.expr(f"at div {FANOUT}").alias("at")).agg(
        F.ceil(F.max("size") / FANOUT).cast("long").alias("size"), *spread
    )
    digest = sha256(*[s["digest"] for s in slots()])
    nothing = lambda f: F.lit(None).cast(parents.schema["slot0"].dataType[f].dataType).alias(f)
    return parents.withColumn("node", F.struct(digest.alias("digest"), nothing("id"), nothing("other")))


def grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All levels above the nodes, and the tops: tree, height, node."""
    levels, widest = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while widest > 1:
        levels.append(stored(risen(levels[-1]), f"merkle-level{len(levels)}"))
        widest = -(-widest // FANOUT)
    tops = [x.where(F.col("size") == 1).select("tree", F.lit(h).alias("height"), "node") for h, x in enumerate(levels)]
    every = tops[0]
    for top in tops[1:]:
        every = every.union(top)
    return levels, every


def proofs(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tree, node, root, path of every node of the lowest level; tops: tree, height, root, path of every tree.

    A path holds what stands left and right of a node among its siblings, from its own level to the top.
    """

    def at_height(h: int) -> DataFrame:
        return tops.where(F.col("height") == h).select("tree", F.lit(0).cast("long").alias("at"), "root", "path")

    known = at_height(len(levels) - 1)
    for h in range(len(levels) - 1, 0, -1):
        beside = [
            F.struct(F.lit(s).cast("long").alias("slot"), own.alias("node"), F.struct(
                F.concat_ws("", *[x["digest"] for x in slots()[:s]]).alias("left"),
                F.concat_ws("", *[x["digest"] for x in slots()[s + 1:]]).alias("right")).alias("beside"))
            for s, own in enumerate(slots())
        ]
        children = levels[h].join(known, ["tree", "at"]).select(
            "tree", "at", "root", "path", F.inline(F.filter(F.array(*beside), lambda x: x["node"].isNotNull()))
        )
        below = children.select(
            "tree", (F.col("at") * FANOUT + F.col("slot")).alias("at"), "root",
            F.concat(F.array("beside"), F.col("path")).alias("path"), "node",
        )
        known = below.drop("node").unionByName(at_height(h - 1)) if h > 1 else below
    if len(levels) == 1:
        return levels[0].join(known, ["tree", "at"]).select("tree", "node", "root", "path")
    alone = levels[0].where(F.col("size") == 1).join(at_height(0), ["tree", "at"])
    return known.unionByName(alone.select(known.columns)).select("tree", "node", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda node, x: sha256(x["left"], node, x["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.concat_ws("", F.flatten(F.transform(path, lambda x: F.array(x["left"], x["right"]))))


def manifest(docs: DataFrame, *, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS,
             changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """id, leaf, other (the leaf of changed fields where asked for), subroot, root, path of every row."""
    where = F.lit(False) if where is None else where
    hashed = stored(leaves(docs, key=key, group=group, fields=fields, changed=changed or {}, where=where), "merkle-leaves")
    placed = stored(numbered(hashed.withColumn("leaf", F.col("node.digest")), ["place", "leaf", "number"]), "merkle-level0")
    levels, tops = grown(placed)
    tops = stored(tops, "merkle-tops")
    roots = tops.select(F.lit("").alias("tree"), F.struct(
        F.col("node.digest").alias("digest"), F.struct("tree", "height").alias("id"), F.lit(None).cast("string").alias("other")
    ).alias("node"), F.col("tree").alias("place"))
    upper, top = grown(stored(numbered(roots, ["place"]), "merkle-groups"))
    all_ = top.select("tree", "height", F.col("node.digest").alias("root"), F.array().cast(
        "array<struct<left:string,right:string>>").alias("path"))
    groups = stored(proofs(upper, all_).select(
        F.col("node.id.tree").alias("tree"), F.col("node.id.height").alias("height"),
        F.struct(F.col("node.digest").alias("sub"), F.col("root").alias("all")).alias("root"), "path",
    ), "merkle-group-proofs")
    return proofs(levels, groups).select(
        F.col("node.id").alias("id"), F.col("node.digest").alias("leaf"), F.col("node.other").alias("other"),
        F.col("root.sub").alias("subroot"), F.col("root.all").alias("root"), "path",
    )


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """Every document's proof; documents whose id's crc32 is even are verified with a text that lost its line ends."""
    tampered = {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    found = manifest(table(spark, sf_dir, "documents"), changed=tampered, where=even)
    again = folded(F.coalesce("other", "leaf"), F.col("path"))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        again.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, row_number() OVER () AS number,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
           coalesce(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
               lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda b: 0::UBIGINT)),
                   lambda x, b: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) & 1 = 1, false) AS even
    FROM documents),
h AS (
    SELECT doc_id, source, number, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           CASE WHEN even THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS other
    FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, number) - 1 AS pos,
             count(*) OVER (PARTITION BY source) AS size FROM h),
up AS (
    SELECT 0 AS level, source, pos, size, leaf AS digest FROM l
    UNION ALL
    SELECT level + 1, source, pos // 3, (any_value(size) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM up
    WHERE size > 1 GROUP BY level, source, pos // 3),
sub AS (SELECT source, digest, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size
        FROM up WHERE size = 1),
top AS (
    SELECT 0 AS level, pos, size, digest FROM sub
    UNION ALL
    SELECT level + 1, pos // 3, (any_value(size) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM top
    WHERE size > 1 GROUP BY level, pos // 3),
root AS (SELECT digest AS root FROM top WHERE size = 1),
beside AS (
    SELECT a.level, a.source, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS low,
           coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS high
    FROM up a JOIN up b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.pos // 3 = b.pos // 3
    WHERE a.size > 1 GROUP BY ALL),
beside_top AS (
    SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS low,
           coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS high
    FROM top a JOIN top b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.size > 1 GROUP BY ALL),
walk AS (
    SELECT l.number, l.source, 0 AS step, l.pos, sub.height, sub.pos AS place, coalesce(l.other, l.leaf) AS node, '' AS proof
    FROM l JOIN sub ON l.source IS NOT DISTINCT FROM sub.source
    UNION ALL
    SELECT w.number, w.source, w.step + 1, CASE WHEN w.step + 1 = w.height THEN w.place ELSE w.pos // 3 END, w.height, w.place,
           sha256(coalesce(b.low, t.low) || w.node || coalesce(b.high, t.high)), w.proof || coalesce(b.low, t.low) || coalesce(b.high, t.high)
    FROM (SELECT * REPLACE (CASE WHEN step = 0 AND height = 0 THEN place ELSE pos END AS pos) FROM walk) w
    LEFT JOIN beside b ON w.step < w.height AND b.level = w.step AND b.pos = w.pos AND b.source IS NOT DISTINCT FROM w.source
    LEFT JOIN beside_top t ON w.step >= w.height AND t.level = w.step - w.height AND t.pos = w.pos
    WHERE b.level IS NOT NULL OR t.level IS NOT NULL),
done AS (SELECT number, arg_max(node, step) AS folded_root, sha256(arg_max(proof, step)) AS proof_sha256 FROM walk GROUP BY number)
SELECT l.doc_id, l.leaf, sub.digest AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN sub ON l.source IS NOT DISTINCT FROM sub.source JOIN done USING (number) CROSS JOIN root
"""
