"""N-gram Jaccard join by grouped prefixes (Bouros et al., 2012, on prefix and position filters), and the groups its links make.

1. One pass counts word n-grams (64-bit hashes) that recur inside a stretch of documents; the counts of all stretches give the most frequent
   n-grams, at most ``ORDERED`` of them. They stand last in the order of all n-grams, by count; the others stand by hash. Any one order gives
   the same links, this one keeps common passages out of prefixes.
2. A second pass gives every document its size n, a fingerprint of its set, its prefix (the first n - ceil(n * percent / 100) + 1 n-grams in the
   order) and a parity sketch (a bit per hash value, flipped by every n-gram there, at least two bits per n-gram).
3. Documents with equal prefix and size collapse into one group; only groups are indexed. Groups that share a prefix n-gram meet in its bucket,
   beside sizes that can reach the threshold, and pairs pass if what follows the shared n-gram can still hold the overlap.
4. Stars first: each bucket's hub is paired with the others, each group's first member with its other members. Pairs are tried by sketch
   (differing bits never exceed the differing n-grams) and confirmed on full sets; links are grouped by union-find, and a second turn of hubs
   follows. So a bucket of n alike documents costs n pairs.
5. In buckets and groups that still hold several components, all group pairs that pass the filters are expanded to their members of
   different components and verified in the same way. Small buckets are joined with themselves; in larger ones the members meet in cells of
   two blocks, which hand on only pairs that pass the sketch too. So no link between components goes unseen.

All filters are exact, so links are lost only to equal 64-bit hashes. Hubs and other per-bucket results are written before they are joined, so that
both sides of such joins are plain and hot buckets are split; tasks hold batches, blocks, or the partners of one salted group.

Edges: null and blank texts have no n-grams and stay alone; fewer words than an n-gram form one; a null id takes no part (n_shingles and
component null); an id with several texts is one document that has them all; repeated rows repeat in the result; an empty table gives no rows;
only the key and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.common import table
from cardwatch.llm.components import components
from cardwatch.llm.neardup import confirmed, mixed, shingles
from cardwatch.runtime import stored

SHINGLE, PERCENT = 4, 85
#: frequent n-grams that are ordered by count, n-grams of one counted stretch
ORDERED, STRETCH = 500_000, 4_000_000
#: turns of hubs, groups of a bucket that is joined with itself, members of one block of a cell, pairs tried at once there
TURNS, FEW, BLOCK, TRIED = 2, 32, 4000, 250_000
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, group_a long, group_b long, prefix array<long>, sketch binary"


def least_overlap(a, b, percent: int):
    """Shared n-grams that sets of a and b members need: of two names of columns a column, of numbers or arrays the like."""
    if isinstance(a, str):
        return F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}")
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def sums(found):
    """Two 64-bit sums that stand for a set."""
    import numpy as np

    return [int(np.sum(mixed(found + np.uint64(salt)), dtype=np.uint64).astype(np.int64)) for salt in (1, 2)]


def frequent(docs: DataFrame, size: int):
    """(n-grams, counts) of at most ``ORDERED`` frequent n-grams as arrays by rising n-gram.

    A stretch counts equal sets once and gives what it holds twice; every document is counted.
    """
    import numpy as np

    def count(batches):
        import numpy as np
        import pyarrow as pa

        def finish(parts):
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            twice = counts > 1
            return pa.record_batch([pa.array(values[twice].view(np.int64)), pa.array(counts[twice])], ["token", "n"])

        parts, seen, held = [], set(), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = shingles(text, size)
                mark = (len(found), int(np.sum(found, dtype=np.uint64)))
                if mark in seen or not len(found):
                    continue
                seen.add(mark)
                parts.append(found)
                held += len(found)
                if held >= STRETCH:
                    yield finish(parts)
                    parts, seen, held = [], set(), 0
        if parts:
            yield finish(parts)

    found = docs.select("text").mapInArrow(count, "token long, n long")
    counted = stored(found.groupBy("token").agg(F.sum("n").cast("long").alias("n")), "ngram-counts")
    levels = counted.groupBy(F.floor(F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect()
    total, floor = 0, None
    for level, n in levels:
        total += n
        if total > ORDERED:
            break
        floor = 1 << level
    kept = counted.where(F.col("n") >= floor).collect() if floor else []
    tokens = np.array([r["token"] for r in kept], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r["n"] for r in kept], np.int64)[order]


def signer(size: int, percent: int, tokens, counts):
    """mapInArrow function: (doc_id, text) to ``SIGNED``."""

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        maybe = np.zeros(1 << max(8, (8 * len(tokens)).bit_length()), bool)
        mask = np.uint64(len(maybe) - 1)
        maybe[tokens & mask] = True

        def prefix(found):
            """The first members of a set in the order."""
            n = len(found)
            length = n + 1 - -(-percent * n // 100)
            rare = np.ones(n, bool)
            hits = np.flatnonzero(maybe[found & mask])
            if not len(hits):
                return found[:length]
            at = np.minimum(np.searchsorted(tokens, found[hits]), len(tokens) - 1)
            true = tokens[at] == found[hits]
            rare[hits[true]] = False
            first = found[rare][:length]
            if len(first) == length:
                return first
            common, at = found[hits[true]], at[true]
            return np.concatenate([first, common[np.lexsort((common, counts[at]))][:length - len(first)]])

        def sketch(found):
            bits = max(64, 1 << (2 * len(found) - 1).bit_length())
            return np.packbits((np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows, prefixes = [], []
                for text in part.column("text").to_pylist():
                    found = shingles(text, size)
                    first = prefix(found) if len(found) else found
                    prefixes.append(first)
                    rows.append((len(found), *sums(found), *sums(first), sketch(found) if len(found) else b""))
                n, *marks, sketches = zip(*rows, strict=True)
                starts = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(prefixes).view(np.int64)))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(m, pa.int64()) for m in marks), lists, pa.array(sketches, pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "group_a", "group_b", "prefix", "sketch"],
                )

    return sign


def sketched(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the threshold."""
    sides = [classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b").where(similar("n_a", "n_b", percent))

    def near(batches):
        import pyarrow as pa

        def number(bits, length):
            """A sketch as an integer, folded to ``length`` bytes."""
            while len(bits) > length:
                half = len(bits) // 2
                bits = (int.from_bytes(bits[:half]) ^ int.from_bytes(bits[half:])).to_bytes(half)
            return int.from_bytes(bits)

        def apart(x, y):
            length = min(len(x), len(y))
            return (number(x, length) ^ number(y, length)).bit_count()

        for batch in batches:
            most = batch.column("most").to_pylist()
            keep = [apart(x, y) <= m for x, y, m in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), most, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    most = (F.col("n_a") + F.col("n_b") - 2 * least_overlap("n_a", "n_b", percent)).alias("most")
    return both.select("a", "b", "s_a", "s_b", most).mapInArrow(near, "a long, b long")


def similar(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether n-grams from a shared one on can hold the overlap: columns n_a, at_a and n_b, at_b."""
    after = F.least(F.col(f"n_{a}") - F.col(f"at_{a}"), F.col(f"n_{b}") - F.col(f"at_{b}"))
    return similar(f"n_{a}", f"n_{b}", percent) & (after >= least_overlap(f"n_{a}", f"n_{b}", percent))


def bucketed(groups: DataFrame, percent: int) -> DataFrame:
    """token, band, grp, n, at, guest: prefix n-grams that several groups share, each in the band of its size and, as guest, in the next.

    Sizes that can reach the threshold lie in one band or in neighbours. A bucket needs an n-gram among the first of some smaller set.
    """
    dealt = groups.select("grp", "n", F.posexplode("prefix").alias("at", "token"))
    leading = F.col("at") <= F.col("n") - least_overlap("n", "n", percent)
    kept = dealt.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.max(leading).alias("leading"))
    kept = stored(kept.where(F.col("leading") & (F.col("low") != F.col("high"))).select("token"), "ngram-tokens")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent))).cast("int")
    places = F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band + 1).alias("band"), F.lit(True).alias("guest")))
    return dealt.join(kept, "token").select("token", "grp", "n", "at", F.inline(places))


def unsettled(members: DataFrame, states: DataFrame) -> DataFrame:
    """Members of buckets that hold several components; states: grp, low, high (labels of a group's members)."""
    named = members.drop("low", "high").join(states, "grp")
    mixed_ = named.groupBy("token", "band").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.min("guest").alias("guests"))
    open_ = stored(mixed_.where((F.col("least") != F.col("most")) & ~F.col("guests")).select("token", "band"), "ngram-open")
    return stored(named.join(open_, ["token", "band"]), "ngram-members")


def star_pairs(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Group pairs (a, b) of each bucket's hub with its other members; the hub is the smallest group, in later turns one drawn by hash."""
    by = F.lit(0).cast("long") if turn == 0 else F.xxhash64("low", F.lit(turn))
    first = F.min(F.struct(by.alias("by"), "grp", "n", "at", "low", "high"))
    hubs = stored(members.where(~F.col("guest")).groupBy("token", "band").agg(first.alias("hub")), "ngram-hubs")
    sides = members.select("token", "band", "grp", F.col("n").alias("n_a"), F.col("at").alias("at_a"), "low", "high")
    both = sides.join(hubs, ["token", "band"]).withColumns({"n_b": F.col("hub.n"), "at_b": F.col("hub.at")})
    apart = (F.col("grp") != F.col("hub.grp")) & (F.least("low", "hub.low") != F.greatest("high", "hub.high"))
    kept = both.where(apart & may_link("a", "b", percent))
    return kept.select(F.least("grp", "hub.grp").alias("a"), F.greatest("grp", "hub.grp").alias("b")).distinct()


def bucket_sizes(members: DataFrame) -> DataFrame:
    return stored(members.groupBy("token", "band").agg(F.count("*").alias("together")), "ngram-sizes")


def few_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Group pairs (a, b) that pass the filters in buckets of at most ``FEW`` groups."""
    one, two = (members.select("token", "band", *[F.col(c).alias(f"{c}_{side}") for c in ("grp", "n", "at", "low", "high", "guest")]) for side in "ab")
    apart = (F.col("grp_a") < F.col("grp_b")) & ~(F.col("guest_a") & F.col("guest_b")) & (F.least("low_a", "low_b") != F.greatest("high_a", "high_b"))
    both = one.join(two, ["token", "band"]).where(apart & may_link("a", "b", percent))
    return both.select(F.col("grp_a").alias("a"), F.col("grp_b").alias("b")).distinct()


def folded(sketches: list[bytes]):
    """Sketches as rows of 64-bit numbers, all as long as the shortest: halves of a parity sketch flip each other."""
    import numpy as np

    width = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), width), np.uint64)
    for row, sketch in enumerate(sketches):
        out[row] = np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, width), axis=0)
    return out


def many_pairs(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Member pairs (a, b) of different components that pass all filters in larger buckets.

    Groups are expanded to their members (grp, rep, label, sketch), these are dealt to blocks, and every two blocks meet in a cell.
    """
    bucket = ["token", "band"]
    rows = members.drop("low", "high", "together").join(sketches, "grp")
    counts = stored(rows.groupBy(bucket).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), "ngram-blocks")
    placed = rows.join(counts, bucket).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    meets = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key, values = [*bucket, "x", "y"], ["block", "rep", "label", "n", "at", "guest", "sketch"]
    cells = meets.select(*bucket, F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), *values)

    def pairs(batches):
        import numpy as np
        import pandas as pd

        cell, held = None, []

        def finish():
            block, rep, label, n, at, guest, sketch = (np.concatenate(c) for c in zip(*held, strict=True))
            bits = folded(sketch.tolist())
            sides = [np.flatnonzero(block == cell[2]), np.flatnonzero(block == cell[3])]
            step = max(1, TRIED // max(1, len(sides[1])))
            for start in range(0, len(sides[0]), step):
                i, j = sides[0][start:start + step, None], sides[1][None, :]
                fits = (label[i] != label[j]) & ~(guest[i] & guest[j])
                if cell[2] == cell[3]:
                    fits &= rep[i] < rep[j]
                p, q = np.nonzero(fits)
                p, q = i[p, 0], j[0, q]
                need = least_overlap(n[p], n[q], percent)
                fits = (np.minimum(n[p] - at[p], n[q] - at[q]) >= need) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
                p, q, most = p[fits], q[fits], (n[p] + n[q] - 2 * need)[fits]
                some = max(1, 8 * TRIED // bits.shape[1])
                for low in range(0, len(p), some):
                    part = slice(low, low + some)
                    near = np.bitwise_count(bits[p[part]] ^ bits[q[part]]).sum(axis=1) <= most[part]
                    x, y = rep[p[part][near]], rep[q[part][near]]
                    if len(x):
                        yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

        for batch in batches:
            keys = batch[key].to_numpy()
            columns = [batch[c].to_numpy() for c in values]
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if start == stop:
                    continue
                own = tuple(keys[start].tolist())
                if own != cell:
                    if held:
                        yield from finish()
                    cell, held = own, []
                held.append([c[start:stop] for c in columns])
        if held:
            yield from finish()

    return cells.repartition(*key).sortWithinPartitions(*key).mapInPandas(pairs, "a long, b long").distinct()


def expanded(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Member pairs (a, b) of group pairs, a group with itself included, in different components; named: grp, rep, label."""
    one, two = (named.select(F.col("grp").alias(c), F.col("rep").alias(f"rep_{c}"), F.col("label").alias(f"label_{c}")) for c in ("a", "b"))
    apart = (F.col("label_a") != F.col("label_b")) & ((F.col("a") != F.col("b")) | (F.col("rep_a") < F.col("rep_b")))
    both = pairs.join(one, "a").join(two, "b").where(apart)
    return both.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def join_components(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable) of every row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    tokens, counts = frequent(known, shingle)
    signed = stored(known.mapInArrow(signer(shingle, percent, tokens, counts), SIGNED), "ngram-signed")
    sets, prefixes = ["n_shingles", "set_a", "set_b"], ["n_shingles", "group_a", "group_b"]
    filled = signed.where(F.col("n_shingles") > 0)
    groups = stored(
        filled.groupBy(prefixes).agg(F.min("doc_id").alias("grp"), F.any_value("prefix").alias("prefix"))
        .withColumnRenamed("n_shingles", "n"), "ngram-groups",
    )
    alike = filled.groupBy([*sets, "group_a", "group_b"]).agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch"))
    numbers = groups.select(F.col("n").alias("n_shingles"), "group_a", "group_b", "grp")
    classes = stored(alike.join(numbers, prefixes).withColumn("n", F.col("n_shingles")), "ngram-classes")

    def named(labels: DataFrame | None) -> DataFrame:
        own = classes.select("grp", "rep")
        if labels is None:
            return own.withColumn("label", F.col("rep"))
        return stored(own.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
            "grp", "rep", F.coalesce("label", "rep").alias("label")), "ngram-labels")

    def states(members: DataFrame) -> DataFrame:
        return members.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high"))

    links, tried, label = None, None, named(None)
    members = stored(bucketed(groups, percent), "ngram-shared")
    for turn in range(TURNS):
        members = unsettled(members, states(label))
        pairs = star_pairs(members, turn, percent)
        if turn == 0:
            pairs = pairs.union(classes.where(F.col("grp") != F.col("rep")).select(F.col("grp").alias("a"), F.col("rep").alias("b")))
        pairs = stored(pairs, "ngram-stars")
        found = stored(confirmed(stored(sketched(pairs, classes, percent), "ngram-near"), rows, shingle, percent), "ngram-links")
        links, tried = (found, pairs) if links is None else (links.union(found), tried.union(pairs))
        label = named(components(links))
    members = unsettled(members, states(label))
    several = states(label).where(F.col("low") != F.col("high")).select(F.col("grp").alias("a"), F.col("grp").alias("b"))
    sized = stored(members.join(bucket_sizes(members), ["token", "band"]), "ngram-sized")
    pairs = stored(few_pairs(sized.where(F.col("together") <= FEW), percent).union(several), "ngram-group-pairs")
    rest = stored(expanded(pairs, label).join(tried, ["a", "b"], "left_anti"), "ngram-expanded")
    sketches = label.join(classes.select("rep", "sketch"), "rep")
    many = many_pairs(sized.where(F.col("together") > FEW), sketches, percent).join(tried, ["a", "b"], "left_anti")
    near = stored(sketched(rest, classes, percent).union(many).distinct(), "ngram-near")
    if not near.isEmpty():
        more = stored(confirmed(near, rows, shingle, percent), "ngram-links")
        if not more.isEmpty():
            label = named(components(links.union(more)))
    heads = classes.select(*sets, "rep").join(label.select("rep", "label"), "rep").drop("rep")
    found = signed.select("doc_id", *sets).join(stored(heads, "ngram-heads"), sets, "left")
    unnamed = rows.where(F.col("doc_id").isNull()).select("doc_id", *[F.lit(None).cast("long").alias(c) for c in ("n_shingles", "component_id")])
    return found.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")).union(unnamed)


def op12_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE w AS (
    SELECT DISTINCT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS sh
      FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
