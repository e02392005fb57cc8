"""MinHash near-deduplication with SuperMinHash signatures (Ertl, 2017), banding, verification and union-find.

1. Every text gives its set of distinct shingles (64-bit hashes), a fingerprint of that set, its signature and band keys.
   An element's permutation ranks are dealt level by level; a document stops once no later level can lower a slot.
2. Equal sets become one class (equal fingerprint); all later work is on classes, so copies cost one row each.
3. Classes sharing a band key share a bucket. The member of a bucket that shares most buckets is its hub; every member is paired with
   its hubs, so a bucket of n classes gives n - 1 pairs. Pairs whose signatures are too far apart for the threshold are dropped;
   texts of the others are brought together per hub, in salted groups, and confirmed on full sets. Links are grouped by
   union-find. Another turn of hubs follows in buckets that still hold several groups.
4. Buckets that hold several groups after that are finished: members are dealt to blocks of bounded size, and every two blocks that
   hold members outside the bucket's largest group meet in a cell. Pairs are tried by signature and then decided on full sets; a
   cell hands on only links that join two groups in it. So no pair of a bucket goes unseen unless its two members are already in
   one group, a task holds two blocks, and a cell gives fewer rows than it has members.

With 32 bands of 4 rows a pair at the threshold itself is missed with a chance of 5e-6, one at 0.8 with 5e-8; the signature test
(68 of 128 slots, expected 96) adds less than 1e-8.

Edges: null and blank texts have no shingles, stay alone and are kept; fewer words than a shingle form one; a null id takes no part
(component null, kept); an id with several texts is one document that has them all; repeated rows repeat in the result; an empty
table gives no rows; only the key and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.common import lower_words, table
from cardwatch.llm.components import components
from cardwatch.runtime import lookup_join, stored

SLOTS, ROWS = 128, 4
SHINGLE, PERCENT = 5, 75
#: least equal slots of two signatures that may still reach the threshold
MIN_EQUAL = 68
#: elements whose permutations are dealt together, and members of one comparing block
ELEMENTS, BLOCK = 100_000, 1000
#: shingles of one comparing block
BLOCK_SHINGLES = 4_000_000
#: rounds of hubs before the rest of the buckets is compared in blocks
TURNS = 2
#: texts checked against one hub in one group
GROUP = 300
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>"


def mixed(x):
    """The splitmix64 finalizer on unsigned 64-bit arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int):
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a text, A-Z lower-cased."""
    import numpy as np
    import xxhash

    found = [xxhash.xxh3_64_intdigest(w) for w in lower_words(text)]
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    codes = np.array(found, np.uint64)
    span = min(n, size)
    total = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + codes[k:n - span + 1 + k])
    return np.unique(total)


def super_minhash(elements, starts, slots: int = SLOTS):
    """Signatures (documents, slots) of concatenated sets: elements[starts[d]:starts[d + 1]] is one set.

    Element e takes slot p_j(e) of its permutation p at level j with value (j, random); the least value of a slot stays.
    Values of later levels are larger, so a document whose slots all hold earlier levels is done.
    """
    import numpy as np

    sizes = np.diff(starts)
    n_docs = len(sizes)
    least = np.full((n_docs, slots), np.iinfo(np.uint64).max, np.uint64)
    document = np.repeat(np.arange(n_docs), sizes)
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(elements), 1))
    state, rows = elements.copy(), np.arange(len(elements))
    flat = least.reshape(-1)
    for level in range(slots):
        if not len(rows):
            break
        state = state + np.uint64(0x9E3779B97F4A7C15)
        value = mixed(state)
        pick = level + ((value >> np.uint64(32)) % np.uint64(slots - level)).astype(np.int64)
        chosen = order[rows, pick]
        order[rows, pick] = order[rows, level]
        draw = (np.uint64(level) << np.uint64(56)) | (mixed(value) >> np.uint64(8))
        np.minimum.at(flat, document * slots + chosen, draw)
        open_ = least.max(axis=1) >= np.uint64(level + 1) << np.uint64(56)
        stay = open_[document]
        if not stay.all():
            rows, document, state = rows[stay], document[stay], state[stay]
    return least


def signer(size: int, rows_per_band: int):
    """mapInPandas function: (doc_id, text) to ``SIGNED``."""

    def finish(part):
        import numpy as np
        import pandas as pd

        sizes = np.array([len(s) for _, s in part])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        elements = np.concatenate([s for _, s in part]) if part else np.zeros(0, np.uint64)
        signature = super_minhash(elements, starts)
        bands = signature.reshape(len(part), -1, rows_per_band)
        key = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64) << np.uint64(40), bands.shape[:2])
        for r in range(rows_per_band):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
        short = (mixed(signature) & np.uint64(255)).astype(np.uint8)
        sums = []
        for salt in (1, 2):
            total = np.concatenate([[0], np.cumsum(mixed(elements + np.uint64(salt)), dtype=np.uint64)]).astype(np.uint64)
            sums.append((total[starts[1:]] - total[starts[:-1]]).view(np.int64))
        return pd.DataFrame({
            "doc_id": [d for d, _ in part], "n_shingles": sizes, "set_a": sums[0], "set_b": sums[1],
            "signature": [s.tobytes() for s in short],
            "bands": [k.view(np.int64) if n else np.zeros(0, np.int64) for k, n in zip(key, sizes, strict=True)],
        })

    def sign(batches):
        for batch in batches:
            part, held = [], 0
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                found = shingles(text, size)
                if part and held + len(found) > ELEMENTS:
                    yield finish(part)
                    part, held = [], 0
                part.append((doc, found))
                held += len(found)
            if part:
                yield finish(part)

    return sign


def similar_size(a: str, b: str, percent: int) -> Column:
    """Sets can only reach the threshold if the smaller holds that share of the larger."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def screened(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the threshold."""
    sides = [
        classes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
        for c in ("a", "b")
    ]
    both = pairs.join(sides[0], "a").join(sides[1], "b").where(similar_size("n_a", "n_b", percent))

    def near(batches):
        import numpy as np

        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("s_a", "s_b")
            )
            if len(batch):
                yield batch.loc[(left == right).sum(axis=1) >= MIN_EQUAL, ["a", "b"]]

    return both.select("a", "b", "s_a", "s_b").mapInPandas(near, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold.

    Texts meet per ``a``: its text goes once to each salted group of at most about ``GROUP`` partners. Only texts of pairs are
    moved: the table of their ids is broadcast if it is counted small, else joined by id.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("salts"))
    salted = pairs.join(groups, "a").select(
        F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b"
    )
    hubs = groups.select(
        F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
        F.lit(None).cast("long").alias("b"),
    )
    sides = stored(salted.union(hubs), "neardup-sides")
    rows = lookup_join(docs.select("doc_id", "text"), sides, "doc_id", "inner").select("a", "salt", "b", "text")
    ordered = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def check(batches):
        import numpy as np
        import pandas as pd

        group, hubs = None, []
        for batch in batches:
            found = []
            for a, salt, b, text in zip(*(batch[c].tolist() for c in ("a", "salt", "b", "text")), strict=True):
                if (a, salt) != group:
                    group, hubs = (a, salt), []
                own = shingles(text, size)
                if b is None:
                    hubs.append(own)
                    continue
                for hub in hubs:
                    both = len(np.intersect1d(hub, own, assume_unique=True))
                    if 100 * both >= percent * (len(hub) + len(own) - both):
                        found.append((int(a), int(b)))
                        break
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    exact = ordered.select("a", F.col("salt"), F.col("b").cast("string").alias("b"), "text")
    return exact.mapInPandas(check, "a long, b long").distinct()


def unsettled(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join groups within a bucket; members: bucket, rep, label, n_shingles, signature.

    Members outside a bucket's largest group are dealt to the blocks 0 to asking - 1, the others to the blocks after them; a bucket that
    fits into one block is one. Cell (x, y) with x < asking and x <= y holds the blocks x and y. Pairs are tried where sizes and
    signatures allow and decided on full sets.
    """
    counts = members.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    blocks = lambda n, shingles: F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("long")
    main = F.max(F.struct("n", F.negative("label").alias("label"), "shingles"))
    split = counts.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.count("*").alias("labels"), main.alias("main"),
    ).where(F.col("labels") > 1).select(
        "bucket", F.negative("main.label").alias("main"), (blocks(F.col("n"), F.col("shingles")) == 1).alias("whole"),
        blocks(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles")).alias("asking"),
        blocks(F.col("main.n"), F.col("main.shingles")).alias("others"),
    )
    asks, at = F.col("label") != F.col("main"), F.xxhash64("rep")
    block = F.when(F.col("whole"), F.lit(0)).when(asks, F.pmod(at, F.col("asking"))).otherwise(F.col("asking") + F.pmod(at, F.col("others")))
    last = F.when(F.col("whole"), F.lit(0)).when(asks, F.col("asking") + F.col("others") - 1).otherwise(F.col("asking") - 1)
    placed = members.join(split, "bucket").withColumns({"block": block.cast("long"), "last": last.cast("long")})
    meets = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    columns = ["bucket", "x", "y", "block", "rep", "label", "n_shingles", "signature"]
    rows = stored(
        meets.withColumns({"x": F.least("block", "with"), "y": F.greatest("block", "with")}).select(columns), "neardup-cells"
    )

    def full(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"rep": batch["rep"], "set": [shingles(t, size).tobytes() for t in batch["text"]]})

    asked = stored(rows.select(F.col("rep").alias("doc_id")).distinct(), "neardup-asked")
    texts = lookup_join(docs.select("doc_id", "text"), asked, "doc_id", "inner")
    sets = texts.select(F.col("doc_id").alias("rep"), "text").mapInPandas(full, "rep long, set binary")

    def compare(batches):
        import numpy as np
        import pandas as pd

        cell, held, parent = None, ([], []), {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        def linked(x, y):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * both >= percent * (len(x) + len(y) - both)

        def finish():
            sides = [held[0], held[1] if cell and cell[1] != cell[2] else held[0]]
            if not all(sides):
                return []
            (a_id, a_label, a_n, a_sig, a_set), (o_id, o_label, o_n, o_sig, o_set) = (list(zip(*x, strict=True)) for x in sides)
            a_sig, o_sig = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (a_sig, o_sig))
            a_n, o_n, a_lab, o_lab = (np.array(x, np.int64) for x in (a_n, o_n, a_label, o_label))
            found, step = [], max(1, 20_000 // len(o_n))
            for at in range(0, len(a_n), step):
                some = slice(at, at + step)
                fits = 100 * np.minimum(a_n[some, None], o_n) >= percent * np.maximum(a_n[some, None], o_n)
                x, y = np.nonzero(fits & (a_lab[some, None] != o_lab))
                if cell[1] == cell[2]:
                    x, y = x[at + x < y], y[at + x < y]
                equal = (a_sig[at + x] == o_sig[y]).sum(axis=1)
                for k in np.flatnonzero(equal >= MIN_EQUAL)[np.argsort(-equal[equal >= MIN_EQUAL], kind="stable")].tolist():
                    p, q = at + int(x[k]), int(y[k])
                    left, right = find(a_label[p]), find(o_label[q])
                    if left != right and linked(a_set[p], o_set[q]):
                        parent[max(left, right)] = min(left, right)
                        found.append((min(a_id[p], o_id[q]), max(a_id[p], o_id[q])))
            return found

        for batch in batches:
            found = []
            for bucket, x, y, block, *row in zip(*(batch[c].tolist() for c in [*columns, "set"]), strict=True):
                if (bucket, x, y) != cell:
                    found += finish()
                    cell, held, parent = (bucket, x, y), ([], []), {}
                held[block != x].append(row)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")
        yield pd.DataFrame(finish(), columns=["a", "b"]).astype("int64")

    ordered = rows.join(sets, "rep").select(*columns, "set").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return ordered.mapInPandas(compare, "a long, b long").distinct()


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (bucket, rep, degree, label) of buckets that hold several groups."""
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", "degree", F.coalesce("label", "rep").alias("label")
    )
    mixed_ = named.groupBy("bucket").agg(F.min("label").alias("first"), F.max("label").alias("last")).where(
        F.col("first") != F.col("last")
    ).select("bucket")
    return stored(named.join(mixed_, "bucket"), "neardup-open")


def hub_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each bucket's hub with its members of other groups.

    A hub is the member that shares most buckets with others; in later turns, one such member of a group drawn by hash.
    """
    drawn = F.col("degree") if turn == 0 else F.pmod(F.xxhash64("label", F.lit(turn)), F.lit(1 << 20)) * F.lit(1 << 20) + F.col("degree")
    hubs = members.groupBy("bucket").agg(F.max(F.struct(drawn.alias("by"), F.negative("rep").alias("rep"), "label")).alias("hub"))
    both = members.join(hubs.select(
        "bucket", F.negative("hub.rep").alias("hub"), F.col("hub.label").alias("of")), "bucket")
    apart = both.where((F.col("rep") != F.col("hub")) & (F.col("label") != F.col("of")))
    return apart.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept of every row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    exact = rows.where(F.col("doc_id").isNotNull())
    signed = stored(exact.mapInPandas(signer(shingle, ROWS), SIGNED), "neardup-signed")
    classes = stored(
        signed.where(F.col("n_shingles") > 0).groupBy("n_shingles", "set_a", "set_b").agg(
            F.min("doc_id").alias("rep"), F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands")
        ), "neardup-classes",
    )
    dealt = classes.select("rep", F.explode("bands").alias("bucket"))
    buckets = stored(
        dealt.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"))
        .where(F.col("hub") != F.col("last")).select("bucket", "hub"), "neardup-buckets",
    )
    shared = stored(dealt.join(buckets.select("bucket"), "bucket"), "neardup-shared")
    members = stored(shared.join(shared.groupBy("rep").agg(F.count("*").alias("degree")), "rep"), "neardup-members")
    open_, links, labels = members.withColumn("label", F.col("rep")), None, None
    for turn in range(TURNS):
        pairs = stored(screened(hub_pairs(open_, turn), classes, percent), "neardup-pairs")
        found = stored(confirmed(pairs, rows, shingle, percent), "neardup-links")
        links = found if links is None else links.union(found)
        labels = components(links)
        open_ = open_buckets(members, labels)
        if open_.isEmpty():
            break
    else:
        detailed = open_.join(classes.select("rep", "n_shingles", "signature"), "rep").drop("degree")
        rest = stored(unsettled(detailed, rows, shingle, percent), "neardup-rest")
        if not rest.isEmpty():
            labels = components(links.union(rest))
    groups = classes.select("n_shingles", "set_a", "set_b", "rep").join(
        labels.withColumnRenamed("node", "rep"), "rep", "left"
    ).select("n_shingles", "set_a", "set_b", F.coalesce("label", "rep").alias("label"))
    found = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(groups, ["n_shingles", "set_a", "set_b"], "left")
    grouped = found.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    unnamed = rows.where(F.col("doc_id").isNull()).select(
        "doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")
    )
    return grouped.union(unnamed).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near-duplicates."""
    found = stored(near_duplicates(docs, key=key), "neardup-found")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    left = lookup_join(docs, gone, key, "left_anti")
    again = found.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return left
    unnamed = left.where(F.col(key).isNull())
    return left.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(unnamed)


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
    SELECT DISTINCT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
      FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
