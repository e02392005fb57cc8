"""Whitening, n-gram join and manifest against brute force, and their edges."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.llm import merkle, ngram_join, whitening

# --- whitening ---

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def whole(df):
    rows = df.select("vec_id", whitening.whole_entries(F.col("embedding")).alias("x")).where(F.col("x").isNotNull())
    return rows, whitening.whitened(rows, whitening.Whitening(rows))


def expected(vectors):
    """Deviations, eigenvalues and components of floor(64 c) + 1000000 by numpy, from exact integers."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64).astype(object) + 1_000_000
    n = len(x)
    apart = n * x - x.sum(axis=0)
    centred = apart.astype(float) / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    return (apart ** 2).sum(axis=1), centred, values[::-1], components[:, ::-1]


@pytest.mark.parametrize("rows", [300, 9_000])
def test_whitening_against_eigenvectors(spark, rows):
    draw = np.random.default_rng(rows)
    base = (draw.normal(size=(rows, 40)) * np.linspace(4, 0.3, 40)) @ np.linalg.qr(draw.normal(size=(40, 40)))[0]
    vectors = base.astype(np.float32).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(40)
    _, found = whole(df)
    got = found.orderBy("vec_id", "component").collect()
    assert found.columns == COLUMNS and len(got) == rows * 32
    deviations, centred, values, components = expected(vectors)
    assert [r["deviation"] for r in got[::32]] == deviations.tolist()
    mine = np.array([r["whitened"] for r in got]).reshape(rows, 32)
    theirs = centred @ components[:, :32] / np.sqrt(values[:32])
    assert np.abs(mine * np.sign((mine * theirs).sum(axis=0)) - theirs).max() < 1e-8
    assert np.allclose([r["explained"] for r in got[:32]], values[:32] / values.sum(), rtol=1e-10)
    assert np.abs(mine.T @ mine / rows - np.eye(32)).max() < 1e-10 and got[0]["identity_error"] < 1e-10


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>, x string, component string, n string"
    rows = [
        (1, [1.0, 2.0, 0.0]), (2, [0.5, -1.0, 0.0]), (3, [3.0]), (4, []), (None, [0.0, 1.0, 0.0]), (1, [1.0, 2.0, 0.0]),
        (5, None), (6, [1.0, None, 0.0]), (7, [float("nan"), 0.0, 0.0]), (8, [float("inf"), 0.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], schema)
    _, found = whole(df)
    got = found.collect()
    assert sorted({r["vec_id"] for r in got}, key=str) == [1, 2, 3, 4, None] and {r["n"] for r in got} == {6}
    assert {r["component"] for r in got} == {1, 2} and len(got) == 12  # the third dimension is constant
    padded = [[*v, 0.0, 0.0, 0.0][:3] for _, v in rows[:6]]
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(expected(padded)[0].tolist())
    assert got[0]["identity_error"] < 1e-10
    for none in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 2"), df.where("vec_id in (4, 5, 6)")):
        assert whole(none)[1].count() == 0
    huge = spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<float>")
    assert {(r["vec_id"], r["deviation"]) for r in whole(huge)[1].collect()} == {(1, None), (2, None), (3, 1 + 448 ** 2)}


def test_whitening_of_dependent_dimensions(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(500, 3)) * 10
    vectors = np.concatenate([np.floor(base * 64) / 64, np.floor(base * 64) / 64, np.ones((500, 2))], axis=1).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = whole(df)[1].toPandas()
    assert got["component"].max() == 3 and got["identity_error"].max() < 1e-9
    assert abs(got[got["vec_id"] == 0]["explained"].sum() - 1) < 1e-9


# --- n-gram join ---

def brute_components(docs, size=4, percent=85):
    """Component and set size of every id by comparing all pairs; docs: (id, text)."""
    sets = {}
    for i, text in docs:
        ws = [w.lower() for w in (text or "").encode().split()]
        own = {tuple(ws[k:k + size]) for k in range(max(len(ws) - size + 1, 1))} if ws else set()
        sets.setdefault(i, []).append(own)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = sorted((i, s) for i, own in sets.items() for s in map(frozenset, own))
    for (i, s), (j, t) in itertools.combinations(flat, 2):
        both = len(s & t)
        if both and 100 * both >= percent * len(s | t):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: find(i) for i in sets}


def near_copies(seed, families, copies, words, changes):
    """Texts of families around a random text, each copy with some words changed, all with a common passage."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(5000)}"
    passage = [word() for _ in range(words // 5)]
    out = []
    for _ in range(families):
        base = passage + [word() for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(draw.randint(0, changes)):
                own[draw.randrange(len(own))] = word()
            out.append(" ".join(own))
    draw.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("few, block, ordered, turns", [(32, 4000, 500_000, 2), (2, 7, 40, 1), (0, 3, 0, 1)])
def test_join_against_all_pairs(spark, monkeypatch, few, block, ordered, turns):
    for name, value in {"FEW": few, "BLOCK": block, "ORDERED": ordered, "TURNS": turns, "TRIED": 100}.items():
        monkeypatch.setattr(ngram_join, name, value)
    for docs in (near_copies(1, 12, 25, 60, 5), near_copies(2, 3, 60, 150, 9), near_copies(3, 60, 3, 9, 2)):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(df).collect()}
        assert got == brute_components(docs)


def test_join_at_the_threshold(spark):
    """17 of 20 n-grams in common link, 16 of 20 do not; words in upper case and other white space make no difference."""
    base = [f"a{i}" for i in range(21)]
    docs = [(1, " ".join(base[:20])), (2, "\t".join(base[:20]).upper()), (3, " ".join(base)), (4, " ".join(base[:18]))]
    for shared in range(12, 24):
        x = [f"s{shared}x{i}" for i in range(shared + 3)]
        docs += [(100 + shared, " ".join(x)), (200 + shared, " ".join([*x, *(f"t{shared}y{i}" for i in range(3))]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(df).collect()} == brute_components(docs)


def test_join_edges(spark, messy, empty):
    got = ngram_join.join_components(messy).collect()
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    want = brute_components([r for r in rows if r[0] is not None])
    assert len(got) == len(rows) and sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] in (3, 4, 5, 6, 10)} == {3: 0, 4: 0, 5: 0, 6: 1, 10: 1}
    assert ngram_join.join_components(empty).count() == 0
    assert ngram_join.join_components(messy.where("doc_id in (3, 4, 5)")).count() == 3


# --- manifest ---

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*map(put, r))
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)

    def tree(nodes):
        """Root, and per node the (left, right) siblings of every level."""
        paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
            for at, members in enumerate(groups):
                run = runs[at // 3]
                for i in members:
                    paths[i].append(("".join(run[:at % 3]), "".join(run[at % 3 + 1:])))
            groups = [sum(groups[i:i + 3], []) for i in range(0, len(groups), 3)]
            nodes = [digest(*run) for run in runs]
        return nodes[0], paths

    sources = sorted({r[1] for r in rows}, key=order)
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *tree([leaf(r) for r in own]))
    root, above = tree([trees[s][1] for s in sources])
    out = []
    for s, upper in zip(sources, above):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths):
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in path + upper:
                node = digest(left, node, right)
            out.append((r[0], leaf(r), subroot, root, digest(*itertools.chain(*(path + upper))), node, node == root))
    return out


def manifested(spark, df, path):
    df.write.parquet(f"{path}/documents.parquet")
    found = merkle.op13_merkle(spark, str(path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=str)


def test_manifest_against_brute_force(spark, messy, empty, tmp_path):
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    draw = random.Random(3)
    sources = [None, "", "a", "b", "é", "\U0001f600", "￿"]
    rows = [(i, draw.choice(sources[:4]) if i % 3 else "hot", "x", draw.randrange(9), f"t{i}\n" * (i % 3)) for i in range(240)]
    rows += [(1000 + i, s, None, None, None) for i, s in enumerate(sources)] + [(7, "hot", "x", 1, "again\n")] * 3
    many = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for k, df in enumerate((many.repartition(7), messy, empty, messy.limit(1), many.where("doc_id < 3"), many.where("source is null"))):
        want = brute_manifest([tuple(r) for r in df.select(*names).collect()]) if not df.isEmpty() else []
        assert manifested(spark, df, tmp_path / str(k)) == sorted(want, key=str)


def test_manifest_of_a_hot_group_uses_many_ranges(spark, tmp_path):
    """Places in a group run on across ranges."""
    df = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.lit("en").alias("lang"), F.col("id").alias("n_chars"), F.lit("x\ny").alias("text")
    ).repartition(9)
    hashed = merkle.leaves(df, key="doc_id", group="source", fields=merkle.FIELDS, changed={}, where=F.lit(False))
    placed = merkle.numbered(hashed, ["place", "number"])
    assert [r["at"] for r in placed.orderBy("node.id").collect()] == list(range(5000))
    want = brute_manifest([tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert manifested(spark, df, tmp_path) == sorted(want, key=str)
