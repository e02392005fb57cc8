"""Mixing, near-duplicates, search, rollups, language model, pipeline: brute force and edges."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cardwatch.llm import components, lm, mixing, neardup, rollup, topk
from cardwatch.llm.catalogue import ORACLE, QUERIES
from cardwatch.runtime import fresh_path, stored
from tests.parity import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_its_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert not differences(df.collect(), df.columns, connect(sf).execute(ORACLE[name]))


def test_names_cover_the_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


# --- mixing ---

def filled(sizes, weights, budget, epochs):
    """Water-filling by clamping one round after another."""
    targets, free, left = {}, set(sizes), budget
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if total and left * weights[s] / total > epochs * sizes[s]}
        if not over:
            return targets | {s: left * weights[s] / total if total else 0.0 for s in free}
        for s in over:
            targets[s], left = epochs * sizes[s], left - epochs * sizes[s]
        free -= over
    return targets


def test_water_filling_against_rounds(spark):
    draw = random.Random(1)
    for epochs, share in ((2.0, 1.5), (4.0, 3.9), (1.0, 1.5)):
        sizes = {f"s{i}": draw.randint(0, 1000) for i in range(12)}
        weights = {s: draw.choice([0.0, 0.5, 1.0, 7.0]) for s in sizes}
        budget = share * sum(sizes.values())
        df = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size long, weight double")
        got = {r["source"]: r["target"] for r in mixing.targets(df, budget, epochs).collect()}
        want = filled({s: n for s, n in sizes.items() if weights[s]}, weights, budget, epochs)
        for s in sizes:
            assert math.isclose(got[s], want.get(s, 0.0), rel_tol=1e-9, abs_tol=1e-6)


def sized(df):
    return df.drop("size").withColumn("size", mixing.n_words(F.col("text")))


def test_mix_meets_targets_and_is_repeatable(spark, messy, empty):
    for df in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), messy):
        rows = sized(df)
        planned = mixing.by_code_points(rows)
        shared = mixing.shares(rows, planned, seed=42)
        taken = F.col("epochs") * F.col("size") + F.col("part_words")
        per = shared.groupBy("source").agg(F.sum(taken).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
        assert len(per) == df.select("source").distinct().count()
        for r in per:
            assert abs(r["taken"] - r["target"]) <= r["n"] + 1
        assert shared.where(taken > 2 * F.col("size")).isEmpty()
        again = mixing.shares(rows, mixing.by_code_points(rows), seed=42)
        key = lambda x: sorted(str(r) for r in x.select("doc_id", "source", "epochs", "part_words").collect())
        assert key(shared) == key(again)
        out = mixing.materialize(shared)
        words = out.withColumn("w", mixing.n_words(F.col("text"))).agg(F.sum("w")).first()[0]
        assert words == shared.agg(F.sum(taken)).first()[0]
    none = sized(empty)
    assert mixing.shares(none, mixing.by_code_points(none), seed=42).count() == 0


# --- search ---

def test_top_k_against_all_scores(spark):
    draw = np.random.default_rng(2)
    vectors = [(int(i), [float(x) for x in draw.normal(size=8)]) for i in range(2500)]
    vectors += [(50, None), (100, [float("nan")] * 8), (101, [1.0, None] + [0.0] * 6), (None, [9.0] * 8), (150, [0.0] * 8),
                (2501, [float("inf")] * 8), (2502, [1e30] * 8), (3, vectors[3][1]), (2600, [0.5, 0.5]), (2650, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").select(
        "vec_id", topk.whole_components(F.col("embedding")).alias("vector"))
    queries = df.where(F.col("vec_id") % 50 == 0)
    kept = [(r["vec_id"], r["vector"]) for r in df.collect() if r["vec_id"] is not None and r["vector"] is not None]
    assert not {2501, 101} & {i for i, _ in kept if i > 100 and i in (101, 2501) and vectors[i][0] != i}
    dot = lambda a, b: max(1 - (1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(a, b))))
    asked = {(i, tuple(v)) for i, v in kept if i % 50 == 0}
    want = defaultdict(list)
    for i, v in asked:
        want[i] += sorted(((-dot(v, w), j) for j, w in kept if j != i))[:5]
    got = defaultdict(list)
    for r in topk.top_k(df, queries, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    assert {i: got[i] for i in want} == {i: sorted(x)[:5] for i, x in want.items()}
    assert topk.top_k(df.limit(0), queries.limit(0), k=5).count() == 0
    few = df.where("vec_id < 3")
    assert topk.top_k(few, few.where("vec_id = 0"), k=5).count() == 2


def test_top_k_of_large_components_is_exact(spark, monkeypatch):
    """Components past 2**27 and 2**53, whose products pass 64 bits, between others that differ in the last unit."""
    monkeypatch.setattr(topk, "DEPTH", 2)
    draw = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in draw.normal(size=4) * 10.0 ** draw.integers(-1, 8)]) for i in range(120)]
    vectors += [(120 + i, [3e7 + i / 256, -1e16, 2e7, 1.0]) for i in range(5)] + [(130 + i, [1e12, 1.0, float(i), 0.0]) for i in range(3)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").select("vec_id", topk.whole_components(F.col("embedding")).alias("vector"))
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors}
    cut = lambda x: max(1 - (1 << 63), min((1 << 63) - 1, x))
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 10 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    for i in got:
        scores = sorted(((-sum(a * b for a, b in zip(whole[i], whole[j])), j) for j in whole if j != i))[:5]
        assert sorted(got[i]) == sorted((cut(-s), j) for s, j in scores)


def test_blocks_and_groups_do_not_matter(spark, monkeypatch):
    draw = np.random.default_rng(4)
    df = spark.createDataFrame([(int(i), [int(x) for x in draw.integers(-3, 4, 4)]) for i in range(400)], "vec_id long, vector array<long>").withColumn("vector", F.col("vector").cast("array<double>"))
    ask = lambda: sorted(map(tuple, topk.top_k(df, df.where("vec_id % 7 = 0"), k=4).collect()))
    whole = ask()
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "GROUP", 9)
    assert ask() == whole


# --- near-duplicates ---

def brute_components(docs):
    """Component of every id by comparing all pairs; docs: id to text."""
    sets = {}
    for i, text in docs.items():
        ws = [w.lower() for w in (text or "").encode().split()]
        sets[i] = {tuple(ws[k:k + 5]) for k in range(max(len(ws) - 4, 1))} if ws else set()
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sorted(docs), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: find(i) for i in docs}, {i: len(s) for i, s in sets.items()}


def variants(seed, n):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randint(0, 3000)}"
    passage, docs = [word() for _ in range(60)], []
    for _ in range(n // 6):
        base = [word() for _ in range(draw.choice([3, 5, 12, 60, 200]))]
        docs.append(base)
        for _ in range(4):
            own = list(draw.choice(docs[-3:]))
            for _ in range(draw.randint(0, max(1, len(own) // 30))):
                own[draw.randrange(len(own))] = word()
            docs.append(own)
        docs.append(passage + [word() for _ in range(draw.choice([15, 40, 80]))])
    draw.shuffle(docs)
    return {i: " ".join(d).upper() if i % 5 == 0 else "\n".join(d) for i, d in enumerate(docs)}


@pytest.mark.parametrize("block", [1000, 7])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "GROUP", 3 if block == 7 else 300)
    docs = variants(block, 360)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want, sizes = brute_components(docs)
    rows = neardup.near_duplicates(df).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in rows} == {
        i: (c, sizes[i], c == i) for i, c in want.items()}


def test_cells_hold_two_blocks_and_give_links_only(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 10)
    n = 60
    # texts of 100 words, each 84 to 89 words of one text and words of its own: similarities on both sides of the threshold
    common_ = [f"c{k}" for k in range(100)]
    docs = {i: " ".join(common_[:84 + i % 6] + [f"o{i}-{k}" for k in range(16 - i % 6)]) for i in range(n)}
    want = brute_components(docs)[0]
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(96)} for i, t in docs.items()}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    signed = df.mapInPandas(neardup.signer(5, neardup.ROWS), neardup.SIGNED)
    members = signed.select(F.lit(1).cast("long").alias("bucket"), F.col("doc_id").alias("rep"), F.col("doc_id").alias("label"),
                            "n_shingles", "signature")
    cells = []
    monkeypatch.setattr(neardup, "stored", lambda rows, name: cells.append((name, stored(rows, name))) or cells[-1][1])
    links = [tuple(r) for r in neardup.unsettled(members, df, 5, 75).collect()]
    held = dict(cells)["neardup-cells"].groupBy("bucket", "x", "y").agg(F.countDistinct("block").alias("blocks"), F.count("*").alias("n"))
    assert all(r["blocks"] <= 2 and r["n"] < n for r in held.collect())
    assert all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in links)
    labels = {i: i for i in docs} | {r["node"]: r["label"] for r in components.components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert labels == want


def test_near_duplicate_edges(messy, empty):
    rows = neardup.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    found = {r["doc_id"]: (r["component_id"], r["kept"]) for r in rows}
    assert found[1] == (1, True) and found[2] == (1, False) and found[None] == (None, True)
    assert found[3] == (3, True) and found[4] == (4, True) and found[5] == (5, True) and found[9] == (6, False)
    assert neardup.near_duplicates(empty).count() == 0
    left = neardup.one_of_each(messy)
    assert left.columns == messy.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 10, 11] and ids.count(None) == 2
    assert neardup.one_of_each(empty).count() == 0


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        a = draw.integers(0, 2**63, 300).astype(np.uint64)
        same = int(draw.integers(100, 300))
        b = np.concatenate([a[:same], draw.integers(0, 2**63, 300 - same).astype(np.uint64)])
        s = neardup.super_minhash(np.concatenate([a, b]), np.array([0, 300, 600]))
        errors.append((s[0] == s[1]).mean() - same / (600 - same))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    small = neardup.super_minhash(np.arange(1, 4, dtype=np.uint64), np.array([0, 1, 1, 3]))
    assert (small[[0, 2]] < np.iinfo(np.uint64).max).all() and (small[1] == np.iinfo(np.uint64).max).all()


def test_components_of_chains_and_stars(spark, monkeypatch):
    monkeypatch.setattr(components, "LINKS_PER_TASK", 10)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(500, 500 + i) for i in range(1, 40)] + [(540, 520)]
    random.Random(1).shuffle(chain)
    df = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    labels = {r["node"]: r["label"] for r in components.components(df).collect()}
    assert labels == {i: 0 for i in range(61)} | {i: 500 for i in range(500, 541)}
    assert components.components(df.limit(0)).count() == 0


def test_links_of_a_hub_are_spread(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 401)], "a long, b long")
    sizes = [r["count"] for r in components.spread(star, 4).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 200


# --- rollups ---

def test_rollup_commits_once(spark):
    rows = spark.createDataFrame(
        [("a", "en", "t1", 5), ("a", "en", "t1", 7), (None, None, "t1", 2), ("b", "en", "t1", 3)],
        "source string, lang string, tokenizer string, tokens long")
    kept = rollup.Rollup(spark, fresh_path(spark, "rollup-test"))
    assert kept.commit("one", rollup.inserted(rows)) and not kept.commit("one", rollup.inserted(rows))
    total = lambda r, ids: {(x["source"], x["lang"], x["tokenizer"]): (x["documents"], x["tokens"]) for x in r.totals(ids).collect()}
    assert total(kept, ["one"]) == {("a", "en", "t1"): (2, 12), (None, None, "t1"): (1, 2), ("b", "en", "t1"): (1, 3)}
    kept.commit("two", rollup.deleted(rows.where("tokens = 3")))
    after = rows.where("tokens = 7").withColumn("tokens", F.lit(9)).withColumn("tokenizer", F.lit("t2"))
    kept.commit("three", rollup.revised(rows.where("tokens = 7"), after))
    kept.commit("none", rollup.inserted(rows.limit(0)))
    ids = ["one", "two", "three", "none", "never"]
    want = {("a", "en", "t1"): (1, 5), ("a", "en", "t2"): (1, 9), (None, None, "t1"): (1, 2)}
    assert total(kept, ids) == want
    other = kept.fold(ids, fresh_path(spark, "rollup-test"))
    assert total(other, ids) == want and not other.commit("two", rollup.inserted(rows))
    assert other.commit("four", rollup.inserted(rows.where("source = 'b'"))) and total(other, [*ids, "four"])["b", "en", "t1"] == (1, 3)


def test_rollup_without_success_mark_is_written_again(spark):
    kept = rollup.Rollup(spark, fresh_path(spark, "rollup-test"))
    rows = spark.createDataFrame([("a", "en", "t1", 5)], "source string, lang string, tokenizer string, tokens long")
    rollup.inserted(rows).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(kept.folder("one"))
    assert not kept.committed("one") and kept.totals(["one"]).isEmpty()
    assert kept.commit("one", rollup.inserted(rows)) and kept.totals(["one"]).first()["tokens"] == 5


def test_rollup_query_against_counting(spark, sf):
    from cardwatch.llm.common import ByteBpe
    from cardwatch.llm.packing import tokenizer_file

    bpe = ByteBpe(tokenizer_file())
    seen, want = set(), defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        if r["text"] in seen:
            continue
        seen.add(r["text"])
        text = "\n".join(dict.fromkeys((r["text"] or "").split("\n")))
        for name, n in (("words-1", len(text.encode().split())), ("byte-bpe-50k-1", len(bpe.whole(text)) // bpe.kind.itemsize)):
            want[r["source"], r["lang"], name][0] += 1
            want[r["source"], r["lang"], name][1] += n
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["documents"], r["tokens"]] for r in rollup.op7_rollup(spark, sf).collect()}
    assert got == dict(want)


# --- language model ---

def test_gradients_against_differences(monkeypatch):
    monkeypatch.setattr(lm, "TAILS", 5)
    monkeypatch.setattr(lm, "HIDDEN", 4)
    draw = np.random.default_rng(1)
    net = lm.Network(np.array([5.0, 4, 3, 2, 2, 1, 1]), np.array([3.0, 1, 2, 2, 1]), 0)
    net.p = {k: (v + draw.normal(0, 0.3, v.shape) * (v > -100)).astype(np.float64) for k, v in net.p.items()}
    docs = [draw.integers(0, 12, n).astype(np.int32) for n in (3, 6, 0, 2)]
    inputs, resets, targets, real, _, _ = lm.laid_out(docs, 2)
    h = draw.normal(size=(2, 4))

    def loss():
        states, _, _ = net.states(inputs, resets, h)
        return -net.outputs(states.reshape(-1, 4)[real.reshape(-1)].astype(np.float64), targets.reshape(-1)[real.reshape(-1)]).mean()

    slopes, _, types = net.step(inputs, resets, targets, real, h)
    met, slopes["E"] = slopes["E"], np.zeros_like(net.p["E"])
    slopes["E"][types] = met
    for name, g in slopes.items():
        flat, own = net.p[name].reshape(-1), g.reshape(-1)
        for k in draw.choice(len(flat), 6):
            if flat[k] < -100:
                continue
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - own[k]) < 2e-3, name


def test_next_token_probabilities_sum_to_one():
    head = [(f"w{i}".encode(), 100 - i) for i in range(70)] + [(lm.END, 30)]
    scorer = lm.Scorer(head, 5000, 200, {k: (40, 4) for k in range(lm.TAILS)})
    net, size = scorer.network, scorer.network.n_words + lm.TAILS
    state = np.random.default_rng(0).normal(size=(1, lm.HIDDEN)).astype(np.float32).repeat(size, axis=0)
    net.p["C"] += 0.1
    assert math.isclose(np.exp(net.outputs(state, np.arange(size))).sum(), 1, rel_tol=1e-4)


def test_lanes_do_not_matter(monkeypatch):
    head = [(f"w{i}".encode(), 100 - i) for i in range(70)] + [(lm.END, 30)]
    scorer = lm.Scorer(head, 5000, 200, {k: (40, 4) for k in range(lm.TAILS)})
    scorer.network.p["W"] += np.random.default_rng(0).normal(0, 0.3, scorer.network.p["W"].shape).astype(np.float32)
    docs = [scorer.read(" ".join(f"w{(i * j) % 90}" for j in range(n)))[0] for i, n in enumerate((0, 3, 100, 40, 7))]
    many = scorer.score(docs)
    monkeypatch.setattr(lm, "LANES", 1)
    monkeypatch.setattr(lm, "WINDOW", 5)
    assert np.allclose(many, scorer.score(docs), rtol=1e-4)


def check_scores(rows, docs, held):
    counts = Counter()
    tokens = {k: [w.lower() for w in (t or "").encode().split()] + [b""] for k, (_, t) in enumerate(docs)}
    for k, (doc, _) in enumerate(docs):
        if doc is not None and not held(doc):
            counts.update(tokens[k])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for k, (doc, _) in enumerate(docs):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[k])
        want[doc, len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), n, round(base, 4)] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows)
    assert got == want
    assert all(r["score"] <= 1e-6 and math.isfinite(r["score"]) for r in rows)


def test_lm_query(spark, sf):
    rows = lm.op9_lm(spark, sf, learn_tokens=60_000).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_scores(rows, docs, lambda d: zlib.crc32(str(d).encode()) % 10 == 0)
    apart = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart)


def test_learning_grows_with_the_counted_tokens(monkeypatch, spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(lm, "TASK_TOKENS", 20_000)
    dealt = []
    monkeypatch.setattr(lm, "stored", lambda df, name: dealt.append((name, stored(df, name))) or dealt[-1][1])
    scorer, counts = lm.learn(docs, learn_tokens=10_000, seed=1, learn_share=0.4)
    learned = sum(len(r["types"]) // 4 + 1 for r in dict(dealt)["lm-dealt"].collect())
    assert 0.3 * scorer.n < learned < 0.5 * scorer.n and learned > 20_000
    assert len(scorer.neural) == 1 + int(2048 * (int(0.4 * scorer.n) / 10_000) ** 0.5)
    plain = lm.learn(docs, learn_tokens=10_000, seed=1, learn_share=0.0)[0]
    assert len(plain.neural) == 2049
    total = lambda s: lm.scores(docs, s, counts).agg(F.sum("score")).first()[0]
    assert total(scorer) > total(plain)


def test_lm_query_learns_from_every_token(monkeypatch, spark):
    """In several passes over few tokens, and in one pass over more: no learned document is left out."""
    for few in (lm.FEW_TOKENS, 50_000):
        monkeypatch.setattr(lm, "FEW_TOKENS", few)
        dealt = []
        monkeypatch.setattr(lm, "stored", lambda df, name: dealt.append((name, stored(df, name))) or dealt[-1][1])  # noqa: B023
        rows = lm.op9_lm(spark, "/root/testdata/sf0.01", learn_tokens=10_000).collect()
        kept = dict(dealt)["lm-dealt"].collect()
        assert sum(len(r["types"]) // 4 + 1 for r in kept) == rows[0]["train_tokens"]
        assert len(kept) == sum(not r["held_out"] for r in rows)
        assert {r["slice"] for r in kept} == set(range(lm.SLICES if few > 50_000 else lm.EPOCHS * lm.SLICES))
        apart = [r for r in rows if r["held_out"]]
        assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart)


def test_every_token_is_passed_over_in_every_epoch_at_any_size(monkeypatch, spark, sf):
    """Few tokens and many: a round for each slice in each of the passes, at rates that fall to the last round."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plain = lm.rates
    for few, slices in ((lm.FEW_TOKENS, lm.SLICES), (1000, lm.EPOCHS * lm.SLICES)):
        monkeypatch.setattr(lm, "FEW_TOKENS", few)
        met, dealt = [], []
        monkeypatch.setattr(lm, "rates", lambda *a: met.append(a) or plain(*a))  # noqa: B023
        monkeypatch.setattr(lm, "stored", lambda df, name: dealt.append((name, stored(df, name))) or dealt[-1][1])  # noqa: B023
        lm.learn(docs, learn_tokens=10_000, seed=1, learn_share=1.0)
        assert {r["slice"] for r in dict(dealt)["lm-dealt"].select("slice").distinct().collect()} == set(range(slices))
        assert [a[0] for a in met] == list(range(lm.EPOCHS * slices)) and {a[1:] for a in met} == {(lm.EPOCHS * slices,)}
    falling = [plain(k, 36) for k in range(36)]
    assert falling[0][0] == lm.RATE and all(a[1] == b[0] and a[0] >= a[1] for a, b in zip(falling, falling[1:]))


def test_more_tasks_learn_as_well_as_one(monkeypatch, spark):
    """The gain over the base on documents not learned from, with eight tasks and with one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("doc_id < 3000")
    of_model, apart = docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 = 0")
    gains = []
    for tasks in (1, 8):
        monkeypatch.setattr(lm, "TASK_TOKENS", 200_000 // tasks)
        scorer, counts = lm.learn(of_model, learn_tokens=200_000, seed=1)
        gains.append(lm.scores(apart, scorer, counts).agg(F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).first()[0])
    assert gains[0] > 0.2 and gains[1] > 0.95 * gains[0]


def test_lm_edges(messy, empty):
    for df in (messy, empty):
        docs = df.select("doc_id", "text")
        scorer, counts = lm.learn(docs.where("doc_id is not null"), learn_tokens=5000, seed=1)
        check_scores(lm.scores(docs, scorer, counts).collect(), [tuple(r) for r in docs.collect()], lambda d: False)
    scorer, counts = lm.learn(empty.select("doc_id", "text"), learn_tokens=5000, seed=1)
    assert {r["base_score"] for r in lm.scores(messy.select("doc_id", "text"), scorer, counts).collect()} == {0.0}


# --- pipeline ---

def test_stages_pass_messy_and_empty_rows(spark, sf, messy, empty):
    for df in (messy, empty):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            if name != "packing":
                assert docs.schema.simpleString() == df.schema.simpleString(), name
        assert docs.count() >= 0


def test_pipeline_decisions(spark, sf):
    """Every stage keeps what its operator says and drops the rest; the last packs every row of the mix."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        kept[name] = docs
        assert docs.select("doc_id").exceptAll(before.select("doc_id").unionAll(before.select("doc_id"))).isEmpty()
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in kept.items()}
    assert good <= set(ids["quality"]) and len(bad & set(ids["quality"])) <= 0.2 * len(bad)
    texts = {r["doc_id"]: r["text"] for r in kept["language"].select("doc_id", "text").collect()}
    want, _ = brute_components(texts)
    assert sorted(ids["near_duplicates"]) == sorted(i for i, c in want.items() if i == c)
    assert max(Counter(ids["mixing"]).values()) <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept["mixing"], sf).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(ids["mixing"])
