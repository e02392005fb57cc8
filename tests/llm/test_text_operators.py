"""Quality rules, language, quality, licenses, packing: brute force, round trips, accuracy, edges."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardwatch.llm import common, language, licenses, packing, quality, repetition
from cardwatch.runtime import stored


def tokenizer():
    import public_tokenizers

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def texts(spark, sf):
    return [r[0] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


# --- tokens ---

def test_ids_equal_the_tokenizers_own(spark, sf):
    bpe, own = common.ByteBpe(packing.tokenizer_file()), tokenizer()
    odd = ["", " ", "  a", " a b", "a  b", "a\n b", "don't  stop's '", "x y z", "a  b", "a <|endoftext|> b", "\U0001f600 hé  b "]
    for part in (odd, texts(spark, sf)):
        want = [own.encode(t, add_special_tokens=False).ids for t in part]
        assert [np.frombuffer(x, bpe.kind).tolist() for x in bpe.encode(part)] == want


def test_added_tokens_keep_their_ids(spark):
    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x  y", "a<|endoftext|>\n b <|endoftext|", "", "no mark"]
    want = [own.encode(t, add_special_tokens=False).ids for t in odd]
    assert want[0] == [64, 220, 50256, 275]
    bpe = common.ByteBpe(packing.tokenizer_file(), added=True)
    assert [np.frombuffer(x, bpe.kind).tolist() for x in bpe.encode(odd)] == want
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [[] for _ in odd]
    for r in sorted(packing.pack(df).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]] += np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    assert got == [ids + [0] for ids in want]


# --- repetition ---

def longest(ws):
    found = [0] * len(ws)
    for i, j in itertools.permutations(range(len(ws)), 2):
        k = 0
        while max(i, j) + k < len(ws) and ws[i + k] == ws[j + k]:
            k += 1
        found[i] = max(found[i], k)
    return found


def test_longest_repeats_against_all_pairs():
    draw = random.Random(3)
    for _ in range(150):
        docs = [[draw.choice("abc"[:draw.randint(1, 3)]) for _ in range(draw.randint(0, 20))] for _ in range(draw.randint(1, 4))]
        sizes = [len(d) for d in docs]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        document = np.repeat(np.arange(len(docs)), sizes)
        codes = document * 1000 + np.array([ord(c) for d in docs for c in d], np.int64)
        assert repetition.longest_repeats(codes, starts[1:][document]).tolist() == sum((longest(d) for d in docs), [])


def base_counts(text):
    text = text or ""
    ws = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    windows = Counter(zip(ws, ws[1:], ws[2:]))
    at = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i:i + 3])] > 1 for k in range(3)}
    failed = len(ws) < 50 or 100 * len(at) > 50 * len(ws)
    return (len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(at), failed)


def test_repetition_on_messy_rows(messy, empty):
    rows = repetition.repetition(messy).collect()
    assert len(rows) == messy.count()
    given = {r["doc_id"]: r["text"] for r in messy.collect() if r["doc_id"] is not None}
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_counts(
                given[r["doc_id"]])
        assert r["n_covered"] == sum(s["stop"] - s["start"] for s in r["spans"])
    assert repetition.repetition(empty).count() == 0


def test_repetition_verdicts(spark):
    word = lambda i: f"w{i}"
    clean = " ".join(map(word, range(300)))
    once = " ".join([*map(word, range(200)), *map(word, range(20)), *map(word, range(300, 400))])
    block = " ".join([*map(word, range(120)), *map(word, range(1000, 1100)), *map(word, range(120))])
    df = spark.createDataFrame([(1, clean), (2, once), (3, block)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in repetition.repetition(df).collect()}
    assert found[1]["kept"] and found[1]["longest_repeat"] == 0
    assert found[2]["kept"] and found[2]["longest_repeat"] == 20 and found[2]["n_covered"] == 40
    assert not found[3]["kept"] and found[3]["longest_repeat"] == 120
    assert [(s["start"], s["stop"]) for s in found[3]["spans"]] == [(0, 120), (220, 340)]


# --- language ---

@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    code = language.codewords(n, 1)
    assert code.shape[0] == n and len({tuple(r) for r in code}) == n
    if n > 1:
        assert (abs(code.sum(axis=0)) < n).all()


def test_grams_do_not_depend_on_parts(monkeypatch):
    data = b" some words of a text that is cut into parts "
    whole = np.sort(np.concatenate(list(language.grams(data))))
    monkeypatch.setattr(language, "PART", 7)
    assert (np.sort(np.concatenate(list(language.grams(data)))) == whole).all()


def test_language_accuracy_and_edges(spark, messy, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    found = language.op5_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98
    model = language.learn(docs, learn_rows=500, seed=1)
    rows = language.languages(messy, model).collect()
    assert len(rows) == messy.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for k in (3, 4, 5, 7):
        assert (by_id[k]["lang_pred"], by_id[k]["score"]) == ("und", 0.0)
    assert by_id[1]["lang_pred"] in model.languages and 0 < by_id[1]["score"] <= 1
    assert language.languages(empty, model).count() == 0
    assert language.learn(empty.select("doc_id", "text", "lang"), learn_rows=5, seed=1) is None
    assert {r["lang_pred"] for r in language.languages(messy, None).collect()} == {"und"}
    one = language.learn(docs.where("lang = 'en'"), learn_rows=50, seed=1)
    assert {r["lang_pred"] for r in language.languages(messy, one).collect()} == {"en", "und"}


def test_inputs_other_than_text_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.learn(docs, learn_rows=100, seed=1)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 7)
    answer = lambda df: sorted((r["lang_pred"], r["score"]) for r in language.languages(df, model).collect())
    assert answer(docs) == answer(other)


# --- quality ---

def chain(emission, transition):
    """Log-partition and marginals of one chain by listing all labellings."""
    n = len(emission)
    total, marginal, pairs = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
    for ys in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(emission[t, y] for t, y in enumerate(ys)) + sum(transition[a, b] for a, b in itertools.pairwise(ys)))
        total += p
        for t, y in enumerate(ys):
            marginal[t, y] += p
        for a, b in itertools.pairwise(ys):
            pairs[a, b] += p
    return np.log(total), marginal / total, pairs / total


def test_forward_backward_against_listing():
    random_ = np.random.default_rng(5)
    sizes = [1, 4, 2, 6]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    emission, transition = random_.normal(size=(starts[-1], 2)) * 3, random_.normal(size=(2, 2))
    logs, marginal, pairs = quality.Chains(starts).run(emission, transition)
    want = [chain(emission[a:b], transition) for a, b in itertools.pairwise(starts)]
    assert np.isclose(logs, sum(w[0] for w in want))
    assert np.allclose(marginal, np.vstack([w[1] for w in want]))
    assert np.allclose(pairs, sum(w[2] for w in want))


def test_quality_accuracy_and_edges(spark, messy, empty, labels):
    sf = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    found = quality.op6_quality(spark, sf).join(known, "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0]
    assert right > 0.93
    model = quality.learn(messy.select("doc_id", "text"), quality.allowed(labels), learn_rows=10, seed=1)
    rows = quality.quality(messy, model).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    kept = quality.good_ones(messy, model)
    assert kept.columns == messy.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert quality.quality(empty, model).count() == 0 and quality.good_ones(empty, model).count() == 0
    only = quality.learn(messy.select("doc_id", "text"), labels.where("quality = 1"), learn_rows=10, seed=1)
    assert only == 1.0 and quality.learn(empty.select("doc_id", "text"), labels, learn_rows=10, seed=1) == 0.5
    assert {r["score"] for r in quality.quality(messy, 0.5).collect()} == {0.5}


def test_late_junk_of_long_documents_is_learned():
    lines = np.arange(5000)
    found = quality.stretches(lines, [42, 7], 1000)
    assert sum(map(len, found)) == 1000 and max(map(max, found)) >= 1000
    again = quality.stretches(lines, [42, 7], 1000)
    assert [x.tolist() for x in found] == [x.tolist() for x in again]
    assert [x.tolist() for x in quality.stretches(lines[:1000], [42, 7], 1000)] == [list(range(1000))]


# --- licenses ---

def test_licenses(spark, messy, empty):
    rows = [
        (1, "some words here\nReleased under the MIT License.\nmore of it"), (2, "Licensed under the Apache License, Version 2.0."),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"),
        (4, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
        (5, "He was released under the care of a doctor. The driver lost his license."), (6, "Mit."), (7, None),
        (8, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = licenses.learn(corpus, learn_rows=1000, seed=42)
    found = {r["doc_id"]: [(x["line"], x["family"]) for x in r["found"] if x["confirmed"]] for r in licenses.licenses(df, model).collect()}
    assert found == {1: [(1, "MIT")], 2: [(0, "Apache-2.0")], 3: [(0, "MIT")], 4: [(0, "GPL")], 5: [], 6: [], 7: [], 8: [(0, "CC-BY-NC")]}
    assert licenses.licenses(messy, model).count() == messy.count() and licenses.licenses(empty, model).count() == 0
    assert licenses.learn(empty.select("doc_id", "text"), learn_rows=10, seed=1).limit >= 0.5


def test_licenses_are_learned_from_every_line(spark, monkeypatch):
    """Examples and limits together take every line of every document once, also of long ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    given = sum(2 for r in docs.collect() for x in (r["text"] or "").split("\n") if (w := licenses.terms(x)) and not licenses.declares(w))
    tables = {}
    monkeypatch.setattr(licenses, "stored", lambda df, name: tables.setdefault(name, stored(df, name)))
    model = licenses.learn(docs, seed=42)
    lines = tables["license-lines"].agg(F.sum("n")).first()[0]
    apart = tables["license-values"].where("kind = 2").agg(F.sum("n")).first()[0]
    assert lines + apart == given and 0.3 * given < lines < 0.7 * given
    best = [r for r in tables["license-values"].where("kind = 0").collect() if r["value"] > model.limit]
    assert sum(r["n"] for r in best) <= licenses.FALSE_SHARE * apart or model.limit == 0.95


def test_notices_beside_other_words(spark):
    mit = " ".join(["MIT License Copyright (c) 2020 Jane Doe", *licenses.TEMPLATES["MIT"][4:], *licenses.WARRANTIES["MIT"]])
    prose = "The river ran past the old mill and the children played by the water until evening came over the hills. "
    lines = [
        ("MIT", "Copyright (c) 2020 Jane Doe. Released under the MIT License."), ("MIT", mit),
        ("Apache-2.0", "Copyright 2021 Acme Corp. SPDX-License-Identifier: Apache-2.0"),
        ("MIT", prose + "Released under the MIT License. " + prose),
        ("Apache-2.0", prose + "Licensed under the Apache License, Version 2.0. " + prose),
        ("none", prose + "She was granted a license to use the boat under the terms of the agreement. " + prose),
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = licenses.learn(docs, learn_rows=1000, seed=42)
    got = [{x[1] for x in model.scan(t) if x[4]} for _, t in lines]
    assert got == [{f} if f != "none" else set() for f, _ in lines]


def test_near_licenses_and_denials_are_not_confirmed(spark):
    others = [
        "Licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the Eclipse Public License 2.0.", "Licensed under the Apache License, Version 1.1.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "This project is not released under the MIT License.", "It is no longer licensed under the terms of the MIT License.",
        "Copyright 2020 Jane Doe. Released under the Foo Public License 2.0.",
    ]
    own = {
        "GPL": "Copyright 2020 Jane Doe. Released under the GNU General Public License.", "MIT": "We are happy to say: Released under the MIT License.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "MPL-2.0": "Released under the Mozilla Public License 2.0.",
    }
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("doc_id < 4000")
    model = licenses.learn(docs, learn_rows=1000, seed=42)
    assert [line for line in others if any(x[4] for x in model.scan(line))] == []
    for family, line in own.items():
        assert [x[1] for x in model.scan(line) if x[4]] == [family], line


def test_license_query_finds_the_given_lines(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    lines = {"MIT": "Released under the MIT License", "Apache-2.0": "Apache License, Version 2.0", "GPL": "GNU General Public License"}
    joined = licenses.op2_licenses(spark, sf).join(docs, "doc_id").collect()
    for r in joined:
        given = [f for f, line in lines.items() if line in (r["text"] or "")]
        assert not given or r["family"] in given
        assert r["family"] not in lines or r["family"] in given


# --- packing ---

def test_hilbert_neighbours_differ_by_one_step():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = packing.hilbert(points, bits)
        assert sorted(key) == list(range(len(points)))
        steps = np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def check_pieces(pieces, docs):
    """Pieces hold every document's ids and its end once, sequences are gapless, full or a power of two."""
    own = tokenizer()
    want = Counter()
    for doc, text in docs:
        want[doc, tuple(own.encode(text or "", add_special_tokens=False).ids + [0])] += 1
    got = Counter()
    for doc in {d for d, _ in docs}:
        rows = sorted((r for r in pieces if r["doc_id"] == doc), key=lambda r: r["start"])
        sizes = {r["doc_tokens"] for r in rows}
        for size in sizes:  # documents of one id and length are told apart by their texts only
            parts = [r for r in rows if r["doc_tokens"] == size]
            copies = sum(v for (d, ids), v in want.items() if d == doc and len(ids) == size)
            assert sum(r["length"] for r in parts) == size * copies
            if copies == 1:
                ids = b"".join(bytes(r["ids"]) for r in parts)
                assert [r["start"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1])
                got[doc, tuple(np.frombuffer(ids, "<u4").tolist())] += 1
    assert all(v == want[k] for k, v in got.items())
    for _, rows in itertools.groupby(sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in rows:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == 1024 or at & (at - 1) == 0


def test_packing_round_trip(spark, sf, messy, empty):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), messy):
        pieces = packing.pack(df).collect()
        check_pieces(pieces, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert packing.pack(empty).count() == 0


def test_packing_over_several_ranges(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "IDS_PER_RANGE", 20_000)
    monkeypatch.setattr(packing, "BLOCK", 500)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = packing.pack(df).collect()
    assert len({r["sequence_id"] >> 33 for r in pieces}) > 2
    check_pieces(pieces, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    digest = packing.op3_pack(spark, sf).limit(5).collect()
    assert all(0 <= r["ids_crc32"] < 1 << 32 for r in digest) and zlib.crc32(b"") == 0
