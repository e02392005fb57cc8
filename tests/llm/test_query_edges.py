"""Whole queries on tables with nulls, repeated rows, empty texts and clashing columns, and on empty tables."""

from collections import Counter

from pyspark.sql import functions as F

from cardwatch.llm import licenses, rollup, topk


def put(path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_rollup_of_messy_and_empty_tables(spark, messy, empty, tmp_path):
    got = {
        (r["source"], r["lang"]): (r["documents"], r["tokens"])
        for r in rollup.op7_rollup(spark, put(tmp_path / "messy", documents=messy)).where("tokenizer = 'words-1'").collect()
    }
    rows = [(r["doc_id"], r["source"], r["lang"], r["text"]) for r in messy.collect()]
    first = {}
    for doc, _, _, text in rows:
        if text is not None and doc is not None:
            first[text] = min(doc, first.get(text, doc))
    documents, tokens = Counter(), Counter()
    for doc, source, lang, text in rows:
        if text is None or doc is None or first[text] == doc:
            once = "\n".join(dict.fromkeys((text or "").split("\n")))
            documents[source, lang] += 1
            tokens[source, lang] += len(once.encode().split())
    assert {k: v for k, v in got.items() if v != (0, 0)} == {k: (n, tokens[k]) for k, n in documents.items()}
    assert rollup.op7_rollup(spark, put(tmp_path / "empty", documents=empty)).count() == 0


def test_licenses_of_messy_and_empty_tables(spark, messy, empty, tmp_path):
    found = licenses.op2_licenses(spark, put(tmp_path / "messy", documents=messy)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in messy.collect())
    assert licenses.op2_licenses(spark, put(tmp_path / "empty", documents=empty)).count() == 0


def test_search_in_tables_with_clashing_columns(spark, tmp_path):
    rows = [(0, [1.0, 0.5]), (50, [0.25, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [None, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (4, [2.0 ** 40, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("block", "group", "query", "cell", "vector", "score", "rank", "query_id"):
        df = df.withColumn(name, F.lit("clash"))
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.op4_topk(spark, put(tmp_path / "some", embeddings=df)).collect()]
    whole = [(i, [int(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and None not in v]
    want = []
    for i, v in whole[:2]:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i)
        want += [(i, k, j, -s) for k, (s, j) in enumerate(scores[:5], 1)]
    assert sorted(found) == sorted(want)
    assert topk.op4_topk(spark, put(tmp_path / "none", embeddings=df.limit(0))).count() == 0
