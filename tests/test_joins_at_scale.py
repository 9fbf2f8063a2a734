"""Joins that hold for any number of keywords or queries, against brute force."""

import random

from pyspark.sql import functions as F

from ticketloom.operators import retrieval as R
from ticketloom.operators import substrings as S


def test_ten_thousand_keywords(spark):
    """Words of one to many characters, of a few letters so that grams are shared, and of other planes; repeated and null ids."""
    rng = random.Random(5)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i // 2 if i % 9 else None, word(rng.randint(0, 300), "abcde 退款😀")) for i in range(200)] + [(7, None), (8, ""), (9, "ab" * 30_000), (9, "ab" * 30_000)]
    keys = {word(rng.randint(1, 12), "abcde 退款😀") for _ in range(14_000)} | {texts[5][1][3:90], "zzzz", "ab" * 900, "", None}
    assert len(keys) > 10_000
    want = {(k, i) for i, t in texts if t for k in keys if k and k in t}
    t = spark.createDataFrame(texts, "id long, text string").repartition(3)
    got = [tuple(r) for r in S.keyword_join(t, spark.createDataFrame([(k,) for k in keys], "keyword string")).collect()]
    assert set(got) == want and {len(k) for k, _ in want} >= {1, 2, 3, 4, 5, 87, 1800}


def test_no_keywords_no_texts(spark):
    t, k = spark.createDataFrame([(1, "abc")], "id long, text string"), spark.createDataFrame([("b",)], "keyword string")
    assert S.keyword_join(t, k.limit(0)).count() == 0 and S.keyword_join(t.limit(0), k).count() == 0
    assert [tuple(r) for r in S.keyword_join(t, k.unionByName(k)).collect()] == [("b", 1)]


def test_texts_of_one_hash_are_both_looked_at(spark, monkeypatch):
    monkeypatch.setattr(S, "text_hash", lambda c: F.unhex(F.lit("00")))
    t = spark.createDataFrame([(1, "refund"), (2, "returns"), (3, "other")], "id long, text string")
    k = spark.createDataFrame([("refund",), ("turn",), ("the",)], "keyword string")
    assert {tuple(r) for r in S.keyword_join(t, k).collect()} == {("refund", 1), ("turn", 2), ("the", 3)}


def test_a_gram_of_no_text_settles_a_keyword(spark):
    t = spark.createDataFrame([(i, f"the refund of order {i}") for i in range(50)], "id long, text string")
    k = spark.createDataFrame([("the refund of order 7",), ("the refund of order x7",)], "keyword string")
    assert {tuple(r) for r in R.keyword_hits(t, k, block=0).collect()} == {("the refund of order 7", 7)}


def _cosines(chunks, queries, k, least):
    import numpy as np

    u = lambda v: np.asarray(v) / max(np.linalg.norm(v), 1e-300)
    want = {}
    for q, v in queries:
        s = sorted((-round(float(u(v) @ u(w)), 6), d) for d, w in chunks if len(w) == len(v))
        want[q] = [(d, -x) for x, d in s if -x >= least][:k]
    return {(q, d, n) for q, rows in want.items() for n, (d, _) in enumerate(rows, 1)}


def test_clustered_search(spark):
    """Tight clusters, copies that fill a block, zeros, two lengths, fewer than k rows; the bounds leave out most blocks."""
    import numpy as np

    from ticketloom.operators import clustered as C

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    chunks = [(i, (centres[i % 12] + 0.05 * rng.normal(size=16)).tolist()) for i in range(1200)]
    chunks += [(2000 + i, centres[0].tolist()) for i in range(300)] + [(3000, [0.0] * 16), (3001, [1.0, 2.0]), (3002, [2.0, 1.0])]
    queries = [(i, (centres[i % 12] + 0.05 * rng.normal(size=16)).tolist()) for i in range(40)] + [(50, centres[0].tolist()), (51, [0.0] * 16), (52, [1.0, 1.0]), (53, [1.0] * 3)]
    c = spark.createDataFrame(chunks, "id long, v array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query long, vector array<double>")
    for k, least in ((3, 0.35), (5, -1.0)):
        rows, met = C.clustered_search(c, q, "id", "v", k, least, centroids=24, block=40)
        ranked = R.top(rows, ["query"], [F.desc("score"), F.col("doc")], k)
        assert {(r["query"], r["doc"], r["rank"]) for r in ranked.collect()} == _cosines(chunks, queries, k, least)
        share = met.filter("query < 40").agg(F.sum("met") / F.sum("blocks")).first()[0]
        assert share < 0.5 if k == 3 else True
    blocks, bounds, _ = C.vector_blocks(c, "id", "v", 24, 40)
    assert blocks.count() == len(chunks) and bounds.agg(F.max("n")).first()[0] < 120
