"""Queries over whole texts and all rows, compared with plain recomputations on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.functions.vocab import TRIGGERS
from ticketloom.operators import mining as M
from ticketloom.plans import catalog

HEAD = "A common heading of many documents, which says nothing of what they are about. " * 4


@pytest.fixture
def table(spark, tmp_path):
    """A writer of small tables into a folder of their own."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def run(spark, name, folder):
    return catalog.queries()[name](spark, folder).collect()


DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_faq_search_reads_whole_texts(spark, table):
    texts = [HEAD + "the refund is paid in five days", HEAD + "the refund is paid in six days", "short", HEAD + "😀 the refund is paid in five days, twice", None, ""]
    table("documents", [(i, t, "en", "s") for i, t in enumerate(texts)], DOCUMENTS)
    keys = ["the refund is paid in five days", "the refund is paid in seven days", HEAD[:12] + "x", "😀", "ix", "", HEAD]
    folder = table("benchmark", [(i, t) for i, t in enumerate(keys)], "item_id long, text string")
    want = {(k, i, n) for k in keys if k for n, i in enumerate([i for i, t in enumerate(texts) if k in (t or "")][:3], 1)}
    assert {(r["keyword"], r["id"], r["rank"]) for r in run(spark, "r17_faq_search", folder)} == want and len(want) == 7


def test_faq_search_is_brute_force(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    keys = {r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(k, i, n) for k in keys for n, i in enumerate(sorted(r["doc_id"] for r in d if k in r["text"])[:3], 1)}
    assert {(r["keyword"], r["id"], r["rank"]) for r in run(spark, "r17_faq_search", sf_dir)} == want and want


def test_evidence_and_answers_are_whole(spark, sf_dir, table):
    n = len(TRIGGERS) + 2
    texts = {i: HEAD + TRIGGERS[i % n][0] for i in range(4 * n) if i % n < len(TRIGGERS) and i % 4 in (1, 3)}
    folder = table("documents", [(i, t, "en", "s") for i, t in texts.items()], DOCUMENTS)
    assert {r["reason"] for r in run(spark, "e3_faithfulness", folder)} == {"supported"}
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in run(spark, "r11_citations", sf_dir):
        assert r["answer"] == text[r["chunk_id"] % 1000000]
    cited, faq = ({r["query"]: r[c] for r in run(spark, q, sf_dir)} for q, c in (("r20_evidence", "evidence"), ("r16_faq_text", "text")))
    for r in run(spark, "r2_bm25_topk", sf_dir):
        if r["rank"] <= 3:
            assert text[r["doc"]] in cited[r["query"]] and text[r["doc"]] in faq[r["query"]]


def test_sufficiency_reads_whole_texts(spark, table):
    folder = table("documents", [(1, "a " * 120 + "refund", "en", "s"), (2, "a b c", "en", "s")], DOCUMENTS)
    assert {r["doc_id"]: r["sufficient"] for r in run(spark, "e4_sufficiency", folder)} == {1: True, 2: False}


def test_semantic_dedup_across_labels(spark, table, monkeypatch):
    x = np.random.default_rng(5).normal(size=(12, 4)).round(3)
    vectors = [x[i % 12].tolist() for i in range(60)] + [(x[i] * 2 + 0.01).tolist() for i in range(12)] + [[0.0] * 4] * 3
    folder = table("embeddings", [(i, v, i % 5 if i % 7 else None) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    unit = np.array(vectors, np.float32).astype(float)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    kept = []
    for i, u in enumerate(unit):
        if not any(u @ unit[k] >= 0.92 for k in kept):
            kept.append(i)
    paired = []
    pairs = M.similar_pairs
    monkeypatch.setattr(M, "similar_pairs", lambda rows, *a: paired.append(rows.count()) or pairs(rows, *a))
    got = {r["id"]: r["status"] for r in run(spark, "m6_semantic_dedup", folder)}
    assert sorted(i for i, s in got.items() if s == "kept") == kept and len(got) == len(vectors)
    assert paired == [12 + 12 + 3]


def test_confidence_takes_all_events(spark, table):
    rows = [(i, 1 + i % 5, v, "view", "{}") for i, v in enumerate([40.0, 190.0, 60.0, 10.0, 0.0] * 12)] + [(77, 9, 100.0, "view", "{}"), (78, None, 50.0, "view", "{}"), (79, None, 20.0, "view", "{}"), (99, 8, None, "view", "{}")]
    folder = table("events", rows, "event_id long, user_id long, value double, event_type string, props string")
    want = {}
    for u in {r[1] for r in rows}:
        s = sorted(((r[2] or 0) / 200 for r in rows if r[1] == u), reverse=True)
        margin = s[0] - s[1] if len(s) > 1 else 0.5 * s[0]
        want[u] = round(min(1, 0.6 * s[0] + 0.25 * min(sum(x >= 0.25 for x in s) / 3, 1) + 0.15 * margin), 9)
    assert {r["query"]: r["confidence"] for r in run(spark, "r18_confidence", folder)} == want
    assert {r["query"]: r["gate"] for r in run(spark, "r19_gate", folder)} == {u: "pass" if c >= 0.4 else "fallback" for u, c in want.items()}
    assert {r["query"] for r in run(spark, "f1_pool_rows", folder)} == {u for u, c in want.items() if c < 0.4 and u is not None}


def same_heads(table, n=40):
    """Documents of one heading that differ after it, each but the first ten in two copies, the second in upper case."""
    texts = [HEAD + f"part {i % 10}" for i in range(10)] + [f" {HEAD}part {i}\n".upper() if k else HEAD + f"part {i}" for i in range(10, 25) for k in (0, 1)]
    return table("documents", [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts[:n])], DOCUMENTS), texts[:n]


def test_dedup_keys_are_whole_texts(spark, table):
    folder, texts = same_heads(table)
    status = {r["id"]: r["status"] for r in run(spark, "m5_exact_dedup", folder)}
    kept = {i for i in range(40) if i < 10 or i % 2 == 0}
    assert {i for i, s in status.items() if s == "kept"} == kept and len(status) == 40
    assert sum(r["n"] for r in run(spark, "m7_staging_counts", folder) if r["status"] == "kept") == 25
    assert {r["questions"] for r in run(spark, "m8_kept_to_chunks", folder)} == {texts[i] for i in kept}


def test_gaps_are_whole_texts(spark, table):
    folder, texts = same_heads(table)
    key = lambda t: t.strip().lower()
    matched = run(spark, "f4_match_gaps", folder)
    groups = {}
    for r in matched:
        groups.setdefault(r["matched_review_id"], set()).add(key(texts[r["id"]]))
    assert len(matched) == 40 and len(groups) == 25 and all(len(g) == 1 for g in groups.values())
    assert {key(r["normalized_question"]) for r in run(spark, "f4_queue_after", folder)} == set(map(key, texts))
    # Of the queue's four gaps, 0 and 20 are pending.
    assert [(r["processed"], r["new"], r["merged"]) for r in run(spark, "f5_processing_counts", folder)] == [(40, 23, 17)]
    assert all(r["raw_questions"] <= 2 for r in run(spark, "f6_review_list", folder))
    assert {r["question"] for r in run(spark, "f7_review_detail", folder)} >= set(texts)
    assert {r["question"] for r in run(spark, "f3_normalise", folder)} == {t.strip() for t in texts}
    gaps = {r["gap"]: r["occurrence_count"] for r in run(spark, "x1_gap_counters", folder)}
    assert gaps == {k: sum(key(t) == k for t in texts) for k in map(key, texts)}


def test_routes_merge_whole_texts(spark, table):
    folder = table("documents", [(97 * i, HEAD + f"part {i % 3}", "en", "s") for i in range(12)], DOCUMENTS)
    got = run(spark, "r12_route_merge", folder)
    assert sorted(r["doc"] // 97 % 3 for r in got) == [0, 1, 2]


NAN, INF = float("nan"), float("inf")


def test_odd_vectors(spark):
    """Null, empty, non-finite, ragged and zero vectors on either side."""
    from ticketloom.operators import retrieval as R

    chunks = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, []), (5, [NAN, 1.0]), (6, [INF, 1.0]), (7, [0.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [None, 1.0]), (10, [1.0, 0.0])]
    queries = [(20, [1.0, 0.0]), (21, None), (22, [NAN, 0.0]), (23, [1.0, 0.0, 0.0]), (24, [0.0, 0.0]), (25, []), (None, [1.0, 0.0])]
    c = spark.createDataFrame(chunks, "id long, v array<double>")
    q = spark.createDataFrame(queries, "query long, vector array<double>")
    for rows in (20_000, 2):
        got = {(r["query"], r["rank"], r["doc"]) for r in R.dense_search(c, q, "id", "v", 2, 0.35, rows).collect()}
        assert got == {(20, 1, 1), (20, 2, 10), (23, 1, 8)}
    assert R.dense_search(c, q.limit(0), "id", "v").count() == 0 and R.dense_search(c.limit(0), q, "id", "v").count() == 0
    kept = M.semantic_dedup(c.select("id", F.col("id").alias("place"), F.col("v").alias("vector"))).filter("status = 'kept'").collect()
    assert sorted(r["id"] for r in kept) == [1, 3, 4, 5, 6, 7, 8, 9]


def test_keywords_in_blocks(spark):
    from ticketloom.operators import retrieval as R

    texts = spark.createDataFrame([(1, "abc bcd"), (2, "bcd"), (3, None), (4, ""), (5, "xbcdabc")], "id long, text string")
    keys = spark.createDataFrame([("abc",), ("bcd",), ("",), (None,), ("b",), ("zz",), ("abc",)], "keyword string")
    want = {("abc", 1), ("abc", 5), ("bcd", 1), ("bcd", 2), ("bcd", 5), ("b", 1), ("b", 2), ("b", 5)}
    for block in (500_000, 3):
        assert {tuple(r) for r in R.keyword_hits(texts, keys, block=block).collect()} == want
    assert R.keyword_hits(texts, keys.limit(0)).count() == 0
