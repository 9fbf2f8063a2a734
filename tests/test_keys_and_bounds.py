"""Text keys whose hashes meet, bounded search against plain scoring, long conversations, skewed key ranges, feedback and pages."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import classifier as V
from ticketloom.operators import context as C
from ticketloom.operators import dataprep as D
from ticketloom.operators import evaluation as E
from ticketloom.operators import flywheel as Y
from ticketloom.operators import kb as K
from ticketloom.operators import retrieval as R
from ticketloom.operators.textkeys import text_hash, text_keys
from ticketloom.sources import io


def few_hashes(c):
    """Only two different hashes, so that different texts meet."""
    return F.when(F.length(c) % 2 == 0, F.lit(b"0")).otherwise(F.lit(b"1"))


TEXTS = ["a", "bb", "ccc", "bb", "a", "", None, "dd", "bb", "eeeee", "dd", "a"]


@pytest.mark.parametrize("hashed", [text_hash, few_hashes])
def test_text_keys(spark, hashed):
    rows = spark.createDataFrame([(i + 1, t) for i, t in enumerate(TEXTS)], "id long, t string").repartition(3)
    got = {r["id"]: (r["first"], r["n"]) for r in text_keys(rows, "id", F.col("t"), hashed).collect()}
    assert got == {i + 1: (TEXTS.index(t) + 1, TEXTS.count(t)) for i, t in enumerate(TEXTS) if t is not None}
    assert text_keys(rows.limit(0), "id", F.col("t"), hashed).count() == 0


@pytest.mark.parametrize("hashed", [text_hash, few_hashes])
def test_gaps_and_leaks_by_hash(spark, hashed):
    pool = spark.createDataFrame([(i + 1, t if t is None else f" {t.upper()} ", None) for i, t in enumerate(TEXTS)] + [(50, "a", 7)], "id long, question string, matched_review_id long")
    queue = spark.createDataFrame([(3, "dd", 1, "待审"), (7, "A ", 2, "待审"), (9, "a", 1, "待审"), (20, "bb", 1, "通过")], "id long, normalized_question string, occurrence_count long, review_status string")
    matched, after = Y.match_gaps(pool, queue, hashed)
    got = {r["id"]: r["matched_review_id"] for r in matched.collect()}
    new = {t: got[TEXTS.index(t) + 1] for t in ("bb", "ccc", "", "eeeee")}
    assert sorted(new.values()) == [21, 22, 23, 24] and new["bb"] == 21 and new["ccc"] == 22
    assert got == {50: 7} | {i + 1: None if t is None else {"a": 7, "dd": 3, **new}[t] for i, t in enumerate(TEXTS)}
    rows = {r["id"]: (r["normalized_question"], r["occurrence_count"], r["review_status"]) for r in after.collect()}
    assert rows[7] == ("A ", 5, "待审") and rows[3][1] == 3 and rows[9][1] == 1 and rows[20] == ("bb", 1, "通过") and rows[21] == (" BB ", 3, "待审")
    split = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate([("a ", "train"), (" a", "val"), ("b", "train"), ("c", "test"), ("c", "test"), (" ", "val"), (" ", "test"), (None, "val"), ("dd", "val"), ("dd", "test")])], "doc_id long, text string, split string")
    r = D.leakage(split, "text", hashed=hashed).first()
    assert (r["train"], r["val"], r["test"], r["train_val"], r["train_test"], r["val_test"], r["passed"]) == (2, 2, 2, 1, 0, 1, False)


@pytest.mark.parametrize("hashed", [text_hash, few_hashes])
def test_variants_by_hash(spark, hashed):
    rows = [(1, "快递到了吗"), (2, "快递到了吗"), (3, "物流到了吗"), (4, "怎么退款"), (5, "无"), (6, None)]
    got = D.augmented(spark.createDataFrame(rows, "id long, text string"), "id", "text", hashed=hashed).collect()
    texts = {r["text"] for r in got if not r["variant"]}
    made = [r["text"] for r in got if r["variant"]]
    assert len(got) - len(made) == len(rows) and made and len(set(made)) == len(made) and not texts & set(made)


def plain_bm25(docs, queries, k):
    bags = {i: Counter(t.split()) for i, t in docs if t.split()}
    n, avg = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    out = []
    for q, t in queries:
        s = {}
        for w in set(t.split()):
            for i, b in bags.items():
                if b[w]:
                    s[i] = s.get(i, 0) + math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / avg))
        out += [(q, i, rank) for rank, (i, _) in enumerate(sorted(s.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("k", "block"), [(1, 4), (3, 8), (10, 64), (500, 16)])
def test_bounded_search_is_plain_scoring(spark, monkeypatch, k, block):
    """Ties at rank k, copies, empty texts, words that no document holds, and queries without any known word."""
    monkeypatch.setattr(R.bm25_blocks, "__defaults__", (block,))
    r = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(words, [1 / (j + 1) for j in range(60)], k=r.randint(0, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(60)]
    queries = [(q, " ".join(r.choices(words, k=r.randint(1, 12)))) for q in range(20)] + [(90, "unknown"), (91, "w0"), (92, "w59 unknown")]
    d, q = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(queries, "query long, text string")
    terms = R.asked_terms(q, "query", "text")
    index = io.stored(R.bm25_index(d, "id", "text", terms, True), "postings")
    got = sorted((x["query"], x["doc"], x["rank"]) for x in R.bm25_search(R.bm25_blocks(index), terms, k).collect())
    assert got == plain_bm25(docs, queries, k)


def test_bounds_leave_documents_out(spark):
    """Documents that share only a frequent word with a query aren't scored whole."""
    docs = [(i, "the " * (1 + i % 3) + f"x{i}") for i in range(2000)] + [(5000 + i, "rare words stand here the") for i in range(12)]
    d = spark.createDataFrame(docs, "id long, text string")
    terms = io.stored(R.asked_terms(spark.createDataFrame([(1, "the rare words stand here")], "query long, text string"), "query", "text"), "terms")
    postings = R.bm25_blocks(io.stored(R.bm25_index(d, "id", "text", terms, True), "postings"))
    assert R.bm25_candidates(postings, terms, 10)[0].count() == 12 and postings.count() == 2000 + 12 * 5


def test_long_conversation_spreads(spark, monkeypatch):
    """One conversation of very many messages: anchors equal the plain loop, and ranges go to many tasks."""
    n, most = 1_000_000, 5_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("c"), F.col("id").alias("o"), (F.col("id") % 7 + 1).alias("tok"), F.when(F.col("id") % 5 == 0, "user").otherwise("assistant").alias("role"))
    total, last = 0, n
    while total + (last - 1) % 7 + 1 <= most:
        last -= 1
        total += last % 7 + 1
    r = C.layer1_anchor(rows, "c", "o", F.col("tok"), F.lit(most)).first()
    assert (r["anchor"], r["kept_tokens"]) == (last - 1, total)
    ids = [x["o"] for x in C.trimmed(rows, "c", "o", "role", F.col("tok"), most).select("o").collect()]
    assert min(ids) == -(-last // 5) * 5 and max(ids) == n - 1 and len(ids) == n - min(ids)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spread = C.newer_sums(rows, "c", "o", F.col("tok"), "s").filter("s > 0").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.set("spark.sql.adaptive.enabled", old)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(spread) > 8 and max(x["count"] for x in spread) < n / 4


def test_summarised_messages_do_not_count(spark):
    rows = spark.createDataFrame([(c, i, 10) for c in (1, 2, 3, 4) for i in range(1, 11)], "c long, o long, tok long")
    anchors = spark.createDataFrame([(1, None, 8), (2, 3, 8), (3, 8, 3), (4, 2, None)], "conversation long, layer1_from long, summary_upto long")
    got = {r["conversation"]: (r["anchor"], r["kept_tokens"]) for r in C.layer1_anchor(rows, "c", "o", F.col("tok"), F.lit(50), anchors).collect()}
    assert got == {1: (None, 20), 2: (3, 20), 3: (8, 20), 4: (5, 50)}


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, size):
    got = spark.range(1).select(K.running_sums(F.array(*map(F.lit, range(size))) if size else F.expr("cast(array() as array<int>)")).alias("x")).first()["x"]
    assert got == [i * (i + 1) // 2 for i in range(size)]


def test_key_ranges_of_skewed_ids(spark):
    """A gap, a hot stretch, a hot key and null keys: ranges are even, and hold each row once."""
    keys = [None] * 5 + list(range(4000)) + [10**12 + i // 2 for i in range(4000)] + list(range(10**9, 10**9 + 10))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    ranges = io.key_ranges(df, "k", 8)
    sizes = [df.filter(c).count() for c in ranges]
    assert sum(sizes) == len(keys) and sizes[-1] == 5 and max(sizes) < 2 * len(keys) / 8 and len(ranges) == 9
    assert [df.filter(c).count() for c in io.key_ranges(df, "k", 1)] == [len(keys) - 5, 5]
    assert [df.filter("k < 0").filter(c).count() for c in io.key_ranges(df.filter("k < 0"), "k", 4)][0] == 0


def test_feedback_takes_the_last_call(spark):
    messages = spark.createDataFrame([(1, 1, "user", "q1", None), (1, 2, "assistant", "r", "query_faq"), (2, 1, "user", "q2", None), (2, 2, "assistant", "r", "query_faq"), (2, 3, "assistant", "r", "query_order"), (3, 1, "assistant", "r", "search_knowledge"), (4, 1, "assistant", "r", None)], "conversation long, id long, role string, content string, tool string")
    audits = spark.createDataFrame([(1, 1, "query_faq", '[{"text": "old"}]'), (2, 1, "search_knowledge", '{"hits": [{"content": "c", "distance": 0.5, "section_path": "p"}, {"text": "", "answer": "a", "score": 0}]}'), (3, 2, "query_faq", '[{"text": "x"}]'), (4, 3, "query_faq", "broken"), (5, 1, "query_order", '[{"text": "no"}]')], "id long, conversation long, tool string, result string")
    votes = spark.createDataFrame([(1, " "), (2, "asked"), (3, None), (4, ""), (5, None)], "conversation long, query string")
    got = {r["conversation"]: (r["raw_question"], r["chunks"] and [tuple(c) for c in r["chunks"]]) for r in Y.feedback_rows(votes, messages, audits).collect()}
    assert got == {1: ("q1", [("c", 0.5, "p"), ("a", 0.0, "")]), 2: ("asked", None), 3: ("未知用户问题", None), 4: ("未知用户问题", None), 5: ("未知用户问题", None)}


def test_pages_have_totals(spark):
    store = spark.createDataFrame([(i, "done" if i % 2 else "pending", "c", "q", None if i % 3 else "holds it", None) for i in range(50)], "id long, vectorize_status string, category string, questions string, answer string, section_path string")
    got = K.browse(store, status="done", page=2, size=20).collect()
    assert [r["id"] for r in got] == [9, 7, 5, 3, 1] and {r["total"] for r in got} == {25}
    assert K.browse_total(store, holds="holds").first()["total"] == 17 and K.browse(store, page=9).count() == 0
    ledger = spark.createDataFrame([(str(i), "未解决" if i % 2 else "已解决", "A_policy" if i < 20 else "B_model", i % 3) for i in range(40)], "eval_id string, status string, bucket string, seen_count long").withColumn("id", F.col("eval_id").cast("long"))
    cases = E.ledger_cases(ledger, "未解决", "A_policy", 2, 4, "id").collect()
    assert [(r["id"], r["recurrent"], r["total"]) for r in cases] == [(11, True, 10), (9, False, 10), (7, False, 10), (5, True, 10)]


def test_redline_messages(spark):
    counts = spark.createDataFrame([("退换货", 89, 11, 11, 0), ("物流", 9, 1, 1, 0)], "class string, tp long, fp long, fn long, tn long")
    got = {r["class"]: (r["status"], r["symbol"], r["message"]) for r in V.redlines(counts).collect()}
    assert got["退换货"] == ("fail", "❌", "先回头搞数据 (F1: 0.89 < 0.90)") and got["物流"] == ("pass", "✅", "达标")
