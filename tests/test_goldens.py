"""Hand-computed cases of single operators."""

import random

import pytest
from pyspark.sql import functions as F

from ticketloom.functions import text as T
from ticketloom.functions.vocab import BUDGET
from ticketloom.operators import classifier as V
from ticketloom.operators import context as C
from ticketloom.operators import dataprep as D
from ticketloom.operators import evaluation as E
from ticketloom.operators import flywheel as Y
from ticketloom.operators import kb as K
from ticketloom.operators import mining as M
from ticketloom.operators import observability as O
from ticketloom.operators import retrieval as R
from ticketloom.sources import io


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_confidence(spark):
    rows = [(1, 0.8), (1, 0.5), (1, 0.2), (2, 0.6), (3, None)]
    got = {r["query"]: round(r["confidence"], 6) for r in R.confidence(spark.createDataFrame(rows, "query long, score double")).collect()}
    assert got == {1: 0.691667, 2: 0.488333, 3: 0.0}


def test_cost(spark):
    rows = [("knowledge", 5000, 1000), ("refund", 2000, 1000), ("chitchat", 1000, 500), ("", 50, 50)]
    got = {r["intent"]: r for r in O.cost_by_intent(spark.createDataFrame(rows, "intent string, prompt_tokens long, completion_tokens long")).collect()}
    assert sum(r["total_tokens"] for r in got.values()) == 10600
    assert got["knowledge"]["cost_usd"] == 0.0225 and got["UNKNOWN"]["calls"] == 1


@pytest.mark.parametrize(("text", "n"), [("Hello world", 3), ("订单号是123456", 6), ("", 0), (None, 0), ("“好”——", 5), ("a　b", 2)])
def test_tokens(spark, text, n):
    assert one(spark, T.estimated_tokens(F.col("t")), t=F.lit(text).cast("string")) == n


def test_message_tokens(spark):
    got = spark.createDataFrame([("hi", '[{"name":"f"}]'), (None, None)], "c string, t string").select(C.message_tokens(F.col("c"), F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [1 + 4, 0]


@pytest.mark.parametrize(("window", "want"), [(18000, (8750, 3600, 5650, 3954, 1695)), (128000, (8750, 3600, 10000, 7000, 3000)), (5000, (8750, 3600, 0, 0, 0))])
def test_budget(spark, window, want):
    r = C.budget(spark.createDataFrame([tuple((BUDGET | {"model_context_window": window}).values())], ", ".join(f"{k} long" for k in BUDGET))).first()
    assert (r["fixed"], r["peak"], r["history"], r["layer1"], r["layer2"]) == want


def test_ranks_and_recall(spark):
    samples = spark.createDataFrame([(1, [["甲"]]), (2, [["甲"], ["乙", "丙"]])], "sample long, targets array<array<string>>")
    hits = [(s, "hybrid", k, x, None, None) for s, names in ((1, "abc甲d"), (2, "a甲bc丙")) for k, x in enumerate(names, 1)]
    got = {r["sample"]: r for r in E.recall_mrr(E.hit_ranks(samples, spark.createDataFrame(hits, "sample long, strategy string, rank long, section_path string, question string, category string"), ["hybrid"])).collect()}
    assert (got[1]["recall_3"], got[1]["recall_5"], got[1]["mrr"]) == (0.0, 1.0, 0.25)
    assert (got[2]["recall_3"], got[2]["recall_5"], got[2]["mrr"]) == (0.5, 1.0, 0.35)


def test_samples_without_hits_count(spark):
    """A strategy that found nothing for a sample, a blank question and a sample without targets have rank 0 and count in all means."""
    samples = spark.createDataFrame([(1, [["甲"]]), (2, [["甲"], ["乙"]]), (3, None), (4, [])], "sample long, targets array<array<string>>")
    hits = spark.createDataFrame([(1, "hybrid", 1, "甲", None, None), (2, "bm25_only", 2, None, "乙", None), (1, "other", 1, "甲", None, None)], "sample long, strategy string, rank long, section_path string, question string, category string")
    ranks = E.hit_ranks(samples, hits, ["hybrid", "bm25_only"])
    assert {(r["sample"], r["strategy"], r["target"]): r["rank"] for r in ranks.collect()} == {(1, "hybrid", 0): 1, (1, "bm25_only", 0): 0, (2, "hybrid", 0): 0, (2, "hybrid", 1): 0, (2, "bm25_only", 0): 0, (2, "bm25_only", 1): 2, (3, "hybrid", 0): 0, (3, "bm25_only", 0): 0, (4, "hybrid", 0): 0, (4, "bm25_only", 0): 0}
    m = E.recall_mrr(ranks).withColumns({"bucket": F.lit("A_policy"), "faithful": F.lit(1.0), "refused": F.lit(0.0)})
    got = {r["strategy"]: r for r in E.by_bucket(m).filter("bucket = 'overall'").collect()}
    assert (got["hybrid"]["n"], got["hybrid"]["mrr"], got["bm25_only"]["mrr"], got["bm25_only"]["recall_3"]) == (4, 0.25, 0.0625, 0.125)
    queries = spark.createDataFrame([(1, "甲"), (2, " \n")], "query long, text string")
    route = spark.createDataFrame([(1, 5, 1, 0.9), (2, 5, 1, 0.9)], "query long, doc long, rank long, score double")
    found = R.by_strategy(["vector_only"], queries, route, route, spark.createDataFrame([(5, "甲")], "doc long, text string"))
    assert [r["query"] for r in found.collect()] == [1]


def test_means_round_halves_up(spark):
    rows = spark.createDataFrame([("s", "A_policy", x, x, x, x, 1.0, 0.0) for x in (0.1234, 0.1235)] + [("s", "D_absent", 0.9, 0.9, 0.9, 0.9, 0.0, 1.0)], "strategy string, bucket string, recall_3 double, recall_5 double, recall_10 double, mrr double, faithful double, refused double")
    got = {r["bucket"]: r for r in E.by_bucket(rows).collect()}
    assert (got["overall"]["mrr"], got["overall"]["n"], got["D_absent"]["mrr"], got["D_absent"]["refusal_rate"]) == (0.1235, 3, None, 1.0)


def test_confidence_of_odd_scores(spark):
    """Null and NaN scores are 0; equal best scores have no margin."""
    nan = float("nan")
    rows = [(1, 0.9), (1, None), (2, nan), (2, 0.5), (3, 0.7), (3, 0.7), (4, None), (5, nan), (None, 0.6), (6, 2.0), (7, -1.0)]
    got = {r["query"]: round(r["confidence"], 6) for r in R.confidence(spark.createDataFrame(rows, "query long, score double")).collect()}
    assert got == {1: 0.758333, 2: 0.458333, 3: 0.586667, 4: 0.0, 5: 0.0, None: 0.488333, 6: 1.0, 7: 0.0}


def test_edges_first(spark):
    for n in range(12):
        got = {r["place"]: r["rank"] for r in R.edges_first(spark.createDataFrame([(1, i) for i in range(1, n + 1)], "query long, rank long")).collect()}
        assert [got[i] for i in range(n)] == [*range(1, n + 1, 2), *reversed(range(2, n + 1, 2))]


def test_rerank_window(spark):
    hits = spark.createDataFrame([(1, i, i, float(i)) for i in range(1, 19)], "query long, doc long, rank long, score double")
    got = R.rerank(hits, F.col("doc") / 100.0, 17).orderBy("rank").collect()
    assert [r["doc"] for r in got] == [*range(15, 0, -1), 16, 17] and got[15]["rerank_score"] == 0.0


def test_fusion_and_strategies(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query long, doc long, rank long")
    b = spark.createDataFrame([(1, 8, 1)], "query long, doc long, rank long")
    got = R.fuse([a, b]).collect()
    assert [r["doc"] for r in sorted(got, key=lambda r: r["rank"])] == [8, 7]
    with pytest.raises(ValueError, match="unknown"):
        R.by_strategy(["hybrid", "other"], a, a, b, a)


def test_lexical_score(spark):
    got = spark.createDataFrame([("退货 运费", "退货 运费 谁付"), ("abc", "xyz"), ("", "x"), ("x", "")], "q string, d string").select(R.lexical_score(F.col("q"), F.col("d")).alias("s")).collect()
    assert got[0]["s"] > 0.9 and [r["s"] for r in got[1:]] == [0.0, 0.0, 0.0]


def test_route_merge(spark):
    rows = [(1, 0, 1, "a", 0.88), (1, 1, 2, "a ", 0.95), (1, 0, 3, "b", 0.88), (1, 1, 4, "c", 0.82), (1, 2, 5, "d", 0.78)]
    got = R.merge_routes(spark.createDataFrame(rows, "query long, route int, doc long, text string, score double")).orderBy("rank").collect()
    assert [r["score"] for r in got] == [0.95, 0.88, 0.82, 0.78]


def test_sweep_matches_direct_counts(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.random() < 0.5, round(rng.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "class string, truth boolean, score double")
    for r in V.passed_lines(df, [30, 50, 70], ["class"]).collect():
        own = [(t, s) for c, t, s in rows if c == r["class"]]
        assert r["tp"] == sum(t and s >= r["threshold"] for t, s in own) and r["fp"] == sum(not t and s >= r["threshold"] for t, s in own)
    assert V.threshold_sweep(df).filter("best").count() == 1


def test_error_accounting(spark):
    rows = [(1, ["物流"], ["运费"]), (2, ["物流", "发票"], ["物流"]), (3, ["价保"], ["价保", "支付"]), (4, ["支付"], ["支付"])]
    e = V.errors(spark.createDataFrame(rows, "id long, true_labels array<string>, pred_labels array<string>"))
    t = V.error_totals(e).first()
    assert (t["wrong"], t["under"], t["over"], t["displaced"], t["penalty"]) == (3, 1, 1, 1, 4)
    notes = {r["id"]: r["note"] for r in e.collect()}
    assert notes == {1: "物流 ↔ 运费: 物流管货、运费管钱", 2: "—", 3: "—"}
    rows = [(1, ["退换货", "物流"], ["运费", "保修维修"]), (2, ["物流", "价保"], []), (3, ["支付"], ["物流"]), (4, [], ["物流"])]
    notes = {r["id"]: r["note"] for r in V.errors(spark.createDataFrame(rows, "id long, true_labels array<string>, pred_labels array<string>")).collect()}
    assert notes[1].split("；") == ["物流 ↔ 运费: 物流管货、运费管钱", "退换货 ↔ 保修维修: 修归保修维修、退归退换货"] and notes[3] == notes[4] == "—"
    assert notes[2] == "价保: 价保是补差价、优惠活动是券和满减；物流: 物流管货、运费管钱"


def test_positive_weights(spark):
    rows = [(["尺码"],)] * 25 + [(["退换货"],)] * 75
    got = {r["class"]: r["weight"] for r in D.positive_weights(spark.createDataFrame(rows, "labels array<string>"), "labels").collect()}
    assert round(got["尺码"], 6) == round(3**0.5, 6) and got["退换货"] == 1.0 and got["物流"] == 5.0


def test_masking(spark):
    got = one(spark, D.cleaned(F.col("t")), t=" 我叫王小明 电话13812345678， 订单12345678901234567 的快弟 ")
    assert got == "我叫[姓名] 电话[手机号]， 订单[订单号] 的快递"


def test_split_sizes_and_leakage(spark):
    rows = spark.createDataFrame([(i, [["物流"], ["发票"]][i % 2] if i < 90 else [], f" t{i % 95}") for i in range(100)], "id long, labels array<string>, text string")
    s = D.stratified_split(rows, "id", "labels")
    assert {(r["l"], r["split"]): r["count"] for r in s.groupBy(F.coalesce(F.try_element_at("labels", F.lit(1)), F.lit("其他")).alias("l"), "split").count().collect()} == {
        ("物流", "train"): 36, ("物流", "val"): 4, ("物流", "test"): 5, ("发票", "train"): 36, ("发票", "val"): 4, ("发票", "test"): 5, ("其他", "train"): 8, ("其他", "val"): 1, ("其他", "test"): 1,
    }
    assert D.leakage(rows.withColumn("split", F.when(F.col("id") < 95, "train").otherwise("val")), "text", id="id").first()["train_val"] == 5


def test_augmentation_keeps_labels_and_new_texts(spark):
    rows = spark.createDataFrame([(1, "怎么退款吗？", ["退换货"]), (2, "如何退款吗？", ["退换货"]), (3, "x", ["其他"])], "id long, text string, labels array<string>")
    got = D.augmented(rows, "id", "text").collect()
    texts = [r["text"] for r in got]
    assert len(texts) == len(set(texts)) and 4 <= len(got) <= 5 and all(r["labels"] == ["退换货"] for r in got if r["variant"])


@pytest.mark.parametrize(("text", "want"), [("帮我查TB987654", "TB987654"), ("退款3000元", None), ("订单1002到哪了", "1002"), ("2024年买的", None), ("", None)])
def test_order_id(spark, text, want):
    assert one(spark, C.order_id(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("经核实，该订单不支持退款。", False), ("**支持退款**，请放心", True), ("可点击下方“申请退款”按钮", True), ("本商品不属于不支持退货的特殊品类。可以退货。", True), ("", False), ("超过7天", False), ("您好", False)])
def test_refund(spark, text, want):
    assert one(spark, C.refund_supported(F.col("t")), t=text) is want


@pytest.mark.parametrize(("text", "want"), [('```\n"你好"\n```', "你好"), ("改写后：“我的订单”", "“我的订单”"), ("“我的订单”", "我的订单"), ("plain", "plain")])
def test_clean_rewrite(spark, text, want):
    assert one(spark, C.clean_rewrite(F.col("t")), t=text) == want


def test_anchor_equals_popping(spark):
    rng = random.Random(5)
    rows = [(c, i, rng.randint(0, 40)) for c in range(30) for i in range(rng.randint(1, 12))]
    got = {r["conversation"]: r["anchor"] for r in C.layer1_anchor(spark.createDataFrame(rows, "c long, i long, t long"), "c", "i", F.col("t"), F.lit(100)).collect()}
    for c in range(30):
        own, anchor = [(i, t) for k, i, t in rows if k == c], None
        while sum(t for _, t in own) > 100:
            anchor = own.pop(0)[0]
        assert got[c] == anchor


def test_exact_dedup(spark):
    rows = [(1, "怎么退款？", "短"), (2, "怎么 退款", "更长的答案"), (3, "发票", "x"), (4, "？", "a"), (5, "", "a")]
    got = {r["id"]: r["status"] for r in M.exact_dedup(spark.createDataFrame(rows, "id long, q string, a string"), "id", "q", "a").collect()}
    assert got == {1: "discarded", 2: "kept", 3: "kept", 4: "kept", 5: "discarded"}


def test_semantic_dedup_is_sequential(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.standard_normal((120, 6))
    x[60:] = x[:60] + 0.25 * rng.standard_normal((60, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = []
    for i in range(120):
        if all(x[i] @ x[j] < 0.92 for j in kept):
            kept.append(i)
    got = M.semantic_dedup(spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "id long, place long, vector array<double>")).filter("status = 'kept'").collect()
    assert sorted(r["id"] for r in got) == kept


def test_parsed_pairs(spark):
    texts = ['```json\n[{"question": "q", "answer": "a"}]\n```', '{"qa_list": [{"question": "q", "answer": " "}]}', "nothing", None, "[broken"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(M.parsed_pairs(F.col("t"))).alias("n")).collect()
    assert [r["n"] for r in got] == [1, 0, 0, 0, 0]


def test_gaps(spark):
    pool = spark.createDataFrame([(1, "Ａ?", None), (2, " x ", None), (3, "X", None), (4, "new", None), (5, "New ", None)], "id long, question string, matched_review_id long")
    queue = spark.createDataFrame([(10, "x", 1, "待审"), (11, "new", 3, "通过")], "id long, normalized_question string, occurrence_count long, review_status string")
    matched, after = Y.match_gaps(pool, queue)
    m = {r["id"]: r["matched_review_id"] for r in matched.collect()}
    assert m[2] == m[3] == 10 and m[4] == m[5] == 13 and m[1] == 12
    assert {r["id"]: r["occurrence_count"] for r in after.collect()} == {10: 3, 11: 3, 12: 1, 13: 2}


def test_batch_gate(spark):
    assert [Y.batch_gate(spark.range(n), 10, forced) for n, forced in ((0, True), (3, False), (3, True), (10, False))] == ["empty", "skip", "run", "run"]


def test_markdown(spark):
    text = "# 售后\n不支持退换。\n## 运费\n| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 60} |" for i in range(12)) + "\n```\n# no heading\n```\n### 常见\n问：能退吗\n答：能\n可以\n问：多久\n答：7天\n"
    got = K.split_markdown(text)
    assert [r[6] for r in got] == list(range(len(got))) and got[0][:2] == ("售后", "售后") and got[0][5]
    tables = [r for r in got if r[2].startswith("| a | b |\n|---|---|")]
    assert len(tables) > 1 and all(len(r[2]) <= 500 for r in tables) and tables[0][3] == "售后 > 运费" and tables[0][0] == "售后"
    assert [(r[1], r[2]) for r in got if r[4] == "faq"] == [("能退吗", "能\n可以"), ("多久", "7天")]
    assert any("# no heading" in r[2] for r in got) and K.split_markdown(" ") == [] == K.split_markdown(None)


def test_chunks_cover_and_overlap():
    text = "".join(f"第{i}句话有三点{i}.5个字。" for i in range(200))
    got = K.chunks(text, 100, 20)
    assert all(c in text and len(c) <= 100 and c.endswith("。") for c in got) and got[0].startswith("第0") and got[-1].endswith("字。")
    assert K.chunks("x" * 1000, 100, 20) == ["x" * 100] * 10 and K.boundaries("3.14。”好.") == [6, 8]


def test_sentence_ends_agree(spark):
    texts = ["a。b!”c", "3.14 is. ok", "", "x;y？）】z\nw", ".5. 6.7."]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(K.sentence_ends(F.col("t")).alias("e")).collect()
    assert [r["e"] for r in got] == [K.boundaries(t) for t in texts]


def test_embedding_is_unit(spark):
    v = one(spark, K.embedder()(F.col("t")), t="你好")
    assert len(v) == 1024 and abs(sum(x * x for x in v) - 1) < 1e-4


def test_lines_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("你好", ["物流"])], io.LABELLED)
    io.write_lines(rows, f"{tmp_path}/a")
    assert io.read_labelled(spark, f"{tmp_path}/a").collect() == rows.collect()
    for name, text in (("b.md", "# x\n正文。"), ("c.md", "\n"), ("d.txt", "no")):
        (tmp_path / name).write_text(text)
    assert sorted(r["file"] for r in io.read_markdown(spark, str(tmp_path)).collect()) == ["b.md", "c.md"]
    got = {r["file"]: r["chunks"] for r in io.inventory(spark, str(tmp_path), 500, 80).collect()}
    assert got == {"b.md": 1, "c.md": 0}
    (tmp_path / "s.json").write_text('{"samples": [{"text": "t", "true_labels": ["a", "z"], "scores": {"a": 0.5}}]}')
    got = io.class_scores(io.read_scores(spark, f"{tmp_path}/s.json"), ["a", "b"]).orderBy("class").collect()
    assert [(r["class"], r["truth"], r["score"]) for r in got] == [("a", True, 0.5), ("b", False, 0.0)]
