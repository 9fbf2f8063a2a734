"""Queries without SQL over whole tables against plain recomputations."""

import hashlib
import re

import numpy as np

from ticketloom.functions.vocab import PARTICLES, SYNONYMS, TYPOS
from ticketloom.operators import kb as K
from ticketloom.plans import catalog


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()


def run(spark, name, sf_dir):
    return catalog.queries()[name](spark, sf_dir).collect()


def ends(text):
    """Sentence ends, character by character."""
    out = []
    for i, c in enumerate(text):
        number = c == "." and i and i + 1 < len(text) and text[i - 1] in "0123456789" and text[i + 1] in "0123456789"
        if c in "。！？；!?;\n" or (c == "." and not number):
            j = i + 1
            while j < len(text) and text[j] in "”\"'’）)]】 ":
                j += 1
            out.append(j)
    return out


def pieces(text, size=500, overlap=80):
    """Chunks by their definition, looking through all ends each time."""
    text, start, out = text.strip(), 0, []
    all_ends = ends(text)
    while len(text) - start > size:
        inside = [e for e in all_ends if start < e <= start + size]
        after = [e for e in all_ends if e > start + size]
        stop = inside[-1] if inside else after[0] if after else start + size
        out.append(text[start:stop].strip())
        if stop >= len(text):
            start = stop
            break
        back = min((e for e in all_ends if start < e < stop), key=lambda e: (abs(e - (stop - overlap)), e), default=stop)
        while back < len(text) and text[back] in " \t\n\r":
            back += 1
        start = back if back > start else stop
    out.append(text[start:].strip())
    return [c for c in out if c]


def test_sentence_chunks(spark, sf_dir):
    want = {(r["doc_id"], k, c) for r in documents(spark, sf_dir) for k, c in enumerate(pieces(r["text"] or ""))}
    assert {(r["doc"], r["place"], r["chunk"]) for r in run(spark, "k3_sentence_chunks", sf_dir)} == want


def test_markdown_split(spark, sf_dir):
    plain = {r["doc_id"]: r for r in documents(spark, sf_dir) if not re.search(r"(?m)^\s{0,3}#|\||^\s*(问|答|[QqAa])[：:]|^\s*(```|~~~)", r["text"])}
    assert len(plain) > 150
    got = {}
    for r in run(spark, "k1_markdown_split", sf_dir):
        got.setdefault(r["doc"], []).append(r)
    for i, d in plain.items():
        s, lang = d["source"], d["lang"]
        want = [(s, s, c, s, "policy") for c in pieces(d["text"].replace("\r\n", "\n").replace("\r", "\n"))]
        want += [(s, lang, c, f"{s} > {lang}", "policy") for c in ("| a | b |\n|---|---|\n| 1 | 2 |", "不支持退换")]
        want += [(f"{s} > {lang}", f"q{i}", "a", f"{s} > {lang} > FAQ", "faq")]
        own = sorted(got[i], key=lambda r: r["order_index"])
        assert [(r["category"], r["questions"], r["answer"], r["section_path"], r["content_type"]) for r in own] == want
        assert [r["is_key_clause"] for r in own] == ["不支持" in f"{w[1]} {w[2]}" for w in want]
        n = len(want)
        assert [(r["order_index"], r["prev_index"], r["next_index"]) for r in own] == [(k, k - 1 if k else None, k + 1 if k + 1 < n else None) for k in range(n)]


def test_embeddings(spark, sf_dir):
    text = {r["doc_id"]: r["text"] for r in documents(spark, sf_dir)}
    for r in run(spark, "k10_embeddings", sf_dir):
        digest = hashlib.md5(text[r["doc_id"]].encode()).digest()
        v = np.random.RandomState(digest[0] | digest[1] << 8 | digest[2] << 16 | digest[3] << 24).standard_normal(1024)
        assert np.allclose(r["vector"], v / np.sqrt((v * v).sum()), atol=1e-6)


def test_term_vectors():
    v = K.term_vector("Refund refund, 退货 x_y")
    want = np.zeros(64)
    for w in ("refund", "refund", "退货", "x", "y"):
        want[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64] += 1
    assert (v == want).all()


def test_masks(spark, sf_dir):
    space = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"

    def masked(t):
        t = re.sub(r"(?:(?:\+|00)86)?(?<!\d)1[3-9]\d{9}(?!\d)", "[手机号]", t, flags=re.ASCII)
        t = re.sub(r"(?<!\d)\d{14,24}(?!\d)", "[订单号]", t, flags=re.ASCII)
        for wrong, right in TYPOS.items():
            t = t.replace(wrong, right)
        return re.sub(space, " ", t).strip(" ")

    got = {r["doc_id"]: r["clean"] for r in run(spark, "d1_clean_mask", sf_dir)}
    assert got == {r["doc_id"]: masked(r["text"]) for r in documents(spark, sf_dir)}


def test_variants(spark, sf_dir):
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    base = {r["doc_id"]: "请问快递怎么退款吗？" + r["text"] for r in documents(spark, sf_dir) if r["doc_id"] in ids}
    known = {hashlib.md5(t.encode()).hexdigest() for t in base.values()}

    def ways(t):
        for a, b in SYNONYMS:
            yield t.replace(a, b, 1) if a in t else t.replace(b, a, 1)
        for a, b in PARTICLES:
            yield t.replace(a, b, 1)

    got = run(spark, "d2_augment", sf_dir)
    assert {(r["doc_id"], r["text_md5"]) for r in got if not r["variant"]} == {(i, hashlib.md5(t.encode()).hexdigest()) for i, t in base.items()}
    made = [(r["doc_id"], r["text_md5"]) for r in got if r["variant"]]
    assert len({i for i, _ in made}) == len({t for _, t in made}) == len(made) > 0.9 * len(set(base.values()))
    labels = {r["doc_id"]: r["labels"] for r in got if not r["variant"]}
    for r in got:
        if r["variant"]:
            assert r["text_md5"] in {hashlib.md5(w.encode()).hexdigest() for w in ways(base[r["doc_id"]])} - known and r["labels"] == labels[r["doc_id"]]
