"""Collocations, language-model scores and the source audit against plain recomputation, with odd rows."""

import collections
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import collocations, divergence, lm_score
from ticketloom.llm import queries as registered

SCHEMA = "doc_id long, text string, lang string, source string"
ODD = [None, "", " ", "\n\t", "a", "x" * 20000, "word " * 3000, "日本語 text é́", "\x00\x1c ", "A B", "😀 emoji 😀", "1 2 3", "a\x0bb\x0cc\rd", "É é E.e,E;e", "ÿ ÿ"]
WORDS = "the of and Of new york city union station rain falls on été naïve x".split()


def made(seed, n):
    """Documents of few words, so that phrases are frequent; odd texts, repeated rows, null ids, languages and sources."""
    r = random.Random(seed)
    rows = [(i, "".join(r.choice(WORDS) + r.choice([" ", " ", " ", ", ", ".", "\n", "  \t"]) for _ in range(r.randint(0, 60))), r.choice(["en", "en", "fr", None, "und", ""]), r.choice(["a", "b", "ç", None, ""])) for i in range(n)]
    rows += [(10_000 + i, t, r.choice(["en", "zz"]), "odd") for i, t in enumerate(ODD)]
    return rows + rows[:7] + [(None, "New York City", None, None), (None, None, None, "b"), (5, rows[5][1], "en", "a")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("n", "term", "phrase", "bucket", "range", "score", "rank", "shard", "words")})


def sql(name, rows):
    import pandas as pd

    db = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])  # noqa: F841  read by the SQL
    db.execute("create table documents as select * from documents")
    return db.execute(registered.oracle_sql()[name]).fetchall()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def collocations_by_hand(rows, least=10, longest=3, contained=50, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(t)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * b >= contained * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                continue
            s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("seed", "shards", "cells", "block", "longest"), [(1, 4, 1 << 22, 1 << 20, 3), (2, 2, 8, 50, 3), (3, 1, 97, 500, 4)])
def test_collocations(spark, monkeypatch, seed, shards, cells, block, longest):
    monkeypatch.setattr(collocations.counted, "__defaults__", (block,))
    monkeypatch.setattr(collocations.frequencies, "__defaults__", (*collocations.frequencies.__defaults__[:-1], 5000))
    rows = made(seed, 400)
    got = collocations.mine(frame(spark, rows), longest=longest, shards=shards, cells=cells).collect()
    want = collocations_by_hand(rows, longest=longest)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == want and len(want) > 20
    if longest == 3:
        assert sorted(sql("op11_collocations", rows)) == want


def test_collocations_count_one_cycle(spark, monkeypatch):
    """A phrase that becomes frequent late is counted once by each shard, and scans end when nothing is active."""
    scans = []
    real = collocations.counted
    monkeypatch.setattr(collocations, "counted", lambda *a: scans.append(a[2]) or real(*a))
    rows = [(i, "rare pair here" if i % 20 == 0 else "so it goes", "en", "s") for i in range(240)]
    got = {r["phrase"]: r["a"] for r in collocations.mine(frame(spark, rows), shards=3).collect()}
    assert got == {"rare pair here": 12, "so it goes": 228} and 3 < len(scans) <= 9


def test_collocations_found_after_their_cells_are_full(spark):
    """Rare phrases whose words are found often enough only after common pairs have filled most cells of pairs."""
    r = random.Random(0)
    said = [" ".join(f"w{3 * i + k}" for k in range(3)) for i in range(60) for _ in range(r.randint(10, 25))]
    r.shuffle(said)
    rows = [(i, " ".join(f"c{r.randrange(20)}" for _ in range(60)) + "." + ". ".join(said[i::300]), "en", "s") for i in range(300)]
    got = collocations.mine(frame(spark, rows), cells=512).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == collocations_by_hand(rows)


def test_collocations_go_no_further_than_their_cycle(spark, monkeypatch):
    """Counts of a length and step of activation are carried for one cycle; at its end only frequent phrases are left."""
    steps = []
    real = collocations.table
    monkeypatch.setattr(collocations, "table", lambda df, name: real(df, name) if name != "phrase-counts" else steps.append(real(df, name)) or steps[-1])
    rows = made(4, 200) + [(20_000 + i, "rare pair here", "en", "s") for i in range(12)]
    got = collocations.mine(frame(spark, rows), shards=2).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == collocations_by_hand(rows)
    ended = 0
    for step, t in enumerate(steps):
        for r in t.filter("words > 1").collect():
            assert r["start"] < step <= r["start"] + 2
            if step == r["start"] + 2:
                ended += 1
                assert collocations.unpacked(r["counts"], "int64").min() >= 10
    assert ended and len(steps) > 4


@pytest.mark.parametrize("block", [5, 300, 1 << 20])
def test_collocations_blocks_hold_all_words(spark, block):
    """Words by place, of each language and shard, are those of the texts, in pieces."""
    import json

    import zstandard

    rows = made(5, 60)
    docs = frame(spark, rows).selectExpr("coalesce(lang, 'und') as lang", "coalesce(text, '') as text", "cast(abs(hash(text)) % 2 as int) as shard")
    got, want, size = collections.Counter(), collections.Counter(), 0
    stored = collocations.blocks(docs, 2, block).collect()
    for b in stored:
        names = zstandard.decompress(b["names"]).split(b"\n")
        langs = [x for x, n in json.loads(b["langs"]) for _ in range(n)]
        at, size = collocations.unpacked(b["at"], "int32").tolist(), size + b["size"]
        assert at[0] == at[-1] == 0
        piece = []
        for i in at:
            if i == 0 and piece:
                assert len({langs[j - 1] for j in piece}) == 1
                got[b["shard"], langs[piece[0] - 1], b" ".join(names[j - 1] for j in piece)] += 1
            piece = [*piece, i] if i else []
    for r in docs.collect():
        pieces = (re.findall("[^ \t]+", x) for x in re.split("[.,;:!?\n-\r]", lower(r["text"])))
        want.update((r["shard"], r["lang"], " ".join(x).encode()) for x in pieces if x)
    assert got == want and size >= sum(len((t or "").encode()) for _, t, _, _ in rows)
    assert (len(stored) > 6) == (block < 1000)


def test_collocations_exact_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000
    rows = [("en", 0, "", 9 * big), ("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1)]
    monkeypatch.setattr(collocations, "frequencies", lambda *a: spark.createDataFrame(rows, "lang string, words int, phrase string, n long"))
    r = collocations.mine(spark.createDataFrame([], SCHEMA)).first()
    assert r["score"] == 1_000_000 * (big - 1) ** 2 // (big * (big + 1))


def test_collocations_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, None, None, None)], SCHEMA)).count() == 0


def model_by_hand(rows, order):
    """Plain recursion over counts of word tuples; a text begins after an end that isn't counted."""
    texts = [(("" if i is None else str(i)), re.findall("[^ \t-\r]+", lower(t))) for i, t, _, _ in rows]
    taught = [w for i, w in texts if zlib.crc32(i.encode()) % 5 != 1]
    one, c = collections.Counter(), collections.Counter()
    for w in taught:
        one.update([*w, None])
        s = [None, *w, None]
        for k in range(2, order + 1):
            c.update(tuple(s[j : j + k]) for j in range(len(s) - k + 1))
    n, v = sum(one.values()), len(one)
    base = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    context = lambda h: one[h[0]] if len(h) == 1 else c[h]

    def p(h, w):
        if not h:
            return base(w)
        ch = context(h)
        if not ch:
            return p(h[1:], w)
        m = lm_score.PRIOR * ch**lm_score.POWER
        return (c[(*h, w)] + m * p(h[1:], w)) / (ch + m)

    out = []
    for i, w in texts:
        s = [None, *w, None]
        out.append((i, len(w) + 1, sum(one[x] > 0 for x in s[1:]), n, sum(math.log10(base(x)) for x in s[1:]), sum(math.log10(p(tuple(s[max(0, j - order + 1) : j]), s[j])) for j in range(1, len(s)))))
    return out


@pytest.mark.parametrize(("order", "bucket", "ranges"), [(2, 8 << 20, 8 << 20), (3, 2000, 700), (4, 500, 5000)])
def test_language_model(spark, order, bucket, ranges):
    rows = made(order, 150)
    got = lm_score.score(frame(spark, rows), order=order, bucket_bytes=bucket, range_bytes=ranges)
    assert dict(got.dtypes)["doc_id"] == "bigint"
    found = sorted((("" if r["doc_id"] is None else str(r["doc_id"])), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got.collect())
    want = sorted((i, n, k, t, round(b, 6), round(s, 6)) for i, n, k, t, b, s in model_by_hand(rows, order))
    assert [x[:4] for x in found] == [x[:4] for x in want]
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6) for x, y in zip(found, want, strict=True) for a, b in zip(x[4:], y[4:], strict=True))
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 1) for r in got.collect())


def test_language_model_adds_up(spark):
    """From each context, the probabilities of all words and an unknown one are 1: texts that end in each word after each context."""
    taught = ["a b a b c", "b a a c", "c c b"] * 5
    one = collections.Counter(" ".join([*taught, *["."] * 15]).split())
    contexts = ["", "a", "a b", "b a", "c c", "b c", "q", "a q", "q a"]
    asked = [f"{c} {w}" for c in contexts for w in ("a", "b", "c", "zz")] + contexts
    b = lm_score.texts(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(taught + asked)], SCHEMA).coalesce(1)).first()
    own = lm_score.Bucket(bytes(b["blob"]), [i >= 15 for i in range(len(taught + asked))], 3)
    n, v = sum(one.values()), len(one)
    a = lm_score.Automaton(own, own.word_counts(), own.keys()[1], n, v)
    def last(i):  # of the word before the end, and of the end
        places = range(own.ends[i] - own.lengths[i] + 1, own.ends[i] + 1)
        until = [a.walk(places[0], places[0] + k) for k in range(-1, len(places))]
        return until[-2] - until[-3], until[-1] - until[-2]

    for k, c in enumerate(contexts):
        first = 15 + 4 * k
        words = [10 ** last(first + j)[0] for j in range(4)]
        closing = 10 ** (last(15 + 36 + k)[1] if c else a.walk(own.ends[15 + 36], own.ends[15 + 36]))
        assert math.isclose(sum(words) + closing, 1, rel_tol=1e-9), c


def test_language_model_of_nothing(spark):
    assert lm_score.score(spark.createDataFrame([], SCHEMA)).count() == 0
    untaught = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm_score.score(spark.createDataFrame([(untaught, "only held out", "en", "s")], SCHEMA)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"], r["base_score"]) == (4, 0, 0, 0.0, 0.0)


def test_language_model_beats_its_base(spark, sf_dir):
    """Of held-out documents of the small table, near copies of training texts among them."""
    got = lm_score.score(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]


def audit_by_hand(rows, least=3, terms=200):
    docs, counts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, t, lang, source in rows:
        w = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t))
        docs[lang or ""].update(set(w))
        counts[lang or "", source or ""].update(w)
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: c for (x, s), c in counts.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            over = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:terms]
            out += [(lang, s, part, x.decode(), -v, i) for part, some in (("pair", pairs), ("term", over)) for i, (v, x) in enumerate(some, 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "block", "shard_rows", "cells"), [(1, 16 << 20, 100_000, 1 << 20), (2, 300, 7, 10)])
def test_audit(spark, monkeypatch, seed, block, shard_rows, cells):
    monkeypatch.setattr(divergence.partial_counts, "__defaults__", ("text", "lang", "source", block))
    monkeypatch.setattr(divergence, "CELLS", cells)
    real = divergence.partial_counts
    monkeypatch.setattr(divergence, "partial_counts", lambda *a: real(*a, block))
    rows = made(seed, 200)
    got = sorted(tuple(r) for r in divergence.audit(frame(spark, rows), shard_rows=shard_rows).collect())
    want = audit_by_hand(rows)
    assert got == want and {x[2] for x in want} == {"pair", "term"}
    assert sorted(sql("op13_divergence_audit", rows)) == want


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    got = divergence.audit(spark.createDataFrame([(1, "", "en", "a"), (2, None, "en", None)], SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [("en", "", "pair", "a", 0, 1), ("en", "a", "pair", "", 0, 1)]


def test_audit_beyond_64_bits(spark):
    """Shares of counts whose thousand-million-fold passes 64 bits."""
    r = spark.range(1).select(divergence._share("20000000000", "30000000000", "7").alias("p"), divergence._share("0", "0", "1").alias("q")).first()
    assert (r["p"], r["q"]) == (1 + 10**9 * (2 * 10**10 + 1) // (3 * 10**10 + 7), 1_000_000_001)
