"""Stores that grow by batches, against plain dictionaries, full rebuilds and the batch forms."""

import glob
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import evaluation as E
from ticketloom.operators import kb as K
from ticketloom.operators import keyword_index as X
from ticketloom.operators import retrieval as R
from ticketloom.sources.store import KeyedStore, newest

ROWS = "id long, version long, text string"


def written(path, kind, batch):
    return sum(ds.dataset(f).count_rows() for f in glob.glob(f"{path}/{kind}/batch_no={batch}/**/*.parquet", recursive=True))


@pytest.mark.parametrize("turns", [1, 3, 8])
def test_newest_rows(spark, tmp_path, turns):
    """Versions that fall, ties, null versions and keys, an empty batch, and batches that come twice."""
    rng, store, want = random.Random(turns), KeyedStore(str(tmp_path), ROWS, "id", newest("id", "version"), turns), {}
    assert store.read(spark).count() == 0 and store.last(spark) == -1
    for k in range(11):
        rows = {i: (i, rng.choice([None, 1, 2, 3]), f"t{k}") for i in [*rng.sample(range(30), 9), None]} if k != 4 else {}
        batch = spark.createDataFrame(list(rows.values()), ROWS)
        assert store.apply(batch, "a", k)
        assert not store.apply(spark.createDataFrame([(1, 99, "again")], ROWS), "a", k)
        for i, r in rows.items():
            if i not in want or (r[1] or 0) >= (want[i][1] or 0):
                want[i] = r
        assert {r["id"]: tuple(r) for r in store.read(spark).collect()} == want


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    """1 % of the keys, spread over all buckets: under 5 % of the store is written, and as much read."""
    n, store = 200_000, KeyedStore(str(tmp_path), ROWS, "id", newest("id", "version"))
    some = lambda step, k: spark.range(0, n, step).select("id", F.lit(k).cast("long").alias("version"), F.lit(f"t{k}").alias("text"))
    store.apply(some(1, 0))
    for k in range(1, 5):
        store.apply(some(100, k))
    for k in (1, 3, 4):
        assert written(tmp_path, "rows", k) == n // 100
        assert 0 < written(tmp_path, "folded", k) < 0.04 * n
        assert written(tmp_path, "rows", k) + written(tmp_path, "folded", k) < 0.05 * n
        # Read: the rows of one bucket, those of the first batch too.
        since = sum(ds.dataset(f).count_rows() for j in range(k + 1) for f in glob.glob(f"{tmp_path}/rows/batch_no={j}/bucket_no={k % 32}/*.parquet"))
        assert written(tmp_path, "folded", k) <= since < 0.05 * n
    got = store.read(spark).groupBy("version").count().collect()
    assert {r["version"]: r["count"] for r in got} == {0: n - n // 100, 4: n // 100}


def test_a_batch_that_failed(spark, tmp_path):
    """A batch that fails while it folds leaves the store as it was, and counts once when it comes again."""

    def counted(rows):
        return rows.groupBy("id").agg(F.sum("version").alias("version"), F.lit("").alias("text"))

    def failing(rows):
        raise RuntimeError("lost")

    batch = spark.createDataFrame([(i, 1, "") for i in range(20)], ROWS)
    good, bad = [KeyedStore(str(tmp_path), ROWS, "id", m, 2) for m in (counted, failing)]
    for k in range(5):
        with pytest.raises(RuntimeError):
            bad.apply(batch, "s", k)
        assert good.last(spark) == k - 1
        assert good.apply(batch, "s", k)
    assert {(r["id"], r["version"]) for r in good.read(spark).collect()} == {(i, 5) for i in range(20)}


T0 = datetime(2024, 1, 1)
DECIDE = "eval_id string, new_status string, note string, at timestamp"


def test_ledger_in_batches(spark, tmp_path):
    """Sightings and decisions in any order give what the whole-table forms give, one after the other."""
    rng = random.Random(5)
    store = E.ledger_store(str(tmp_path), 3)
    whole = spark.createDataFrame([], "eval_id string, reason string, status string, seen_count long, resolution string, first_seen_at timestamp, last_seen_at timestamp, resolved_at timestamp")
    columns, seen = whole.columns, set()
    for k in range(9):
        if k % 3 == 2:
            rows = [(str(rng.randrange(14)), rng.choice(["已解决", "已解决", "已解决", "无需解决", "未解决", "?"]), rng.choice([" fixed ", "x", "y", "z", " ", None]), T0 + timedelta(days=k)) for _ in range(25)]
            rows = list(({r[0]: r for r in rows} | {i: (i, st, "told", T0 + timedelta(days=k)) for i, st in (("1", "无需解决"), ("2", "已解决"))}).values())
            batch = spark.createDataFrame(rows, DECIDE)
            store.apply(E.rulings(batch))
            whole = E.resolve(whole, batch)
        else:
            rows = [(str(rng.randrange(12)), rng.choice(["a", "b", None]), T0 + timedelta(days=k, seconds=rng.randrange(10**6))) for _ in range(15)] + [(i, "c", T0 + timedelta(days=k)) for i in "12"] + [("3", f"hot{j}", T0 + timedelta(days=k, seconds=j)) for j in range(40)]
            batch = spark.createDataFrame(rows, "eval_id string, reason string, seen_at timestamp")
            store.apply(E.sightings(batch.unionByName(spark.createDataFrame([(None, "no case", T0)], batch.schema))))
            whole = E.ledger_upsert(whole, batch)
        whole = spark.createDataFrame(whole.collect(), whole.schema)
        got = sorted((tuple(r) for r in store.read(spark).select(*columns).collect()), key=str)
        assert got == sorted((tuple(r) for r in whole.collect()), key=str)
        seen |= {(r[2], r[4] is None, r[7] is None) for r in got}
    assert {("已解决", False, False), ("未解决", True, False), ("未解决", True, True), ("无需解决", False, False)} <= seen


class Failing(KeyedStore):
    def apply(self, rows, source="", number=None):
        raise RuntimeError("lost")


def test_index_in_batches(spark, tmp_path):
    """After any split of the chunks, with changed and removed ones and a failure between both steps, the search is that of a full build."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(25)]
    embed = K.embedder(K.term_vector, "double")
    index, done = X.index_store(f"{tmp_path}/index", 3), X.done_store(f"{tmp_path}/done", 2)
    queries = spark.createDataFrame([(q, " ".join(rng.choices(words, k=4))) for q in range(6)], "query long, text string")
    terms = R.asked_terms(queries, "query", "text")
    held: dict[int, str] = {}
    for k in range(5):
        batch = {rng.randrange(40): rng.choice(["", None, *[" ".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(6)]]) for _ in range(15)}
        gone = rng.sample(sorted(held), 3) if held else []
        rows = spark.createDataFrame([*batch.items(), (None, "nobody")], "id long, text string")
        removed = spark.createDataFrame([(i,) for i in gone], "id long")
        if k == 2:
            with pytest.raises(RuntimeError):
                X.sync(rows, index, Failing(done.path, done.schema, "id", done.merge, 2), embed, removed)
            at = index.last(spark)
        X.sync(rows, index, done, embed, removed)
        if k == 2:  # all was indexed: nothing but the removals is written again
            assert written(index.path, "rows", at + 1) == len(gone)
        held = {i: t for i, t in (held | {i: t or "" for i, t in batch.items()}).items() if i not in gone}
        assert {r["id"] for r in done.read(spark).collect()} == set(held)
        now = spark.createDataFrame(list(held.items()), "id long, text string")
        full = R.bm25_index(now, "id", "text", marked=True)
        cols = ["term", "doc", "tf", "dl"]
        assert sorted(map(tuple, X.postings(spark, index).select(*cols).collect())) == sorted(map(tuple, full.select(*cols).collect()))
        got, want = [R.bm25_search(R.bm25_blocks(p, 4), terms, 5).collect() for p in (X.postings(spark, index, terms), full)]
        assert got and sorted(map(tuple, got)) == sorted(map(tuple, want))
    vectors = {r["id"]: r["vector"] for r in index.read(spark).collect()}
    assert vectors == {r["id"]: r["v"] for r in now.select("id", embed(F.coalesce("text", F.lit(""))).alias("v")).collect()}
