"""Numbering over many partitions, and streams whose files arrive in any order."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import kb as K
from ticketloom.operators import mining as M
from ticketloom.sources import io
from ticketloom.streaming import jobs


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_numbers_are_dense(spark, adaptive):
    n = 300_000
    rows = spark.range(0, n, 1, 16).select(F.xxhash64("id").alias("key"), F.repeat(F.lit("x"), 20).alias("wide"))
    got = M.numbered(rows, "key", "n")
    r = got.agg(F.count("*").alias("rows"), F.countDistinct("n").alias("numbers"), F.min("n").alias("low"), F.max("n").alias("high")).first()
    assert tuple(r) == (n, n, 0, n - 1)
    assert got.columns == ["key", "wide", "n"]
    pairs = got.select("n", "key").alias("a").join(got.select((F.col("n") - 1).alias("n"), F.col("key").alias("next")).alias("b"), "n")
    assert pairs.filter("key > next").count() == 0 and pairs.count() == n - 1


def test_links_of_many_chunks(spark, adaptive):
    n = 200_000
    rows = spark.range(0, n, 1, 16).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 5000)).alias("doc"), F.col("id").alias("place"))
    got = K.linked(rows, "doc", "place", 1)
    r = got.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.max("id").alias("high"), F.count_if(F.col("prev_chunk_id").isNull()).alias("first"), F.count_if(F.col("next_chunk_id").isNull()).alias("last")).first()
    docs = rows.select("doc").distinct().count()
    assert tuple(r) == (n, n, n, docs, docs)
    other = got.select(F.col("id").alias("prev_chunk_id"), F.col("doc").alias("d"), F.col("place").alias("p"), F.col("next_chunk_id").alias("back"))
    both = got.join(other, "prev_chunk_id")
    assert both.count() == n - docs and both.filter("doc <> d or p >= place or back <> id").count() == 0


def test_batches_number_small_tables(spark):
    assert M.batches(spark.range(0), "id", "0").count() == 0
    got = M.batches(spark.range(0, 45, 1, 7), "id", "0").collect()
    assert {r["id"]: r["batch_no"] for r in got} == {i: f"BATCH_0_{i // 20 + 1:03d}" for i in range(45)}


def test_shared_folder_is_asked_for(spark, monkeypatch):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf(**{k.replace("_", "."): v for k, v in values.items()})

    assert io.shared_dir(Session(spark_master="spark://h:7077", spark_checkpoint_dir="s3a://b/x/")) == "s3a://b/x"
    assert io.shared_dir(Session(spark_master="local[4]"))
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            io.shared_dir(Session(spark_master=master))


def anchors(rows, most):
    """The batch form: (anchor, kept tokens) of each conversation that has one."""
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((i, t) for k, i, t in rows if k == c)
        total, anchor = sum(t for _, t in own), None
        while total > most:
            anchor, gone = own.pop(0)
            total -= gone
        if anchor is not None:
            out[c] = anchor, total
    return out


@pytest.mark.parametrize("arrival", ["reversed", "each its own", "random"])
def test_triggers_in_any_order(spark, tmp_path, arrival):
    rng = random.Random(11)
    rows = [(c, i, rng.choice([0, 30, 60, 90])) for c in range(4) for i in range(1, 7)] + [(9, 1, 500)]
    if arrival == "reversed":
        parts = sorted(([r for r in rows if r[1] == k] for k in range(1, 7)), key=lambda p: -p[0][1])
    elif arrival == "each its own":
        parts = [[r] for r in rng.sample(rows, 12)] + [[r for r in rows]]
        once = {r for p in parts[:-1] for r in p}
        parts[-1] = [r for r in rows if r not in once]
    else:
        mixed = rng.sample(rows, len(rows))
        parts = [mixed[k : k + 6] for k in range(0, len(mixed), 6)]
    schema = "conversation long, id long, tokens long"
    out, seen = [], tmp_path / "in"
    seen.mkdir()
    for k, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(f"{tmp_path}/w{k}")
        (file,) = (tmp_path / f"w{k}").glob("*.parquet")
        target = seen / f"f{k:03d}.parquet"
        file.rename(target)
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))  # the order of arrival
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(seen))
    got = jobs.summary_triggers(stream, 100, None)
    got.writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in out:
        assert r["anchor"] > last.get(r["conversation"], 0)  # it only grows
        last[r["conversation"]] = r["anchor"]
    want = anchors(rows, 100)
    assert last == {c: a for c, (a, _) in want.items()}


def stream_of(spark, tmp_path, parts, schema):
    seen = tmp_path / "in"
    seen.mkdir()
    for k, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(f"{tmp_path}/w{k}")
        (file,) = (tmp_path / f"w{k}").glob("*.parquet")
        os.utime(file.rename(seen / f"f{k:03d}.parquet"), (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(seen))


def test_gap_store_compacts(spark, tmp_path):
    rng = random.Random(2)
    parts = [[(10 * k + i, rng.choice(["a", " A", "b", "c "])) for i in range(4)] for k in range(7)]
    assert jobs.read_gaps(spark, f"{tmp_path}/none").count() == 0
    jobs.gap_counters(stream_of(spark, tmp_path, parts, "id long, question string"), f"{tmp_path}/s", f"{tmp_path}/c", 3).awaitTermination()
    rows = [r for p in parts for r in p]
    want = {k: (min(i for i, q in rows if q.strip().lower() == k), sum(q.strip().lower() == k for _, q in rows)) for k in {q.strip().lower() for _, q in rows}}
    assert {r["gap"]: (r["first_id"], r["occurrence_count"]) for r in jobs.read_gaps(spark, f"{tmp_path}/s", 3).collect()} == want
    assert sorted(p.name for p in (tmp_path / "s" / "bases").iterdir()) == ["n=2", "n=5"]
    # A batch that runs again changes nothing.
    again = spark.createDataFrame([(q.strip().lower(), q, i, 1) for i, q in parts[5]], jobs.GAPS)
    jobs.append_changes(f"{tmp_path}/s", 5, again, jobs.GAPS, jobs.merged_gaps, 3)
    assert {r["gap"]: (r["first_id"], r["occurrence_count"]) for r in jobs.read_gaps(spark, f"{tmp_path}/s", 3).collect()} == want


def test_index_store_takes_the_last_version(spark, tmp_path):
    parts = [[(1, "a", "pending"), (2, "b", "done")], [(1, "a2", "pending"), (3, "c", "pending")], [(2, "b2", "pending"), (2, "b2", "pending")]]
    jobs.index_pending(stream_of(spark, tmp_path, parts, "id long, answer string, vectorize_status string"), K.embedder(), F.col("answer"), f"{tmp_path}/s", f"{tmp_path}/c", 2).awaitTermination()
    got = {r["id"]: r for r in jobs.read_index(spark, f"{tmp_path}/s", 2).collect()}
    assert {i: r["version"] for i, r in got.items()} == {1: 1, 2: 2, 3: 1} and all(r["vectorize_status"] == "done" for r in got.values())
    assert abs(got[1]["vector"][0] - float(K.hashed_vector("a2")[0])) < 1e-6
