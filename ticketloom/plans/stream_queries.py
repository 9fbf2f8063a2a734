"""The streaming forms over the given tables: a file stream, run to its end, and what it left behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import kb as K
from ..streaming import jobs
from .context_queries import tokens_sql
from .kb_queries import _folder
from .label_queries import strip_sql
from .tables import Registry, read

QUERIES = Registry()
add = QUERIES.add


def _stream(rows: DataFrame, order: str, parts: int = 3) -> DataFrame:
    """`rows` as a stream of files, written to the shared folder in ranges of `order`."""
    spark, path = rows.sparkSession, _folder(rows.sparkSession)
    rows.repartitionByRange(parts, order).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _ordered_stream(rows: DataFrame, order: str) -> DataFrame:
    """As `_stream`, but files come in the order of their ranges: each is written after the one before it."""
    spark, path = rows.sparkSession, _folder(rows.sparkSession)
    cuts = rows.agg(F.percentile_approx(order, [0.3, 0.6])).first()[0] or []
    edges = [None, *cuts, None]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = rows if a is None else rows.filter(F.col(order) > F.lit(a))
        (part if b is None else part.filter(F.col(order) <= F.lit(b))).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@add(
    "x1_gap_counters",
    f"select lower({strip_sql('text')}) as gap, min(doc_id) as first_id, count(*) as occurrence_count from documents group by 1",
)
def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _folder(spark)
    pool = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"))
    jobs.gap_counters(_stream(pool, "id"), store, _folder(spark)).awaitTermination()
    return jobs.read_gaps(spark, store).drop("question")


@add(
    "x2_summary_triggers",
    f"""with t as (select conv_id, turn, {tokens_sql('text')} as tok from conversations), s as (select *, sum(tok) over (partition by conv_id order by turn desc) as suffix from t)
    select conv_id as conversation, max(turn) filter (suffix > 200) as anchor, coalesce(max(suffix) filter (suffix <= 200), 0)::bigint as kept_tokens from s group by 1 having max(turn) filter (suffix > 200) is not null""",
)
def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark)
    m = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation"), F.col("turn").alias("id"), T.estimated_tokens(F.col("text")).alias("tokens"))
    got = jobs.summary_triggers(_stream(m, "id"), 200, None)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b={number}")

    got.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("conversation long, anchor long, kept_tokens long, batch int").parquet(f"{out}/*")
    # A conversation's last anchor is its largest; messages that came later without a trigger count as kept.
    last = rows.groupBy("conversation").agg(F.max("anchor").alias("anchor"))
    tail = m.join(last, "conversation").filter("id > anchor").groupBy("conversation").agg(F.sum("tokens").alias("kept"))
    return last.join(tail, "conversation", "left").select("conversation", "anchor", F.coalesce("kept", F.lit(0)).alias("kept_tokens"))


@add("x3_index_pending", "select doc_id as id, doc_id::varchar as vector_id, 'done' as vectorize_status from documents where doc_id % 5 = 0")
def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _folder(spark)
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"), F.when(F.col("doc_id") % 5 == 0, "pending").otherwise("done").alias("vectorize_status"))
    jobs.index_pending(_stream(chunks, "id"), K.embedder(), F.col("answer"), store, _folder(spark)).awaitTermination()
    return jobs.read_index(spark, store).select("id", "vector_id", "vectorize_status")


@add(
    "e11_ledger_stream",
    "select user_id::varchar as eval_id, '未解决' as status, count(*) as seen_count, arg_max(event_type || ':' || event_id, ts) as reason, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from events group by 1",
)
def e11s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in the order of their times, streamed into a ledger."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("eval_id"), F.concat_ws(":", "event_type", "event_id").alias("reason"), F.col("ts").cast("timestamp").alias("seen_at"))
    store = E.ledger_store(_folder(spark), 4)
    jobs.ledger_stream(_ordered_stream(rows, "seen_at"), store, _folder(spark)).awaitTermination()
    us = lambda c: F.unix_micros(F.col(c))
    return store.read(spark).select("eval_id", "status", "seen_count", "reason", us("first_seen_at").alias("first_us"), us("last_seen_at").alias("last_us"))
