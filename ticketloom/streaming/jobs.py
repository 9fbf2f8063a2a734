"""Streaming forms of the keyed jobs: gap counters, summary triggers, pending chunks, ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.evaluation import sightings
from ..operators.flywheel import gap_key
from ..operators.kb import embed_pending
from ..sources.store import KeyedStore


#: Micro-batches whose changes are merged into one base.
COMPACT = 16
GAPS = "gap string, question string, first_id long, occurrence_count long"
INDEX = "id long, vector_id string, vectorize_status string, vector array<float>, version long"
Merge = Callable[[DataFrame], DataFrame]


def _state(spark: SparkSession, store: str, last: int, schema: str, merge: Merge, compact: int) -> DataFrame:
    """The store after batch `last`: the newest base and the changes behind it, merged."""
    base = (last + 1) // compact * compact - 1
    paths = [f"{store}/bases/n={base}"] * (base >= 0) + [f"{store}/changes/n={k}" for k in range(base + 1, last + 1)]
    return merge(spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema))


def append_changes(store: str, number: int, changes: DataFrame, schema: str, merge: Merge, compact: int = COMPACT) -> None:
    """Write a micro-batch's merged changes under its number; each `compact`-th batch also merges base and changes into the next base.

    A batch costs what it holds, not what the store holds. One that runs again after a failure overwrites its own folders
    and reads only those of batches before it, so nothing counts twice.
    """
    spark = changes.sparkSession
    merge(changes).write.mode("overwrite").parquet(f"{store}/changes/n={number}")
    if (number + 1) % compact == 0:
        base = number - compact
        paths = [f"{store}/bases/n={base}"] * (base >= 0) + [f"{store}/changes/n={k}" for k in range(base + 1, number + 1)]
        merge(spark.read.schema(schema).parquet(*paths)).write.mode("overwrite").parquet(f"{store}/bases/n={number}")


def read_store(spark: SparkSession, store: str, schema: str, merge: Merge, compact: int = COMPACT) -> DataFrame:
    """A store as it stands; empty before its first batch."""
    try:
        last = spark.read.schema(f"{schema}, n long").parquet(f"{store}/changes").agg(F.max("n")).first()[0]
    except AnalysisException:  # nothing was written yet
        last = None
    # A batch may hold no rows and so no number of its own; the batches behind it do, and before it nothing is missing.
    return _state(spark, store, -1 if last is None else last, schema, merge, compact)


def merged_gaps(rows: DataFrame) -> DataFrame:
    """Counts of each gap's key, with the question of its first id."""
    return rows.groupBy("gap").agg(F.min_by("question", "first_id").alias("question"), F.min("first_id").alias("first_id"), F.sum("occurrence_count").alias("occurrence_count"))


def merged_index(rows: DataFrame) -> DataFrame:
    """The row of the highest version of each id."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy("id").agg(F.max_by(row, "version").alias("r")).select("r.*")


def gap_counters(pool: DataFrame, store: str, checkpoint: str, compact: int = COMPACT) -> StreamingQuery:
    """A stream of questions (id, question) into gaps (gap, question, first_id, occurrence_count) by key; read by `read_gaps`."""

    def add(batch: DataFrame, number: int) -> None:
        new = batch.select(gap_key(F.col("question")).alias("gap"), "question", F.col("id").alias("first_id"), F.lit(1).cast("long").alias("occurrence_count"))
        append_changes(store, number, new, GAPS, merged_gaps, compact)

    return pool.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_gaps(spark: SparkSession, store: str, compact: int = COMPACT) -> DataFrame:
    return read_store(spark, store, GAPS, merged_gaps, compact)


def summary_triggers(messages: DataFrame, most: int, idle_ms: int | None = 1_800_000) -> DataFrame:
    """A stream of (conversation, id, tokens) into (conversation, anchor, kept_tokens), a row whenever old messages must leave layer 1.

    The anchor is the newest message whose own and all newer tokens are over `most`; it only grows, in whatever order
    messages come: one that is not newer than the anchor has left already and is ignored. The state is the anchor and the
    messages behind it that hold tokens: bounded by the budget. It goes after `idle_ms` without a message; None keeps it,
    for streams that are run to their end (a query with processing-time timeouts never ends).
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, ids, sizes = state.get if state.exists else (None, [], [])
        held, moved = list(zip(ids, sizes, strict=True)), False
        for p in parts:
            held += [(i, t) for i, t in zip(p["id"].tolist(), p["tokens"].tolist(), strict=True) if t > 0 and (anchor is None or i > anchor)]
        held.sort()
        total = sum(t for _, t in held)
        while total > most:
            anchor, gone = held.pop(0)
            total, moved = total - gone, True
        state.update((anchor, [i for i, _ in held], [t for _, t in held]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if moved:
            yield pd.DataFrame({"conversation": [key[0]], "anchor": [anchor], "kept_tokens": [total]})

    return messages.groupBy("conversation").applyInPandasWithState(fold, "conversation long, anchor long, kept_tokens long", "anchor long, ids array<long>, tokens array<long>", "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def index_pending(chunks: DataFrame, embed: Callable[[Column], Column], text: Column, store: str, checkpoint: str, compact: int = COMPACT) -> StreamingQuery:
    """A stream of chunks; the pending ones are embedded and upserted by id, a later batch's row in place of an earlier one's; read by `read_index`."""

    def add(batch: DataFrame, number: int) -> None:
        new = embed_pending(batch, embed, text).withColumn("version", F.lit(number).cast("long"))
        append_changes(store, number, new.select(*[c.split()[0] for c in INDEX.split(", ")]), INDEX, merged_index, compact)

    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, store: str, compact: int = COMPACT) -> DataFrame:
    return read_store(spark, store, INDEX, merged_index, compact)


def ledger_stream(answers: DataFrame, ledger: KeyedStore, checkpoint: str, source: str = "answers") -> StreamingQuery:
    """A stream of unfaithful answers (eval_id, reason, seen_at) into a ledger (`ledger_store`), which also takes decisions between its micro-batches.

    The state of a case is its row in the store, so the stream holds none, and a micro-batch that comes again after a
    restart is known by its number. Reasons and times go by the order of micro-batches, as in `ledger_upsert`.
    """

    def add(batch: DataFrame, number: int) -> None:
        ledger.apply(sightings(batch), source, number)

    return answers.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
