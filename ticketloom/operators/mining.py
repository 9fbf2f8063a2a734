"""Mining question-answer pairs from dialogues: transcripts, batches, parsing, exact and semantic dedup."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.io import stored
from .retrieval import sound

#: Parameters: conversations of a batch, cosine from which an answer repeats another, vectors of a block.
BATCH, SIMILAR, BLOCK = 20, 0.92, 2000
_PAIR = "array<struct<question:string,answer:string>>"


def transcripts(messages: DataFrame, conversation: str, order: list[str], role: str, content: str) -> DataFrame:
    """M1: (conversation, source_ref, transcript, message_count) of user and assistant lines, in order; empty ones drop out."""
    said = messages.filter(F.col(role).isin("user", "assistant") & (F.coalesce(T.strip(F.col(content)), F.lit("")) != ""))
    line = F.concat(F.when(F.col(role) == "user", "用户: ").otherwise("客服: "), T.strip(F.col(content)))
    g = said.groupBy(F.col(conversation).alias("conversation")).agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("l")))).alias("ls"))
    return g.select("conversation", F.concat(F.lit("conversation:"), F.col("conversation").cast("string")).alias("source_ref"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("transcript"), F.size("ls").cast("long").alias("message_count"))


def numbered(rows: DataFrame, order: str | list[str], name: str = "n") -> DataFrame:
    """Numbers from 0 in order, by ranges and their offsets: no task holds all rows.

    The sorted rows are written once, each with its range and its place there, so that counting the ranges and numbering
    the rows see the same ranges. Rows of equal order get neighbouring numbers, in any order among them.
    """
    inner = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    s = stored(rows.sort(order).withColumn("_range", F.spark_partition_id()).withColumn("_place", inner), "sorted")
    sizes = s.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    return s.join(F.broadcast(before.select("_range", "_before")), "_range", "left").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def batches(rows: DataFrame, order: str, stamp: str, size: int = BATCH) -> DataFrame:
    """M2: each conversation's batch number, `size` to a batch in order of id."""
    n = numbered(rows, order, "_at")
    return n.withColumn("batch_no", F.format_string(f"BATCH_{stamp}_%03d", F.floor(F.col("_at") / size) + 1)).drop("_at")


def parsed_pairs(model: Column) -> Column:
    """M3: a model's pairs, fenced or wrapped or not, blank ones left out; what can't be read gives none."""
    body = T.json_body(model)
    wrapped = [F.from_json(F.get_json_object(body, f"$.{k}"), _PAIR) for k in ("items", "qa_list", "data")]
    both = F.coalesce(*wrapped, F.when(body.startswith("["), F.from_json(body, _PAIR)), F.expr(f"cast(array() as {_PAIR})"))
    return F.filter(both, lambda x: (F.coalesce(T.strip(x["question"]), F.lit("")) != "") & (F.coalesce(T.strip(x["answer"]), F.lit("")) != ""))


def staged(rows: DataFrame, pairs: Column) -> DataFrame:
    """M4: a row for each pair: trimmed, extracted, with its batch and source."""
    e = rows.select("batch_no", "source_ref", F.explode(pairs).alias("p"))
    return e.select("batch_no", "source_ref", T.strip(F.col("p.question")).alias("question"), T.strip(F.col("p.answer")).alias("answer"), F.lit("extracted").alias("status"))


def exact_dedup(rows: DataFrame, id: str, question: str, answer: str) -> DataFrame:
    """M5: (id, status): of equal cleaned questions the longest trimmed answer is kept, of these the lowest id.

    The choice is a maximum with partial aggregation, so a key that many rows share doesn't gather in one task.
    Questions may be long: their keys are shuffled as hashes.
    """
    r = rows.select(F.col(id).alias("id"), F.sha2(F.coalesce(T.dedup_key(F.col(question)), F.lit("")), 256).alias("k"), F.coalesce(F.length(T.strip(F.col(answer))), F.lit(0)).alias("n"))
    best = r.groupBy("k").agg(F.max(F.struct(F.col("n"), -F.col("id"))).alias("b"))
    kept = best.select((-F.col("b.col2")).alias("id"), F.lit(True).alias("kept"))
    return r.join(kept, "id", "left").select("id", F.when(F.col("kept"), "kept").otherwise("discarded").alias("status"))


def similar_pairs(rows: DataFrame, least: float = SIMILAR, by: str | None = None, block: int = BLOCK) -> DataFrame:
    """(id, other) with cosine >= least, other before id in `place`, by matrix products of blocks.

    rows (id, place, vector, more). Blocks hold about `block` vectors; each pair of blocks is a task, so the work spreads
    evenly and only pairs that pass leave it. `by` limits pairs to rows that agree in that column. Vectors that are null,
    empty or hold null or non-finite numbers, and vectors of different lengths, make no pair.
    """
    rows = rows.filter(sound("vector"))
    n = max(1, -(-rows.count() // block))
    key = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    own = rows.select("id", "place", "vector", (F.col(by) if by else F.lit(0)).alias("by"), key.alias("c")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    own = own.select("id", "place", "vector", "by", "c", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(p["vector"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        ids, place, same, c = (p[k].to_numpy() for k in ("id", "place", "by", "c"))
        left, right = (np.flatnonzero(c == p["i"].iloc[0]), np.flatnonzero(c == p["j"].iloc[0]))
        hit = (x[left] @ x[right].T >= least) & (same[left][:, None] == same[right][None, :]) & (place[left][:, None] != place[right][None, :])
        if p["i"].iloc[0] == p["j"].iloc[0]:
            hit &= place[left][:, None] > place[right][None, :]
        a, b = (z[k] for z, k in zip((left, right), np.nonzero(hit), strict=True))
        late = place[a] > place[b]
        return pd.DataFrame({"id": np.where(late, ids[a], ids[b]), "other": np.where(late, ids[b], ids[a])})

    return own.groupBy("i", "j", F.size("vector")).applyInPandas(run, "id long, other long")


def semantic_dedup(rows: DataFrame, least: float = SIMILAR, by: str | None = None) -> DataFrame:
    """M6: (id, status): in order of place, a row is discarded if it is similar to one kept before it.

    Exactly the sequential result, in rounds: a row without an open earlier neighbour is kept, and rules out its later
    neighbours; pairs of rows that are ruled out close. Each round settles at least the first open row of every chain.
    Rounds are tables in the shared folder. Later copies of a vector are discarded with or by its first row, so they are
    not paired; a vector of zeros is similar to nothing, not even to its copies.
    """
    firsts = rows.filter(F.exists("vector", lambda x: x != 0)).groupBy(F.col("vector").alias("v"), (F.col(by) if by else F.lit(0)).alias("b")).agg(F.min("place").alias("first"))
    same = (F.col("vector") == F.col("v")) & ((F.col(by) if by else F.lit(0)).eqNullSafe(F.col("b")))
    seen = stored(rows.join(firsts, same, "left").withColumn("copy", F.coalesce(F.col("place") > F.col("first"), F.lit(False))).drop("v", "b", "first"), "rows")
    open_pairs, gone = stored(similar_pairs(seen.filter("not copy"), least, by), "pairs"), seen.filter("copy").select("id")
    while open_pairs.limit(1).count():
        kept = open_pairs.select(F.col("other").alias("o")).distinct().join(open_pairs.select(F.col("id").alias("o")).distinct(), "o", "left_anti")
        out = stored(open_pairs.join(kept, F.col("other") == F.col("o"), "left_semi").select("id").distinct(), "gone")
        gone = gone.unionByName(out)
        open_pairs = stored(open_pairs.join(out, "id", "left_anti").join(out.select(F.col("id").alias("other")), "other", "left_anti"), "pairs")
    marked = rows.select("id").join(gone.distinct().withColumn("g", F.lit(True)), "id", "left")
    return marked.select("id", F.when(F.col("g"), "discarded").otherwise("kept").alias("status"))


def staging_counts(rows: DataFrame) -> DataFrame:
    """M7: rows by batch and status."""
    return rows.groupBy("batch_no", "status").agg(F.count("*").alias("n"))


def as_chunks(rows: DataFrame) -> DataFrame:
    """M8: kept pairs as chunks of the knowledge base, pending."""
    return rows.filter("status = 'kept'").select(F.lit("历史问答挖掘").alias("category"), F.col("question").alias("questions"), "answer", F.concat(F.lit("客服对话挖掘 > "), F.col("source_ref")).alias("section_path"), F.lit("mined_qa").alias("content_type"), F.lit(False).alias("is_key_clause"), F.lit("pending").alias("vectorize_status"))
