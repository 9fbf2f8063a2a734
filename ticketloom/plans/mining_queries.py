"""Queries of dialogue mining and the flywheel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import flywheel as Y
from ..operators import mining as M
from .label_queries import strip_sql
from .tables import Registry, read

QUERIES = Registry()
add = QUERIES.add

_SAID = f"said as (select conv_id, turn, role, {strip_sql('text')} as text from conversations where role in ('user', 'assistant') and {strip_sql('text')} <> '')"
_LINES = f"{_SAID}, tr as (select conv_id as conversation, string_agg(case when role = 'user' then '用户: ' else '客服: ' end || text, chr(10) order by turn) as transcript, count(*) as message_count from said group by 1)"


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.transcripts(read(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role", "text")


@add("m1_transcripts", f"with {_LINES} select conversation, 'conversation:' || conversation as source_ref, transcript, message_count from tr")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir)


@add("m2_batches", f"with {_LINES} select conversation, printf('BATCH_0_%03d', (row_number() over (order by conversation) - 1) // 20 + 1) as batch_no from tr")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.batches(transcripts(spark, sf_dir).select("conversation"), "conversation", "0")


def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer for each reply: a fenced list, a wrapped list, or text that isn't JSON."""
    c = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    pair = F.to_json(F.array(F.struct(F.concat(F.lit("q"), F.col("turn")).alias("question"), F.col("text").alias("answer")), F.struct(F.lit(" ").alias("question"), F.lit("a").alias("answer"))))
    said = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("```json\n"), pair, F.lit("\n```"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit('{"items": '), pair, F.lit("}"))).otherwise("no pairs")
    return c.select("conv_id", "turn", F.lit("BATCH_0_001").alias("batch_no"), F.concat(F.lit("conversation:"), F.col("conv_id")).alias("source_ref"), said.alias("said"))


@add("m3_parse_pairs", f"select conv_id, turn, 'q' || turn as question, text as answer from conversations where role = 'assistant' and conv_id % 3 < 2 and {strip_sql('text')} <> ''")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_output(spark, sf_dir).select("conv_id", "turn", F.explode(M.parsed_pairs(F.col("said"))).alias("p")).select("conv_id", "turn", "p.question", "p.answer")


@add("m4_stage_rows", f"select 'BATCH_0_001' as batch_no, 'conversation:' || conv_id as source_ref, 'q' || turn as question, {strip_sql('text')} as answer, 'extracted' as status from conversations where role = 'assistant' and conv_id % 3 < 2 and {strip_sql('text')} <> ''")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.staged(model_output(spark, sf_dir), M.parsed_pairs(F.col("said")))


_KEY = r"regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')"
_DEDUP = f"ded as (select doc_id as id, text, source, row_number() over (partition by {_KEY} order by length({strip_sql('text')}) desc, doc_id) = 1 as keep from documents)"


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("question"), F.col("text").alias("answer"), "source")


@add("m5_exact_dedup", f"with {_DEDUP} select id, case when keep then 'kept' else 'discarded' end as status from ded")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.exact_dedup(staged(spark, sf_dir), "doc_id", "question", "answer")


@add("m6_semantic_dedup")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return M.semantic_dedup(e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("place"), F.col("embedding").alias("vector")))


@add("m7_staging_counts", f"with {_DEDUP} select source as batch_no, case when keep then 'kept' else 'discarded' end as status, count(*) as n from ded group by 1, 2")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = staged(spark, sf_dir)
    return M.staging_counts(M.exact_dedup(s, "doc_id", "question", "answer").join(s.select(F.col("doc_id").alias("id"), F.col("source").alias("batch_no")), "id"))


@add(
    "m8_kept_to_chunks",
    f"with {_DEDUP} select '历史问答挖掘' as category, text as questions, md5(text) as answer, '客服对话挖掘 > ' || source as section_path, 'mined_qa' as content_type, false as is_key_clause, 'pending' as vectorize_status from ded where keep",
)
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = staged(spark, sf_dir)
    rows = s.join(M.exact_dedup(s, "doc_id", "question", "answer"), F.col("doc_id") == F.col("id"))
    return M.as_chunks(rows.withColumnRenamed("source", "source_ref")).withColumn("answer", F.md5("answer"))


# The pool: each document is a question; gaps: those of every tenth document.
_POOL = "pool as (select doc_id as id, text as question, null::bigint as m from documents)"
_QUEUE = f"q as (select id, question as normalized_question, 1::bigint as occurrence_count, case when id % 20 = 0 then '待审' else '通过' end as review_status from pool where id % 10 = 0)"
_GAP = strip_sql("question").join(["lower(", ")"])
_MATCH = f"""{_POOL}, {_QUEUE}, pk as (select *, {_GAP} as k from pool), qk as (select {strip_sql('normalized_question').join(['lower(', ')'])} as k, min(id) as gap from q where review_status = '待审' group by 1),
bk as (select k, count(*) as n, min(id) as first, arg_min(question, id) as question from pk group by 1), kn as (select * from bk left join qk using (k)),
fr as (select k, n, question, (select coalesce(max(id), 0) from q) + row_number() over (order by first) as gap from kn where gap is null), ids as (select k, gap from kn where gap is not null union all select k, gap from fr),
after as (select q.id, normalized_question, occurrence_count + coalesce(n, 0) as occurrence_count, review_status from q left join (select gap, n from kn where gap is not null) o on q.id = o.gap union all select gap, question, n, '待审' from fr),
matched as (select pk.id, question, gap as matched_review_id from pk join ids using (k))"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.lit(None).cast("long").alias("matched_review_id"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the questions as gaps that stand in the queue already: the queue of this example, not a sample of the pool."""
    return pool(spark, sf_dir).filter("id % 10 = 0").select("id", F.col("question").alias("normalized_question"), F.lit(1).cast("long").alias("occurrence_count"), F.when(F.col("id") % 20 == 0, "待审").otherwise("通过").alias("review_status"))


@add("f4_match_gaps", f"with {_MATCH} select id, matched_review_id from matched")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.match_gaps(pool(spark, sf_dir), queue(spark, sf_dir))[0].select("id", "matched_review_id")


@add("f4_queue_after", f"with {_MATCH} select id, normalized_question, occurrence_count::bigint as occurrence_count, review_status from after")
def f4q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.match_gaps(pool(spark, sf_dir), queue(spark, sf_dir))[1]


@add("f5_processing_counts", f"with {_MATCH} select (select count(*) from pool) as processed, (select count(*) from fr) as new, (select count(*) from pool) - (select count(*) from fr) as merged")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = pool(spark, sf_dir), queue(spark, sf_dir)
    return Y.processing_counts(p, Y.match_gaps(p, q)[1], q)


_RAW = "raw as (select matched_review_id as id, count(*) as raw_questions from matched group by 1)"


@add("f6_review_list", f"with {_MATCH}, {_RAW} select id, normalized_question, occurrence_count::bigint as occurrence_count, review_status, coalesce(raw_questions, 0) as raw_questions from after left join raw using (id) where review_status = '待审' order by occurrence_count desc, id desc limit 20")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched, after = Y.match_gaps(pool(spark, sf_dir), queue(spark, sf_dir))
    return Y.review_list(after, matched, "待审")


@add("f7_review_detail", f"with {_MATCH} select after.id, matched.id as question_id, question from after left join matched on after.id = matched_review_id")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched, after = Y.match_gaps(pool(spark, sf_dir), queue(spark, sf_dir))
    return Y.review_detail(after, matched).select("id", "question_id", "question")


@add(
    "f8_decisions",
    f"with {_POOL}, {_QUEUE} select id, case when id % 30 = 0 and length({strip_sql('normalized_question')}) > 0 then '通过' when id % 30 = 10 then '驳回' else review_status end as review_status, case when id % 30 = 0 then {strip_sql('normalized_question')} end as approved_answer from q",
)
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queue(spark, sf_dir)
    d = q.filter("id % 30 < 20").select("id", (F.col("id") % 30 == 0).alias("approve"), F.col("normalized_question").alias("answer"))
    return Y.decide(q, d)[0].select("id", "review_status", "approved_answer")


@add("f8_approved_chunks", f"with {_POOL}, {_QUEUE} select '常见问题' as category, normalized_question as questions, {strip_sql('normalized_question')} as answer, '数据飞轮/FAQ' as section_path, 'faq' as content_type, true as is_key_clause, 'pending' as vectorize_status from q where id % 30 = 0")
def f8c(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queue(spark, sf_dir)
    return Y.decide(q, q.filter("id % 30 < 20").select("id", (F.col("id") % 30 == 0).alias("approve"), F.col("normalized_question").alias("answer")))[1]


_SAID_SQL = f"regexp_replace({strip_sql('text')}, '\\n[\\s\\x0B]*\\n', chr(10), 'g')"  # the question as the model says it


@add(
    "f3_normalise",
    f"select doc_id, case when doc_id % 2 = 0 then {strip_sql(_SAID_SQL)} else {strip_sql('text')} end as question, case when doc_id % 2 = 0 then '{{a}}' else '暂无建议' end as answer from documents".replace("{a}", "answer"),
)
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = T.strip(F.col("text"))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.regexp_replace(raw, r"\n\s*\n", "\n"), F.lit("\n\nanswer")))
    got = Y.normalised(raw, said, "暂无建议")
    return read(spark, sf_dir, "documents").select("doc_id", got["question"].alias("question"), got["answer"].alias("answer"))


@add(
    "f2_feedback",
    f"""with r as (select conv_id, turn, text, case turn % 3 when 0 then 'query_faq' when 1 then 'search_knowledge' else 'query_order' end as tool from conversations where role = 'assistant'),
    asked as (select conv_id, arg_max(text, turn) filter (role = 'user') as q from conversations group by 1), votes as (select distinct conv_id from conversations where conv_id % 3 = 0),
    call as (select conv_id, arg_max(tool, turn) as tool from r group by 1), hit as (select conv_id, arg_max(text, turn) as text, max(turn) as turn from r where tool <> 'query_order' group by 1)
    select votes.conv_id as conversation, coalesce(nullif(case when votes.conv_id % 2 = 0 then 'vote ' || votes.conv_id else ' ' end, ' '), q, '未知用户问题') as raw_question, 'user_feedback' as source,
    case when call.tool <> 'query_order' and hit.turn % 5 < 4 then substr(hit.text, 1, 300) end as first_text, case when call.tool <> 'query_order' and hit.turn % 5 < 4 then hit.turn / 8.0::double + 1 end as first_score, case when call.tool <> 'query_order' and hit.turn % 5 < 4 then 's' || hit.turn end as first_section
    from votes left join asked using (conv_id) left join call using (conv_id) left join hit using (conv_id)""",
)
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies call one of two knowledge tools or another one; audits name their hits in different ways, and every fifth can't be read."""
    i = F.col("id")
    tool = F.when(i % 3 == 0, "query_faq").when(i % 3 == 1, "search_knowledge").otherwise("query_order")
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation"), F.col("turn").alias("id"), "role", F.col("text").alias("content")).withColumn("tool", F.when(F.col("role") == "assistant", tool))
    votes = c.filter("conversation % 3 = 0").select("conversation").distinct().withColumn("query", F.when(F.col("conversation") % 2 == 0, F.concat(F.lit("vote "), F.col("conversation"))).otherwise(" "))
    plain = F.array(F.struct(F.col("content").alias("text"), (i / 8.0 + 1).alias("score"), F.concat(F.lit("s"), i).alias("section")))
    other = F.struct(F.array(F.struct(F.lit("").alias("text"), F.col("content").alias("answer"), (i / 8.0 + 1).alias("distance"), F.concat(F.lit("s"), i).alias("section_path"))).alias("hits"))
    said = F.when(i % 5 == 4, "{not read").when(i % 2 == 0, F.to_json(plain)).otherwise(F.to_json(other))
    audits = c.filter("role = 'assistant'").select("id", "conversation", "tool", said.alias("result"))
    got = Y.feedback_rows(votes, c, audits)
    return got.select("conversation", "raw_question", "source", F.col("chunks")[0]["text"].alias("first_text"), F.col("chunks")[0]["score"].alias("first_score"), F.col("chunks")[0]["section"].alias("first_section"))
