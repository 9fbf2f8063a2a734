"""The flywheel: weak answers into a pool, the pool into reviewed gaps, approved gaps into knowledge; topics of the pool."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import GATE, TAXONOMY, TIERS
from ..sources.io import stored
from .mining import numbered
from .textkeys import text_hash, text_keys


#: Fixed value: the question of a vote whose conversation has none.
UNKNOWN_QUESTION = "未知用户问题"


def pool_rows(confidences: DataFrame, hits: DataFrame, questions: DataFrame, least: float = GATE, keep: int = 5, chars: int = 300) -> DataFrame:
    """(query, raw_question, reason, chunks): questions whose evidence is weak, with their best hits, cut short."""
    weak = confidences.filter(F.col("confidence") < least)
    own = hits.filter(F.col("rank") <= keep).join(weak.select("query"), "query", "left_semi")
    got = own.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", F.substring("text", 1, chars).alias("text"), "score", "section"))).alias("c"))
    return weak.join(questions, "query").join(got, "query", "left").select("query", F.col("text").alias("raw_question"), F.lit("retrieval_low_conf").alias("source"), F.col("confidence"), F.coalesce(F.transform("c", lambda x: F.struct(x["text"], x["score"], x["section"])), F.expr("cast(array() as array<struct<text:string,score:double,section:string>>)")).alias("chunks"))


def feedback_rows(votes: DataFrame, messages: DataFrame, audits: DataFrame, chars: int = 300) -> DataFrame:
    """(conversation, raw_question, source, chunks): down-votes with their question and what the last knowledge tool call found.

    votes (conversation, query); messages (conversation, id, role, content, tool): tool is the first call of a reply;
    audits (id, conversation, tool, result): JSON, a list of hits or an object with hits. Hits count where the newest reply
    of the conversation called a knowledge tool; they are those of the newest audit of such a tool. Of a hit, text, content
    or answer, score or distance, and section or its path are taken, whichever is first and not blank; chunks are null
    where nothing was found.
    """
    tools = ["query_faq", "search_knowledge"]
    asked = messages.groupBy("conversation").agg(F.max_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("id"))).alias("last_question"), F.max_by(F.struct("tool"), F.when(F.col("role") == "assistant", F.col("id"))).alias("call"))
    seen = audits.filter(F.col("tool").isin(tools)).groupBy("conversation").agg(F.max_by("result", "id").alias("result"))
    both = votes.join(asked, "conversation", "left").join(seen, "conversation", "left")
    one = "text string, content string, answer string, score double, distance double, section string, section_path string"
    found = F.coalesce(F.from_json(F.when(F.col("result").rlike(r"^\s*\["), F.col("result")), "array<struct<" + one.replace(" string", ":string").replace(" double", ":double").replace(", ", ",") + ">>"), F.from_json(F.col("result"), "hits array<struct<" + one.replace(" string", ":string").replace(" double", ":double").replace(", ", ",") + ">>")["hits"])
    first = lambda h, names, blank: F.coalesce(*[F.nullif(h[n], F.lit(blank)) for n in names], F.lit(blank))
    hits = F.transform(found, lambda h: F.struct(F.substring(first(h, ("text", "content", "answer"), ""), 1, chars).alias("text"), first(h, ("score", "distance"), 0.0).alias("score"), first(h, ("section", "section_path"), "").alias("section")))
    chunks = F.when(F.col("call.tool").isin(tools) & (F.size(hits) > 0), hits)
    question = F.coalesce(F.nullif(T.strip(F.col("query")), F.lit("")), "last_question", F.lit(UNKNOWN_QUESTION))
    return both.select("conversation", question.alias("raw_question"), F.lit("user_feedback").alias("source"), chunks.alias("chunks"))


def normalised(raw: Column, model: Column, fallback: str = "") -> Column:
    """struct<question, answer>: a model's text split at its first blank line; without one the question as it is."""
    said = F.split(T.strip(model), r"\n\s*\n", 2)
    has = F.coalesce(T.strip(model) != "", F.lit(False))
    return F.struct(F.when(has, T.strip(said[0])).otherwise(raw).alias("question"), F.when(has & (F.size(said) > 1), T.strip(F.try_element_at(said, F.lit(2)))).otherwise(F.lit(fallback)).alias("answer"))


def gap_key(c: Column) -> Column:
    """questions are one gap if they are equal, trimmed and in lower case."""
    return F.lower(T.strip(c))


def match_gaps(pool: DataFrame, queue: DataFrame, hashed: Callable[[Column], Column] = text_hash) -> tuple[DataFrame, DataFrame]:
    """(pool with matched_review_id, queue after it).

    pool (id, question, matched_review_id); queue (id, normalized_question, occurrence_count, review_status). A question
    joins the pending gap of its key with the lowest id; the others make a gap for each key, that of the lowest pool id
    in front; counts grow by the questions. All by key: no order of arrival is needed. A null question stays unmatched.
    """
    # Questions of both tables get a key each, the smallest number of a row with the same text; texts aren't shuffled for it.
    asked = pool.filter("matched_review_id is null").select(F.struct(F.lit(0).alias("of"), F.col("id")).alias("row"), gap_key(F.col("question")).alias("text"))
    waiting = queue.filter("review_status = '待审'").select(F.struct(F.lit(1).alias("of"), F.col("id")).alias("row"), gap_key(F.col("normalized_question")).alias("text"))
    keyed = text_keys(asked.unionByName(waiting), "row", F.col("text"), hashed).select(F.col("first").alias("k"), F.col("id.of").alias("of"), F.col("id.id").alias("id"))
    by_key = keyed.groupBy("k").agg(F.count_if(F.col("of") == 0).alias("n"), F.min(F.when(F.col("of") == 0, F.col("id"))).alias("first"), F.min(F.when(F.col("of") == 1, F.col("id"))).alias("gap"))
    known = stored(by_key.filter("n > 0"), "gaps")
    top = queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = numbered(known.filter("gap is null").select("k", "n", "first"), "first", "at").crossJoin(F.broadcast(top)).select("k", "n", "first", (F.col("top") + F.col("at") + 1).alias("gap"))
    old = known.filter("gap is not null").select("k", "n", "gap")
    ids = keyed.filter("of = 0").select("k", F.col("id").alias("_id")).join(old.select("k", "gap").unionByName(fresh.select("k", "gap")), "k").select("_id", "gap")
    matched = pool.join(ids, F.col("id") == F.col("_id"), "left").withColumn("matched_review_id", F.coalesce("matched_review_id", "gap")).select(*pool.columns)
    grown = queue.join(old.select(F.col("gap").alias("id"), "n"), "id", "left").withColumn("occurrence_count", (F.col("occurrence_count") + F.coalesce("n", F.lit(0))).cast("long")).select(*queue.columns)
    said = pool.select(F.col("id").alias("first"), "question").join(fresh, "first")  # the texts of new gaps alone
    added = said.select(F.col("gap").alias("id"), F.col("question").alias("normalized_question"), F.col("n").alias("occurrence_count"), F.lit("待审").alias("review_status"))
    return matched, grown.unionByName(added, allowMissingColumns=True)


def processing_counts(before: DataFrame, after_queue: DataFrame, queue: DataFrame) -> DataFrame:
    """one row: questions processed, of them in new gaps first seen, and merged."""
    open_rows = before.filter("matched_review_id is null").agg(F.count("*").alias("processed"))
    new = after_queue.join(queue.select("id"), "id", "left_anti").agg(F.count("*").alias("new"))
    return open_rows.crossJoin(new).withColumn("merged", F.col("processed") - F.col("new"))


def review_list(queue: DataFrame, pool: DataFrame, status: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """a page of gaps, most frequent first, with how many raw questions each has."""
    raw = pool.filter("matched_review_id is not null").groupBy(F.col("matched_review_id").alias("id")).agg(F.count("*").alias("raw_questions"))
    q = queue.filter(F.col("review_status") == status) if status else queue
    return q.join(raw, "id", "left").withColumn("raw_questions", F.coalesce("raw_questions", F.lit(0))).orderBy(F.desc("occurrence_count"), F.desc("id")).offset((page - 1) * size).limit(size)


def review_detail(queue: DataFrame, pool: DataFrame) -> DataFrame:
    """each gap with its raw questions, a row for each, so that a frequent gap stays rows."""
    return queue.join(pool.select(F.col("matched_review_id").alias("id"), F.col("id").alias("question_id"), "question"), "id", "left")


def decide(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F8: (queue after the decisions, chunks of approved gaps); decisions (id, approve, answer), an approval needs an answer."""
    d = decisions.groupBy("id").agg(F.max(F.struct("approve", "answer")).alias("d"))
    answer = T.strip(F.col("d.answer"))
    yes, no = F.col("d.approve") & (F.coalesce(answer, F.lit("")) != ""), F.col("d.approve") == F.lit(False)
    both = queue.join(d, "id", "left")
    after = both.withColumn("review_status", F.when(yes, "通过").when(no, "驳回").otherwise(F.col("review_status"))).withColumn("approved_answer", F.when(yes, answer))
    made = after.filter("approved_answer is not null").select(F.lit("常见问题").alias("category"), F.col("normalized_question").alias("questions"), F.col("approved_answer").alias("answer"), F.lit("数据飞轮/FAQ").alias("section_path"), F.lit("faq").alias("content_type"), F.lit(True).alias("is_key_clause"), F.lit("pending").alias("vectorize_status"))
    return after.drop("d"), made


def unclassified(pool: DataFrame, done: DataFrame, id: str = "id", key: str = "question_id") -> DataFrame:
    """questions without a classification."""
    return pool.join(done.select(F.col(key).alias("_k")).distinct(), F.col(id) == F.col("_k"), "left_anti")


def batch_gate(rows: DataFrame, least: int = 10, forced: bool = False) -> str:
    """`empty`, `skip` below the least number unless forced, or `run`; counts `least` rows at most."""
    n = rows.limit(max(least, 1)).count()
    return "empty" if n == 0 else "run" if forced or n >= least else "skip"


def labels_of(scores: Column, threshold: Column | float | dict[str, float]) -> Column:
    """classes whose score, rounded to 4, reaches the (or their) threshold, best first, then in order of name."""
    if isinstance(threshold, dict):
        lines = F.create_map(*[F.lit(x) for kv in threshold.items() for x in kv])
        line = lambda k: F.coalesce(lines[k], F.lit(0.5))
    else:
        line = lambda k: threshold if isinstance(threshold, Column) else F.lit(threshold)
    each = F.transform(F.map_entries(scores), lambda e: F.struct((-F.round(e["value"], 4)).alias("s"), e["key"].alias("k")))
    return F.transform(F.array_sort(F.filter(each, lambda e: -e["s"] >= line(e["k"]))), lambda e: e["k"])


def insert_new(done: DataFrame, new: DataFrame, key: str = "question_id") -> DataFrame:
    """classifications after a run: those of questions that had none yet are added, one for each question."""
    fresh = new.join(done.select(key), key, "left_anti").dropDuplicates([key])
    return done.unionByName(fresh)


def topic_distribution(done: DataFrame, pool_size: Column, labels: str = "labels") -> DataFrame:
    """a row for each class: questions, share of labels and of questions in %, tier, whether it is among the top three.

    Labels beyond the classes count toward the total and may take a place of the top three without a row.
    """
    spark = done.sparkSession
    names = spark.createDataFrame([(i, c, next(t for t, (cs, _) in TIERS.items() if c in cs)) for i, c in enumerate(TAXONOMY)], "ord int, class string, tier string")
    tags = done.select(F.explode(labels).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    both = tags.join(F.broadcast(names), "class", "full").withColumn("n", F.coalesce("n", F.lit(0)))  # a row for each label value
    total = both.agg(F.sum("n").alias("tags"))
    asked = done.agg(F.count("*").alias("classified"))
    place = F.row_number().over(W.orderBy(F.desc("n"), F.coalesce("ord", F.lit(len(TAXONOMY))), "class"))
    x = both.withColumn("place", place).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(asked))
    share = lambda a, b: F.when(b > 0, F.round(a * 100.0 / b, 2)).otherwise(0.0)
    return x.filter("ord is not null").select("class", "tier", "n", share(F.col("n"), F.col("tags")).alias("tag_share"), share(F.col("n"), F.col("classified")).alias("question_share"), ((F.col("place") <= 3) & (F.col("n") > 0)).alias("top"), (pool_size - F.col("classified")).alias("unclassified"))
