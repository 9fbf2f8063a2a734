"""Queries of the knowledge-base build and of sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import CLOSING, KEY_CLAUSES, SENTENCE_ENDS
from ..operators import kb as K
from ..sources import io
from .label_queries import strip_sql
from .tables import LABELLED_SQL, Registry, labelled, read

QUERIES = Registry()
add = QUERIES.add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: the source and language as headings, a table, a question and its answer."""
    text = F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.col("text"), F.lit("\n## "), F.col("lang"), F.lit("\n| a | b |\n|---|---|\n| 1 | 2 |\n不支持退换\n### FAQ\n问：q"), F.col("doc_id"), F.lit("\n答：a"))
    return docs(spark, sf_dir).select("doc_id", text.alias("text"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of the store; every fifth is pending."""
    return docs(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("source").alias("category"), F.col("lang").alias("questions"), F.col("text").alias("answer"), F.concat_ws(" > ", "source", "lang").alias("section_path"), F.when(F.col("doc_id") % 5 == 0, "pending").otherwise("done").alias("vectorize_status")
    )


@add("k1_markdown_split")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.split_documents(markdown(spark, sf_dir), "doc_id", "text")


# A point between digits ends no sentence: such points become another sign of one character, twice, as neighbours overlap.
_NUMBERS = r"regexp_replace(regexp_replace(text, '([0-9])\.([0-9])', '\1_\2', 'g'), '([0-9])\.([0-9])', '\1_\2', 'g')"
_ENDING = "[" + SENTENCE_ENDS.replace("\n", "\\n") + ".][" + CLOSING.replace("]", "\\]").replace("'", "''") + "]*"
_ENDS = f"""se as (select doc_id, regexp_extract_all(t, '{_ENDING}') as h, string_split_regex(t, '{_ENDING}') as p from (select doc_id, {_NUMBERS} as t from documents)),
sl as (select doc_id, unnest(range(1, len(h) + 1)) as i, unnest(list_transform(h, lambda x: length(x))) as h, unnest(list_transform(p[1:len(h)], lambda x: length(x))) as p from se),
en as (select doc_id, sum(h + p) over (partition by doc_id order by i)::int as b from sl)"""


@add("k2_sentence_ends", f'with {_ENDS} select doc_id, b as "end" from en')
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = docs(spark, sf_dir).select("doc_id", F.explode_outer(K.sentence_ends(F.col("text"))).alias("end"))
    return ends.filter(F.col("end").isNotNull())  # an inner explode would look for the ends twice


@add("k3_sentence_chunks")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sentence_chunks(docs(spark, sf_dir), "doc_id", "text")


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each document, of up to forty rows whose width goes by the document, between two paragraphs."""
    i = F.col("doc_id")
    row = lambda k: F.concat(F.lit("| "), F.lpad(k.cast("string"), 2, "0"), F.lit(" | "), F.repeat(F.lit("x"), (i % 90).cast("int")), F.lit(" |"))
    rows = F.array_join(F.transform(F.sequence(F.lit(0), i % 40), row), "\n")
    return docs(spark, sf_dir).select("doc_id", F.concat(F.lit("# t\nbefore\n| n | "), F.col("lang"), F.lit(" |\n|---|:-:|\n"), rows, F.lit("\nafter")).alias("text"))


# Rows of a table are of one length, so as many fit into each chunk; a table that fits whole is one chunk anyway.
@add(
    "k4_table_chunks",
    """with t as (select doc_id, '| n | ' || lang || ' |' || chr(10) || '|---|:-:|' as head, doc_id % 40 + 1 as n, doc_id % 90 + 9 as w from documents), p as (select *, greatest(1, (500 - length(head)) // (w + 1)) as k from t),
    r as (select doc_id, head, k, unnest(range(0, n)) as i, w from p) select doc_id, any_value(head) || chr(10) || string_agg('| ' || lpad(i::varchar, 2, '0') || ' | ' || repeat('x', (w - 9)::int) || ' |', chr(10) order by i) as answer from r group by doc_id, i // k""",
)
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.split_documents(tables(spark, sf_dir), "doc_id", "text").filter("answer like '| n |%'").select(F.col("doc").alias("doc_id"), "answer")


def faqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An introduction, then up to three questions by the document, with answers of several lines; every fourth has its question as the title."""
    i = F.col("doc_id")
    pair = lambda k: F.concat(F.when(k % 2 == 0, "问：").otherwise("Q: "), F.col("source"), F.lit(" "), k, F.lit("\n答："), F.col("lang"), F.lit("\nmore of "), i, F.lit("\na: "), k)
    many = F.concat(F.lit("# faq\nintro of "), i, F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(0), i % 3), pair), "\n"))
    return docs(spark, sf_dir).select("doc_id", F.when(i % 4 == 0, F.concat(F.lit("## 问：title "), i, F.lit("\n答："), F.col("source"))).otherwise(many).alias("text"))


@add(
    "k5_faq_pairs",
    """with d as (select doc_id, source, lang, unnest(range(0, doc_id % 3 + 1)) as k from documents where doc_id % 4 > 0)
    select doc_id, source || ' ' || k as question, lang || chr(10) || 'more of ' || doc_id || chr(10) || k as answer, 'faq' as content_type from d union all select doc_id, 'title ' || doc_id, source, 'faq' from documents where doc_id % 4 = 0
    union all select doc_id, 'faq', 'intro of ' || doc_id, 'policy' from documents where doc_id % 4 > 0""",
)
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.split_documents(faqs(spark, sf_dir), "doc_id", "text").select(F.col("doc").alias("doc_id"), F.col("questions").alias("question"), "answer", "content_type")


@add("k6_key_clauses", "select doc_id, doc_id % 7 = 0 or " + " or ".join(f"contains(text, '{k}')" for k in KEY_CLAUSES) + " as key_clause from documents")
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("doc_id") % 7 == 0, F.lit("特别说明"))
    return docs(spark, sf_dir).select("doc_id", K.key_clause(q, F.col("text")).alias("key_clause"))


@add("k7_aligned_cut", f"with {_ENDS}, n as (select doc_id, min({{'far': abs(b - 500) > 40, 'd': abs(b - 500), 'b': b}}) as n from en group by 1) select doc_id, coalesce(n.n.b, least(500, length(text)))::int as cut from documents left join n using (doc_id)")
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", K.aligned(F.col("text"), F.lit(500)).alias("cut"))


@add("k8_linked_chunks", "select row_number() over (order by source, doc_id) as id, source, doc_id, lag(n) over (partition by source order by doc_id) as prev_chunk_id, lead(n) over (partition by source order by doc_id) as next_chunk_id from (select source, doc_id, row_number() over (order by source, doc_id) as n from documents)")
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.linked(docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id")


@add("k9_composed_texts", "select doc_id, md5('分类：' || source || chr(10) || '问题：' || lang || chr(10) || '内容：' || text) as embedded, md5('【类目】' || source || '【标准问法】' || lang || '【解答】' || text) as indexed from documents")
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("source", "lang", "text")]
    return docs(spark, sf_dir).select("doc_id", F.md5(K.embedding_text(*c)).alias("embedded"), F.md5(K.index_text(*c)).alias("indexed"))


@add("k10_embeddings")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", K.embedder()(F.col("text")).alias("vector"))


@add("k11_embed_pending", "select doc_id as id, doc_id::varchar as vector_id, 'done' as vectorize_status, 1024::bigint as dims from documents where doc_id % 5 = 0")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = K.embed_pending(store(spark, sf_dir), K.embedder(), K.embedding_text(F.col("category"), F.col("questions"), F.col("answer")))
    return got.select("id", "vector_id", "vectorize_status", F.size("vector").cast("long").alias("dims"))


@add("k12_reindex", "select doc_id as id, md5('【类目】' || source || '【标准问法】' || lang || '【解答】' || text) as chunk_md5, 1.0::double as length from documents")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = K.reindex(store(spark, sf_dir), K.embedder())
    return r.select("id", F.md5("chunk_text").alias("chunk_md5"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 3).alias("length"))


@add("k13_stats", "select count(*) as total, count_if(doc_id % 5 <> 0)::bigint as done, count_if(doc_id % 5 = 0)::bigint as pending, 0::bigint as failed, count_if(doc_id % 5 <> 0)::bigint as indexed, true as aligned from documents")
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return K.stats(s, s.filter("vectorize_status = 'done'"))


@add("k14_browse", "select doc_id as id, source as category, count(*) over () as total from documents where doc_id % 5 <> 0 and (contains(lang, 'en') or contains(text, 'en') or contains(source || ' > ' || lang, 'en')) order by doc_id desc limit 20 offset 20")
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.browse(store(spark, sf_dir), status="done", holds="en", page=2).select("id", "category", "total")


@add("k15_category_default", "select doc_id as id, case when doc_id % 3 = 0 then 'given' when doc_id % 3 = 1 then 'given' else source end as category from documents")
def k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, "未分类").when(F.col("id") % 3 == 2, F.col("category")).alias("category"))
    return K.with_category(s, "given")


@add(
    "k16_direct_entry",
    """with s as (select doc_id, source, row_number() over (order by source, doc_id) as n from documents where doc_id % 2 = 0), l as (select *, lag(n) over (partition by source order by doc_id) as p, lead(n) over (partition by source order by doc_id) as x from s)
    select doc_id, n as id, 'done' as vectorize_status, p as prev_chunk_id, x as next_chunk_id, n::varchar as vector_id from l
    union all select doc_id, (select count(*) from s) + row_number() over (order by source, doc_id), 'pending', null, null, null from documents where doc_id % 2 = 1""",
)
def k16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents go to the index at once; odd ones are entered behind them, as pending."""
    d = docs(spark, sf_dir).select("source", "doc_id")
    now = K.direct_entry(d.filter("doc_id % 2 = 0"), "source", "doc_id", True)
    later = K.direct_entry(d.filter("doc_id % 2 = 1"), "source", "doc_id", False, now.count() + 1)
    return now.unionByName(later).select("doc_id", "id", "vectorize_status", "prev_chunk_id", "next_chunk_id", "vector_id")


@add(
    "k12_postings",
    r"""with w as (select doc_id, list_filter(string_split(regexp_replace(lower(source || ' ' || lang || ' ' || text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') as w from documents),
    t as (select doc_id, unnest(list_concat(w, ['类', '目', '标', '准', '问', '法', '解', '答', '类目', '标准', '准问', '问法', '解答'])) as term, len(w) + 13 as dl from w) select doc_id as doc, term, count(*) as tf, any_value(dl) as dl from t group by 1, 2""",
)
def k12p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rebuilt(store(spark, sf_dir), K.embedder())[1]


def _folder(spark: SparkSession) -> str:
    return io.new_path(spark, "io")


@add("s1_labelled_lines", f"with {LABELLED_SQL} select id::varchar as text, array_to_string(labels, ',') as labels from labelled")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    io.write_lines(labelled(spark, sf_dir).select(F.col("id").cast("string").alias("text"), "labels"), path)
    return io.read_labelled(spark, path).select("text", F.array_join("labels", ",").alias("labels"))


@add("s2_json_lines", "select doc_id, text from documents")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    io.write_lines(docs(spark, sf_dir).select("doc_id", "text"), path)
    return spark.read.schema("doc_id long, text string").json(path)


_MARK = "\n<!-- end -->\n"


def markdown_folder(rows: DataFrame, text: str) -> str:
    """`text` of each row into files of at most 100 rows, each row closed by a mark; Spark's writer names them *.txt."""
    path = _folder(rows.sparkSession)
    rows.select(text).write.option("lineSep", _MARK).option("maxRecordsPerFile", 100).text(path)
    return path


@add("s3_markdown_folder", "select doc_id, md5('# ' || doc_id || chr(10) || text) as content from documents")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are read whole, then cut at the marks: each document comes back as it was."""
    path = markdown_folder(docs(spark, sf_dir).select(F.concat(F.lit("# "), F.col("doc_id"), F.lit("\n"), F.col("text")).alias("t")), "t")
    each = io.read_markdown(spark, path, "*.txt").select(F.explode(F.split("text", _MARK)).alias("t")).filter("t <> ''")
    return each.select(F.regexp_extract("t", "^# ([0-9]+)\n", 1).cast("long").alias("doc_id"), F.md5("t").alias("content"))


@add("s4_inventory", f"select sum(octet_length(encode('# ' || doc_id || chr(10) || source || chr(10) || lang || chr(10) || length(text))) + {len(_MARK)})::bigint as bytes, count(*) as chunks, true as dated from documents")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of what a document is: a section each, so a chunk each; sums over the files, whose names are Spark's."""
    sheet = F.concat_ws("\n", F.concat(F.lit("# "), F.col("doc_id")), "source", "lang", F.length("text").cast("string"))
    path = markdown_folder(docs(spark, sf_dir).select(sheet.alias("t")), "t")
    return io.inventory(spark, path, 500, 80, "*.txt").agg(F.sum("bytes").alias("bytes"), F.sum("chunks").alias("chunks"), F.bool_and(F.col("modified") > F.lit("2020-01-01").cast("timestamp")).alias("dated"))


@add("s5_relational_read", "select conv_id, turn, role, text from conversations where role in ('user', 'assistant')")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in a database, read in ranges of the conversation's id. `ticketloom.jdbc.url` names the database; Spark in one process has its own, in memory."""
    url = spark.conf.get("ticketloom.jdbc.url", None)
    if not url:
        if not io.one_process(spark):
            raise ValueError("set ticketloom.jdbc.url to a database that all executors reach")
        url = f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true"
    table = f"messages_{uuid.uuid4().hex[:12]}"
    m = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    m.write.jdbc(url, table, properties={"createTableColumnTypes": "role VARCHAR(32)"})
    got = io.read_relational(spark, url, table, io.key_ranges(m, "conv_id", 8, '"conv_id"'))
    got = got.select(*[F.col(c).alias(c.lower()) for c in got.columns])
    return got.filter(F.col("role").isin("user", "assistant"))


@add("s6_score_rows", f"with {LABELLED_SQL} select id::varchar as text, c as class, list_contains(labels, c) as truth, case when c = '物流' then round(id % 10 / 10.0, 1) else 0.0 end as score from labelled, (select unnest(['退换货', '物流', '尺码']) as c)")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select(F.col("id").cast("string").alias("text"), F.col("labels").alias("true_labels"), F.create_map(F.lit("物流"), F.round(F.col("id") % 10 / 10.0, 1)).alias("scores"))
    return io.class_scores(rows, ["退换货", "物流", "尺码"]).select("text", "class", "truth", "score")


@add("s7_report", "select source, count(*) as n from documents group by 1")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    io.write_report(docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")), path)
    return spark.read.schema("source string, n long").json(path)
