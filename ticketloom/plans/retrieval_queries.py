"""Queries of retrieval and its evaluation: benchmark passages as questions, documents as chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import OUT_OF_SCOPE, REFUSALS, TRIGGERS
from ..operators import evaluation as E
from ..operators import flywheel as Y
from ..operators import kb as K
from ..operators import keyword_index as X
from ..operators import retrieval as R
from ..sources.io import bounded_batches, new_path, stored
from .label_queries import strip_sql
from .tables import Registry, read

QUERIES = Registry()
add = QUERIES.add

_TERMS = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_INDEX = f"ws as (select doc_id as doc, {_TERMS.format('text')} as ws from documents), tok as (select doc, unnest(ws) as term, len(ws) as dl from ws), ix as (select doc, term, count(*) as tf, any_value(dl) as dl from tok group by 1, 2)"
_BM25 = f"""{_INDEX}, st as (select count(*) as n, avg(dl) as avgdl from (select doc, any_value(dl) as dl from ix group by 1)), dfs as (select term, count(*) as df from ix group by 1),
qt as (select distinct item_id as query, unnest({_TERMS.format('text')}) as term from benchmark),
bs as (select query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score from qt join ix using (term) join dfs using (term), st group by 1, 2),
b as (select *, row_number() over (partition by query order by score desc, doc) as rank from bs)"""
# Questions of the dense search: the vectors whose id is divisible by 50.
_DENSE = """v as (select vec_id, list_transform(embedding, lambda x: x::double) as e, label from embeddings), u as (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v),
ds as (select q.vec_id as query, d.vec_id as doc, round(list_dot_product(q.e, d.e), 6) as score from u q, u d where q.vec_id % 50 = 0), dn as (select *, row_number() over (partition by query order by score desc, doc) as rank from ds where score >= {least})"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_index(read(spark, sf_dir, "documents"), "doc_id", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


def bm25(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Passages against documents; the postings of the asked terms are made once and stored."""
    docs, terms = read(spark, sf_dir, "documents"), R.asked_terms(questions(spark, sf_dir), "query", "text")
    return R.bm25_search(R.bm25_blocks(stored(R.bm25_index(docs, "doc_id", "text", terms, True), "postings")), terms, k)


def dense(spark: SparkSession, sf_dir: str, k: int = 3, least: float = 0.35, broadcast_rows: int = 20_000) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return R.dense_search(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), "vec_id", "embedding", k, least, broadcast_rows)


@add("r1_bm25_index", f"with {_INDEX} select doc, term, tf, dl from ix")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir)


@add("r2_bm25_topk", f"with {_BM25} select query, doc, round(score, 4) as score, rank from b where rank <= 10")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(spark, sf_dir).withColumn("score", F.round("score", 4))


def synced(spark: SparkSession, sf_dir: str) -> X.KeyedStore:
    """Documents put into an index in two batches: first every second as its first half of text and all others whole, then what was cut, whole, and every seventh removed."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index, done = X.index_store(new_path(spark, "index"), 4), X.done_store(new_path(spark, "done"), 4)
    cut = F.when(F.col("id") % 2 == 0, F.left(F.col("text"), (F.length("text") / 2).cast("int"))).otherwise(F.col("text"))
    encode = K.embedder(K.term_vector, "double")
    X.sync(d.select("id", cut.alias("text")), index, done, encode)
    X.sync(d.filter("id % 2 = 0"), index, done, encode, d.filter("id % 7 = 0"))
    return index


_HELD = _INDEX.replace("from documents)", "from documents where doc_id % 7 <> 0)")


@add("k11_synced_index", f"with {_HELD} select ws.doc as id, len(ws.ws)::bigint as length, len(list_distinct(ws.ws))::bigint as terms from ws")
def k11s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synced(spark, sf_dir).read(spark, ["id", "length", F.size("tfs").cast("long").alias("terms"), "gone"]).drop("gone")


@add("r2_incremental_topk", f"with {_BM25.replace(_INDEX, _HELD)} select query, doc, score, rank from b where rank <= 10")
def r2i(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 over an index that grew by batches."""
    return X.search(spark, synced(spark, sf_dir), R.asked_terms(questions(spark, sf_dir), "query", "text"), 10)


_TOP3 = f"with {_DENSE.format(least=0.35)} select query, doc, round(score, 4) as score, rank from dn where rank <= 3"


@add("r3_dense_topk", _TOP3)
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir).withColumn("score", F.round("score", 4))


@add("r3_clustered_topk", _TOP3)
def r3c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over clustered chunks, as for more queries than are broadcast."""
    return dense(spark, sf_dir, broadcast_rows=0).withColumn("score", F.round("score", 4))


@add("r4_filtered_search", f"with {_DENSE.format(least=0.0)}, f as (select query, doc, score, row_number() over (partition by query order by score desc, doc) as rank from ds join embeddings e on e.vec_id = doc where e.label = 1 and score >= 0) select query, doc, round(score, 4) as score, rank from f where rank <= 3")
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return R.dense_search(e.filter("label = 1"), q, "vec_id", "embedding", 3, 0.0).withColumn("score", F.round("score", 4))


def routes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The best 50 by BM25 and by the vectors of an encoder of texts, both stored, as several queries' parts read them."""
    encode = K.embedder(K.term_vector, "double")
    bounded_batches(spark)
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), encode(F.col("text")).alias("vector"))
    asked = questions(spark, sf_dir).select("query", encode(F.col("text")).alias("vector"))
    return stored(bm25(spark, sf_dir, 50), "bm25"), stored(R.dense_search(chunks, asked, "doc", "vector", 50, 0.35), "dense")


# The encoder in SQL: words at places by their MD5; cosines of documents with passages.
_PLACE = "('0x' || substr(md5(term), 1, 4))::int % 64"
_ROUTES = f"""{_BM25}, dv as (select doc, {_PLACE} as place, sum(tf)::double as x from ix group by 1, 2), dl as (select doc, sqrt(sum(x * x)) as l from dv group by 1),
qw as (select item_id as query, unnest({_TERMS.format('text')}) as term from benchmark), qv as (select query, {_PLACE} as place, count(*)::double as x from qw group by 1, 2), ql as (select query, sqrt(sum(x * x)) as l from qv group by 1),
cs as (select query, doc, round(sum(qv.x * dv.x) / (any_value(ql.l) * any_value(dl.l)), 6) as score from qv join dv using (place) join dl using (doc) join ql using (query) group by 1, 2),
c as (select *, row_number() over (partition by query order by score desc, doc) as rank from cs where score >= 0.35)"""
_FUSED = f"{_ROUTES}, fs as (select query, doc, round(sum(1.0::double / (60 + rank)), 9) as score from (select query, doc, rank from b where rank <= 50 union all select query, doc, rank from c where rank <= 50) group by 1, 2), fu as (select *, row_number() over (partition by query order by score desc, doc) as rank from fs)"


@add("r5_rank_fusion", f"with {_FUSED} select query, doc, round(score, 7) as score from fu where rank <= 50")
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(list(routes(spark, sf_dir))).select("query", "doc", F.round("score", 7).alias("score"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def fused_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits with their texts: (query, doc, rank, score, text, qtext)."""
    q = questions(spark, sf_dir).withColumnRenamed("text", "qtext")
    return R.fuse(list(routes(spark, sf_dir)), 20).join(texts(spark, sf_dir), "doc").join(q, "query")


def strategies(spark: SparkSession, sf_dir: str, wanted: tuple[str, ...] = R.STRATEGIES) -> DataFrame:
    """All four strategies, a blank question among the passages; reranked rows need half the score."""
    bm25_route, dense_route = routes(spark, sf_dir)
    blank = spark.range(1).select(F.lit(-1).cast("long").alias("query"), F.lit(" \n").alias("text"))
    return R.by_strategy(list(wanted), questions(spark, sf_dir).unionByName(blank), bm25_route, dense_route, texts(spark, sf_dir), 10, 50, 0.5)


def _lexical_sql(hits: str) -> str:
    """Common table expressions up to `lx` (columns of hits, lexical): the score of a hit's whole text for its passage."""
    chars = "list_distinct(regexp_extract_all(replace({}, ' ', ''), '(?s).'))"
    return f"""l0 as (select h.*, lower({strip_sql('q.text')}) as q, lower({strip_sql('d.text')}) as d from {hits} h join benchmark q on q.item_id = h.query join documents d on d.doc_id = h.doc),
    l1 as (select *, list_distinct({_TERMS.format('q')}) as qw, list_distinct({_TERMS.format('d')}) as dw, {chars.format('q')} as qc, {chars.format('d')} as dc from l0),
    l2 as (select * exclude (qw, dw, qc, dc), len(qw) as n, len(dw) as m, len(list_intersect(qw, dw)) as k, case when len(qc) > 0 then len(list_intersect(qc, dc)) / len(qc)::double else 0 end as ch from l1),
    l3 as (select * exclude (k, ch), 0.55::double * k / greatest(n, 1) + 0.25::double * k / greatest(n + m - k, 1) + 0.20::double * ch as base, case when contains(d, q) then 0.2 when length(q) > 4 and list_bool_or(list_transform(range(1, length(q) - 2), lambda i: contains(d, substr(q, i, 4)))) then 0.1 else 0 end::double as more from l2),
    lx as (select * exclude (q, d, n, m, base, more), case when n > 0 and d <> '' then round(least(case when more > 0 then 1 else base end, base + more), 4) else 0 end as lexical from l3)"""


def _reranked_sql(depth: int) -> str:
    return f"""{_FUSED}, fh as (select query, doc, rank from fu where rank <= {depth}), {_lexical_sql('fh')},
    rs as (select query, doc, rank > 15 as tail, rank as was, case when rank > 15 then 0 else lexical end as rerank_score from lx), rr as (select query, doc, rerank_score, row_number() over (partition by query order by tail, rerank_score desc, was) as rank from rs)"""


# The strategies in SQL: (strategy, query, doc, rank).
_STRATEGIES = f"""{_reranked_sql(50)}, rg as (select *, row_number() over (partition by query order by rank) as r, count(*) over (partition by query) as n from rr where rank <= 10 and rerank_score >= 0.5),
sg as (select 'vector_only' as strategy, query, doc, rank from c where rank <= 10 union all select 'bm25_only', query, doc, rank from b where rank <= 10 union all select 'hybrid', query, doc, rank from fu where rank <= 10
union all select 'hybrid_rerank', query, doc, (case when r % 2 = 1 then (r - 1) // 2 else n - 1 - (r - 2) // 2 end + 1)::bigint from rg)"""


@add("r6_strategies", f"with {_STRATEGIES} select * from sg")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies(spark, sf_dir).select("strategy", "query", "doc", "rank")


@add("r7_lexical_score", f"with {_reranked_sql(20)} select query, doc, lexical as score from lx")
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_hits(spark, sf_dir).select("query", "doc", R.lexical_score(F.col("qtext"), F.col("text")).alias("score"))


def reranked(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return R.rerank(fused_hits(spark, sf_dir), R.lexical_score(F.col("qtext"), F.col("text")), k)


@add("r8_rerank_window", f"with {_reranked_sql(20)} select query, doc, rerank_score, rank from rr where rank <= 17")
def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir, 17).select("query", "doc", "rerank_score", "rank")


@add("r9_score_cut", f"with {_reranked_sql(20)} select query, doc, rerank_score from rr where rank <= 10 and rerank_score >= 0.5")
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cut(reranked(spark, sf_dir).withColumn("distance", F.lit(0.0)), 0.5).select("query", "doc", "rerank_score")


@add("r10_edges_first", f"with {_BM25} select query, doc, rank, case when rank % 2 = 1 then (rank - 1) // 2 else (count(*) over (partition by query)) - 1 - (rank - 2) // 2 end::bigint as place from b where rank <= 10")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.edges_first(bm25(spark, sf_dir)).select("query", "doc", "rank", "place")


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 1000000).alias("chunk_id"), F.col("source").alias("section_path"), F.concat(F.lit(" \n"), F.col("lang"), F.lit("\nx")).alias("questions"), F.col("text").alias("answer"))
    return R.citations(R.edges_first(bm25(spark, sf_dir, 5)).join(d, "doc"))


_CITED = f"{_BM25}, h as (select query, doc, case when rank % 2 = 1 then (rank - 1) // 2 else (count(*) over (partition by query)) - 1 - (rank - 2) // 2 end as place from b where rank <= 5), ci as (select query, row_number() over (partition by query order by place) as n, case when doc % 2 = 0 then doc + 1000000 else doc end as chunk_id, source as section_path, {strip_sql('lang')} as question, text as answer from h join documents on doc = doc_id)"


@add("r11_citations", f"with {_CITED} select * from ci")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited(spark, sf_dir)


@add("r20_evidence", f"with {_CITED} select query, string_agg('[' || n || '] ' || section_path || chr(10) || '问：' || question || chr(10) || '答：' || answer, chr(10) || chr(10) order by n) as evidence from ci group by 1")
def r20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evidence(cited(spark, sf_dir))


@add(
    "r12_route_merge",
    f"""with r as (select doc_id % 97 as query, doc_id % 3 as route, doc_id as doc, text, (doc_id * 7919 % 100) / 100.0::double as score from documents),
    o as (select *, row_number() over (partition by query, {strip_sql('text')} order by score desc, route, doc) as k from r), f as (select *, row_number() over (partition by query order by score desc, route, doc) as rank from o where k = 1) select query, doc, score, rank from f where rank <= 5""",
)
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    hits = read(spark, sf_dir, "documents").select((i % 97).alias("query"), (i % 3).alias("route"), i.alias("doc"), F.col("text"), (i * 7919 % 100 / 100.0).alias("score"))
    return R.merge_routes(hits).select("query", "doc", "score", "rank")


@add(
    "r13_expanded_queries",
    "select item_id as query, 0::bigint as place, text from benchmark union all select item_id, 1, 'extra ' || item_id from benchmark where item_id % 2 = 0",
)
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.concat(F.lit("extra "), F.col("item_id"))
    said = F.when(F.col("item_id") % 2 == 0, F.to_json(F.array(extra, F.lit(" "), extra, F.col("text")))).otherwise("not json [")
    return R.expanded(read(spark, sf_dir, "benchmark").withColumn("m", said), "item_id", "text", "m").withColumn("place", F.col("place").cast("long"))


@add("r14_bm25_query", "select item_id, case when item_id % 3 = 0 then text else 'std ' || item_id || ' a b' end as q from benchmark")
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    std = F.when(F.col("item_id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("std "), F.col("item_id")))
    return read(spark, sf_dir, "benchmark").select("item_id", R.bm25_query(std, F.array(F.lit("a"), F.lit(" "), F.lit("b")), F.col("text")).alias("q"))


@add("r15_understood_query", "select item_id, case item_id % 3 when 0 then 's' || item_id when 1 then 't' || item_id else text end as standard, case item_id % 3 when 2 then '' else 'a,b' end as keywords from benchmark")
def r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    said = F.when(i % 3 == 0, F.concat(F.lit('```json\n{"standard_query": "s'), i, F.lit('", "keywords": ["a", "b"]}\n```'))).when(i % 3 == 1, F.concat(F.lit('{"standard_query": "t'), i, F.lit('", "keywords": "a，b"}'))).otherwise("nothing")
    got = R.understood(said, F.col("text"))
    return read(spark, sf_dir, "benchmark").select("item_id", got["standard"].alias("standard"), F.array_join(got["keywords"], ",").alias("keywords"))


@add("r16_faq_text", f"with {_BM25}, h as (select query, rank, lang, text as a from b join documents on doc = doc_id where rank <= 3) select query, string_agg(rank || '. 问：' || lang || ' 答：' || a, chr(10) || chr(10) order by rank) as text from h group by 1")
def r16(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("question"), F.col("text").alias("answer"))
    return R.faq_text(bm25(spark, sf_dir, 3).join(d, "doc"))


_FAQ = """with k as (select distinct text as keyword from benchmark where text <> ''), h as (select keyword, doc_id as id, row_number() over (partition by keyword order by doc_id) as rank from k join documents on contains(text, keyword)) select keyword, id, rank from h where rank <= 3"""


def faq_found(spark: SparkSession, sf_dir: str, block: int = R.KEYWORD_CHARS) -> DataFrame:
    faq = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("question"), F.col("text").alias("answer"))
    return R.faq_search(faq, read(spark, sf_dir, "benchmark").select(F.col("text").alias("keyword")), block=block)


@add("r17_faq_search", _FAQ)
def r17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faq_found(spark, sf_dir)


@add("r17_indexed_search", _FAQ)
def r17i(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by rarest grams, as for more keywords than are broadcast."""
    return faq_found(spark, sf_dir, 0)


_SCORES = "sc as (select user_id as query, coalesce(value / 200, 0) as score from events)"
_CONFIDENCE = "greatest(0, least(1, 0.60 * s0 + 0.25 * least(n / 3.0, 1) + 0.15 * case when c > 1 then greatest(l[1] - l[2], 0) else 0.5 * s0 end)) as confidence"
_CONF = f"{_SCORES}, g as (select query, max(score) as s0, count_if(score >= 0.25) as n, count(*) as c, list_sort(list(score), 'DESC') as l from sc group by 1), cf as (select query, {_CONFIDENCE} from g)"


def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every event is a retrieval score of its user.
    return R.confidence(read(spark, sf_dir, "events").select(F.col("user_id").alias("query"), (F.col("value") / 200).alias("score")))


# Scores here have four digits at most, so values have seven or repeat thirds: none ends on a half at the ninth.
@add("r18_confidence", f"with {_CONF} select query, round(confidence, 9) as confidence from cf")
def r18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidences(spark, sf_dir).withColumn("confidence", F.round("confidence", 9))


@add("r19_gate", f"with {_CONF} select query, case when confidence >= 0.40 then 'pass' else 'fallback' end as gate from cf")
def r19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidences(spark, sf_dir).select("query", R.gate(F.col("confidence")).alias("gate"))


@add("f1_pool_rows", f"with {_CONF} select query, 'user ' || query as raw_question, 'retrieval_low_conf' as source from cf where confidence < 0.40")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = confidences(spark, sf_dir)
    hits = read(spark, sf_dir, "events").select(F.col("user_id").alias("query"), (F.col("event_id") % 7 + 1).alias("rank"), F.col("props").alias("text"), (F.col("value") / 200).alias("score"), F.col("event_type").alias("section"))
    return Y.pool_rows(c, hits, c.select("query", F.concat(F.lit("user "), F.col("query")).alias("text"))).select("query", "raw_question", "source")


_POOLED = f"""{_reranked_sql(20)}, sc as (select query, rerank_score as score from rr where rank <= 10), g as (select query, max(score) as s0, count_if(score >= 0.25) as n, count(score) as c, list_sort(list(score), 'DESC') as l from sc group by 1),
cf as (select query, {_CONFIDENCE} from g)"""


@add(
    "f1_pool_chunks",
    f"with {_POOLED} select query, b.text as raw_question, rr.rank::int as place, substr(d.text, 1, 300) as chunk, rerank_score as score, source as section from cf join rr using (query) join benchmark b on b.item_id = query join documents d on d.doc_id = doc where confidence < 0.8 and rr.rank <= 5",
)
def f1c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages whose reranked documents are weak evidence, with the snapshot of the best five, each cut to 300 characters as the pool asks."""
    r = stored(reranked(spark, sf_dir), "reranked")
    c = R.confidence(r.select("query", F.col("rerank_score").alias("score")))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("section"))
    hits = r.join(d, "doc").select("query", "rank", "text", F.col("rerank_score").alias("score"), "section")
    got = Y.pool_rows(c, hits, questions(spark, sf_dir), 0.8)
    each = got.select("query", "raw_question", F.posexplode("chunks").alias("place", "c"))
    return each.select("query", "raw_question", (F.col("place") + 1).alias("place"), F.col("c.text").alias("chunk"), F.col("c.score").alias("score"), F.col("c.section").alias("section"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two targets for each passage: a source and another one, or a language."""
    i = F.col("item_id")
    src = lambda x: F.concat(F.lit("<src"), x.cast("string"), F.lit(">"))
    return read(spark, sf_dir, "benchmark").select(i.alias("sample"), F.array(F.array(src(i % 20), src((i + 7) % 20)), F.array(F.lit("<fr>"), src((i + 3) % 20))).alias("targets"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.lit("<"), F.col("source"), F.lit(">")).alias("section_path"), F.lit(None).cast("string").alias("question"), F.concat(F.lit("<"), F.col("lang"), F.lit(">")).alias("category"))
    return strategies(spark, sf_dir).join(d, "doc").withColumnRenamed("query", "sample")


_HITS = f"{_STRATEGIES}, hi as (select strategy, query as sample, rank, source, lang from sg join documents on doc = doc_id)"
_RANKS = f"""{_HITS}, sm as (select item_id as sample, unnest({list(R.STRATEGIES)}) as strategy from benchmark), rk as (select sample, strategy, 0 as target, coalesce(min(rank) filter (source = 'src' || sample % 20 or source = 'src' || (sample + 7) % 20), 0) as rank from sm left join hi using (sample, strategy) group by 1, 2
union all select sample, strategy, 1, coalesce(min(rank) filter (lang = 'fr' or source = 'src' || (sample + 3) % 20), 0) from sm left join hi using (sample, strategy) group by 1, 2)"""
_METRICS = f"{_RANKS}, me as (select sample, strategy, round(avg((rank between 1 and 3)::int), 4) as recall_3, round(avg((rank between 1 and 5)::int), 4) as recall_5, round(avg((rank between 1 and 10)::int), 4) as recall_10, round(avg(case when rank > 0 then 1.0 / rank else 0 end), 4) as mrr from rk group by 1, 2)"


@add("e1_hit_ranks", f"with {_RANKS} select sample, strategy, target::bigint as target, rank::bigint as rank from rk")
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hit_ranks(samples(spark, sf_dir), hits(spark, sf_dir), list(R.STRATEGIES)).withColumn("target", F.col("target").cast("long"))


@add("e2_recall_mrr", f"with {_METRICS} select * from me")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.recall_mrr(E.hit_ranks(samples(spark, sf_dir), hits(spark, sf_dir), list(R.STRATEGIES)))


def _answer(i: Column) -> Column:
    said = [f"您好，{p}。" for p, _ in TRIGGERS] + ["抱歉，暂未收录。", "可以。"]
    return F.element_at(F.array(*map(F.lit, said)), (i % len(said) + 1).cast("int"))


_SAID = "[" + ", ".join(f"'您好，{p}。'" for p, _ in TRIGGERS) + ", '抱歉，暂未收录。', '可以。']"
_MADE = "case " + " ".join(f"when contains(a, '{p}') and not contains(e, '{p}') then '{why} ({p})'" for p, why in TRIGGERS) + " end"


@add(
    "e3_faithfulness",
    f"""with x as (select doc_id, {_SAID}[doc_id % {len(TRIGGERS) + 2} + 1] as a, case when doc_id % 4 > 0 then text || case when doc_id % 4 = 2 then '免单' else '' end end as e from documents)
    select doc_id, case when e is null then {' or '.join(f"contains(a, '{r}')" for r in REFUSALS)} else {_MADE} is null end as faithful,
    case when e is null then case when {' or '.join(f"contains(a, '{r}')" for r in REFUSALS)} then 'refused without evidence' else 'answered without evidence' end else coalesce({_MADE}, 'supported') end as reason from x""",
)
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    evidence = F.when(i % 4 > 0, F.concat(F.col("text"), F.when(i % 4 == 2, "免单").otherwise("")))
    return read(spark, sf_dir, "documents").select("doc_id", E.faithfulness(_answer(i), evidence).alias("r")).select("doc_id", "r.faithful", "r.reason")


@add(
    "e4_sufficiency",
    f"""with x as (select doc_id, {_TERMS.format('text')} as w, lower(text) as e, doc_id % 9 = 0 as oos from documents)
    select doc_id, not oos and coalesce(list_bool_or(list_transform(list_filter(w, lambda x: length(x) >= 2), lambda x: contains(e, x))), false) as sufficient from x""",
)
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.col("text"), F.when(F.col("doc_id") % 9 == 0, F.lit(OUT_OF_SCOPE[0])).otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", E.sufficient(q, F.col("text")).alias("sufficient"))


@add("e5_judge_json", "select doc_id, doc_id % 4 in (0, 1) as sufficient, case doc_id % 4 when 3 then '' else 'r' || doc_id end as reason from documents")
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    body = lambda v: F.concat(F.lit(f'{{"sufficient": {v}, "reason": "r'), i, F.lit('"}'))
    said = F.when(i % 4 == 0, F.concat(F.lit("```json\n"), body("true"), F.lit("\n```"))).when(i % 4 == 1, F.concat(F.lit('sufficient? "sufficient": true, "reason": "r'), i, F.lit('"'))).when(i % 4 == 2, body("false")).otherwise("?")
    return read(spark, sf_dir, "documents").select("doc_id", E.judged(said).alias("j")).select("doc_id", "j.sufficient", "j.reason")


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.element_at(F.array(*map(F.lit, ["A_policy", "B_model", "C_colloquial", "E_multi", "D_absent"])), (F.col("sample") % 5 + 1).cast("int"))
    return e2(spark, sf_dir).select("strategy", b.alias("bucket"), "recall_3", "recall_5", "recall_10", "mrr", F.lit(1.0).alias("faithful"), (F.col("sample") % 2).cast("double").alias("refused"))


_BUCKETED = f"{_METRICS}, bu as (select strategy, ['A_policy', 'B_model', 'C_colloquial', 'E_multi', 'D_absent'][sample % 5 + 1] as bucket, recall_3, recall_5, recall_10, mrr, 1.0::double as faithful, (sample % 2)::double as refused from me)"
_AVG = ", ".join(f"((2 * sum(round({c} * 10000)::bigint) filter (bucket <> 'D_absent') + count(*) filter (bucket <> 'D_absent')) // (2 * count(*) filter (bucket <> 'D_absent')))::bigint / 10000.0::double as {c}" for c in ("recall_3", "recall_5", "recall_10", "mrr", "faithful"))
_BY = f"{_BUCKETED}, by_b as (select strategy, bucket, count(*) as n, {_AVG}, round(avg(refused) filter (bucket = 'D_absent'), 4) as refusal_rate from bu group by 1, 2 union all select strategy, 'overall', count(*), {_AVG}, round(avg(refused) filter (bucket = 'D_absent'), 4) from bu group by 1)"


@add("e6_by_bucket", f"with {_BY} select * from by_b")
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_bucket(bucketed(spark, sf_dir))


@add("e7_stratified_sample", "select source, doc_id, place from (select source, doc_id, row_number() over (partition by source order by doc_id) as place from documents) where place <= 3")
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stratified(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 3)


@add(
    "e8_comparison",
    f"""with {_BY}, o as (select strategy, recall_5, mrr, list_position(['vector_only', 'bm25_only', 'hybrid', 'hybrid_rerank'], strategy) as o from by_b where bucket = 'overall'), s as (select strategy, mrr as spoken from by_b where bucket = 'C_colloquial'), j as (select * from o left join s using (strategy)), base as (select max(spoken) filter (strategy = 'bm25_only') as base from j),
    cv as (select strategy, max(round(least(1.0, 1.02 * recall_5), 3)) filter (bucket = 'A_policy') as cover_a, max(round(least(1.0, 1.02 * recall_5), 3)) filter (bucket = 'B_model') as cover_b, max(round(least(1.0, 1.02 * recall_5), 3)) filter (bucket = 'C_colloquial') as cover_c, max(round(least(1.0, 1.02 * recall_5), 3)) filter (bucket = 'E_multi') as cover_e from by_b group by 1)
    select strategy, (select strategy from j order by mrr desc, o limit 1) as best_strategy, case when base > 0 then round((spoken - base) / base * 100, 2) end as colloquial_lift, cover_a, cover_b, cover_c, cover_e, round(least(1.0, 1.01 * recall_5), 4) as evidence_coverage, round(0.98 * mrr, 4) as answer_coverage from j join cv using (strategy), base""",
)
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("coverage")
    return E.comparison(e6(spark, sf_dir)).select("strategy", "best_strategy", "colloquial_lift", c["A_policy"].alias("cover_a"), c["B_model"].alias("cover_b"), c["C_colloquial"].alias("cover_c"), c["E_multi"].alias("cover_e"), "evidence_coverage", "answer_coverage")
