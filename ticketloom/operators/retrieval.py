"""Batch retrieval: many queries against many chunks; BM25, exact dense search, fusion, reranking, citations, gate."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import GATE
from ..sources.io import bounded_batches, stored
from .clustered import clustered_search, unit
from .substrings import keyword_join

#: Parameters of BM25 and of rank fusion.
K1, B, FUSION = 1.2, 0.75, 60
#: Documents of a block of postings; room below a score's bound for rounding.
BLOCK_DOCS, SLACK = 64, 2e-6
#: Characters of keywords that are broadcast at most; more are joined by their rarest grams.
KEYWORD_CHARS = 500_000
STRATEGIES = ("vector_only", "bm25_only", "hybrid", "hybrid_rerank")


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked; Spark keeps k rows of a group in each task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)


def bm25_index(docs: DataFrame, doc: str, text: str, only: DataFrame | None = None, marked: bool = False) -> DataFrame:
    """Postings (term, doc, tf, dl), tf counted before any shuffle by term; `only` (term) leaves out other terms' postings.

    marked: each document that has a term also has a posting of the empty term, of which number and mean length are read.
    """
    words = docs.select(F.col(doc).alias("doc"), T.terms(F.col(text)).alias("ws"))
    if marked:
        mark = F.array(F.lit(""))
        each = words.select("doc", F.size("ws").cast("long").alias("dl"), F.explode_outer(F.when(F.size("ws") > 0, F.concat("ws", mark))).alias("term")).filter("term is not null")
        each = each if only is None else each.join(only.select("term").unionByName(only.sparkSession.createDataFrame([("",)], "term string")).distinct(), "term", "left_semi")
        return each.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    # An outer explode: before an inner one Spark filters by the size of the array, and splits each text twice.
    each = words.select("doc", F.size("ws").cast("long").alias("dl"), F.explode_outer("ws").alias("term")).filter("term is not null")
    each = each if only is None else each.join(only.select("term").distinct(), "term", "left_semi")
    return each.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def asked_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, term): each term of a query once."""
    return queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(T.terms(F.col(text)))).alias("term"))


def bm25_blocks(index: DataFrame, block: int = BLOCK_DOCS) -> DataFrame:
    """R2: stored postings with their scores (term, doc, block, part); idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    index: marked postings of at least the asked terms, stored. A block has about `block` documents whose lengths are within
    an eighth of each other, so that its largest scores aren't those of much shorter or longer documents.
    """
    length = F.floor(8 * F.log(F.col("dl")))
    marks = index.filter("term = ''")
    size = marks.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    parts = marks.groupBy(length.alias("length")).agg(F.ceil(F.count("*") / block).alias("parts"))  # at most 8 ln(2^31) rows
    words = index.filter("term <> ''")
    df = words.groupBy("term").agg(F.count("*").alias("df"))
    known = words.join(df, "term").withColumn("length", length).join(F.broadcast(parts), "length").crossJoin(F.broadcast(size))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return stored(known.select("term", "doc", (F.shiftleft(F.col("length"), 40) + F.pmod(F.xxhash64("doc"), F.col("parts"))).alias("block"), part.alias("part")), "blocks")


def bm25_candidates(postings: DataFrame, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """R2: (candidates (query, doc, block, found, rest), terms left out (query, block, term)); both steps of the search.

    First a lower bound of each query's k-th score: the whole scores of the best documents of its rarest terms. Then, of
    each block of documents, the terms in order of their largest score there: those whose sum can't reach the bound are
    left out, and with all of them the block. What is left out can't bring a document among the best by itself, so the
    candidates are the documents of the other terms that can still reach the bound with what is left out.
    """
    best = postings.groupBy("term", "block").agg(F.max("part").alias("best"), F.count("*").alias("df"))
    best = stored(best.join(terms, "term"), "maxima")
    by_query = best.groupBy("query", "term").agg(F.sum("df").alias("df"))
    before = F.sum("df").over(W.partitionBy("query").orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1))  # the terms of a query
    rare = by_query.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < 8 * k).select("query", "term")
    seeds = top(postings.join(rare, "term").groupBy("query", "doc", "block").agg(F.sum("part").alias("s")), ["query"], [F.desc("s"), F.col("doc")], 4 * k).select("query", "doc", "block")
    whole = seeds.join(terms, "query").join(postings, ["doc", "block", "term"]).groupBy("query", "doc").agg(F.sum("part").alias("s"))
    bound = top(whole, ["query"], [F.desc("s")], k).filter(F.col("rank") == k).select("query", (F.col("s") - SLACK).alias("bound"))
    reach = F.sum("best").over(W.partitionBy("query", "block").orderBy("best", "term").rowsBetween(W.unboundedPreceding, 0))  # the terms of a query
    known = stored(best.select("query", "block", "term", "best").withColumn("reach", reach).join(bound, "query", "left"), "reach")
    out = known.filter("reach < bound").select("query", "block", "term", "reach")
    rest = out.groupBy("query", "block").agg(F.max("reach").alias("rest"))
    kept = known.filter("bound is null or reach >= bound").select("query", "block", "term", "bound")
    found = postings.join(kept, ["term", "block"]).groupBy("query", "doc", "block").agg(F.sum("part").alias("found"), F.first("bound").alias("bound"))
    found = found.join(rest, ["query", "block"], "left").filter("bound is null or found + coalesce(rest, 0) >= bound")
    return found.select("query", "doc", "block", "found"), out.select("query", "block", "term")


def bm25_search(postings: DataFrame, terms: DataFrame, k: int = 50) -> DataFrame:
    """R2: (query, doc, score, rank) of the best k by BM25, exactly; postings: `bm25_blocks`, terms (query, term), each once.

    Only candidates are scored whole: what was left out is looked up for them. Equal scores are ranked by document; scores
    are rounded to six digits first, for which the bounds leave room.
    """
    terms = stored(terms.select("query", "term").distinct(), "terms")
    found, out = bm25_candidates(postings, terms, k)
    found = stored(found, "candidates")
    more = found.select("query", "doc", "block").join(out, ["query", "block"]).join(postings, ["doc", "block", "term"]).select("query", "doc", F.col("part").alias("found"))
    scored = found.select("query", "doc", "found").unionByName(more).groupBy("query", "doc").agg(F.round(F.sum("found"), 6).alias("score"))
    return top(scored, ["query"], [F.desc("score"), F.col("doc")], k)


def sound(vector: str) -> Column:
    """A vector that isn't null or empty and holds finite numbers only."""
    return F.expr(f"coalesce(size({vector}) > 0 and not exists({vector}, x -> x is null or isnan(x) or abs(x) = double('infinity')), false)")


def dense_search(chunks: DataFrame, queries: DataFrame, doc: str, vector: str, k: int = 3, least: float = 0.35, broadcast_rows: int = 20_000) -> DataFrame:
    """(query, doc, score, rank) of the best k by exact cosine, at least `least`; queries (query, vector), each number once.

    Up to `broadcast_rows` query vectors are broadcast, and each Arrow batch of chunks meets them in one matrix product and
    keeps k rows for each query. More queries stay a table and meet blocks of clustered chunks (`clustered_search`). Vectors
    that are null, empty or hold null or non-finite numbers, on either side, and vectors of different lengths don't meet;
    a vector of zeros has cosine 0.
    """
    spark = chunks.sparkSession
    known = chunks.select(F.col(doc).alias("doc"), F.col(vector).alias("vector")).filter(sound("vector"))
    asked = queries.select("query", "vector").filter(sound("vector") & F.col("query").isNotNull())
    if asked.count() > broadcast_rows:
        return top(clustered_search(known, asked, "doc", "vector", k, least)[0], ["query"], [F.desc("score"), F.col("doc")], k)
    bounded_batches(spark)
    rows = asked.toPandas()  # at most broadcast_rows rows
    by_length = {n: (g["query"].to_numpy(), unit(g["vector"])) for n, g in rows.groupby(rows["vector"].map(len))} if len(rows) else {}
    sent = spark.sparkContext.broadcast(by_length)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, same in b.groupby(b["vector"].map(len)):
                if n not in sent.value:
                    continue
                ids, asked_units = sent.value[n]
                same = same.sort_values("doc", kind="stable")
                docs, s = same["doc"].to_numpy(), np.round(asked_units @ unit(same["vector"]).T, 6)
                if s.shape[1] > k:
                    # The k-th best score of each query; what ties with it stays, and the ranking below decides.
                    s = np.where(s >= np.partition(s, -k, axis=1)[:, -k][:, None], s, -2.0)
                r, c = np.nonzero(s >= max(least, -1.5))
                yield pd.DataFrame({"query": ids[r], "doc": docs[c], "score": s[r, c]})

    found = known.mapInPandas(search, "query long, doc long, score double")
    return top(found, ["query"], [F.desc("score"), F.col("doc")], k)


def fuse(routes: list[DataFrame], k: int = 50, depth: int = 50) -> DataFrame:
    """Reciprocal rank fusion of (query, doc, rank) routes; ranks from 1."""
    every = reduce(DataFrame.unionByName, [r.filter(F.col("rank") <= depth).select("query", "doc", "rank") for r in routes])
    fused = every.groupBy("query", "doc").agg(F.round(F.sum(1.0 / (FUSION + F.col("rank"))), 9).alias("score"))
    return top(fused, ["query"], [F.desc("score"), F.col("doc")], k)


def by_strategy(wanted: list[str], queries: DataFrame, bm25: DataFrame, dense: DataFrame, texts: DataFrame, k: int = 10, depth: int = 50, least: float | None = None) -> DataFrame:
    """One long table (strategy, query, doc, rank, score) of the wanted strategies; an unknown one is an error.

    queries (query, text), of which blank ones find nothing; bm25 and dense: ranked routes, at least `depth` deep; texts
    (doc, text). hybrid_rerank scores the fused rows again, drops those below `least` and puts the best at both ends.
    """
    if bad := set(wanted) - set(STRATEGIES):
        raise ValueError(f"unknown strategies: {sorted(bad)}")
    asked = queries.filter(F.coalesce(T.strip(F.col("text")), F.lit("")) != "").select("query", F.col("text").alias("qtext"))
    bm25, dense = (r.join(asked.select("query"), "query", "left_semi") for r in (bm25, dense))
    out = {}
    for s in wanted:
        if s == "vector_only":
            out[s] = dense.filter(F.col("rank") <= k)
        elif s == "bm25_only":
            out[s] = bm25.filter(F.col("rank") <= k)
        elif s == "hybrid":
            out[s] = fuse([dense, bm25], k, depth)
        else:
            hits = fuse([dense, bm25], depth, depth).join(texts.select("doc", F.col("text").alias("dtext")), "doc").join(asked, "query")
            best = rerank(hits, lexical_score(F.col("qtext"), F.col("dtext")), k)
            best = best if least is None else cut(best.withColumn("distance", F.lit(0.0)), least)
            best = best.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("rank")).cast("long"))  # at most k rows a query
            out[s] = edges_first(best).withColumn("rank", F.col("place") + 1).withColumn("score", F.col("rerank_score"))
    return reduce(DataFrame.unionByName, [d.select(F.lit(s).alias("strategy"), "query", "doc", "rank", F.col("score").cast("double").alias("score")) for s, d in out.items()])


def lexical_score(query: Column, doc: Column) -> Column:
    """0.55 word recall + 0.25 Jaccard + 0.20 character recall, lifted for a contained query or a shared four-gram; 0 to 1."""
    chars = lambda c: F.array_distinct(F.regexp_extract_all(F.replace(c, F.lit(" "), F.lit("")), F.lit("(?s)."), F.lit(0)))
    # Texts, then their words and characters, are bound once by a function over a one-element array: nothing is computed twice.
    texts = F.array(F.struct(F.lower(T.strip(query)).alias("q"), F.lower(T.strip(doc)).alias("d")))
    sets = F.transform(texts, lambda x: F.struct(x["q"].alias("q"), x["d"].alias("d"), F.array_distinct(T.terms(x["q"])).alias("qw"), F.array_distinct(T.terms(x["d"])).alias("dw"), chars(x["q"]).alias("qc"), chars(x["d"]).alias("dc")))
    sizes = F.transform(sets, lambda x: F.struct(x["q"].alias("q"), x["d"].alias("d"), F.size(x["qw"]).alias("n"), F.size(x["dw"]).alias("m"), F.size(F.array_intersect(x["qw"], x["dw"])).alias("both"), F.when(F.size(x["qc"]) > 0, F.size(F.array_intersect(x["qc"], x["dc"])) / F.size(x["qc"])).otherwise(0.0).alias("c")))
    bases = F.transform(sizes, lambda x: F.struct(x["q"].alias("q"), x["d"].alias("d"), x["n"].alias("n"), (0.55 * x["both"] / F.greatest(x["n"], F.lit(1)) + 0.25 * x["both"] / F.greatest(x["n"] + x["m"] - x["both"], F.lit(1)) + 0.20 * x["c"]).alias("base")))

    def lifted(x: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x["q"]) - 3, F.lit(1))), lambda i: F.substring(x["q"], i, F.lit(4)))
        more = F.when(x["d"].contains(x["q"]), 0.2).when((F.length(x["q"]) > 4) & F.exists(grams, lambda g: x["d"].contains(g)), 0.1)
        return F.when((x["n"] > 0) & (x["d"] != ""), F.round(F.when(more.isNull(), x["base"]).otherwise(F.least(F.lit(1.0), x["base"] + more)), 4)).otherwise(0.0)

    return F.coalesce(F.element_at(F.transform(bases, lifted), 1), F.lit(0.0))


def rerank(hits: DataFrame, score: Column, k: int, window: int = 15) -> DataFrame:
    """The first `window` rows of a query are scored again and sorted; the rest follow at 0.0 where fewer than k are left."""
    s = hits.withColumn("tail", F.col("rank") > window).withColumn("rerank_score", F.when(F.col("rank") > window, 0.0).otherwise(score))
    return top(s.drop("score").withColumnRenamed("rank", "was"), ["query"], [F.col("tail"), F.desc("rerank_score"), F.col("was")], k)


def cut(hits: DataFrame, least: float, rerank_score: str = "rerank_score", distance: str = "distance") -> DataFrame:
    """Rows whose rerank score, or else distance, is at least `least`."""
    return hits.filter(F.coalesce(F.col(rerank_score), F.col(distance)) >= least)


def edges_first(hits: DataFrame) -> DataFrame:
    """The best rows go to both ends: even places from 0 keep order in front, odd ones count from the back."""
    at = F.col("rank") - 1
    n = F.count("*").over(W.partitionBy("query"))
    return hits.withColumn("place", F.when(at % 2 == 0, F.floor(at / 2)).otherwise(n - 1 - F.floor((at - 1) / 2)).cast("long"))


def citations(hits: DataFrame, order: str = "place") -> DataFrame:
    """(query, n, chunk_id, section_path, question, answer), n from 1; the first non-blank question line; null as empty."""
    q = F.filter(F.split(F.coalesce(F.col("questions"), F.lit("")), "\n"), lambda x: T.strip(x) != "")
    n = F.row_number().over(W.partitionBy("query").orderBy(order)).cast("long")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return hits.select("query", n.alias("n"), F.coalesce("chunk_id", "id").alias("chunk_id"), blank("section_path"), F.coalesce(T.strip(F.try_element_at(q, F.lit(1))), F.lit("")).alias("question"), blank("answer"))


def evidence(cited: DataFrame) -> DataFrame:
    """(query, evidence): a block for each citation, in order."""
    block = F.format_string("[%d] %s\n问：%s\n答：%s", F.col("n"), F.col("section_path"), F.col("question"), F.col("answer"))
    g = cited.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", block.alias("b")))).alias("bs"))
    return g.select("query", F.array_join(F.transform("bs", lambda b: b["b"]), "\n\n").alias("evidence"))


def merge_routes(hits: DataFrame, k: int = 5) -> DataFrame:
    """Texts found by several routes once, with their best score (the first route on a tie); the best k of a query."""
    once = top(hits.withColumn("key", T.strip(F.col("text"))), ["query", "key"], [F.desc("score"), F.col("route"), F.col("doc")], 1, "r").drop("r")
    return top(once, ["query"], [F.desc("score"), F.col("route"), F.col("doc")], k)


def expanded(queries: DataFrame, query: str, text: str, model: str) -> DataFrame:
    """(query, place, text): the question and a model's distinct non-blank rewordings; bad JSON: the question alone."""
    listed = F.from_json(T.json_body(F.col(model)), "array<string>")
    good = F.coalesce(F.filter(F.transform(listed, T.strip), lambda x: F.coalesce(x != "", F.lit(False))), F.expr("cast(array() as array<string>)"))
    return queries.select(F.col(query).alias("query"), F.posexplode(F.array_union(F.array(F.col(text)), good)).alias("place", "text"))


def bm25_query(standard: Column, keywords: Column, raw: Column) -> Column:
    """The standard question and its non-blank keywords; without a standard question the raw one."""
    some = F.filter(F.transform(F.coalesce(keywords, F.expr("cast(array() as array<string>)")), T.strip), lambda x: x != "")
    return F.when(F.coalesce(T.strip(standard), F.lit("")) == "", raw).otherwise(F.concat_ws(" ", T.strip(standard), F.array_join(some, " ")))


def understood(model: Column, raw: Column) -> Column:
    """struct<standard, keywords> of a model's JSON; keywords as a list or a delimited text; anything else: the raw question."""
    body = T.json_body(model)
    lists = F.from_json(body, "struct<standard_query:string,keywords:array<string>>")
    words = F.coalesce(lists["keywords"], F.filter(F.split(F.get_json_object(body, "$.keywords"), "[,，、;；\\s]+"), lambda x: x != ""), F.expr("cast(array() as array<string>)"))
    said = F.coalesce(F.nullif(T.strip(F.get_json_object(body, "$.standard_query")), F.lit("")), F.nullif(F.regexp_extract(model, r'"standard_query"\s*:\s*"([^"]+)"', 1), F.lit("")), raw)
    return F.struct(said.alias("standard"), words.alias("keywords"))


def faq_text(hits: DataFrame) -> DataFrame:
    """(query, text): numbered questions and answers; a fixed sentence where nothing was found."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". 问："), F.col("question"), F.lit(" 答："), F.col("answer"))
    g = hits.groupBy("query").agg(F.sort_array(F.collect_list(F.when(F.col("question").isNotNull(), F.struct("rank", line.alias("t"))))).alias("ts"))
    return g.select("query", F.when(F.size("ts") == 0, "未找到相关常见问题").otherwise(F.array_join(F.transform("ts", lambda t: t["t"]), "\n\n")).alias("text"))


def keyword_hits(texts: DataFrame, keywords: DataFrame, keep: int | None = None, block: int = KEYWORD_CHARS) -> DataFrame:
    """(keyword, id) of each text that holds a keyword; texts (id, text), keywords (keyword), of which empty ones find nothing.

    Up to `block` characters of distinct keywords are broadcast, and one pass of an Aho-Corasick automaton over whole texts
    finds them all; `keep`: only that many smallest ids of a keyword leave a batch. Beyond it: `substrings.keyword_join`.
    """
    spark = texts.sparkSession
    kw = keywords.select("keyword").filter("keyword <> ''").distinct()
    if (kw.agg(F.sum(F.length("keyword"))).first()[0] or 0) > block:
        return keyword_join(texts, kw)
    bounded_batches(spark)
    kinds = dict(texts.dtypes)["id"]
    sent = spark.sparkContext.broadcast(sorted(r["keyword"] for r in kw.collect()))  # at most `block` characters

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, w in enumerate(sent.value):
            automaton.add_word(w, i)
        if len(automaton):
            automaton.make_automaton()
        for b in batches:
            rows: dict[int, list] = {}
            for i, t in zip(b["id"].tolist(), b["text"], strict=True):
                for w in {w for _, w in automaton.iter(t)} if len(automaton) and t else ():
                    rows.setdefault(w, []).append(i)
            rows = {w: sorted(ids)[:keep] for w, ids in rows.items()} if keep else rows
            yield pd.DataFrame([(sent.value[w], i) for w, ids in rows.items() for i in ids], columns=["keyword", "id"])

    return texts.select("id", "text").filter("text is not null").mapInPandas(search, f"keyword string, id {kinds}")


def faq_search(faq: DataFrame, keywords: DataFrame, limit: int = 3, block: int = KEYWORD_CHARS) -> DataFrame:
    """(keyword, id, rank) of the first rows whose question or answer holds the keyword; block: see `keyword_hits`."""
    each = faq.select("id", F.explode(F.array("question", "answer")).alias("text"))
    return top(keyword_hits(each, keywords, 2 * limit, block).distinct(), ["keyword"], [F.col("id")], limit)


def confidence(scores: DataFrame, least: float = 0.25) -> DataFrame:
    """(query, confidence): 0.60 best + 0.25 share of three scores at `least` + 0.15 margin, in [0, 1]; no row of a query: no row.

    A score that is null or not a number is 0. The two best come from maxima that each task takes before the shuffle: no
    array holds a query's scores.
    """
    known = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0))
    by_score = scores.select("query", known.alias("score")).groupBy("query", "score").agg(F.count("*").alias("k"))
    g = by_score.groupBy("query").agg(F.max("score").alias("s0"), F.max_by("k", "score").alias("top"), F.sum(F.when(F.col("score") >= least, F.col("k")).otherwise(0)).alias("n"), F.sum("k").alias("all"))
    second = top(by_score.select(F.col("query").alias("q"), F.col("score").alias("s1")), ["q"], [F.desc("s1")], 2).filter("rank = 2")
    g = g.join(second, F.col("query").eqNullSafe(F.col("q")), "left")
    margin = F.when(F.col("all") == 1, 0.5 * F.col("s0")).when(F.col("top") > 1, 0.0).otherwise(F.col("s0") - F.col("s1"))
    value = 0.60 * F.col("s0") + 0.25 * F.least(F.col("n") / 3.0, F.lit(1.0)) + 0.15 * margin
    return g.select("query", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("confidence"))


def gate(confident: Column, least: float = GATE) -> Column:
    """R19."""
    return F.when(confident >= least, "pass").otherwise("fallback")
