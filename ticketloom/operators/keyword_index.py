"""A search index that grows by batches: vectors and postings of changed chunks only, and a record of what is done."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.io import bounded_batches, stored
from ..sources.store import TURNS, KeyedStore, newest
from .retrieval import B, K1, SLACK, bm25_blocks, bm25_search, top
from .textkeys import text_hash

#: words: a chunk's different words, sorted and with a blank between them, as none holds one; tfs: their counts; length: its words in all.
ENTRIES = "id long, hash binary, vector array<double>, length long, words string, tfs array<int>, gone boolean"
DONE = "id long, hash binary, gone boolean"
#: Pairs of query and term, and queries, that a search broadcasts at most; the terms have at most 20 times as many characters as there may be pairs.
ASKED_PAIRS, ASKED = 500_000, 20_000


def index_store(path: str, turns: int = TURNS) -> KeyedStore:
    """Chunks by id with their vectors and words."""
    return KeyedStore(path, ENTRIES, "id", newest("id", gone="gone"), turns)


def done_store(path: str, turns: int = TURNS) -> KeyedStore:
    """Chunks by id that are done, with the hash of the text that was indexed."""
    return KeyedStore(path, DONE, "id", newest("id", gone="gone"), turns)


def counted(words: Column) -> Column:
    """struct<length, words, tfs> of a text's words, counted in its own row: words that are sorted begin anew where they differ from the one before."""
    starts = lambda ws: F.filter(F.transform(ws, lambda w, i: F.when((i == 0) | (w != F.get(ws, i - 1)), i)), lambda i: i.isNotNull())
    # Words, then their starts, are bound once by a function over a one-element array.
    each = F.transform(F.array(F.sort_array(words)), lambda ws: F.struct(ws.alias("ws"), starts(ws).alias("at")))
    tfs = lambda x: F.transform(x["at"], lambda i, j: F.coalesce(F.get(x["at"], j + 1), F.size(x["ws"])) - i)
    return F.element_at(F.transform(each, lambda x: F.struct(F.size(x["ws"]).cast("long").alias("length"), F.array_join(F.array_distinct(x["ws"]), " ").alias("words"), tfs(x).alias("tfs"))), 1)


def entries(chunks: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Index rows of chunks (id, text, hash, gone), made row by row; those that are `gone` have neither vector nor words."""
    made = chunks.withColumn("_vector", embed(F.col("text")).cast("array<double>")).withColumn("_counted", counted(T.terms(F.col("text"))))
    some = lambda c: F.when(~F.col("gone"), F.col(c))
    return made.select("id", some("hash").alias("hash"), some("_vector").alias("vector"), *[some(f"_counted.{c}").alias(c) for c in ("length", "words", "tfs")], "gone")


def sync(batch: DataFrame, index: KeyedStore, done: KeyedStore, embed: Callable[[Column], Column], removed: DataFrame | None = None) -> None:
    """Chunks (id, text) that are new or changed are embedded, put into the index by id, and recorded as done; ids of `removed` (id) leave both.

    Pending is a chunk whose text isn't both in the index and done. A job that failed between the two steps is run again
    with the same rows or others: what the index has already is only recorded, not embedded again. A null id names no
    chunk, a null text is empty, and of rows that repeat an id the one of the greatest text counts. An id in both tables
    is removed.

    Texts are shuffled once, dealt as the index's buckets are and beside the hashes that the index has, and stored
    nowhere. What is recorded as done is read from the index, for the ids of `batch`, which is read a second time for them.
    """
    spark = batch.sparkSession
    bounded_batches(spark)
    ids = lambda rows: rows.select(F.col("id").cast("long").alias("id")).filter("id is not null")
    out = (spark.createDataFrame([], "id long") if removed is None else ids(removed)).distinct()
    held = lambda store: store.read(spark, ["id", "hash", "gone"]).select("id", "hash")
    texts = batch.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).filter("id is not null")
    each = texts.unionByName(held(index), True).unionByName(out.withColumn("gone", F.lit(True)), True)
    rows = index.dealt(each).groupBy("_bucket", "_share", "id").agg(F.max("text").alias("text"), F.max("hash").alias("indexed"), F.coalesce(F.max("gone"), F.lit(False)).alias("gone"))
    rows = rows.withColumn("text", F.when(F.col("gone"), "").otherwise(F.col("text"))).withColumn("hash", text_hash(F.col("text"))).filter("gone or text is not null and not hash <=> indexed")
    index.apply(entries(rows, embed), dealt=True)
    pending = held(index).join(ids(batch).join(out, "id", "left_anti"), "id", "left_semi").join(held(done), ["id", "hash"], "left_anti")
    done.apply(pending.withColumn("gone", F.lit(False)).unionByName(out.select("id", F.lit(None).cast("binary").alias("hash"), F.lit(True).alias("gone"))))


def postings(spark: SparkSession, index: KeyedStore, only: DataFrame | None = None) -> DataFrame:
    """Marked postings (term, doc, tf, dl) as `bm25_index` makes of all texts, from the stored words; `only` (term) leaves out other terms' ones.

    Number, mean length and document counts are taken from them by the search, so they are those of the chunks held now.
    """
    held = index.read(spark, ["id", "length", "words", "tfs", "gone"]).filter("length > 0")
    terms = F.arrays_zip(F.concat(F.split("words", " "), F.array(F.lit(""))).alias("term"), F.concat("tfs", F.array(F.lit(1))).alias("tf"))
    rows = held.select(F.col("id").alias("doc"), F.col("length").alias("dl"), F.explode(terms).alias("t"))
    rows = rows.select("doc", F.col("t.term").alias("term"), F.col("t.tf").cast("long").alias("tf"), "dl")
    return rows if only is None else rows.join(only.select("term").unionByName(spark.createDataFrame([("",)], "term string")).distinct(), "term", "left_semi")


class Asked:
    """The different (query, term) pairs of a search, for tasks: queries and terms by number, and each term's queries."""

    def __init__(self, pairs: pd.DataFrame) -> None:
        q, self.queries = pd.factorize(pairs["query"], sort=True)
        t, terms = pd.factorize(pairs["term"], sort=True)
        self.number = {w: i for i, w in enumerate(terms)}
        self.degree = np.bincount(t, minlength=len(terms))
        self.start = np.cumsum(self.degree) - self.degree
        self.of = q[np.argsort(t, kind="stable")]

    def scores(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores (queries, documents) of documents, each given by its terms' numbers and what each term adds."""
        terms, part = (np.concatenate(x) for x in zip(*parts, strict=True))
        n = self.degree[terms]
        before = np.cumsum(n) - n
        q = self.of[np.arange(n.sum()) - np.repeat(before - self.start[terms], n)]
        doc = np.repeat(np.repeat(np.arange(len(parts)), [len(x) for x, _ in parts]), n)
        return np.bincount(q * len(parts) + doc, np.repeat(part, n), len(self.queries) * len(parts)).reshape(len(self.queries), -1)


class Best:
    """What can be among the best k documents of each query, of those seen so far; equal scores go by document."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least, self.rows, self.new = k, np.zeros(queries), [], 0
        self.room = max(50_000, 2 * queries * k)

    def see(self, docs: np.ndarray, scores: np.ndarray) -> None:
        q, d = np.nonzero((scores > 0) & (scores >= self.least[:, None]))
        self.rows.append((q, docs[d], scores[q, d]))
        self.new += len(q)
        if self.new > self.room:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows below the k-th score leave, with room for rounding, and of exactly equal scores all but the first k."""
        q, d, s = (np.concatenate(x) for x in zip(*self.rows, strict=True)) if self.rows else (np.empty(0, int), np.empty(0, int), np.empty(0))
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        at = np.arange(len(q))
        kth = np.flatnonzero(at - np.searchsorted(q, q) == self.k - 1)
        self.least[q[kth]] = s[kth] - SLACK
        equal = np.maximum.accumulate(np.where(np.r_[True, (q[1:] != q[:-1]) | (s[1:] != s[:-1])][: len(q)], at, 0))
        keep = (s >= self.least[q]) & (at - equal < self.k)
        self.rows, self.new = [(q[keep], d[keep], s[keep])], 0
        return self.rows[0]


def search(spark: SparkSession, index: KeyedStore, terms: DataFrame, k: int = 10, pairs: int = ASKED_PAIRS) -> DataFrame:
    """R2: (query, doc, score, rank) of the best k by BM25 over the chunks held now, exactly; terms (query, term).

    Up to `pairs` pairs of query and term, of at most 20,000 queries, are broadcast: of each chunk the asked words are kept as numbers before its rows
    are merged, and each task scores its chunks against all queries and gives what can be among its best k. So no posting
    is shuffled by its term, and no pair of query and chunk but those. More pairs go by `postings` and blocks.
    """
    terms = terms.select("query", "term").filter("query is not null and term <> ''").distinct()
    n, asked, chars = terms.agg(F.count("*"), F.countDistinct("query"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if n > pairs or asked > ASKED or chars > 20 * pairs:
        terms = stored(terms, "asked")
        return bm25_search(bm25_blocks(stored(postings(spark, index, terms), "postings")), terms, k)
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(Asked(terms.toPandas()))  # at most `pairs` rows
    known = len(sent.value.number)

    @F.pandas_udf("binary")
    def numbered(words: pd.Series, tfs: pd.Series) -> pd.Series:
        """Numbers of the asked words and their counts, as 32-bit integers."""
        of = sent.value.number.get
        rows = (np.array([(i, c) for w, c in zip(ws.split(" "), cs, strict=True) if (i := of(w)) is not None], "<i4") if ws else np.empty(0, "<i4") for ws, cs in zip(words, tfs, strict=True))
        return pd.Series([r.tobytes() for r in rows], dtype=object)

    held = index.read(spark, ["id", "length", numbered("words", "tfs").alias("asked"), "gone"]).filter("length > 0")
    held = stored(held.select("id", "length", "asked"), "asked")
    docs, mean = held.agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(1.0))).first()

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(known, int)
        for b in batches:
            for x in b["asked"]:
                df[np.frombuffer(x, "<i4")[::2]] += 1
        yield pd.DataFrame({"number": np.flatnonzero(df), "df": df[df > 0]})

    df = np.zeros(known)
    for r in held.select("asked").mapInPandas(counts, "number long, df long").groupBy("number").agg(F.sum("df").alias("df")).collect():  # the asked terms
        df[r["number"]] = r["df"]
    idf = spark.sparkContext.broadcast(np.log(1 + (docs - df + 0.5) / (df + 0.5)))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, best = sent.value, Best(len(sent.value.queries), k)
        for b in batches:
            ids, parts, size = [], [], 0
            for i, dl, x in zip(b["id"], b["length"], b["asked"], strict=True):
                t, tf = np.frombuffer(x, "<i4").reshape(-1, 2).T
                if not len(t):
                    continue
                ids.append(i)
                parts.append((t, idf.value[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))))
                size += asked.degree[t].sum()
                if size > 1_000_000 or len(ids) * len(asked.queries) > 2_000_000:  # one chunk meets each pair once at most
                    best.see(np.array(ids), asked.scores(parts))
                    ids, parts, size = [], [], 0
            if parts:
                best.see(np.array(ids), asked.scores(parts))
        q, d, s = best.cut()
        for i in range(0, len(q), 10_000):
            at = slice(i, i + 10_000)
            yield pd.DataFrame({"query": asked.queries[q[at]], "doc": d[at], "score": s[at]})

    found = held.mapInPandas(scored, f"query {dict(terms.dtypes)['query']}, doc long, score double")
    return top(found.withColumn("score", F.round("score", 6)), ["query"], [F.desc("score"), F.col("doc")], k)
