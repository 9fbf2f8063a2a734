"""Audit of how sources of a language differ in their words: integer chi-square-like divergences, exact.

Each task runs an Arrow compute pipeline over its texts (ascii_lower, split_pattern_regex, dictionary_encode, hash
group_by) and returns partial counts of (lang, source, term), from hundreds of texts at once. Partial counts meet by
(lang, term), so that one shuffle serves the sums by source, the documents that hold a term, and the language's own
counts. What is kept is written as shards of terms; a shard's counts are a matrix of terms and sources, of which numpy
sums every pair of sources, and the sums of all shards are added up.

Arithmetic: shares are computed as decimals in Spark, as 1000000000 * (count + 1) passes 64 bits; a share is at most
1000000001, so the products of shares are exact in 64 bits, and so are the sums.

Cases: null text, lang and source are ''; a text without letters has no term, but its (lang, source) group stands in the
result; a language without kept terms has pairs of value 0 and no terms; a language with one source has no pairs; a
repeated row counts as a document of its own; ties are ranked by the item's UTF-8 bytes; an empty table gives no row.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_rows, table

#: Parameters: documents that a term of a language needs, terms reported of a group, characters of text counted at once,
#: rows of a shard on average, cells of a shard's matrix held at once.
LEAST_DOCS, TERMS, BLOCK_CHARS, SHARD_ROWS, CELLS = 3, 200, 16 << 20, 100_000, 1 << 20
#: What stands between terms: all of ASCII but letters.
GAPS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_KEYS = ["lang", "source", "term"]


def _count(t: pa.Table) -> pa.Table:
    """(lang, source, term, n, docs) of a table (lang, source, text)."""
    words = pc.split_pattern_regex(pc.ascii_lower(t["text"].combine_chunks()), GAPS)
    of, term = pc.list_parent_indices(words), pc.list_flatten(words)
    some = pc.not_equal(term, "")
    of, term = of.filter(some), term.filter(some)
    by_doc = pa.table({"doc": of, "term": term.dictionary_encode()}).group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
    group = pa.table({k: t[k].combine_chunks().dictionary_encode().take(by_doc["doc"]) for k in ("lang", "source")})
    each = group.append_column("term", by_doc["term"]).append_column("n", by_doc["count_all"])
    return _merged(each.append_column("docs", pa.array(np.ones(len(each), np.int64))))


def _merged(t: pa.Table) -> pa.Table:
    out = t.group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*_KEYS, "n", "docs"])
    return out.cast(pa.schema([(k, pa.string()) for k in _KEYS] + [("n", pa.int64()), ("docs", pa.int64())]))


def partial_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", block: int = BLOCK_CHARS) -> DataFrame:
    """(lang, source, term, n, docs): counts of parts of the documents, which add up."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for p in parts:
            held.append(p)
            if sum(b.nbytes for b in held) >= block:
                yield from _count(pa.Table.from_batches(held)).to_batches(max_chunksize=100_000)
                held = []
        if held:
            yield from _count(pa.Table.from_batches(held)).to_batches(max_chunksize=100_000)

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"), (text, "text"))))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(1000000000 * (count + 1) / (total + terms))."""
    return F.expr(f"1 + (1000000000 * cast({count} + 1 as decimal(20, 0))) div cast({total} + {terms} as decimal(20, 0))")


def _pairs(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Of one shard of a language: for every pair of sources, f summed over the shard's terms."""
    names = groups["source"].to_pylist()
    total, v = np.array(groups["total"].to_pylist(), object), groups["v"][0].as_py()
    out = np.zeros((len(names), len(names)), np.int64)
    if len(counts):
        at = {s: i for i, s in enumerate(names)}
        col = np.array([at[s] for s in counts["source"].to_pylist()])
        _, row = np.unique(np.array(counts["term"].to_pylist(), object), return_inverse=True)
        p = np.array(counts["p"].to_pylist(), np.int64)
        none = np.array([1 + 1_000_000_000 // (n + v) for n in total], np.int64)  # the share of a term that a source hasn't
        order = np.argsort(row, kind="stable")
        row, col, p = row[order], col[order], p[order]
        step = max(1, CELLS // len(names))
        for first in range(0, int(row[-1]) + 1, step):
            i, j = np.searchsorted(row, [first, first + step])
            share = np.tile(none, (min(step, int(row[-1]) + 1 - first), 1))
            share[row[i:j] - first, col[i:j]] = p[i:j]
            for s in range(len(names)):
                d = share[:, s, None] - share
                out[s] += (d * d // share).sum(axis=0)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    lang = groups["lang"][0].as_py()
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": pa.array([names[i] for i in a], pa.string()), "item": pa.array([names[i] for i in b], pa.string()), "value": out[a, b]})


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item"))))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, terms: int = TERMS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source, part `term` the terms that a source overuses."""
    blank = lambda c, k: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k)
    with batch_rows(docs.sparkSession, 256):
        met = partial_counts(docs, text, lang, source).repartition("lang", "term")
        sums = met.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        own = W.partitionBy("lang", "term")
        kept = sums.withColumn("d", F.sum("docs").over(own)).withColumn("lang_n", F.sum("n").over(own)).filter(F.col("d") >= least_docs)
        kept = table(kept.select("lang", "term", "source", "n", "lang_n"), "term-counts")
    # One row for each language, and one for each group, whether it has kept terms or not.
    langs = kept.groupBy("lang", "term").agg(F.count("*").alias("rows"), F.first("lang_n").alias("c")).groupBy("lang")
    langs = langs.agg(F.count("*").alias("v"), F.sum("c").alias("lang_total"), F.sum("rows").alias("rows"))
    every = docs.select(blank(lang, "lang"), blank(source, "source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = {"total": 0, "v": 0, "lang_total": 0, "rows": 0}
    groups = table(every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(zero).withColumn("shards", F.ceil((F.col("rows") + 1) / shard_rows)), "groups")

    shares = kept.join(groups.select("lang", "source", "total", "v", "lang_total", "shards"), ["lang", "source"]).withColumn("p", _share("n", "total", "v"))
    over = shares.withColumn("q", _share("lang_n", "lang_total", "v")).filter("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

    of = shares.select("lang", "source", "term", "p", F.expr("pmod(xxhash64(term), shards)").alias("shard"))
    by = groups.select("lang", "source", "total", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    pairs = by.groupBy("lang", "shard").cogroup(of.groupBy("lang", "shard")).applyInArrow(lambda g, c: _pairs(c, g), "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return _ranked(pairs).unionByName(_ranked(over).filter(F.col("rank") <= terms))
