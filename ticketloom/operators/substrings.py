"""Texts that hold keywords, for any number of keywords: an index of each keyword's rarest gram, then a check of what meets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import bounded_batches, stored
from .textkeys import text_hash

#: Characters of a gram; a shorter keyword is a gram of its own length. Slots of the filter of grams, which is 2 MB.
GRAM, SLOTS = 4, 1 << 24


def gram_hashes(text: str, size: int) -> np.ndarray:
    """64-bit hashes of the distinct grams of `size` characters of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points) - size + 1
    if n < 1:
        return np.empty(0, np.int64)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = (h ^ points[j : n + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def _keyword_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sizes = b["keyword"].str.len().clip(upper=GRAM)
        grams = [gram_hashes(w, n) for w, n in zip(b["keyword"], sizes, strict=True)]
        counts = [len(g) for g in grams]
        yield pd.DataFrame({"kid": np.repeat(b["kid"].to_numpy(), counts), "size": np.repeat(sizes.to_numpy(), counts), "gram": np.concatenate([np.empty(0, np.int64), *grams])})


def _filter(grams: DataFrame) -> Broadcast:
    """Sizes of the grams and a bit for each slot that one of them has: at most SLOTS / 64 rows come to the driver."""
    slot = F.pmod("gram", F.lit(SLOTS))
    words = grams.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(gram, {SLOTS}) % 64 as int))")).alias("bits")).toPandas()
    bits = np.zeros(SLOTS // 64, np.int64)
    bits[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    sizes = [r["size"] for r in grams.select("size").distinct().collect()]  # at most GRAM
    return grams.sparkSession.sparkContext.broadcast((sorted(sizes), bits))


def _asked(text: str, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Grams of a text that pass the filter."""
    grams = np.concatenate([np.empty(0, np.int64), *[gram_hashes(text, n) for n in sizes]])
    slot = grams & (SLOTS - 1)
    return grams[(bits[slot >> 6] >> (slot & 63)) & 1 == 1]


def keyword_join(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword, id) of each text that holds a keyword; texts (id, text), keywords (keyword), of which empty ones find nothing.

    A first pass counts in how many texts each gram of a keyword is; a keyword with a gram that no text has is done. A
    second pass gives the texts of each keyword's rarest gram, and a third checks them. So texts are read three times,
    however many keywords there are, and what is broadcast is a filter of one size. Null texts hold nothing; a row of a
    null or repeated id is a row of its own, and a text that many rows share is looked at once for the second pass.
    """
    bounded_batches(texts.sparkSession)
    distinct = keywords.select("keyword").filter("keyword <> ''").distinct()
    kw = stored(distinct.withColumn("kid", F.monotonically_increasing_id()), "keywords")  # written, so that a number stays
    grams = stored(kw.mapInPandas(_keyword_grams, "kid long, size int, gram long"), "keyword-grams")
    rows = texts.select("id", "text").filter("text <> ''")
    known = _filter(grams)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gram, n = np.unique(np.concatenate([np.empty(0, np.int64), *[_asked(t, *known.value) for t in b["text"]]]), return_counts=True)
            yield pd.DataFrame({"gram": gram, "n": n})

    df = rows.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("df"))
    rarity = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "size", "gram")
    rarest = grams.join(df, "gram", "left").groupBy("kid").agg(F.min(rarity).alias("r")).filter("r.df > 0").select("kid", "r.size", "r.gram")
    rarest = stored(rarest, "rarest-grams")
    known.unpersist()
    chosen = _filter(rarest)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            grams = [_asked(t, *chosen.value) for t in b["text"]]
            yield pd.DataFrame({"key": np.repeat(b["key"].to_numpy(), [len(g) for g in grams]), "gram": np.concatenate([np.empty(0, np.int64), *grams])})

    keyed = rows.withColumn("key", text_hash(F.col("text")))
    postings = keyed.select("key", "text").mapInPandas(find, "key binary, gram long").distinct()
    pairs = stored(postings.join(rarest, "gram").select("key", "kid").join(kw, "kid").select("key", "keyword"), "keyword-pairs")
    chosen.unpersist()
    # Texts meet their keywords by hash; two texts of one hash are both looked at.
    return keyed.join(pairs, "key").filter(F.col("text").contains(F.col("keyword"))).select("keyword", "id")
