"""Language identification by compression: the zstandard dictionary that shrinks a text most names its language.

Cases: null or letterless text gives `und` with score 0, rejected; a text whose two best languages differ by less than
`min_margin` keeps its best guess but is rejected; ties go to the alphabetically first language; a repeated row is
scored once per row; a null id counts as empty text for holding out; without training rows every text is `und`; an empty
table gives no row. Other columns of the input, whatever their names, are ignored by `identify` and kept by `accepted`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table

UNKNOWN = "und"
#: Parameters: labelled rows that a language is learned from at most, bytes that each of them gives and bytes of a piece
#: of those (so a dictionary has SAMPLE_TEXTS * EXCERPT bytes at most), compression level, bytes compressed at a time, least relative margin, dictionaries
#: sent to the tasks at once.
SAMPLE_TEXTS, EXCERPT, PIECE, LEVEL, CHUNK, MIN_MARGIN, SENT = 80, 1280, 320, 6, 2048, 0.004, 500
#: zstandard takes a dictionary of 8 bytes or more.
_LEAST_BYTES = 8
_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-case letters with single spaces between."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves remainder 2 by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def excerpt(text: bytes, room: int = EXCERPT, piece: int = PIECE) -> bytes:
    """The text, or pieces of it from its beginning to its end at equal distances; a piece may begin within a character."""
    if len(text) <= room:
        return text
    n = max(2, room // piece)
    return b"".join(text[at : at + piece] for at in ((len(text) - piece) * i // (n - 1) for i in range(n)))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary of raw content for each language, from SAMPLE_TEXTS hash-picked rows that are not held out.

    The bound is on labelled rows: of each, the whole text is read, and a long one gives pieces from all over it; all that
    they give is the dictionary. A language whose rows give less than 8 bytes has none and is never predicted.
    """
    bounded_batches(docs.sparkSession)
    train = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.col(lang).alias("l"), held_out(doc_id).alias("out"))
    train = train.filter("not out and l is not null and t is not null").withColumn("h", F.xxhash64("id", F.lit(7)))
    # One text for each salt: a partial minimum of hashes, so a hot language doesn't gather in one task.
    picked = train.groupBy("l", F.expr(f"pmod(xxhash64(id, 42), {SAMPLE_TEXTS})").alias("salt")).agg(F.min("h").alias("h"))

    @F.pandas_udf("binary")
    def cut(t: pd.Series) -> pd.Series:
        return t.map(lambda x: excerpt(plain(x)))

    rows = train.join(F.broadcast(picked.select("l", "h")), ["l", "h"]).select("l", "h", cut("t").alias("d"))
    rows = rows.groupBy("l", "h").agg(F.min("d").alias("d")).collect()  # rows of one id: the least; EXCERPT bytes of SAMPLE_TEXTS rows a language
    content: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["l"], r["h"])):
        content.setdefault(r["l"], []).append(bytes(r["d"]))
    return {k: d for k, v in content.items() if len(d := b"".join(v)) >= _LEAST_BYTES}


def sizes(dictionaries: dict[str, bytes]) -> Callable[[str | None], list[tuple[int, str]]]:
    """text -> (compressed size, language) of the two smallest, the alphabetically first on a tie; none for a text without letters."""
    packers = []
    for name in sorted(dictionaries):
        d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        packers.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)))

    def measure(text: str | None) -> list[tuple[int, str]]:
        if not text or not any(map(str.isalpha, text)):
            return []
        b = plain(text)
        parts = [b[i : i + CHUNK] for i in range(0, len(b), CHUNK)]
        return sorted((sum(len(p.compress(x)) for x in parts), k) for k, p in packers)[:2]

    return measure


def decided(best: list[tuple[int, str]]) -> tuple[str, float, float]:
    """(language, score 0 to 1, relative margin between the two smallest sizes)."""
    if not best:
        return UNKNOWN, 0.0, 0.0
    first, second = best[0][0], best[1][0] if len(best) > 1 else best[0][0] * 2
    return best[0][1], second / (first + second), (second - first) / second


def _groups(dictionaries: dict[str, bytes]) -> list[dict[str, bytes]]:
    names = sorted(dictionaries)
    return [{k: dictionaries[k] for k in names[i : i + SENT]} for i in range(0, len(names), SENT)] or [{}]


_TWO = "array<struct<size:bigint,lang:string>>"


def _best(seen: list, more: list[tuple[int, str]]) -> list[tuple[int, str]]:
    return sorted([*((x["size"], x["lang"]) for x in seen), *more])[:2]


def _smallest(model: Broadcast) -> Callable[[Column, Column], Column]:
    """A column function (text, smallest sizes so far) -> smallest sizes with the model's languages."""

    @F.pandas_udf(_TWO)
    def smallest(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        measure = sizes(model.value)
        for t, seen in parts:
            yield pd.Series([[{"size": n, "lang": k} for n, k in _best(s, measure(x))] for x, s in zip(t, seen, strict=True)], dtype=object)

    return smallest


def classified(docs: DataFrame, dictionaries: dict[str, bytes], text: str) -> tuple[DataFrame, str]:
    """`docs` with a column (its name is returned) struct<lang_pred, score, margin>.

    Each group of SENT languages is a pass that keeps the two smallest sizes so far, so any number of languages is exact
    while tasks hold the dictionaries of one group: passes before the last are written.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    name = "language"
    while name in map(str.lower, docs.columns):
        name += "_"
    *groups, last = _groups(dictionaries)
    out = docs.withColumn(name, F.expr(f"cast(array() as {_TWO})"))
    for group in groups:
        out = table(out.withColumn(name, _smallest(spark.sparkContext.broadcast(group))(F.col(text), F.col(name))), "languages")
    model = spark.sparkContext.broadcast(last)

    @F.pandas_udf("lang_pred string, score double, margin double")
    def said(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        measure = sizes(model.value)
        for t, seen in parts:
            yield pd.DataFrame([decided(_best(s, measure(x))) for x, s in zip(t, seen, strict=True)], columns=["lang_pred", "score", "margin"])

    return out.withColumn(name, said(F.col(text), F.col(name))), name


def identify(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, rejected) of each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("t"))
    got, name = classified(rows, dictionaries, "t")
    rejected = (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < min_margin)
    return got.select("doc_id", "held_out", f"{name}.*").withColumn("rejected", rejected)


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of `docs`, all columns kept, whose language is clear."""
    got, name = classified(docs, dictionaries, text)
    return got.filter((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.margin") >= min_margin)).drop(name)
