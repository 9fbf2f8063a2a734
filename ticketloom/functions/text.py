"""Column functions on text."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def wide_class() -> str:
    """A regex class of wide and full-width characters and seven marks that count alike; the ranges come from Unicode's data."""
    ranges, start = [], None
    for c in range(0x110000):
        wide = not 0xD800 <= c < 0xE000 and (unicodedata.east_asian_width(chr(c)) in "FW" or chr(c) in "“”‘’—…·")
        if wide and start is None:
            start = c
        elif not wide and start is not None:
            ranges.append((start, c - 1))
            start = None
    if start is not None:
        ranges.append((start, 0x10FFFF))
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


#: White space as Unicode has it, with the separators 1C to 1F.
SPACE = "[\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def estimated_tokens(c: Column) -> Column:
    """Wide characters count one each, 3.5 others that aren't blank count one; null and empty count 0.

    The class of wide characters has over a hundred ranges, so it sees only what isn't ASCII.
    """
    ascii_ = F.length(F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), r"[\x{9}-\x{D}\x{1C}-\x{1F}]+|[^\x{0}-\x{7F}]+", ""))
    parts = F.transform(F.array(F.regexp_replace(c, r"[\x{0}-\x{7F}]+", "")), lambda x: F.struct(F.length(x).alias("all"), F.length(F.regexp_replace(x, wide_class(), "")).alias("narrow"), F.length(F.regexp_replace(x, f"{wide_class()}|{SPACE}", "")).alias("rest")))
    n = F.element_at(parts, 1)  # bound once
    return F.coalesce(n["all"] - n["narrow"] + F.ceil((ascii_ + n["rest"]) / F.lit(3.5)), F.lit(0)).cast("long")


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def first_of(c: Column, words: list[str]) -> Column:
    """The first word of the list that the text holds, or null."""
    return F.coalesce(*[F.when(c.contains(w), F.lit(w)) for w in words])


def dedup_key(c: Column) -> Column:
    """Lower case, letters and digits only: the key of exact question-answer dedup."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits; runs of Han characters as single characters and pairs."""
    low = F.lower(c)
    plain = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))
    han = F.regexp_extract_all(low, F.lit(r"[\p{IsHan}]"), F.lit(0))
    pairs = F.regexp_extract_all(low, F.lit(r"(?=([\p{IsHan}]{2}))"), F.lit(1))
    # Most texts hold no Han character: one pass is enough for them.
    return F.when(low.rlike(r"\p{IsHan}"), F.concat(plain, han, pairs)).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def json_body(c: Column) -> Column:
    """A model's answer without its code fence: from the first opening to the last closing bracket."""
    bare = F.regexp_replace(c, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\[.*\]|\{.*\})", 1), F.lit(""))
