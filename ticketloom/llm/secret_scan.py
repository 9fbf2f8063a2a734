"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regex yields a Boolean query over trigrams (lower case) that every match must contain. The index holds
postings (trigram, doc_id) of the trigrams that some query names; intersecting a document's postings leaves candidates,
whose whole texts the regex verifies. A rule without mandatory trigrams scans all texts.

Cases: null and empty texts have no span; a null doc_id isn't indexed, so its text is verified against all rules; rows
that share a doc_id share postings and are verified one by one; a repeated row is scanned once per row; spans that start
alike are ordered by kind; an empty table gives no row. Other columns of the input, whatever their names, are ignored by
`scan` and kept by `redacted`.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int  # the group whose length counts
    least: int
    base: bool


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The base rules in their order, then those that this method adds.
RULES = (
    Rule("assign", "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", "[0-9a-f]+", 0, 32, True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40, False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, False),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
)
_WIDEST = 64  # strings that one stretch of a pattern may stand for


def _strings(nodes: list) -> list[set[str] | None]:
    """The stretches of a parsed pattern: the strings each may match, None between stretches."""
    out: list[set[str] | None] = [{""}]

    def add(some: set[str] | None) -> None:
        if some is None:
            out.extend([None, {""}])
        elif len(out[-1]) * len(some) > _WIDEST:
            out.extend([None, some])
        else:
            out[-1] = {a + b for a, b in product(out[-1], some)}

    for op, value in nodes:
        if op is sre.LITERAL:
            add({chr(value).lower()})
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value):
            add({chr(v).lower() for _, v in value})
        elif op is sre.SUBPATTERN:
            inner = _strings(list(value[3]))
            for k, s in enumerate(inner):
                add(s) if s is None or k == 0 or s != {""} else None
        elif op is sre.BRANCH:
            ways = [_strings(list(b)) for b in value[1]]
            add(set().union(*(w[0] for w in ways)) if all(len(w) == 1 for w in ways) else None)
        elif op is sre.MAX_REPEAT and value[1] == 1 and value[0] == 0:
            inner = _strings(list(value[2]))
            add(inner[0] | {""} if len(inner) == 1 else None)
        else:
            add(None)
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of ORs of sets of trigrams, all of a set's being needed; empty if no trigram is mandatory."""
    query = []
    for some in _strings(list(sre_parser.parse(pattern))):
        if some and all(len(s) >= 3 for s in some):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in some}
            query.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))
    return query


def postings(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram: its place in `trigrams`, doc_id) for each trigram that a text holds, in either case."""
    low = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("low"))
    # Projections of their own: inside the generator the lower-case text would be made anew for each trigram. An outer
    # explode, as Spark would filter by the whole array before an inner one, making all of it twice.
    held = low.select("doc_id", F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(i)) for i, t in enumerate(trigrams)])).alias("held"))
    return held.select("doc_id", F.explode_outer("held").alias("trigram")).filter("trigram is not null")


def candidates(index: DataFrame, trigrams: list[str], rules: list[Rule]) -> DataFrame:
    """(doc_id, may_<kind>) of documents whose postings meet some rule's query."""
    place = {t: i for i, t in enumerate(trigrams)}
    bits = F.bit_or(F.expr("shiftleft(1L, trigram)")).alias("held")

    def met(rule: Rule) -> Column:
        masks = [[sum(1 << place[t] for t in s) for s in ways] for ways in trigram_query(rule.pattern)]
        return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.col("held").bitwiseAND(F.lit(m)) == m for m in ways]) for ways in masks])

    flags = [met(r).alias(f"may_{r.kind}") for r in rules]
    found = index.groupBy("doc_id").agg(bits).select("doc_id", *flags)
    return found.filter(reduce(lambda a, b: a | b, [F.col(f"may_{r.kind}") for r in rules]))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, place, end>> of a rule's matches, leftmost and non-overlapping, in code points."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    gaps = F.split(text, rule.pattern, -1)  # what stands before, between and behind the matches
    each = F.arrays_zip(
        F.transform(F.slice(gaps, 1, F.size(hits)), lambda g: F.length(g)).alias("gap"),
        F.transform(hits, lambda h: F.length(h)).alias("size"),
        F.transform(held, lambda h: F.length(h)).alias("counts"),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,place:int,end:int>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + x["size"]
        one = F.array(F.struct(a.alias("start"), F.lit(order).alias("place"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(x["counts"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(each, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return _verify(rows).select("doc_id", *_digest())


def _verify(rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, text, more) with the column `found`: all spans by start, then kind."""
    indexed = [r for r in RULES if trigram_query(r.pattern)]
    trigrams = sorted({t for r in indexed for ways in trigram_query(r.pattern) for s in ways for t in s})
    # Candidates are few and narrow. They are written first, so that Spark knows their size before it plans the join: below
    # its own limit it broadcasts them and no text is shuffled, beyond it both sides are.
    may = table(candidates(postings(rows, trigrams), trigrams, indexed), "candidates")
    both = rows.join(may, "doc_id", "left")
    none = F.expr("cast(array() as array<struct<start:int,place:int,end:int>>)")
    found = []
    for k, r in enumerate(RULES):
        if r in indexed:
            test = F.coalesce(F.col(f"may_{r.kind}"), F.col("doc_id").isNull())
        else:
            test = F.col("text").rlike(f"(?:{r.pattern.removesuffix('+')}){{{r.least}}}")
        found.append(F.when(test, _spans(F.col("text"), r, k)).otherwise(none))
    return both.withColumn("found", F.array_sort(F.concat(*found))).drop(*(f"may_{r.kind}" for r in indexed))


def _digest() -> list[Column]:
    names = F.array(*[F.lit(r.kind) for r in RULES])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["place"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["place"] == k)).cast("long")
    base = sum(r.base for r in RULES)
    return [
        *(count(k).alias(f"n_{RULES[k].kind}") for k in range(base)),
        F.sha2(said(F.filter("found", lambda s: s["place"] < base)), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"),
    ]


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with `mark` in place of every span (overlapping spans: one mark), all columns and rows kept."""
    names = docs.columns
    packed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*[F.col(n) for n in names]).alias("row"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    clean = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    changed = F.when(F.size("found") > 0, clean).otherwise(F.col(f"row.{text}"))
    return _verify(packed).select(*[changed.alias(n) if n == text else F.col(f"row.{n}").alias(n) for n in names])
