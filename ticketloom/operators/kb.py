"""Knowledge-base build: splitting documents into linked chunks, composing texts, embedding, the pending-to-done life cycle."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import CLOSING, KEY_CLAUSES, SENTENCE_ENDS
from ..sources.io import bounded_batches
from .mining import numbered
from .retrieval import bm25_index

#: Parameters: characters of a chunk and of the overlap, the category of text without heading, how far a cut is moved.
CHUNK, OVERLAP, NO_CATEGORY, ALIGN = 500, 80, "未分类", 40
CHUNK_SCHEMA = "category string, questions string, answer string, section_path string, content_type string, is_key_clause boolean, order_index int"

_end = re.compile(f"(?:[{re.escape(SENTENCE_ENDS)}]|(?<![0-9])\\.|\\.(?![0-9]))[{re.escape(CLOSING)}]*")
# How a heading, a question, its answer and a cell of the rule below a table's header are written.
_heading = re.compile(r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*$").match
_question = re.compile(r"^\s*(?:问|Q|q)[：:]\s*(.+)$").match
_answer = re.compile(r"^\s*(?:答|A|a)[：:]\s*(.+)$").match
_rule_cell = re.compile(r"^:?-+:?$").match


def boundaries(text: str) -> list[int]:
    """K2: where sentences end, closing quotes and brackets included; a point between digits ends none."""
    return [m.end() for m in _end.finditer(text)]


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """K3: chunks of whole sentences; each next one begins at the sentence end nearest to `overlap` characters back."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    ends, out, start = boundaries(text), [], 0
    while len(text) - start > size:
        k = bisect_right(ends, start + size)
        if k and ends[k - 1] > start:
            stop = ends[k - 1]
        else:
            stop = ends[k] if k < len(ends) else start + size
        out.append(text[start:stop].strip())
        if stop >= len(text):
            start = len(text)
            break
        low, high = bisect_right(ends, start), bisect_left(ends, stop)
        back = stop
        if overlap > 0 and low < high:
            at = bisect_left(ends, stop - overlap, low, high)
            near = [ends[i] for i in (at - 1, at) if low <= i < high]
            back = min(near, key=lambda b: abs(b - (stop - overlap)))
        while back < len(text) and text[back] in " \t\n\r":
            back += 1
        start = back if back > start else stop
    out.append(text[start:].strip())
    return [c for c in out if c]


def _by_number(numbers: Iterable[int], lines: list) -> Iterator[tuple[int, list]]:
    """Neighbouring lines of one number."""
    for number, run in groupby(zip(numbers, lines, strict=True), key=lambda x: x[0]):
        yield number, [line for _, line in run]


def table_chunks(header: str, rule: str, rows: list[str], size: int = CHUNK) -> list[str]:
    """K4: rows packed greedily, header and rule repeated in each chunk; a row that alone is too long has a chunk of its own."""
    head = f"{header}\n{rule}"

    def place(last: tuple[int, int], row: str) -> tuple[int, int]:
        chunk, used = last
        more = len(row) + 1
        return (chunk + 1, len(head) + more) if used > len(head) and used + more > size else (chunk, used + more)

    places = list(accumulate(rows, place, initial=(0, len(head))))[1:]
    return ["\n".join([head, *run]) for _, run in _by_number((c for c, _ in places), rows)] or [head]


def faq_pairs(lines: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """K5: (lines before the first question, question-answer pairs): each question begins a group of lines."""
    asked = [_question(line) for line in lines]
    groups = dict(_by_number(accumulate(bool(q) for q in asked), list(zip(asked, lines, strict=True))))
    intro = [line for _, line in groups.pop(0, [])]
    said = lambda line: a[1].strip() if (a := _answer(line)) else line
    return intro, [(own[0][0][1].strip(), "\n".join(said(line) for _, line in own[1:]).strip()) for own in groups.values()]


def _sections(text: str) -> Iterator[tuple[list[str], list[str]]]:
    """(titles from the outermost, lines) of each stretch under a heading that holds text; headings in fences are text."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    fences = accumulate((line.strip().startswith(("```", "~~~")) for line in lines), initial=0)
    heads = [None if n % 2 else _heading(line) for n, line in zip(fences, lines)]  # noqa: B905
    titles: dict[int, str] = {}  # by level
    for _, own in _by_number(accumulate(bool(h) for h in heads), list(zip(heads, lines, strict=True))):
        head = own[0][0]
        if head:
            level = len(head[1])
            titles = {k: t for k, t in titles.items() if k < level} | {level: head[2].strip()}
        body = [line for h, line in own if not h]
        if any(map(str.strip, body)):
            yield list(titles.values()), body


def _is_rule(line: str) -> bool:
    line = line.strip()
    return "|" in line and all(_rule_cell(c.strip()) for c in line.strip("|").split("|"))


def _blocks(lines: list[str], size: int) -> Iterator[list[str]]:
    """Tables and the text between them, cut into chunks. A table is the rest of a run of lines with bars from the one above a rule."""
    text: list[str] = []
    for barred, run in groupby(lines, key=lambda line: "|" in line):
        own = list(run)
        at = next((i for i in range(len(own) - 1) if _is_rule(own[i + 1])), None) if barred else None
        text += own[:at]
        if at is not None:
            yield chunks("\n".join(text), size)
            text = []
            yield table_chunks(*(x.strip() for x in own[at : at + 2]), [x.strip() for x in own[at + 2 :]], size)
    yield chunks("\n".join(text), size)


def split_markdown(text: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple]:
    """K1: rows of CHUNK_SCHEMA for a document: its sections' FAQ pairs, tables and paragraphs."""
    if not text or not text.strip():
        return []
    out: list[tuple] = []
    for titles, lines in _sections(text):
        path = " > ".join(titles) or None
        category = " > ".join(titles[:-1]) or (titles[0] if titles else NO_CATEGORY)
        title = titles[-1] if titles else "正文"
        intro, pairs = faq_pairs(lines)
        if pairs:
            found = [(title, c, "policy") for c in chunks("\n".join(intro), size, overlap)]
            found += [(q, c, "faq") for q, a in pairs for c in (chunks(a, size, overlap) or [a])]
        elif q := _question(title):
            body = "\n".join(lines).strip()
            a = _answer(body)
            found = [(q[1].strip(), c, "faq") for c in chunks(a[1].strip() if a else body, size, overlap)]
        else:
            found = [(title, c, "policy") for block in _blocks(lines, size) for c in block]
        out += [(category, q, c, path, kind, any(k in f"{q} {c}" for k in KEY_CLAUSES)) for q, c, kind in found]
    return [(*row, i) for i, row in enumerate(out)]


def split_documents(docs: DataFrame, doc: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """K1 over a table: (doc, chunk columns, prev_index, next_index); a document is a row, so its chunks are linked without a shuffle (K8)."""
    kind = dict(docs.dtypes)[doc]
    bounded_batches(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        for p in parts:
            rows = []
            for d, t in zip(p["doc"], p["t"], strict=True):
                got = split_markdown(t, size, overlap)
                rows += [(d, *r, r[-1] - 1 if r[-1] else None, r[-1] + 1 if r[-1] + 1 < len(got) else None) for r in got]
            out = pd.DataFrame(rows, columns=["doc", *names, "prev_index", "next_index"])
            yield out.astype({"prev_index": "Int32", "next_index": "Int32"})

    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("t")).mapInPandas(run, f"doc {kind}, {CHUNK_SCHEMA}, prev_index int, next_index int")


def sentence_chunks(docs: DataFrame, doc: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """K3 over a table: (doc, place, chunk)."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunks(t or "", size, overlap))

    return docs.select(F.col(doc).alias("doc"), F.posexplode(cut(F.col(text))).alias("place", "chunk"))


def sentence_ends(c: Column) -> Column:
    """K2 in SQL functions: the sentence ends of a text, ascending, by the lengths of what stands between them."""
    pattern = f"(?:[{SENTENCE_ENDS}]|(?<![0-9])\\.|\\.(?![0-9]))[{CLOSING.replace(']', chr(92) + ']')}]*"
    hits, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
    return running_sums(sizes)


def running_sums(sizes: Column, chunk: int = 64) -> Column:
    """Sums of an array of ints up to each place, in chunks: adding to an array copies it, so each sum is made from its chunk's slice and the chunks before."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  what a function's argument is bound to is computed once

    def cut(s: Column) -> Column:
        numbers = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.floor((F.size(s) - 1) / chunk).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(numbers, lambda k: F.slice(s, k * chunk + 1, F.lit(chunk)))

    def sums(x: Column) -> Column:
        own = lambda q, k: once(total(F.slice(x["wholes"], F.lit(1), k)), lambda base: F.transform(q, lambda _, i: base + total(F.slice(q, F.lit(1), i + 1))))
        return F.flatten(F.transform(x["parts"], own))

    return once(once(once(sizes, cut), lambda p: F.struct(p.alias("parts"), F.transform(p, total).alias("wholes"))), sums)


def aligned(c: Column, target: Column, window: int = ALIGN) -> Column:
    """K7: the sentence end nearest to `target`, at the window's width first (the earlier on a tie); without one, the target itself."""
    near = F.transform(sentence_ends(c), lambda b: F.struct((F.abs(b - target) > window).alias("far"), F.abs(b - target).alias("d"), b.alias("b")))
    return F.coalesce(F.array_min(near)["b"], F.least(target, F.length(c)))


def key_clause(questions: Column, answer: Column) -> Column:
    """K6."""
    return T.contains_any(F.concat_ws(" ", F.coalesce(questions, F.lit("")), F.coalesce(answer, F.lit(""))), KEY_CLAUSES)


def linked(rows: DataFrame, doc: str, order: str, first_id: int = 1) -> DataFrame:
    """K8: ids in order of (document, place) and links to the neighbours within a document.

    Ids come from a sort by ranges and each range's offset; the neighbours' documents come by their ids, so neither
    all rows nor those of one document are in one task.
    """
    n = numbered(rows, [doc, order], "_at").withColumn("id", F.col("_at") + first_id).drop("_at")
    before = n.select((F.col("id") + 1).alias("id"), F.col(doc).alias("_doc_before"), F.lit(True).alias("_is_before"))
    after = n.select((F.col("id") - 1).alias("id"), F.col(doc).alias("_doc_after"), F.lit(True).alias("_is_after"))
    out = n.join(before, "id", "left").join(after, "id", "left")
    near = lambda side, at: F.when(F.col(f"_is_{side}") & F.col(f"_doc_{side}").eqNullSafe(F.col(doc)), at)
    return out.select("id", *rows.columns, near("before", F.col("id") - 1).alias("prev_chunk_id"), near("after", F.col("id") + 1).alias("next_chunk_id"))


def embedding_text(category: Column, questions: Column, answer: Column) -> Column:
    """K9: what is embedded."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("分类："), blank(category), F.lit("\n问题："), blank(questions), F.lit("\n内容："), blank(answer))


def index_text(category: Column, questions: Column, answer: Column) -> Column:
    """K9: what is indexed."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("【类目】"), blank(category), F.lit("【标准问法】"), blank(questions), F.lit("【解答】"), blank(answer))


def hashed_vector(text: str, size: int = 1024) -> np.ndarray:
    """The stand-in encoder: normal noise seeded by the first four MD5 bytes."""
    seed = int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "little")
    v = np.random.RandomState(seed).standard_normal(size)
    return v / np.linalg.norm(v)


_word = re.compile(r"[^\W_]+").findall


@lru_cache(1 << 18)
def _term_place(term: str) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:4], 16)


def term_vector(text: str, size: int = 64) -> np.ndarray:
    """Another encoder: how often a text's words occur, at places given by the first four hex digits of their MD5."""
    v = np.zeros(size)
    for w, n in Counter(_word(text.lower())).items():
        v[_term_place(w) % size] += n
    return v


def embedder(encode: Callable[[str], np.ndarray] = hashed_vector, kind: str = "float") -> Callable[[Column], Column]:
    """A column function text -> unit vector; an encoder's rows of vectors are averaged to one."""

    @F.pandas_udf(f"array<{kind}>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            made = (np.asarray(encode(t or ""), float) for t in s)
            flat = (v.reshape(-1, v.shape[-1]).mean(axis=0) for v in made)
            yield pd.Series([(v / (np.linalg.norm(v) or 1.0)).astype("float32" if kind == "float" else "float64") for v in flat])

    return embed


def embed_pending(store: DataFrame, embed: Callable[[Column], Column], text: Column) -> DataFrame:
    """The rows still pending, embedded and done: a batch for `upsert`; a rerun finds only what is left."""
    return store.filter("vectorize_status = 'pending'").withColumn("vector", embed(text)).withColumn("vector_id", F.col("id").cast("string")).withColumn("vectorize_status", F.lit("done"))


def reindex(store: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """All chunks with index text and vector, for an overwrite."""
    text = index_text(F.col("category"), F.col("questions"), F.col("answer"))
    return store.select("id", text.alias("chunk_text"), embed(text).alias("vector"))


def rebuilt(store: DataFrame, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(all chunks with index text and vector, the postings of their index texts): what a full reindex writes."""
    rows = reindex(store, embed)
    return rows, bm25_index(rows, "id", "chunk_text")


def stats(store: DataFrame, index: DataFrame) -> DataFrame:
    """One row: chunks by status, rows of the index, and whether both agree."""
    n = lambda s: F.count_if(F.col("vectorize_status") == s).cast("long").alias(s)
    return store.agg(F.count("*").alias("total"), n("done"), n("pending"), n("failed")).crossJoin(index.agg(F.count("*").alias("indexed"))).withColumn("aligned", F.col("done") == F.col("indexed"))


def browse(store: DataFrame, status: str | None = None, category: str | None = None, holds: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of chunks, newest first, each with the total of all pages; a substring is looked for in question, answer and path.

    A page beyond the last has no rows and so no total; `browse_total` has it alone.
    """
    found = _browsed(store, status, category, holds)
    return found.orderBy(F.desc("id")).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(browse_total(store, status, category, holds)))  # one row


def _browsed(store: DataFrame, status: str | None, category: str | None, holds: str | None) -> DataFrame:
    for c, v in (("vectorize_status", status), ("category", category)):
        store = store.filter(F.col(c) == v) if v else store
    each = [F.coalesce(F.col(c).contains(holds), F.lit(False)) for c in ("questions", "answer", "section_path")] if holds else []
    return store.filter(each[0] | each[1] | each[2]) if each else store


def browse_total(store: DataFrame, status: str | None = None, category: str | None = None, holds: str | None = None) -> DataFrame:
    """One row: the chunks of all pages."""
    return _browsed(store, status, category, holds).agg(F.count("*").alias("total"))


def with_category(rows: DataFrame, category: str | None) -> DataFrame:
    """The given category where a chunk has none of its own."""
    own = F.col("category").isNotNull() & ~F.col("category").isin("", NO_CATEGORY)
    return rows.withColumn("category", F.when(own | F.lit(not category), F.col("category")).otherwise(F.lit(category)))


def direct_entry(rows: DataFrame, doc: str, order: str, synced: bool, first_id: int = 1) -> DataFrame:
    """Entered chunks with ids from first_id: done and linked if they went to the index at once, else pending, without links and vector."""
    if synced:
        return linked(rows, doc, order, first_id).withColumn("vectorize_status", F.lit("done")).withColumn("vector_id", F.col("id").cast("string"))
    none = F.lit(None).cast("long")
    entered = numbered(rows, [doc, order], "_at").withColumn("id", F.col("_at") + first_id).drop("_at")
    return entered.withColumn("vectorize_status", F.lit("pending")).withColumn("vector_id", F.lit(None).cast("string")).withColumn("prev_chunk_id", none).withColumn("next_chunk_id", none)
