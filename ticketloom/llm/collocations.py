"""Collocations by dynamic itemset counting: phrases of two and three words that stand together more often than by chance.

The documents are cut into shards, which are scanned in a cycle. Lengths are interleaved: words are counted from the first
shard on; a phrase becomes active with the step after that in which both of its subphrases (all but its last word, all but
its first) have been found often enough, and is counted for one full cycle from there, so that each shard counts once for
it. As a phrase is never more frequent than its subphrases, no frequent phrase stays inactive. The scans end when no
active phrase is left.

Which step a subphrase was found often enough in is told to the tasks by a table of fixed size, as in a Bloom filter: a
frequent phrase writes its step into the cells of its hashes that are empty, and the step of any phrase is the latest of
its cells and its subphrases' steps. Cells are never changed again, so that every task at every time derives the same activation from it. Cells
that phrases share can only make a phrase active early, or one that needn't be: its count is then of another full cycle,
and as exact. So the table's size bounds what is sent and decides on speed, never on results.

Texts are split into words once: blocks of a shard are kept as numbers of words, which all scans read. Counts are packed by
ranges of the phrases' hashes: a task packs what it counted into a row for each length, step of activation and range, and
such a row is added to what it had from earlier steps. After a phrase's cycle its count is whole, so it goes no further and,
if it isn't frequent, is dropped. Phrases are told apart by their words, never by hashes.

Cases: null text is empty and null lang `und`; ties are ranked by count, then by the phrase's bytes; repeated rows count
once per row; fewer documents than shards leave shards empty; an empty table gives no row. Words hold no space, so phrases
joined by spaces are told apart. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import count as steps_from

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_rows, new_path, table
from .hashing import _BASE, mixed
from .lm_score import _range, packed, unpacked

#: Parameters: words of a phrase, occurrences that make one frequent, share of a longer phrase that drops a shorter one (in
#: hundredths), phrases reported of a language; shards, words counted at once, cells and hashes of the table of steps,
#: bytes of the texts behind a range.
LONGEST, LEAST, CONTAINED, TOP, SHARDS, BLOCK_WORDS, CELLS, PROBES, RANGE_BYTES = 3, 10, 50, 2000, 3, 1 << 20, 1 << 22, 2, 8 << 20
#: What ends a piece; the byte that stands for it between words, which no text has.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_BREAK = b"\xff"
_NEVER = 255
_to_breaks = bytes(255 if i in _ENDS else i + 32 if 65 <= i <= 90 else 32 if i == 9 else i for i in range(256))


def spaced(text: str | None) -> bytes:
    """Lower-case words between spaces; a break stands where a piece ends."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_to_breaks).replace(_BREAK, b" \xff ")


def _cells(h: np.ndarray, cells: int) -> list[np.ndarray]:
    return [(mixed(h + np.uint64(k)) % np.uint64(cells)).astype(np.int64) for k in range(PROBES)]


def _word_hashes(langs: Iterable[bytes], words: Iterable[bytes]) -> np.ndarray:
    """Hashes of words, apart for each language."""
    seeds: dict[bytes, int] = {}
    for lang in (langs := list(langs)):
        if lang not in seeds:
            seeds[lang] = xxhash.xxh3_64_intdigest(lang)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, map(seeds.__getitem__, langs)), np.uint64, len(langs))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and that of its last word."""
    return mixed(a * _BASE + b)


def _steps(seen: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step in which each hash was found often enough, by the table; _NEVER where it wasn't yet."""
    return np.max([seen[c] for c in _cells(h, len(seen))], axis=0)


def _packed(length: int, start: np.ndarray, said: list[pa.Array], numbers: list[np.ndarray], h: np.ndarray, n: np.ndarray, ranges: int) -> pd.DataFrame:
    """A row for each step of activation and range of hashes: keys (language, tab, phrase) in the order given, and counts."""
    code = start * ranges + _range(h, ranges)
    code -= code.min()
    order = np.argsort(code.astype(np.uint16) if code.max() < 1 << 16 else code, kind="stable")  # 16 bits are sorted by radix
    code, n, start, r = code[order], n[order], start[order], _range(h[order], ranges)
    cut = np.append(np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])), len(code))
    joined = _lines(_named([x.take(pa.array(i[order])) for x, i in zip(said, numbers, strict=True)]), cut)
    return pd.DataFrame({"words": length, "start": start[cut[:-1]], "range": r[cut[:-1]], "phrases": [zstandard.compress(x, 3) for x in joined], "counts": [packed(n[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]})


def _lines(keys: pa.Array, cut: np.ndarray) -> list[bytes]:
    """Keys between neighbouring cuts, joined by line breaks."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), keys), b"\n").to_pylist()


def _listed(keys: pa.Array) -> list[bytes]:
    """Keys without line breaks; faster than by one value each."""
    return _lines(keys, np.array([0, len(keys)]))[0].split(b"\n") if len(keys) else []


def _named(parts: list[pa.Array]) -> pa.Array:
    """Language, tab, words with spaces between."""
    said = pc.binary_join_element_wise(*parts[1:], b" ") if len(parts) > 2 else parts[1]
    return pc.binary_join_element_wise(parts[0], said, b"\t")


_ROW = "words int, start int, range long, phrases binary, counts binary"


def _phrases(at: np.ndarray, langs: pa.Array, own_words: pa.Array, h: np.ndarray, seen: list[np.ndarray], step: int, shards: int, longest: int, ranges: int) -> Iterator[pd.DataFrame]:
    """Counts of the active phrases of a block. at: word numbers, 0 where a piece ends; language, word and hash of each number."""
    if step < shards:
        n = np.bincount(at, minlength=len(h))
        some = np.flatnonzero(n[1:]) + 1
        if len(some):
            yield _packed(1, np.full(len(some), -1), [langs, own_words], [some, some], h[some], n[some], ranges)
    # Of the length below: the phrases' hashes, the steps in which they were found often enough, and their numbers, by place.
    own, number = h[at], at.astype(np.int64)
    found = _steps(seen[0], h)
    found[0] = _NEVER
    found = found[at]
    for k in range(2, longest + 1):
        begun = np.maximum(found[:-1], found[1:])  # of (i - 1, i): both subphrases
        reached = np.flatnonzero((begun != _NEVER) & (at[1:] != 0)) + 1
        if not len(reached):
            return
        # Numbers of this block, so that no two phrases are taken for one; as words are numbered in order, so are phrases.
        key = number[reached - 1] * len(h) + at[reached]
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        cut = np.flatnonzero(new)
        first, n = reached[order[cut]], np.diff(np.append(cut, len(key)))
        start, longer = begun[first - 1], _joined(own[first - 1], h[at[first]])
        active = np.flatnonzero((start < step) & (step <= start.astype(np.int64) + shards))  # active from start + 1 on
        if len(active):
            place = first[active]
            yield _packed(k, start[active].astype(np.int64), [langs, *[own_words] * k], [at[place], *(at[place - j] for j in range(k - 1, -1, -1))], longer[active], n[active], ranges)
        if k < longest:
            which = np.zeros(len(key), np.int64)
            which[order] = np.cumsum(new) - 1
            found = np.full(len(at), _NEVER, np.uint8)
            # Not before its own start: its cells may have been filled by others while its subphrases weren't found.
            found[reached] = np.maximum(start, _steps(seen[k - 1], longer))[which]
            own, number = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
            own[reached], number[reached] = longer[which], which


def _block(shard: int, texts: dict[str, list[bytes]]) -> pd.DataFrame:
    """Words of a language after another in order, numbered from 1; numbers by place, 0 where a piece or a text ends."""
    langs, names, at, most, size = [], [], [np.zeros(1, np.int32)], 1, 0
    for lang in sorted(texts):
        own = b"".join(b"%b \xff " % t for t in texts[lang])
        size += len(own)
        own = pc.list_flatten(pc.split_pattern(pa.array([own], pa.binary()), b" ")).dictionary_encode()
        known = own.dictionary
        order = pc.sort_indices(known).to_numpy()
        sorted_words = _listed(known.take(pa.array(order)))
        none = (sorted_words[:1] == [b""]) + 0  # nothing stands between neighbouring spaces
        number = np.zeros(len(order), np.int32)
        number[order] = np.arange(most - none, most - none + len(order))
        number[order[:none]] = -1
        number[order[-1]] = 0  # the break: no other word begins with its byte
        own = number[own.indices.to_numpy()]
        at.append(own[own >= 0])
        names += sorted_words[none:-1]
        langs.append((lang, len(sorted_words) - none - 1))
        most = len(names) + 1
    return pd.DataFrame({"langs": [json.dumps(langs)], "names": [zstandard.compress(b"\n".join(names), 3)], "at": [packed(np.concatenate(at))], "size": size, "shard": shard})


def blocks(docs: DataFrame, shards: int, block: int = BLOCK_WORDS) -> DataFrame:
    """(langs, names, at, size, shard): of a block of documents the languages with how many words they have, these words, the numbers of its words by place, bytes; docs (lang, text, shard)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, list[bytes]]] = [{} for _ in range(shards)]
        size = [0] * shards
        for p in parts:
            for lang, text, shard in zip(p["lang"], p["text"], p["shard"], strict=True):
                held[shard].setdefault(lang, []).append(own := spaced(text))
                size[shard] += own.count(b" ") + 2
                if size[shard] >= block:
                    yield _block(shard, held[shard])
                    held[shard], size[shard] = {}, 0
        for shard in range(shards):
            if held[shard]:
                yield _block(shard, held[shard])

    return docs.select("lang", "text", "shard").mapInPandas(run, "langs string, names binary, at binary, size long, shard int")


def counted(shard: DataFrame, seen: list[np.ndarray], step: int, shards: int, longest: int, ranges: int, block: int = BLOCK_WORDS) -> DataFrame:
    """Packed counts of the phrases active in this step, in parts that add up; shard: blocks."""
    sent = shard.sparkSession.sparkContext.broadcast(seen)  # (longest - 1) * CELLS bytes

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for of, names, numbers in zip(p["langs"], p["names"], p["at"], strict=True):
                at = unpacked(numbers, np.int32)
                if not at.any():
                    continue
                own_words = [b"", *zstandard.decompress(names).split(b"\n")]
                langs = [json.dumps(x).encode() for x, _ in json.loads(of)]  # without tab or line break
                which = np.repeat(np.arange(len(langs)), [n for _, n in json.loads(of)])
                which = np.append(which[:1], which)  # of 0 too, which isn't a word
                h = _word_hashes([langs[x] for x in which], own_words)
                langs, own_words = pa.array(langs, pa.binary()).take(pa.array(which)), pa.array(own_words, pa.binary())
                ends = np.flatnonzero(at == 0)
                i = 0
                while i < len(at) - 1:  # up to the last end within a block's size, or the first one beyond it
                    j = np.searchsorted(ends, i + block, "right") - 1
                    j = int(ends[j if ends[j] > i else j + 1])
                    yield from _phrases(at[i : j + 1], langs, own_words, h, sent.value, step, shards, longest, ranges)
                    i = j

    return shard.mapInPandas(run, _ROW)


def _keys(phrases: bytes) -> pa.Array:
    return pc.list_flatten(pc.split_pattern(pa.array([zstandard.decompress(phrases)], pa.binary()), b"\n"))


def _hashes(keys: list[bytes], length: int) -> np.ndarray:
    langs, said = zip(*(k.split(b"\t") for k in keys), strict=True)
    first, *rest = zip(*(x.split(b" ") for x in said), strict=True)
    h = _word_hashes(langs, first)
    for w in rest:
        h = _joined(h, _word_hashes(langs, w))
    return h


def merged(p: pd.DataFrame, least: int, cells: int, step: int, shards: int) -> pd.DataFrame:
    """Of one length, step of activation and range: the sums of all parts, and the cells of what is frequent."""
    parts = [pa.table({"k": _keys(phrases), "n": unpacked(counts, np.int64)}) for phrases, counts in zip(p["phrases"], p["counts"], strict=True)]
    total = pa.concat_tables(parts).group_by("k", use_threads=False).aggregate([("n", "sum")])
    length, start = p["words"].iloc[0], p["start"].iloc[0]
    if length > 1 and start + shards == step:  # all shards were counted; all words count for the languages' totals
        total = total.filter(pc.greater_equal(total["n_sum"], least))
        if not len(total):
            return pd.DataFrame(columns=["words", "start", "range", "phrases", "counts", "cells"], dtype=object)
    total = total.sort_by("k")
    keys, n = total["k"].combine_chunks(), total["n_sum"].to_numpy()
    frequent = _listed(keys.filter(pa.array(n >= least)))
    found = np.unique(np.concatenate(_cells(_hashes(frequent, length), cells))) if frequent else np.zeros(0, np.int64)
    return pd.DataFrame({"words": [length], "start": [start], "range": p["range"].iloc[:1], "phrases": [zstandard.compress(x, 3) for x in _lines(keys, np.array([0, len(keys)]))], "counts": [packed(n)], "cells": [found]})


def _reached(sums: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """Of each length the cells that its frequent phrases have; at most `cells` numbers come back of a length."""
    width = min(cells, 1 << 16)
    each = sums.select("words", F.explode("cells").alias("cell"))
    # At most `width` cells of a block, four bytes each.
    rows = each.groupBy("words", F.expr(f"cell div {width}").alias("block")).agg(F.collect_set(F.expr(f"cast(cell % {width} as int)")).alias("cells")).toArrow()
    out: dict[int, np.ndarray] = {}
    for length, block, own in zip(rows["words"].to_pylist(), rows["block"].to_pylist(), rows["cells"], strict=True):
        out.setdefault(length, np.zeros(-(-cells // width) * width, bool))[block * width + own.values.to_numpy()] = True
    return {k: v[:cells] for k, v in out.items()}


def frequencies(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, cells: int = CELLS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, words, phrase, n): every word and phrase found `least` times; words 0: all words of the language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Equal texts are told apart by their place, so that a large group of copies doesn't make one shard large.
    rows = rows.withColumn("shard", F.expr(f"cast(pmod(xxhash64(text, monotonically_increasing_id()), {shards}) as int)"))
    path = new_path(spark, "shards")
    with batch_rows(spark, 64):  # texts may be long
        blocks(rows, shards).write.partitionBy("shard").parquet(path)
    kept = spark.read.schema("langs string, names binary, at binary, size long, shard int").parquet(path)
    ranges = max(1, -(-(kept.agg(F.sum("size")).first()[0] or 0) // range_bytes))
    seen = [np.full(cells, _NEVER, np.uint8) for _ in range(longest - 1)]
    sums, whole = None, []
    last = [-1] * (longest - 1)  # the last step in which a cell of each length was written
    for step in steps_from():
        if step >= shards and step > max(last) + shards:
            break
        with batch_rows(spark, 8):  # blocks and packed rows are large
            parts = counted(kept.filter(F.col("shard") == step % shards).select("langs", "names", "at"), seen, step, shards, longest, ranges)
            if sums is not None:
                parts = parts.unionByName(sums.filter(F.col("start") + shards >= step).drop("cells"))
            sums = table(parts.groupBy("words", "start", "range").applyInPandas(lambda p: merged(p, least, cells, step, shards), f"{_ROW}, cells array<long>"), "phrase-counts")
        whole.append(sums.filter(F.col("start") + shards == step).drop("cells"))
        for k, own in _reached(sums.filter(F.col("words") < longest), cells).items():
            new = own & (seen[k - 1] == _NEVER)
            if new.any():
                seen[k - 1] = np.where(new, np.uint8(step), seen[k - 1])
                last[k - 1] = step

    def told(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for length, phrases, counts in zip(p["words"], p["phrases"], p["counts"], strict=True):
                keys, n = _keys(phrases), unpacked(counts, np.int64)
                some = n >= least
                said = (k.split(b"\t") for k in _listed(keys.filter(pa.array(some))))
                out = [(json.loads(x), length, y.decode("utf-8", "surrogatepass"), c) for (x, y), c in zip(said, n[some].tolist(), strict=True)]
                if length == 1:
                    own = pa.table({"lang": pc.list_element(pc.split_pattern(keys, b"\t"), 0), "n": n}).group_by("lang", use_threads=False).aggregate([("n", "sum")])
                    out += [(json.loads(x), 0, "", c) for x, c in zip(own["lang"].to_pylist(), own["n_sum"].to_pylist(), strict=True)]
                yield pd.DataFrame(out, columns=["lang", "words", "phrase", "n"])

    found = reduce(DataFrame.unionByName, whole).mapInPandas(told, "lang string, words int, phrase string, n long")
    with batch_rows(spark, 16):
        return table(found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")), "phrases")


def _part(first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, contained: int = CONTAINED, top: int = TOP, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases by their weakest cut."""
    sums = frequencies(docs, text, lang, least, longest, shards, cells)
    total = sums.filter("words = 0").select("lang", F.col("n").alias("total"))
    found = sums.filter("words > 0")
    phrases = found.filter("words > 1").withColumnRenamed("n", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", _part(F.lit(1), F.col("k"))).withColumn("right", _part(F.col("k") + 1, F.col("words") - F.col("k")))
    part = lambda c, n: found.select("lang", F.col("phrase").alias(c), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    # a * a and l * r can pass 64 bits; the quotient is at most 1000000.
    score = F.expr("(1000000 * (cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)))) div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "words", "phrase", "a", "m.l", "m.r", "m.score")
    inner = phrases.withColumn("w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)) if longest > 2 else F.lit(None)).filter("words > 2")
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("w") + 1)))
    longer = inner.groupBy("lang", _part(F.col("i"), F.col("w")).alias("phrase")).agg(F.max("a").alias("longer"))
    rows = best.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < contained * F.col("a"), F.lit(True)))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))).cast("long")
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= top)
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
