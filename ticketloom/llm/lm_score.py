"""Language-model scores: a weighted backoff automaton over smoothed n-grams, learned from the documents themselves.

Counts of all training documents make the model; none is dropped, so it grows with the corpus and fits into no single
machine. It is therefore brought to the texts in parts. Texts are cut into buckets of a few MB. A bucket asks for its own
words and n-grams: sorted keys, cut by ranges of their hash, one packed row for each range. A range adds up what all
buckets say and answers each in the order of its keys, so that answers hold counts only. With them, a bucket builds the
part of the automaton that its texts can reach, and walks it.

The automaton: a state is a context of up to ORDER - 1 words. An arc of a word leaves a state where training holds that
n-gram; it carries log10 of its smoothed probability and leads to the longest context that follows. Every state but the
root has a failure arc to the context without its first word, with the weight of what is left to unseen words; the root
has an arc for any word. One walk from left to right carries the state and adds up.

Smoothing: p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m) with m = A c(h)^B, a Dirichlet prior whose strength follows the
number of different followers that Heaps' law expects; p(w) is the base's (c + 0.5) / (N + 0.5 (V + 1)). For each context
the probabilities of all words and one unknown word add up to 1.

Words are counted by their bytes; n-grams of two words and more are named by 64-bit hashes.

Cases: null and empty texts are the end token alone; a null id counts as empty text for holding out; without training
documents every score is 0; equal texts have equal scores, and repeated rows are scored, and teach, once per row; an empty
table gives no row. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, table
from .hashing import _BASE, mixed

#: Parameters: words of an n-gram; strength and power of the prior; bytes of a bucket's texts, and of the texts behind a range.
ORDER, PRIOR, POWER, BUCKET_BYTES, RANGE_BYTES = 2, 1.0, 0.85, 6 << 20, 6 << 20
#: The end of a text, as a word that no text holds; it stands before a text's first word, too, as its context.
END = b"\xff"


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves remainder 1 by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def packed(a: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 3)


def unpacked(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).reshape(-1)


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BUCKET_BYTES) -> DataFrame:
    """A stored row for each bucket: (bucket, bytes, ids, held, blob); the table fixes which text is in which bucket."""
    schema = pa.schema([("bucket", pa.int64()), ("bytes", pa.int64()), ("ids", pa.list_(pa.string())), ("held", pa.list_(pa.bool_())), ("blob", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, total, ids, held, own = TaskContext.get().partitionId(), 0, 0, [], [], []

        def said() -> pa.RecordBatch:
            blob = zstandard.compress(b" \xff ".join([*own, b""]), 3)
            return pa.RecordBatch.from_pylist([{"bucket": (task << 32) + made, "bytes": total, "ids": ids, "held": held, "blob": blob}], schema)

        for p in parts:
            for i, h, t in zip(*(p.column(k).to_pylist() for k in ("i", "h", "t")), strict=True):
                b = (t or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
                if own and total + len(b) > size:
                    yield said()
                    made, total, ids, held, own = made + 1, 0, [], [], []
                ids.append(i)
                held.append(h)
                own.append(b)
                total += len(b) + 8
        if own:
            yield said()

    rows = docs.select(F.col(doc_id).cast("string").alias("i"), held_out(doc_id).alias("h"), F.col(text).alias("t"))
    with batch_rows(docs.sparkSession, 256):
        return table(rows.mapInArrow(run, "bucket long, bytes long, ids array<string>, held array<boolean>, blob binary"), "lm-texts")


class Bucket:
    """A bucket's texts as numbers. Place 0 is an end; each text follows with an end of its own."""

    def __init__(self, blob: bytes, held: list[bool], order: int) -> None:
        said = [END, *zstandard.decompress(blob).split()]  # of bytes: at 0x20 and 0x09 to 0x0D
        self.words = list(dict.fromkeys(said))
        numbers = {w: i for i, w in enumerate(self.words)}
        self.at = np.fromiter(map(numbers.__getitem__, said), np.int64, len(said))
        self.ends = np.flatnonzero(self.at == 0)[1:]
        self.lengths = np.diff(self.ends, prepend=0)
        self.taught = np.concatenate([[False], np.repeat(~np.array(held, bool), self.lengths)])
        self.word_hash = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        # Of each order from 2: the places where such an n-gram ends, and their keys; the lowest bit is left for `taught`.
        h = self.word_hash[self.at]
        run, self.grams = h, []
        for k in range(2, order + 1):
            run = mixed(run[:-1] * _BASE + h[k - 1 :] + np.uint64(k))
            place = np.arange(k - 1, len(h))
            for inner in range(1, k - 1):  # an end can only be the first word or the last
                place = place[self.at[place - inner] != 0]
            self.grams.append((place, run[place - k + 1] & ~np.uint64(1)))

    def word_order(self, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """Words by range, then by their bytes; the ranges."""
        r = _range(self.word_hash, ranges)
        by_bytes = sorted(range(len(self.words)), key=self.words.__getitem__)
        order = np.array(by_bytes)[np.argsort(r[by_bytes], kind="stable")]
        return order, r[order]

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.at[self.taught], minlength=len(self.words))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Different keys of all orders, sorted, and how often training texts hold them."""
        every = np.concatenate([key | self.taught[place].astype(np.uint64) for place, key in self.grams] or [np.zeros(0, np.uint64)])
        every.sort()
        key = every & ~np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return key[first], np.add.reduceat((every & np.uint64(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    """Equal ranges of the hashes' upper halves, so that sorted keys fall into rising ranges."""
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def asked(buckets: DataFrame, ranges: int, order: int = ORDER) -> DataFrame:
    """What each bucket asks each range for: its words and keys there, with its training counts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, held, blob in zip(p["bucket"], p["held"], p["blob"], strict=True):
                b = Bucket(blob, list(held), order)
                words, word_range = b.word_order(ranges)
                said = b.word_counts()[words]
                keys, counts = b.keys()
                key_range = _range(keys, ranges)
                rows = []
                for r in np.union1d(word_range, key_range).tolist():
                    i, j = np.searchsorted(word_range, [r, r + 1])
                    k, m = np.searchsorted(key_range, [r, r + 1])
                    own = b"\n".join(b.words[x] for x in words[i:j])
                    rows.append((r, name, int(j - i), zstandard.compress(own, 3), packed(said[i:j]), packed(np.diff(keys[k:m], prepend=np.uint64(0))), packed(counts[k:m])))
                yield pd.DataFrame(rows, columns=["range", "bucket", "n", "words", "word_counts", "keys", "key_counts"])

    return buckets.select("bucket", "held", "blob").mapInPandas(run, "range long, bucket long, n long, words binary, word_counts binary, keys binary, key_counts binary")


def answered(p: pd.DataFrame) -> pd.DataFrame:
    """Of one range: all buckets' counts added up, to each bucket in its own order; tokens and different words once."""
    lists = [zstandard.decompress(w).split(b"\n") if n else [] for w, n in zip(p["words"], p["n"], strict=True)]
    total: dict[bytes, int] = {}
    for ws, c in zip(lists, p["word_counts"], strict=True):
        for w, x in zip(ws, unpacked(c, np.int64).tolist(), strict=True):
            total[w] = total.get(w, 0) + x
    keys = [np.cumsum(unpacked(k, np.uint64), dtype=np.uint64) for k in p["keys"]]
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(unique), np.int64)
    np.add.at(sums, at, np.concatenate([unpacked(c, np.int64) for c in p["key_counts"]]))
    cut = np.cumsum([len(k) for k in keys])[:-1]
    first = np.arange(len(p)) == 0
    return pd.DataFrame({
        "bucket": p["bucket"].to_numpy(), "range": p["range"].to_numpy(),
        "words": [packed(np.fromiter((total[w] for w in ws), np.int64, len(ws))) for ws in lists], "keys": [packed(s) for s in np.split(sums[at], cut)],
        "tokens": first * sum(total.values()), "known": first * sum(x > 0 for x in total.values()),
    })


class Automaton:
    """The states and arcs that a bucket's texts can reach; counts are those of all training documents.

    tokens and known: N and V. A state is a context: the last k words before a place, k from 0 (the root) to order - 1. Of
    each order, `arc[k]` has the weight of the arc that the word at a place takes from the context of k words before it,
    NaN where there is none, and `fail[k]` the weight of the failure arc of the context of k words that ends at a place,
    which leads to its last k - 1 words. Both are looked up for all places at once, so the walk reads them in order.
    """

    def __init__(self, b: Bucket, word_counts: np.ndarray, key_counts: np.ndarray, tokens: int, known: int, prior: float = PRIOR, power: float = POWER) -> None:
        keys, _ = b.keys()
        probability = (word_counts + 0.5) / (tokens + 0.5 * (known + 1))
        self.base = np.log10(probability)[b.at]
        arc, fail = [self.base], [np.zeros(len(b.at))]
        low, count, p = b.at, word_counts, probability  # of the order below: its n-gram at each place, their counts and probabilities
        for place, key in b.grams:
            fail.append(self._left(count, prior, power)[low])
            unique, first, here = np.unique(key, return_index=True, return_inverse=True)
            c, end = key_counts[np.searchsorted(keys, unique)], place[first]
            before, suffix = low[end - 1], low[end]  # the context, and the n-gram without its first word
            m = prior * count[before].astype(float) ** power
            q = np.where(count[before] > 0, (c + m * p[suffix]) / np.maximum(count[before] + m, 1e-300), p[suffix])
            weight = np.full(len(b.at), np.nan)
            weight[place] = np.where(c > 0, np.log10(q), np.nan)[here]
            arc.append(weight)
            low = np.full(len(b.at), -1)  # no n-gram of this order ends at a place that is too near to a text's begin
            low[place] = here
            count, p = c, q
        self.arc, self.fail = [x.tolist() for x in arc], [x.tolist() for x in fail]

    @staticmethod
    def _left(count: np.ndarray, prior: float, power: float) -> np.ndarray:
        """log10 of what a context leaves to its failure arc; one without training counts leaves all."""
        m = prior * count.astype(float) ** power
        return np.where(count > 0, np.log10(np.where(count > 0, m, 1) / np.where(count > 0, count + m, 1)), 0.0)

    def walk(self, start: int, end: int) -> float:
        """log10 of the probability of the words from place `start` to place `end`; it begins in the context of an end."""
        arc, fail, most = self.arc, self.fail, len(self.arc) - 1
        state, total = 1, 0.0
        for at in range(start, end + 1):
            weight = arc[state][at]
            while weight != weight:  # NaN: the state has no arc for this word
                total += fail[state][at - 1]
                state -= 1
                weight = arc[state][at]
            total += weight
            state = state + 1 if state < most else most
        return total


def scored(mine: pd.DataFrame, replies: pd.DataFrame, tokens: int, known: int, order: int, ranges: int) -> pd.DataFrame:
    """The rows of a bucket's texts."""
    held, ids = list(mine["held"].iloc[0]), list(mine["ids"].iloc[0])
    b = Bucket(mine["blob"].iloc[0], held, order)
    replies = replies.sort_values("range")
    by_range, _ = b.word_order(ranges)
    words = np.zeros(len(b.words), np.int64)
    words[by_range] = np.concatenate([unpacked(w, np.int64) for w in replies["words"]])
    a = Automaton(b, words, np.concatenate([unpacked(k, np.int64) for k in replies["keys"]]), tokens, known)
    starts = b.ends - b.lengths + 1
    return pd.DataFrame({
        "doc_id": ids, "held_out": held, "n_tokens": b.lengths, "n_known": np.add.reduceat((words[b.at] > 0).astype(np.int64), starts), "train_tokens": tokens,
        "base_score": np.add.reduceat(a.base, starts), "score": [a.walk(i, j) for i, j in zip(starts.tolist(), b.ends.tolist(), strict=True)],
    })


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, bucket_bytes: int = BUCKET_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; order: 2 words or more."""
    if order < 2:
        raise ValueError("an order of 2 or more is needed")
    spark, kind = docs.sparkSession, dict(docs.dtypes)[doc_id]
    buckets = texts(docs, doc_id, text, bucket_bytes)
    ranges = max(1, -(-(buckets.agg(F.sum("bytes")).first()[0] or 0) // range_bytes))
    with batch_rows(spark, 64):  # packed rows are large
        replies = table(asked(buckets, ranges, order).groupBy("range").applyInPandas(answered, "bucket long, range long, words binary, keys binary, tokens long, known long"), "lm-replies")
        total = replies.agg(F.sum("tokens").alias("n"), F.sum("known").alias("v")).first()
        n, v = total["n"] or 0, total["v"] or 0
        own = replies.select("bucket", "range", "words", "keys").groupBy("bucket")
        schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        out = table(buckets.groupBy("bucket").cogroup(own).applyInPandas(lambda a, b: scored(a, b, n, v, order, ranges), schema), "lm-scores")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
