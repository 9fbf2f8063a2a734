"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Cases: null and empty texts score with the bias alone; labels that are null, and documents with both labels, teach
nothing; equal texts have equal scores, whatever stands beside them; a repeated row is scored once per row; a null id
counts as empty text for holding out and has no label; without any usable label every score is 0.5; an empty table gives
no row. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .hashing import blocks, runs, word_hashes
from .language_id import held_out

#: Parameters: hash buckets, labelled rows at most, shards trained apart and averaged, passes, rates.
BUCKETS, MAX_LABELLED, SHARDS, PASSES = 1 << 18, 10_000, 4, 1
ALPHA, BETA, L1, L2 = 1.5, 1.0, 0.005, 0.1
THRESHOLD = 0.7


def buckets(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, then of all word pairs of a block's texts; where each text's words begin."""
    words, bound = word_hashes(block)
    pairs = runs(words, 2)
    narrow = lambda h: (h >> np.uint64(46)).astype(np.int32)
    return np.concatenate([narrow(words), narrow(pairs)]), bound


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and weights of each text's words and word pairs: counts by the root of their number; the bias is not among them."""
    for _, block in blocks(texts):
        got, bound = buckets(block)
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            at, n = np.unique(np.concatenate([got[a:b], got[bound[-1] + a : bound[-1] + max(a, b - 1)]]), return_counts=True)
            yield at, n / np.sqrt(max(1, n.sum()))


def scores(texts: list[str | None], w: np.ndarray, bias: float) -> Iterator[float]:
    """The same dot products for whole blocks; each text is summed by itself."""

    def sums(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, some = np.zeros(len(a)), b > a
        if some.any():  # what lies between two texts, as the last word's missing pair, is summed apart and left out
            out[some] = np.add.reduceat(np.append(x, 0.0), np.stack([a[some], b[some]], axis=1).reshape(-1))[::2]
        return out

    for _, block in blocks(texts):
        got, bound = buckets(block)
        n = bound[-1]
        a, b = bound[:-1], bound[1:]
        last = np.maximum(a, b - 1)
        total = sums(w[got[:n]], a, b) + sums(w[got[n:]], a, np.minimum(last, max(0, len(got) - n)))
        yield from 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(1, (b - a) + (last - a))) + bias, -35, 35)))


class Leader:
    """FTRL-proximal with its own learning rate for each coordinate."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)  # the bias stands last

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        at, x = np.append(at, BUCKETS), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Weights from at most about MAX_LABELLED hash-picked labelled documents that are not held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y"), held_out(doc_id).alias("out")).filter("not out and y is not null and id is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2")
    share = min(1.0, MAX_LABELLED / max(1, known.count()))
    known = known.withColumn("h", F.xxhash64("id", F.lit(11))).filter(F.expr(f"pmod(h, 1000000) < {share} * 1000000"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(known.select("id", "y", "h")), "id")  # at most about MAX_LABELLED rows of 24 bytes

    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = list(features(list(p["t"])))
            yield pd.DataFrame({"shard": p["h"] % SHARDS, "h": p["h"], "y": p["y"], "at": [a.astype("<i4").tobytes() for a, _ in got], "x": [x.astype("<f4").tobytes() for _, x in got]})

    def train(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, shard, count = Leader(), None, 0

        def said() -> pd.DataFrame:
            return pd.DataFrame({"n": [count], "w": [model.weights(slice(None)).astype("<f4").tobytes()]})

        for p in parts:
            for k, y, at, x in zip(p["shard"], p["y"], p["at"], p["x"], strict=True):
                if shard is not None and k != shard:
                    yield said()
                    model, count = Leader(), 0
                shard, count = k, count + 1
                for _ in range(PASSES):
                    model.update(np.frombuffer(at, "<i4"), np.frombuffer(x, "<f4").astype(float), y)
        if count:
            yield said()

    made = rows.mapInPandas(hashed, "shard long, h long, y double, at binary, x binary").repartition(SHARDS, "shard").sortWithinPartitions("shard", "h", "y", "at")
    models = made.mapInPandas(train, "n long, w binary").collect()  # SHARDS rows of 1 MB
    if not models:
        return np.zeros(BUCKETS + 1)
    models.sort(key=lambda r: (r["n"], bytes(r["w"])))
    return np.average([np.frombuffer(r["w"], "<f4").astype(float) for r in models], axis=0, weights=[r["n"] for r in models])


def score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(weights.astype("<f4"))
    kind = dict(docs.dtypes)[doc_id]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = model.value.astype(float)
        for p in parts:
            s = np.fromiter(scores(list(p.pop("t")), w[:-1], w[-1]), float)
            yield p.assign(score=s, predicted=(s >= THRESHOLD).astype(np.int32))

    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("t")).mapInPandas(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )
