"""Exact cosine search over a table of vectors in clusters, for any number of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import bounded_batches, stored

#: Centroids at most, rows of a block about, queries that meet it in one task about and at once, rings of a cluster at most.
CENTROIDS, BLOCK, SLICE, STEP, RINGS = 1024, 4096, 16_384, 512, 64
#: Room below a bound for rounding scores to six digits and for angles.
SLACK = 2e-6


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def vector_blocks(chunks: DataFrame, doc: str, vector: str, centroids: int = CENTROIDS, block: int = BLOCK) -> tuple[DataFrame, DataFrame, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Stored vectors in blocks (doc, vector, cluster, ring, part), stored blocks (cluster, ring, part, lo, hi, n), centroids.

    Centroids are picked by hash among the distinct vectors, at most `centroids`, the only rows that come to the driver.
    Each vector belongs to the nearest centroid of its length, or to the cluster -1 - length without one. A cluster is cut into rings by
    the angle to its centroid, of about `block` rows, and a ring with more, as of many copies, by chance; so no block is
    large, and `lo` and `hi` bound its angles. Only vectors with finite numbers may come; the
    bounds hold for vectors of zeros too, which have cosine 0 and so count as at a right angle to all.
    """
    bounded_batches(chunks.sparkSession, 4096)
    rows = chunks.select(F.col(doc).alias("doc"), F.col(vector).cast("array<double>").alias("vector"))
    n = rows.count()
    wanted = min(centroids, -(-n // block))
    few = rows.select("vector").filter(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < F.lit(min(1.0, 4 * wanted / max(n, 1)) * (1 << 30)))
    few = few.distinct().orderBy(F.xxhash64("vector"), "vector").limit(wanted).toPandas()
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n, g in few.groupby(few["vector"].map(len)):
        by_length[n] = (g.index.to_numpy(), unit(g["vector"]))
    sent = chunks.sparkSession.sparkContext.broadcast(by_length)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, same in b.groupby(b["vector"].map(len)):
                ids, c = sent.value.get(n, (np.array([-1 - n]), None))
                x = unit(same["vector"])
                a = np.zeros((len(x), 1)) if c is None else _angles(x, c)
                at = a.argmin(axis=1)
                yield pd.DataFrame({"doc": same["doc"].to_numpy(), "vector": list(x), "cluster": ids[at], "angle": a[np.arange(len(x)), at]})

    placed = stored(rows.mapInPandas(assign, f"doc {rows.schema['doc'].dataType.simpleString()}, vector array<double>, cluster long, angle double"), "placed")
    sent.unpersist()
    cuts = F.percentile_approx("angle", F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)]), 10_000).alias("cuts")
    clusters = placed.groupBy("cluster").agg(cuts, F.least(F.lit(RINGS), F.ceil(F.count("*") / block)).alias("rings"))  # a row a centroid
    place = F.size(F.filter("cuts", lambda c: c < F.col("angle")))
    ringed = stored(placed.join(F.broadcast(clusters), "cluster").select("doc", "vector", "cluster", "angle", F.floor(place * F.col("rings") / RINGS).alias("ring")), "ringed")
    parts = ringed.groupBy("cluster", "ring").agg(F.ceil(F.count("*") / block).alias("parts"))  # at most centroids x RINGS rows
    cut = ringed.join(F.broadcast(parts), ["cluster", "ring"]).withColumn("part", F.floor(F.rand(7) * F.col("parts"))).drop("parts")
    blocks = stored(cut, "blocks")  # written, so that a part drawn stays
    known = blocks.groupBy("cluster", "ring", "part").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n"))
    return blocks.drop("angle"), stored(known, "bounds"), by_length


def _best(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, k: int, least: float, kind: str) -> DataFrame:
    """(query, doc, score): of each pair (query, slice, cluster, ring, part) the best k rows of the block for the query."""
    at = ["cluster", "ring", "part", "slice"]

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "doc": [], "score": []})
        if not len(q) or not len(c):
            return empty
        c = c.sort_values("doc", kind="stable")
        ids, docs = q["query"].to_numpy(), c["doc"].to_numpy()
        x, y, out = np.stack(q["vector"].to_numpy()), np.stack(c["vector"].to_numpy()).T, []
        for i in range(0, len(x), STEP):
            s = np.round(x[i : i + STEP] @ y, 6)
            # Scores have six digits, so a whole number can hold score and place: ties go by document.
            key = np.rint(s * 1e6).astype(np.int64) * s.shape[1] - np.arange(s.shape[1])
            cols = np.argpartition(key, -k, axis=1)[:, -k:] if s.shape[1] > k else np.indices(s.shape)[1]
            score = np.take_along_axis(s, cols, axis=1)
            r, at = np.nonzero(score >= least)
            out.append(pd.DataFrame({"query": ids[i + r], "doc": docs[cols[r, at]], "score": score[r, at]}))
        return pd.concat(out)

    left = pairs.join(asked.select("query", "vector"), "query").groupBy(*at)
    right = pairs.select(*at).distinct().join(blocks, ["cluster", "ring", "part"]).select("doc", "vector", *[F.col(c).alias(f"_{c}") for c in at])
    return left.cogroup(right.groupBy(*[f"_{c}" for c in at])).applyInPandas(run, f"query long, doc {kind}, score double")


def clustered_search(chunks: DataFrame, queries: DataFrame, doc: str, vector: str, k: int, least: float, centroids: int = CENTROIDS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((query, doc, score), (query, met, blocks)): rows among which are each query's best k of cosine `least` or more, exactly.

    The first step meets each query with the block that may hold its nearest vectors, which gives a lower bound of its k-th
    score. The second meets it with every other block whose best possible cosine, from the angles of query and block to
    the centroid, isn't under that bound. Queries stay a table and meet a block in slices of about SLICE, so no task holds
    more; chunks are placed once, however many queries there are. A query's
    number is its own, once and not null; `met` of all `blocks` were compared with it.
    """
    blocks, bounds, by_length = vector_blocks(chunks, doc, vector, centroids, block)
    kind = blocks.schema["doc"].dataType.simpleString()
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast(by_length)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, same in b.groupby(b["vector"].map(len)):
                ids, c = sent.value.get(n, (np.array([-1 - n]), None))
                x = unit(same["vector"])
                a = np.zeros((len(x), 1)) if c is None else _angles(x, c)
                yield pd.DataFrame({"query": same["query"].to_numpy(), "vector": list(x), "clusters": [ids] * len(x), "angles": list(a)})

    asked = queries.select("query", F.col("vector").cast("array<double>").alias("vector"))
    asked = stored(asked.mapInPandas(place, "query long, vector array<double>, clusters array<long>, angles array<double>"), "asked")
    sent.unpersist()
    slices = F.lit(max(1, -(-asked.count() // SLICE)))
    each = asked.select("query", F.pmod(F.xxhash64("query"), slices).alias("slice"), F.explode(F.arrays_zip("clusters", "angles")).alias("z"))
    each = each.select("query", "slice", F.col("z.clusters").alias("cluster"), F.col("z.angles").alias("a"))
    near = F.greatest(F.lit(0.0), F.col("lo") - F.col("a"), F.col("a") - F.col("hi"))
    reach = F.when(F.col("cluster") < 0, 1.0).otherwise(F.cos(near))
    whole = F.broadcast(bounds.groupBy("cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))  # a row a cluster
    at = ["query", "slice", "cluster", "ring", "part"]
    first = each.join(whole, "cluster").groupBy("query", "slice").agg(F.min_by(F.struct("cluster", "a"), F.struct("a", "cluster")).alias("h")).select("query", "slice", "h.*")
    first = first.join(bounds, "cluster").groupBy("query").agg(F.max_by(F.struct(*at[1:]), F.struct(reach, "n", -F.col("ring"), -F.col("part"))).alias("h"))
    home = stored(first.select("query", "h.*"), "homes")
    found = stored(_best(home, asked, blocks, k, least, kind), "homes-found")
    place_of = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))  # at most k rows a query
    bound = found.withColumn("r", place_of).filter(F.col("r") == k).select("query", F.col("score").alias("bound"))
    known = each.join(bound, "query", "left").withColumn("bound", F.greatest(F.coalesce("bound", F.lit(-2.0)), F.lit(least)) - SLACK)
    # Whole clusters are left out before their blocks are looked at.
    known = known.join(whole, "cluster").filter(reach >= F.col("bound")).drop("lo", "hi").join(bounds, "cluster").filter(reach >= F.col("bound"))
    others = stored(known.select(*at).join(home, at, "left_anti"), "others")
    met = home.select("query").unionByName(others.select("query")).groupBy("query").agg(F.count("*").alias("met"))
    return found.unionByName(_best(others, asked, blocks, k, least, kind)), met.crossJoin(F.broadcast(bounds.agg(F.count("*").alias("blocks"))))  # one row
