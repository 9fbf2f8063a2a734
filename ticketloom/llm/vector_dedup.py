"""Near-duplicate vectors of equal label by a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and split into blocks. Two vectors within squared distance D are, in
at least one block of d of the n dimensions, within D * d / n; so each block is range-joined under that budget, on cells
of its first coordinate whose width is the budget's root, and what any block lets
through is verified exactly. A pair is
verified only by the first block that lets it through, so link counts add up over tasks and no pairs leave a task: a
task returns its vectors' counts and the links of a spanning forest.

Equal vectors of a label are one vector with a weight. A cell of more than TILE vectors is cut into chunks and each pair
of chunks is a task of its own, so a hot cell spreads; nothing is dropped.

Cases: vectors that are null, empty, zero or hold null or non-finite numbers, and null labels, link with nothing; vectors
of different length link with nothing; rows that repeat a vec_id are vectors of their own: links are between vectors, and ids
only name components; an empty table gives none. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, table

#: Parameters: blocks of a vector, vectors of a chunk, seed of the rotation.
BLOCKS, TILE, SEED = 4, 2048, 17
#: Slack on a block's budget for coordinates in single precision, and on the fast test that goes before the exact one.
_SLACK, _ROUGH = 1e-6, 1e-4
_TILE_KEY = ["dim", "label", "block", "cell"]


def rotation(n: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def _cuts(n: int, blocks: int) -> list[tuple[int, int]]:
    k = max(1, min(blocks, n))
    edge = [n * i // k for i in range(k + 1)]
    return list(zip(edge[:-1], edge[1:], strict=True))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _budgets(n: int, least: float, blocks: int) -> list[float]:
    return [2 * (1 - least) * (hi - lo) / n for lo, hi in _cuts(n, blocks)]


def cells(vectors: DataFrame, least: float, blocks: int) -> DataFrame:
    """Each vector (label, id, weight, v) in its own cell of each block, and as a guest in the cell below."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns: dict[int, np.ndarray] = {}
        for p in parts:
            for n, same in p.groupby(p["v"].map(len)):
                if n not in turns:
                    turns[n] = rotation(n)
                x = np.stack(same["v"].to_numpy()).astype(float)
                y = (_units(x) @ turns[n].T).astype("<f4")
                v, turned = [r.tobytes() for r in x.astype("<f8")], [r.tobytes() for r in y]
                for b, ((lo, _), budget) in enumerate(zip(_cuts(n, blocks), _budgets(n, least, blocks), strict=True)):
                    # Wider than what lets a pair through, so that such a pair's cells are the same or neighbours.
                    cell = np.floor(y[:, lo].astype(float) / np.sqrt(budget + 2 * _SLACK)).astype(np.int64)
                    for guest in (0, 1):
                        yield pd.DataFrame({"dim": n, "label": same["label"].to_numpy(), "block": b, "cell": cell - guest, "guest": guest, "id": same["id"].to_numpy(), "weight": same["weight"].to_numpy(), "v": v, "y": turned})

    kinds = dict(vectors.dtypes)
    return vectors.mapInPandas(run, f"dim int, label {kinds['label']}, block int, cell long, guest int, id {kinds['id']}, weight long, v binary, y binary")


def tiles(placed: DataFrame, tile: int) -> DataFrame:
    """The cells' rows, each once for every pair (i, j) of chunks that it belongs to; side: 0 if i = j, else 1 in i and 2 in j."""
    sizes = placed.groupBy(_TILE_KEY).agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))
    cut = placed.join(sizes, _TILE_KEY).withColumn("c", F.expr("cast(pmod(xxhash64(id, v), chunks) as int)"))
    cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2)
    return cut.select(*placed.columns, F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), side.alias("side"))


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def compare(p: pd.DataFrame, least: float, blocks: int) -> pd.DataFrame:
    """Of a tile: (a, null, links) for each vector with links, (a, b, null) for the links of a spanning forest."""
    n, own = int(p["dim"].iloc[0]), int(p["block"].iloc[0])
    unit = _units(np.frombuffer(b"".join(p["v"]), "<f8").reshape(len(p), n))
    y = np.frombuffer(b"".join(p["y"]), "<f4").reshape(len(p), n)
    cuts, budgets = _cuts(n, blocks), _budgets(n, least, blocks)
    lo, hi = cuts[own]
    guest, side, weight, ids = (p[c].to_numpy() for c in ("guest", "side", "weight", "id"))
    whole = not side.any()
    left, right = np.flatnonzero(side != 2), np.arange(len(p)) if whole else np.flatnonzero(side == 2)
    square = (y[:, lo:hi] ** 2).sum(axis=1)
    links, found, forest = np.zeros(len(p), np.int64), [], Forest(len(p))

    def within(r: np.ndarray, c: np.ndarray, b: int) -> np.ndarray:
        d = y[r, cuts[b][0] : cuts[b][1]].astype(float) - y[c, cuts[b][0] : cuts[b][1]]
        return np.einsum("ij,ij->i", d, d) <= budgets[b] + _SLACK

    for k in range(0, len(left), 512):
        a = left[k : k + 512]
        far = square[a][:, None] + square[right][None, :] - 2 * (y[a, lo:hi] @ y[right, lo:hi].T)
        ok = (far <= budgets[own] + _ROUGH) & ~((guest[a] == 1)[:, None] & (guest[right] == 1)[None, :])  # two guests meet in their own cell
        if whole:
            ok &= a[:, None] < right[None, :]
        r, c = np.nonzero(ok)
        r, c = a[r], right[c]
        for s in range(0, len(r), 100_000):
            x, z = r[s : s + 100_000], c[s : s + 100_000]
            first = within(x, z, own)
            for b in range(own):  # a pair that an earlier block lets through is counted there
                first &= ~within(x, z, b)
            x, z = x[first], z[first]
            keep = np.einsum("ij,ij->i", unit[x], unit[z]) >= least
            x, z = x[keep], z[keep]
            np.add.at(links, x, weight[z])
            np.add.at(links, z, weight[x])
            found += [(i, j) for i, j in zip(x.tolist(), z.tolist(), strict=True) if forest.join(i, j)]
    some = np.flatnonzero(links)
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"a": np.concatenate([ids[some], ids[a]]), "b": pd.array([None] * len(some) + ids[b].tolist(), "Int64"), "links": pd.array(links[some].tolist() + [None] * len(a), "Int64")})


def dedup(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    bounded_batches(vectors.sparkSession, 1000)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    bad = "exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    linkable = F.expr(f"coalesce(id is not null and label is not null and size(v) > 0 and not {bad} and exists(v, x -> x <> 0), false)")
    # A different vector of a label is a node; its number has nothing to do with the ids, which may repeat.
    same = rows.filter(linkable).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    same = table(same.withColumn("node", F.monotonically_increasing_id()), "vectors")
    placed = table(cells(same.select("label", F.col("node").alias("id"), "weight", "v"), least, blocks), "cells")
    found = tiles(placed, tile).groupBy(*_TILE_KEY, "i", "j").applyInPandas(lambda p: compare(p, least, blocks), "a long, b long, links long")
    found = table(found, "vector-links")
    counts = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    groups = components(found.filter("b is not null").select("a", "b"))
    groups = same.select("node", "rep").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = groups.groupBy("component").agg(F.min("rep").alias("component_id"))
    facts = same.select("label", "v", "node", "weight").join(groups.select("node", "component").join(names, "component"), "node").join(counts, F.col("node") == F.col("a"), "left")
    facts = facts.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.withColumn("ok", linkable).join(facts, F.col("ok") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
