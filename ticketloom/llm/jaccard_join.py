"""Jaccard self-join of word shingles in size-banded tiles with bitmap signatures.

1. Each text's distinct shingles are hashed; texts with the same set are one node, named by 128 bits of hash.
2. A set's prefix is its first floor((1 - t) * n) + 1 shingles in one global order; sets that reach similarity t share a
   shingle of both prefixes. The order puts very common shingles last (a bounded list, found by counting), so a passage
   that many texts share seldom falls into a prefix. Prefixes travel as arrays, bucketed by shingle.
3. Sets that share a prefix shingle form tiles by size band. A bit per hashed shingle tells how much two sets can overlap
   at most: overlap <= size - bits that only one side has. Pairs that could reach t put their sets into one cluster. A
   shingle that more than TILE sets share puts each band of them into one cluster without looking at pairs; one that is
   counted more than HOT times is combined in each task before the shuffle, so no task gathers its sets.
4. Within a cluster, whole texts are hashed again and pairs that bitmaps let through are verified by intersecting the
   sorted arrays. A pair already linked through others needs no check. A large cluster is dealt to chunks; each chunk
   also gets the cluster's LEADS, to which near copies of one text link at once. What then isn't in the cluster's largest
   component meets all of its other chunks, a task for each pair of chunks.

No pair lists are made: tasks return spanning links. Cases: null, empty and blank texts have the empty set and link with
nothing; a text of fewer words than a shingle is one shingle; texts with equal sets share a component; a repeated row
gives a row each; rows of one id with different texts are nodes of their own; a row with a null id links with nothing; an
empty table gives no row. Other columns, whatever their names, are ignored by `join` and kept by `distinct_documents`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, table
from .hashing import blocks, mixed, runs, word_hashes
from .vector_dedup import Forest

WORDS, PERCENT = 5, 75  #: words of a shingle, similarity in hundredths
COMMON = 1 << 16  #: common shingles put last, at most (16 bytes each, broadcast)
HELD, LOCAL = 4_000_000, 4  #: shingles that a task counts at once; sets among them that make a shingle a candidate for that list
HOT = 1 << 14  #: sets of a shingle, as far as counted, from which its sets are combined before the shuffle
TILE, FEW = 2048, 8  #: sets of a shingle that are compared by bitmaps; sets whose pairs are compared at once
BUCKET_SHINGLES = 1_500_000  #: prefix shingles of a bucket; a set's bitmap goes to each bucket where it meets others, so few large buckets are cheaper
CHUNK, EACH, LEADS = 50_000, 50, 4  #: shingles that a task verifies, with EACH more for every set; leading sets of a large cluster
MOST_BITS = 1 << 16  #: bits of the longest bitmap


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, block in blocks(texts):
        h, bound = word_hashes(block)
        all_runs = runs(h, words)
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            if b - a >= words:
                yield np.unique(all_runs[a : b - words + 1])
            else:
                yield runs(h[a:b], b - a) if b > a else h[:0]


def set_name(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a whole set."""
    one, two = mixed(s + np.uint64(1)), mixed(s ^ np.uint64(0xA5A5A5A5))
    facts = np.array([np.bitwise_xor.reduce(one), one.sum(dtype=np.uint64), np.bitwise_xor.reduce(two), two.sum(dtype=np.uint64), len(s)], np.uint64)
    return int(runs(facts, 5).view(np.int64)[0]), int(runs(facts[::-1], 5).view(np.int64)[0])


def n_bits(n: int) -> int:
    """Bits of the bitmap of a set of n: the power of two that is at least 2 n, from 64."""
    return min(MOST_BITS, 1 << max(6, (2 * n - 1).bit_length()))


def bitmap(s: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of sets at their own width and half of it, to bound overlaps of pairs of sets."""

    def __init__(self, n: np.ndarray, maps: list[bytes], percent: int) -> None:
        self.n, self.percent = n, percent
        own = np.fromiter((8 * len(m) for m in maps), np.int64, len(maps))
        self.own, self.wide = own, {}
        for w in np.unique(own).tolist():
            rows = np.flatnonzero(own == w)
            a = np.frombuffer(b"".join(maps[k] for k in rows), "<u8").reshape(len(rows), -1)
            self._put(w, rows, a)
            if w > 64:  # a shingle's lowest bits choose its bit, so halves fold onto each other
                self._put(w // 2, rows, a[:, : a.shape[1] // 2] | a[:, a.shape[1] // 2 :])

    def _put(self, w: int, rows: np.ndarray, a: np.ndarray) -> None:
        place, held = self.wide.get(w, (np.full(len(self.n), -1), np.zeros((0, a.shape[1]), "<u8")))
        place[rows] = len(held) + np.arange(len(rows))
        self.wide[w] = place, np.concatenate([held, a])

    def could(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs, the smaller set first, may reach the similarity: by their sizes, then by bit counts."""
        ok = 100 * self.n[i] >= self.percent * self.n[j]
        for w in np.unique(self.own[i[ok]]).tolist():
            at = np.flatnonzero(ok & (self.own[i] == w))
            place, held = self.wide[w]
            for k in range(0, len(at), 4096):
                some = at[k : k + 4096]
                x, y = i[some], j[some]
                a, b = held[place[x]], held[place[y]]
                most = np.minimum(self.n[x] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), self.n[y] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
                ok[some] = 100 * most >= self.percent * (self.n[x] + self.n[y] - most)
        return ok


def linked(rows: np.ndarray, labels: np.ndarray, maps: Bitmaps, check: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """Spanning links of a tile, given its rows in order of size; `labels` tells what is linked already and is kept up to date.

    Each set looks back over its band, the sets large enough for it, as far as they aren't linked with it.
    """
    n = maps.n[rows]
    for at, low in enumerate(np.searchsorted(100 * n, maps.percent * n, "left").tolist()):
        i = int(rows[at])
        others = rows[low:at]
        others = others[labels[others] != labels[i]]
        if not len(others):
            continue
        for j in others[maps.could(others, np.full(len(others), i))].tolist():
            if labels[i] != labels[j] and (check is None or check(i, j)):
                labels[labels == labels[j]] = labels[i]
                yield i, j


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Sets of n and more that reach the similarity share at least ceil(t n) shingles, so n - ceil(t n) + 1 are enough."""
    return n - -(-percent * n // 100) + 1


def signatures(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(doc_id, n, name, check, bits) of each row, texts = 0; and rows (name: a shingle, texts: how many) of locally common shingles."""
    columns = ["doc_id", "n", "name", "check", "bits", "texts"]

    def common(sets: dict[tuple[int, int], np.ndarray]) -> Iterator[pd.DataFrame]:
        if sets:
            h, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            some = n >= LOCAL
            if some.any():
                none = pd.array([None] * int(some.sum()), "Int64")
                yield pd.DataFrame({"doc_id": none, "n": 0, "name": pd.array(h[some].view(np.int64).tolist(), "Int64"), "check": none, "bits": None, "texts": n[some]})[columns]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}  # by name: equal sets count once
        size = 0
        for p in parts:
            sets = list(shingle_sets(list(p["t"]), words))
            names = [set_name(s) if len(s) else (None, None) for s in sets]
            ids = pd.array(p["doc_id"].astype(object).where(p["doc_id"].notna(), None).tolist(), "Int64")
            one, two = (pd.array([x[k] for x in names], "Int64") for k in (0, 1))
            yield pd.DataFrame({"doc_id": ids, "n": [len(s) for s in sets], "name": one, "check": two, "bits": [bitmap(s, n_bits(len(s))) if len(s) else None for s in sets], "texts": 0})[columns]
            for name, s in zip(names, sets, strict=True):
                if name[0] is not None and name not in held:
                    held[name] = s
                    size += len(s)
            if size > HELD:
                yield from common(held)
                held, size = {}, 0
        yield from common(held)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInPandas(run, "doc_id long, n long, name long, check long, bits binary, texts long")


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _combined(key: np.ndarray, name: np.ndarray, size: np.ndarray, buckets: int) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    """Of hot shingles' entries: one set a shingle as a row of a bucket below 0, and links of a spanning forest of the sets that share one."""
    order = np.argsort(key, kind="stable")
    key, name, size = key[order], name[order], size[order]
    names, at = np.unique(name, return_inverse=True)
    forest, links = Forest(len(names)), []
    start = _starts(key)
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True):
        links += [(int(names[x]), int(names[at[a]])) for x in at[a + 1 : b].tolist() if forest.join(x, int(at[a]))]
    bucket = -1 - (mixed(key[start]) % np.uint64(buckets)).astype(np.int64)
    return pd.DataFrame({"bucket": bucket, "shingles": [k.tobytes() for k in key[start]], "names": [n.tobytes() for n in name[start]], "sizes": [n.tobytes() for n in size[start]]}), links


def prefixes(docs: DataFrame, doc_id: str, text: str, common: np.ndarray, hot: np.ndarray, words: int, percent: int, buckets: int) -> DataFrame:
    """(bucket, shingles, names, sizes, a, b): the prefixes of many sets as arrays, by bucket; a, b: names of sets that share a hot shingle."""
    last = docs.sparkSession.sparkContext.broadcast((common, hot))
    columns = ["bucket", "shingles", "names", "sizes", "a", "b"]

    def flushed(keys: list[np.ndarray], names: list[int], sizes: list[int]) -> Iterator[pd.DataFrame]:
        if not keys:
            return
        many = [len(k) for k in keys]
        key, name, n = np.concatenate(keys), np.repeat(np.array(names, np.int64), many), np.repeat(np.array(sizes, np.int32), many)
        if len(last.value[1]):
            is_hot = np.isin(key, last.value[1])
            if is_hot.any():
                rows, links = _combined(key[is_hot], name[is_hot], n[is_hot], buckets)
                yield rows.assign(a=None, b=None)[columns]
                if links:
                    a, b = np.array(links, np.int64).T
                    yield pd.DataFrame({"bucket": [int(a[0] % buckets)], "shingles": [b""], "names": [b""], "sizes": [b""], "a": [a.tobytes()], "b": [b.tobytes()]})[columns]
            key, name, n = key[~is_hot], name[~is_hot], n[~is_hot]
        bucket = (mixed(key) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        key, name, n, bucket = key[order], name[order], n[order], bucket[order]
        at = _starts(bucket)
        cut = lambda x: [x[a:b].tobytes() for a, b in zip(at, [*at[1:], len(x)], strict=True)] if len(x) else []
        yield pd.DataFrame({"bucket": bucket[at], "shingles": cut(key), "names": cut(name), "sizes": cut(n), "a": None, "b": None})[columns]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        put_last = last.value[0]
        keys, names, sizes, done, held = [], [], [], set(), 0
        for p in parts:
            for s in shingle_sets(list(p["t"]), words):
                if not len(s) or (name := set_name(s)) in done:
                    continue
                done.add(name)
                k = prefix_length(len(s), percent)
                if len(put_last):
                    is_last = put_last[np.minimum(np.searchsorted(put_last, s), len(put_last) - 1)] == s
                    keys.append(np.concatenate([s[~is_last], s[is_last]])[:k])
                else:
                    keys.append(s[:k])
                names.append(name[0])
                sizes.append(len(s))
                held += k
            if held > HELD // 4:
                yield from flushed(keys, names, sizes)
                keys, names, sizes, done, held = [], [], [], set(), 0
        yield from flushed(keys, names, sizes)

    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(text).alias("t"))
    return rows.mapInPandas(run, "bucket long, shingles binary, names binary, sizes binary, a binary, b binary")


def shared(p: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of a bucket: (name, null, shingles) of each set that shares a shingle with a set of like size; (name, other, null) of sets put into one cluster unseen.

    Unseen are the sets of hot shingles (buckets below 0) and those of a shingle that more than TILE sets of a band share.
    """
    key, name, n = (np.frombuffer(b"".join(p[c]), k) for c, k in (("shingles", "<u8"), ("names", "<i8"), ("sizes", "<i4")))
    a, b = (np.frombuffer(b"".join(x for x in p[c] if x is not None), "<i8") for c in ("a", "b"))
    order = np.argsort(key, kind="stable")
    twice = key[order[1:]] == key[order[:-1]]
    order = order[np.concatenate([[False], twice]) | np.concatenate([twice, [False]])] if len(key) else order  # most shingles come once: the rest is sorted further
    key, name, n = key[order], name[order], n[order].astype(np.int64)
    order = np.lexsort((name, n, key))
    key, name, n = key[order], name[order], n[order]
    new = np.ones(len(key), bool)  # a name may stand for two sets of other sizes
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1]) | (n[1:] != n[:-1])
    key, name, n = key[new], name[new], n[new]
    hot = bool(len(p)) and int(p["bucket"].iloc[0]) < 0
    next_to = np.zeros(len(key) + 1, bool)
    if len(key):
        next_to[1:-1] = (key[1:] == key[:-1]) & ((100 * n[:-1] >= percent * n[1:]) | hot)
    some = next_to[1:] | next_to[:-1]
    start = np.flatnonzero(some & ~next_to[:-1])  # of runs of neighbours
    count = np.flatnonzero(some & ~next_to[1:]) + 1 - start
    over = (count > TILE) | hot
    mine = np.zeros(len(key), bool)
    for s, c in zip(start[over].tolist(), count[over].tolist(), strict=True):
        mine[s : s + c] = True
        a, b = np.concatenate([a, name[s + 1 : s + c]]), np.concatenate([b, np.full(c - 1, name[s])])
    k, m = key[some & ~mine], name[some & ~mine]
    order = np.argsort(m, kind="stable")
    k, m = k[order], m[order]
    at = _starts(m)
    met = [k[x:y].tobytes() for x, y in zip(at, [*at[1:], len(m)], strict=True)] if len(m) else []
    return pd.DataFrame({"bucket": p["bucket"].iloc[0], "name": np.concatenate([m[at], a]), "other": pd.array([None] * len(at) + b.tolist(), "Int64"), "keys": met + [None] * len(a)})


def tile_links(p: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Spanning links of the sets of a tile that share a shingle and whose bitmaps let them be similar."""
    p = p.sort_values(["n", "node"]).reset_index(drop=True)
    node, n = p["node"].to_numpy(), p["n"].to_numpy()
    maps, labels, out = Bitmaps(n, list(p["bits"]), percent), np.arange(len(p)), []
    each = [len(k) // 8 for k in p["keys"]]
    key, row = np.frombuffer(b"".join(p["keys"]), "<u8"), np.repeat(np.arange(len(p)), each)
    order = np.argsort(key, kind="stable")  # rows stay in order of size
    key, row = key[order], row[order]
    start = _starts(key)
    count = np.diff([*start, len(key)])
    # Shingles of a few sets: all their pairs at once, each pair once.
    pairs = [np.zeros(0, np.int64)]
    for c in range(2, FEW + 1):
        a = start[count == c]
        pairs += [row[a + x] * len(p) + row[a + y] for x in range(c) for y in range(x + 1, c)]
    pair = np.unique(np.concatenate(pairs))
    i, j = pair // len(p), pair % len(p)
    ok = maps.could(i, j)
    forest = Forest(len(p))
    out += [(a, b) for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True) if forest.join(a, b)]
    labels = np.fromiter((forest.root(k) for k in range(len(p))), np.int64, len(p))
    for a, c in zip(start[count > FEW].tolist(), count[count > FEW].tolist(), strict=True):
        out += linked(row[a : a + c], labels, maps)
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"a": node[a], "b": node[b]})


def verified(p: pd.DataFrame, words: int, percent: int) -> pd.DataFrame:
    """Spanning links of the sets of each cluster, by exact intersections of the whole texts' sets; sets of one `part_of` are linked already."""
    sets = list(shingle_sets(list(p["t"]), words))
    own_name, own_check = p["name"].tolist(), p["check"].tolist()
    right = [k for k, s in enumerate(sets) if len(s) and set_name(s) == (own_name[k], own_check[k])]  # else another text of that id
    node, cluster = p["node"].to_numpy(), p["cluster"].to_numpy()
    right = list({node[k]: k for k in right}.values())
    n = np.array([len(sets[k]) for k in right], np.int64)
    order = sorted(range(len(right)), key=lambda k: (n[k], node[right[k]]))
    right, n = [right[k] for k in order], n[order]
    if not right:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    maps = Bitmaps(n, [bitmap(sets[k], n_bits(len(sets[k]))) for k in right], percent)
    labels = np.unique(p["part_of"].to_numpy()[right], return_inverse=True)[1]

    def check(i: int, j: int) -> bool:
        both = len(np.intersect1d(sets[right[i]], sets[right[j]], assume_unique=True))
        return bool(100 * both >= percent * (n[i] + n[j] - both))

    own = cluster[right]
    by = np.argsort(own, kind="stable")
    edge = _starts(own[by])
    out = [(node[right[i]], node[right[j]]) for a, b in zip(edge, [*edge[1:], len(by)], strict=True) for i, j in linked(by[a:b], labels, maps, check)]
    return pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)


def _dealt(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with their task, leads of large clusters with theirs): task = (group, i, j); small clusters share groups of about CHUNK."""
    weight = F.sum(F.col("n") + EACH)
    total = members.agg(weight).first()[0] or 0
    groups = max(1, ceil(total / CHUNK))
    sizes = members.groupBy("cluster").agg(F.ceil(weight / CHUNK).cast("int").alias("chunks"))
    m = members.join(sizes, "cluster").withColumn("part_of", F.col("node"))
    group = F.when(F.col("chunks") > 1, F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(groups)) - groups)
    own = F.expr("cast(pmod(xxhash64(node), chunks) as int)")
    tasks = m.withColumn("group", group).withColumn("i", own).withColumn("j", F.col("i"))
    # A hash picks the leads, one for each salt: partial minima, so a cluster doesn't gather.
    row = F.struct(*[F.col(c) for c in m.columns])
    leads = m.filter("chunks > 1").groupBy("cluster", F.expr(f"pmod(xxhash64(node, 3), {LEADS})").alias("salt")).agg(F.min_by(row, F.struct(F.xxhash64("node", F.lit(5)), F.col("node"))).alias("r")).select("r.*")
    guests = leads.withColumn("group", F.col("cluster")).withColumn("own", own).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("i <> own").withColumn("j", F.col("i"))
    return tasks, guests.select(*tasks.columns)


def _left(members: DataFrame, found: DataFrame) -> DataFrame:
    """Of clusters that aren't one component: their sets with the tasks in which those outside the largest component meet all others."""
    weight = F.sum(F.col("n") + EACH)
    sizes = members.groupBy("cluster").agg(weight.alias("all"))
    large = members.join(sizes.filter(F.col("all") > CHUNK).select("cluster"), "cluster")
    state = large.join(found.select("node", "component"), "node", "left").withColumn("part_of", F.coalesce("component", "node")).drop("component")
    parts = state.groupBy("cluster", "part_of").agg(weight.alias("w"))
    main = parts.groupBy("cluster").agg(F.max_by("part_of", F.struct("w", "part_of")).alias("main"), F.max("w").alias("most"), F.sum("w").alias("all"), F.count("*").alias("k")).filter("k > 1")
    main = main.select("cluster", "main", F.ceil((F.col("all") - F.col("most")) / CHUNK).cast("int").alias("p"), F.ceil(F.col("most") / CHUNK).cast("int").alias("q"))
    s = state.join(main, "cluster")
    inner = F.col("part_of") == F.col("main")
    own = F.when(inner, F.expr("cast(p + pmod(xxhash64(node), q) as int)")).otherwise(F.expr("cast(pmod(xxhash64(node), p) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.when(inner, F.col("p")).otherwise(F.col("p") + F.col("q")) - 1))
    s = s.withColumn("own", own).withColumn("other", other).withColumn("group", F.col("cluster"))
    return s.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    bounded_batches(docs.sparkSession)
    made = table(signatures(docs, doc_id, text, words), "signatures")
    rows = made.filter("texts = 0").select("doc_id", "n", "name", "check")
    often = made.filter("texts > 0").groupBy("name").agg(F.sum("texts").alias("texts")).orderBy(F.desc("texts"), "name").limit(COMMON).collect()
    common = np.sort(np.array([r["name"] for r in often], np.int64).view(np.uint64))
    hot = np.sort(np.array([r["name"] for r in often if r["texts"] > HOT], np.int64).view(np.uint64))
    sets = made.filter("texts = 0 and name is not null and doc_id is not null").groupBy("name", "check").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    sets = table(sets.withColumn("node", F.monotonically_increasing_id()), "sets")  # written before it is used: ids stay as they are
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, ceil(total * (100 - percent) / 100 / BUCKET_SHINGLES))
    sent = prefixes(docs, doc_id, text, common, hot, words, percent, buckets)
    met = table(sent.groupBy("bucket").applyInPandas(lambda p: shared(p, percent), "bucket long, name long, other long, keys binary"), "met")
    tiles = met.filter("other is null").join(sets.select("name", "node", "n", "bits"), "name")
    maybe = tiles.groupBy("bucket").applyInPandas(lambda p: tile_links(p, percent), "a long, b long")
    unseen = met.filter("other is not null").select("name", "other").distinct()
    unseen = unseen.join(sets.select("name", F.col("node").alias("a")), "name").join(sets.select(F.col("name").alias("other"), F.col("node").alias("b")), "other").select("a", "b")
    clusters = components(maybe.unionByName(unseen)).select("node", F.col("component").alias("cluster"))
    members = table(clusters.join(sets.select("node", "name", "check", "rep", "n"), "node"), "members")
    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("t"))

    def links(tasks: DataFrame) -> DataFrame:
        both = texts.join(tasks.select("rep", "name", "check", "node", "cluster", "part_of", "group", "i", "j"), "rep")
        return both.groupBy("group", "i", "j").applyInPandas(lambda p: verified(p, words, percent), "a long, b long")

    tasks, guests = _dealt(members)
    first = table(links(tasks.unionByName(guests)), "links")
    found = components(first)
    left = _left(members, found)
    if left.limit(1).count():
        found = components(first.unionByName(links(left)))
    named = sets.select("name", "check", "rep", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = named.join(least, "component").select("name", "check", "component_id")
    out = rows.join(labels, ["name", "check"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), "doc_id").alias("component_id"))


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, all columns kept, that name their component: one document of each group."""
    gone = "gone"
    while gone in map(str.lower, docs.columns):
        gone += "_"
    found = join(docs, doc_id, text, words, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias(gone))
    return docs.join(found.distinct(), F.col(doc_id) == F.col(gone), "left_anti")
