"""Mixing sources to target weights by temperature, in DataFrame functions only.

Source token shares p become weights p^a / sum p^a. The exponent a, of [0, 1] in millionths, is bisected: the largest
whose entropy reaches the target, but at least the smallest that keeps every source within the repetition limit. Each
source then gets its weight of the budget as whole passes over its documents and part of a further pass. Every pass
permutes blocks of documents by hash, and the documents of a block by hash; the part takes documents until it is full.

Cases: a null source is a source of its own; null and empty texts have no token and go with whole passes, and with the
part if they come before its end; a source without any token, beside others, has no weight and goes with one pass, its
share 0; ties of a hash go by id; a repeated row is placed once per row; an empty table, or one without any token, gives
no row. Other columns, whatever their names, are ignored by `schedule` and kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Parameters: budget in token totals, entropy aimed at in shares of the even mix's, passes over a source at most, documents of a block on average.
BUDGET, ENTROPY, REPETITION, BLOCK_ROWS = 1.0, 0.9, 4.0, 1000
_STEPS = 1_000_000


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_sizes(rows: DataFrame) -> DataFrame:
    """(source, docs, tokens) of rows with source and tokens."""
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))


def source_shares(rows: DataFrame) -> DataFrame:
    """(source, docs, tokens, total, p) of the sources that have tokens."""
    return _shares(source_sizes(rows))


def _shares(sizes: DataFrame) -> DataFrame:
    by = sizes.filter("tokens > 0")
    return by.crossJoin(F.broadcast(by.agg(F.sum("tokens").alias("total")))).withColumn("p", F.col("tokens") / F.col("total"))  # one row is broadcast


def _holds(shares: DataFrame, ks: list[int], budget: float) -> dict[int, tuple[float, float]]:
    """For each exponent k / _STEPS: (entropy as a share of the even mix's, largest number of passes)."""
    each = shares.select("p", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).withColumn("q", F.pow("p", F.col("k") / _STEPS))
    got = each.groupBy("k").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("zl"), F.max(F.col("q") / F.col("p")).alias("top"), F.count("*").alias("n"))
    got = got.select("k", F.when(F.col("n") > 1, (F.log("z") - F.col("zl") / F.col("z")) / F.log("n")).otherwise(1.0).alias("entropy"), (F.col("top") / F.col("z") * budget).alias("passes"))
    return {r["k"]: (r["entropy"], r["passes"]) for r in got.collect()}  # one row for each exponent tried


def exponent(shares: DataFrame, budget: float = BUDGET, entropy: float = ENTROPY, repetition: float = REPETITION) -> float:
    """The exponent; each round cuts the range in 16, with one small aggregate over the sources."""

    def first(true_from) -> int:  # noqa: ANN001
        low, high = -1, _STEPS  # not at low, taken as true at high
        while high - low > 1:
            ks = sorted({low + (high - low) * i // 16 for i in range(1, 16)} - {low, high})
            got = _holds(shares, ks, budget)
            true = [k for k in ks if k in got and true_from(*got[k])]
            false = [k for k in ks if k in got and not true_from(*got[k])]
            if not got:
                return _STEPS
            low, high = max([low, *false]), min([high, *true])
        return high

    if (whole := _holds(shares, [_STEPS], budget).get(_STEPS)) is None or whole[0] >= entropy:
        return 1.0
    even = first(lambda h, _: h < entropy) - 1
    within = first(lambda _, n: n <= repetition)
    return max(even, within, 0) / _STEPS


def quotas(shares: DataFrame, a: float, budget: float = BUDGET) -> DataFrame:
    """(source, docs, tokens, weight, quota, passes, part): the tokens each source gives, as whole passes and a part."""
    w = shares.withColumn("q", F.pow("p", F.lit(a)))
    w = w.crossJoin(F.broadcast(w.agg(F.sum("q").alias("z"))))
    w = w.withColumn("weight", F.round(F.col("q") / F.col("z"), 9)).withColumn("quota", F.floor(F.col("weight") * F.col("total") * budget + 0.5).cast("long"))
    passes = F.floor(F.col("quota") / F.col("tokens")).cast("long")
    return w.select("source", "docs", "tokens", "weight", "quota", passes.alias("passes"), (F.col("quota") - passes * F.col("tokens")).alias("part"))


def _placed(rows: DataFrame, counts: DataFrame, plan: DataFrame, block_rows: int) -> DataFrame:
    """`rows` (source, id, tokens, more), once for each pass that takes them, with pass, block, position and share; counts: their (source, id, tokens)."""
    side = plan.select(F.col("source").alias("src"), "docs", "quota", "passes", "part", F.col("tokens").alias("whole"))

    def dealt(some: DataFrame) -> DataFrame:
        # A row for each source: Spark broadcasts it only while it is small. Splitting by block keeps a hot source spread.
        block = F.pmod(F.xxhash64("id", F.lit(3)), F.greatest(F.lit(1), F.floor(F.col("docs") / block_rows)).cast("long"))
        return some.join(side, some["source"].eqNullSafe(side["src"])).withColumn("block", block).drop("src", "docs")

    by_block = dealt(counts).groupBy("source", "block").agg(F.sum("tokens").alias("held"), F.first("passes").alias("passes"), F.first("part").alias("part"))
    runs = by_block.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    # Blocks are permuted by hash; what stands before one is summed by ranges of the hash, then within a range.
    runs = runs.withColumn("h", F.xxhash64("block", "pass", F.lit(5))).withColumn("range", F.shiftright("h", 54))
    ranges = runs.groupBy("source", "pass", "range").agg(F.sum("held").alias("held"))  # at most 1024 rows a source and pass
    ahead = lambda *by: F.coalesce(F.sum("held").over(W.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("source").alias("src"), F.col("pass").alias("p"), F.col("range").alias("r"), ahead("source", "pass", ["range"]).alias("earlier"))
    runs = runs.join(ranges, runs["source"].eqNullSafe(ranges["src"]) & (runs["pass"] == ranges["p"]) & (runs["range"] == ranges["r"])).drop("src", "p", "r")
    runs = runs.withColumn("before", F.col("earlier") + ahead("source", "pass", "range", ["h", "block"]))
    runs = runs.filter((F.col("pass") < F.col("passes")) | (F.col("before") < F.col("part")))
    runs = runs.groupBy("source", "block").agg(F.collect_list(F.struct("pass", "before")).alias("runs"))  # as many as passes
    # Written too: a row for each block is broadcast while that is small, and then texts are shuffled once, for their window.
    runs = table(runs.select(F.col("source").alias("src"), F.col("block").alias("blk"), "runs"), "runs")
    own = dealt(rows)
    taken = own.join(runs, own["source"].eqNullSafe(runs["src"]) & (own["block"] == runs["blk"])).drop("src", "blk")
    taken = taken.withColumn("run", F.explode("runs")).withColumn("pass", F.col("run.pass")).withColumn("before", F.col("run.before")).drop("run", "runs")
    inner = W.partitionBy("source", "block", "pass").orderBy(F.xxhash64("id", "pass", F.lit(9)), "id").rowsBetween(W.unboundedPreceding, -1)
    taken = taken.withColumn("position", F.col("before") + F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    taken = taken.filter((F.col("pass") < F.col("passes")) | (F.col("position") < F.col("part")))
    share = F.when(F.col("quota") > 0, (F.col("position") + F.col("pass") * F.col("whole")) / F.col("quota")).otherwise(0.0)
    return taken.withColumn("share", share).withColumn("position", F.col("position") + F.col("pass") * F.col("whole"))


def _plan(counts: DataFrame, budget: float, entropy: float, repetition: float) -> DataFrame:
    sizes = table(source_sizes(counts), "sources")
    shares = _shares(sizes)
    own = quotas(shares, exponent(shares, budget, entropy, repetition), budget)
    # A source without tokens goes with one pass, if there is any other source.
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    silent = sizes.filter("tokens = 0").crossJoin(F.broadcast(shares.limit(1).select(F.lit(True).alias("any"))))  # one row
    # Written, as a row for each source: Spark then knows that it is small and doesn't shuffle texts by their source.
    return table(own.unionByName(silent.select("source", "docs", "tokens", F.lit(0.0).alias("weight"), zero.alias("quota"), one.alias("passes"), zero.alias("part"))), "plan")


def _counted(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(source, id, tokens) of each row, written: texts are counted once for the plan, its blocks and what they hold."""
    return table(docs.select(F.col(source).alias("source"), F.col(doc_id).alias("id"), tokens(text).alias("tokens")), "counts")


def schedule(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: float = BUDGET, entropy: float = ENTROPY, repetition: float = REPETITION, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, source, pass, block, tokens, position, share), a row for each time that a document is taken.

    position: tokens that its source gives before it; share: that by the source's quota, so ordering by share interleaves
    the sources by their weights.
    """
    counts = _counted(docs, doc_id, text, source)
    placed = _placed(counts, counts, _plan(counts, budget, entropy, repetition), block_rows)
    return placed.select(F.col("id").alias("doc_id"), "source", "pass", "block", "tokens", "position", F.round("share", 6).alias("share"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: float = BUDGET, entropy: float = ENTROPY, repetition: float = REPETITION, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The documents that the schedule takes, as often as it does, with all their columns."""
    counts = _counted(docs, doc_id, text, source)
    rows = docs.select(F.col(source).alias("source"), F.col(doc_id).alias("id"), tokens(text).alias("tokens"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return _placed(rows, counts, _plan(counts, budget, entropy, repetition), block_rows).select("row.*")
