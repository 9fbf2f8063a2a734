"""Evaluation of retrieval and answers, by sample, bucket and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import BUCKETS, OUT_OF_SCOPE, REFUSALS, STOPWORDS, TRIGGERS
from ..sources.store import TURNS, KeyedStore


def hit_ranks(samples: DataFrame, hits: DataFrame, strategies: list[str]) -> DataFrame:
    """(sample, strategy, target, rank): the first hit that names any alias of a target, 0 if none.

    samples (sample, targets array<array<string>>); hits (sample, strategy, rank, section_path, question, category);
    strategies: those that were run. A strategy that found nothing for a sample ranks all its targets 0, and so does
    a sample without targets, as one that no hit names; hits of other strategies are ignored.
    """
    where = F.concat_ws(" ", F.coalesce("section_path", F.lit("")), F.coalesce("question", F.lit("")), F.coalesce("category", F.lit("")))
    each = samples.select("sample", F.posexplode_outer("targets").alias("target", "aliases")).withColumn("target", F.coalesce("target", F.lit(0))).withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))
    met = each.join(hits.select("sample", "strategy", "rank", where.alias("where")), ["sample", "strategy"], "left")
    found = F.exists("aliases", lambda a: F.col("where").contains(a))
    return met.groupBy("sample", "strategy", "target").agg(F.coalesce(F.min(F.when(found, F.col("rank"))), F.lit(0)).cast("long").alias("rank"))


def recall_mrr(ranks: DataFrame) -> DataFrame:
    """Recall at 3, 5 and 10 and mean reciprocal rank of each sample and strategy over its targets."""
    at = lambda k: F.round(F.avg(F.when((F.col("rank") > 0) & (F.col("rank") <= k), 1.0).otherwise(0.0)), 4).alias(f"recall_{k}")
    return ranks.groupBy("sample", "strategy").agg(at(3), at(5), at(10), F.round(F.avg(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)), 4).alias("mrr"))


def faithfulness(answer: Column, evidence: Column) -> Column:
    """struct<faithful, reason> by rule; evidence null: there was none."""
    made_up = F.coalesce(*[F.when(answer.contains(p) & ~evidence.contains(p), F.lit(f"{why} ({p})")) for p, why in TRIGGERS])
    refused = T.contains_any(answer, REFUSALS)
    return F.struct(
        F.when(evidence.isNull(), refused).otherwise(made_up.isNull()).alias("faithful"),
        F.when(evidence.isNull(), F.when(refused, "refused without evidence").otherwise("answered without evidence")).otherwise(F.coalesce(made_up, F.lit("supported"))).alias("reason"),
    )


def sufficient(query: Column, evidence: Column) -> Column:
    """The question is in scope and one of its core words stands in the evidence."""
    words = F.filter(T.terms(query), lambda w: F.length(w) >= 2)
    core = F.array_except(words, F.array(*map(F.lit, STOPWORDS)))
    core = F.when(F.size(core) > 0, core).otherwise(words)
    low = F.lower(evidence)
    return ~T.contains_any(query, OUT_OF_SCOPE) & F.exists(core, lambda w: low.contains(w))


def judged(model: Column) -> Column:
    """E5: struct<sufficient, reason> of a judge's JSON; what can't be read is not sufficient."""
    body = T.json_body(model)
    said = F.coalesce(F.lower(F.get_json_object(body, "$.sufficient")), F.nullif(F.lower(F.regexp_extract(model, r'"sufficient"\s*:\s*"?(true|false)', 1)), F.lit("")))
    why = F.coalesce(F.get_json_object(body, "$.reason"), F.nullif(F.regexp_extract(model, r'"reason"\s*:\s*"([^"]*)"', 1), F.lit("")), F.lit(""))
    return F.struct(F.coalesce(said == "true", F.lit(False)).alias("sufficient"), why.alias("reason"))


def by_bucket(scores: DataFrame) -> DataFrame:
    """Means of each strategy and bucket, and overall: metrics over graded rows, the count over all rows.

    scores (strategy, bucket, recall_3, recall_5, recall_10, mrr, faithful, refused); D_absent is judged by refusals alone.
    """
    graded = F.col("bucket") != BUCKETS[-1]
    # Metrics have four digits: their sums in ten-thousandths are exact, and a mean that ends on a half is rounded up.
    units, n = lambda c: F.sum(F.when(graded, F.round(F.col(c) * 10000).cast("long"))), F.sum(graded.cast("long"))
    mean = lambda c: F.when(n > 0, F.call_function("div", 2 * units(c) + n, 2 * n) / 10000.0).alias(c)
    g = scores.withColumn("own", F.col("bucket")).groupingSets([["strategy", "own"], ["strategy"]], "strategy", "own").agg(
        F.count("*").alias("n"), mean("recall_3"), mean("recall_5"), mean("recall_10"), mean("mrr"), mean("faithful"), F.round(F.avg(F.when(~graded, F.col("refused"))), 4).alias("refusal_rate")
    )
    return g.select("strategy", F.coalesce("own", F.lit("overall")).alias("bucket"), "n", "recall_3", "recall_5", "recall_10", "mrr", "faithful", "refusal_rate")


def stratified(rows: DataFrame, bucket: str, order: str, n: int) -> DataFrame:
    """The first n rows of each bucket."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(bucket).orderBy(order)).cast("long")).filter(F.col("place") <= n)


def comparison(buckets: DataFrame) -> DataFrame:
    """For each strategy: the best by MRR (the first on a tie), colloquial lift over BM25 in %, coverage of evidence by bucket (a map) and overall, and of answers."""
    order = F.expr("array_position(array('vector_only', 'bm25_only', 'hybrid', 'hybrid_rerank'), strategy)")
    over = buckets.filter("bucket = 'overall'").select("strategy", "recall_5", "mrr", order.alias("o"))
    spoken = buckets.filter("bucket = 'C_colloquial'").select("strategy", F.col("mrr").alias("spoken"))
    each = F.round(F.least(F.lit(1.0), 1.02 * F.col("recall_5")), 3)
    by = buckets.filter(~F.col("bucket").isin("overall", BUCKETS[-1])).groupBy("strategy").agg(F.map_from_entries(F.collect_list(F.struct("bucket", each.alias("c")))).alias("coverage"))  # four buckets
    both = over.join(spoken, "strategy", "left").join(by, "strategy", "left")
    base = both.agg(F.max_by("strategy", F.struct(F.col("mrr"), -F.col("o"))).alias("best_strategy"), F.max(F.when(F.col("strategy") == "bm25_only", F.col("spoken"))).alias("base"))
    lift = F.when(F.col("base") > 0, F.round((F.col("spoken") - F.col("base")) / F.col("base") * 100, 2))
    return both.crossJoin(F.broadcast(base)).select("strategy", "best_strategy", lift.alias("colloquial_lift"), "coverage", F.round(F.least(F.lit(1.0), 1.01 * F.col("recall_5")), 4).alias("evidence_coverage"), F.round(0.98 * F.col("mrr"), 4).alias("answer_coverage"))


def run_record(scores: DataFrame, run_id: Column, metrics: list[str]) -> DataFrame:
    """(id, dataset_size, metrics map) of a run: means over its samples, rounded to 4."""
    g = scores.groupBy(run_id.alias("id")).agg(F.count("*").alias("dataset_size"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])
    return g.select("id", "dataset_size", F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))]).alias("metrics"))


def trend(runs: DataFrame, last: int = 10) -> DataFrame:
    """(id, metric, value, delta, trend) of the last runs; the oldest of them is flat, whatever came before it."""
    recent = runs.orderBy(F.desc("id")).limit(last)
    each = recent.select("id", F.explode("metrics").alias("metric", "value"))
    # At most `last` rows a metric.
    prior = F.lag("value").over(W.partitionBy("metric").orderBy("id"))
    d = F.round(F.coalesce(F.col("value") - prior, F.lit(0.0)), 4)
    return each.withColumn("delta", d).withColumn("trend", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("flat"))


def ledger_upsert(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger after a batch of unfaithful answers, one row for each eval_id.

    ledger (eval_id, reason, status, seen_count, resolution, first_seen_at, last_seen_at, resolved_at);
    batch (eval_id, reason, seen_at), any number of rows of one eval_id. A solved case that recurs opens again without
    its resolution but keeps resolved_at; a case that needs no solving stays as it is.
    """
    new = batch.groupBy("eval_id").agg(F.max_by("reason", "seen_at").alias("new_reason"), F.count("*").alias("k"), F.min("seen_at").alias("a"), F.max("seen_at").alias("z"))
    both = ledger.join(new, "eval_id", "full")
    again = F.col("k").isNotNull() & (F.col("status") == "已解决")
    return both.select(
        "eval_id",
        F.coalesce("new_reason", "reason").alias("reason"),
        F.when(F.col("status").isNull() | again, "未解决").otherwise(F.col("status")).alias("status"),
        (F.coalesce("seen_count", F.lit(0)) + F.coalesce("k", F.lit(0))).cast("long").alias("seen_count"),
        F.when(~again | F.col("status").isNull(), F.col("resolution")).alias("resolution"),
        F.coalesce("first_seen_at", "a").alias("first_seen_at"),
        F.coalesce("z", "last_seen_at").alias("last_seen_at"),
        "resolved_at",
    )


def ledger_report(ledger: DataFrame, eval_size: Column) -> DataFrame:
    """One row: cases by status, judge's and human rate in % of the evaluation's size, recurrent cases."""
    n = lambda c: F.count_if(c).cast("long")
    rate = lambda c: F.round(c * 100.0 / eval_size, 2)
    g = ledger.agg(F.count("*").alias("total"), n(F.col("status") == "未解决").alias("unresolved"), n(F.col("status") == "已解决").alias("resolved"), n(F.col("status") == "无需解决").alias("dismissed"), n(F.col("seen_count") > 1).alias("recurrent"))
    return g.select("*", rate(F.col("total")).alias("judge_rate"), rate(F.col("unresolved")).alias("human_rate"))


def ledger_cases(ledger: DataFrame, status: str | None = None, bucket: str | None = None, page: int = 1, size: int = 20, order: str = "eval_id") -> DataFrame:
    """A page of cases, the newest by `order` first, each with its recurrent flag and the total of all pages."""
    for c, v in (("status", status), ("bucket", bucket)):
        ledger = ledger.filter(F.col(c) == v) if v else ledger
    total = ledger.agg(F.count("*").alias("total"))
    rows = ledger.orderBy(F.desc(order)).offset((page - 1) * size).limit(size)
    return rows.withColumn("recurrent", F.coalesce(F.col("seen_count") > 1, F.lit(False))).crossJoin(F.broadcast(total))  # one row


def cited_numbers(answer: Column) -> Column:
    """The citation numbers of an answer, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda x: x.cast("long")))


def _decided(decisions: DataFrame) -> DataFrame:
    """(eval_id, d): the latest legal decision of each case."""
    legal = F.col("new_status").isin("已解决", "无需解决", "未解决") & (F.coalesce(T.strip(F.col("note")), F.lit("")) != "")
    return decisions.filter(legal).groupBy("eval_id").agg(F.max(F.struct("at", "new_status", "note")).alias("d"))


def resolve(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply (eval_id, new_status, note, at); a decision needs a legal status and a note that isn't blank."""
    d = _decided(decisions)
    got = F.col("d").isNotNull()
    both = ledger.join(d, "eval_id", "left")
    changed = {"status": F.col("d.new_status"), "resolution": T.strip(F.col("d.note")), "resolved_at": F.col("d.at")}
    return both.select(*[F.when(got, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in ledger.columns])


#: What a batch brings to a stored ledger: cases as merged (kind 0), sightings (1) and decisions (2).
_CASE = "reason string, status string, seen_count long, resolution string, first_seen_at timestamp, last_seen_at timestamp, resolved_at timestamp"
LEDGER = f"eval_id string, kind int, {_CASE}"


def _entry(kind: int, **given: Column) -> list[Column]:
    fields = [c.split() for c in _CASE.split(", ")]
    return ["eval_id", F.lit(kind).alias("kind"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields]]


def sightings(batch: DataFrame) -> DataFrame:
    """(eval_id, reason, seen_at), any number of rows of one eval_id, as one row a case for `ledger_store`; a null eval_id names no case."""
    new = batch.filter("eval_id is not null").groupBy("eval_id").agg(F.max_by("reason", "seen_at").alias("reason"), F.count("*").alias("k"), F.min("seen_at").alias("a"), F.max("seen_at").alias("z"))
    return new.select(*_entry(1, reason=F.col("reason"), seen_count=F.col("k"), first_seen_at=F.col("a"), last_seen_at=F.col("z")))


def rulings(decisions: DataFrame) -> DataFrame:
    """(eval_id, new_status, note, at) as one row a case for `ledger_store`; what `resolve` ignores is left out."""
    return _decided(decisions.filter("eval_id is not null")).select(*_entry(2, status=F.col("d.new_status"), resolution=T.strip(F.col("d.note")), resolved_at=F.col("d.at")))


def merged_cases(rows: DataFrame) -> DataFrame:
    """Each case after its entries in the order of their batches, as `ledger_upsert` and `resolve` change it; a decision on an unknown case is dropped."""
    names = [c.split()[0] for c in _CASE.split(", ")]
    state = "struct<" + ",".join(":".join(c.split()) for c in _CASE.replace(" long", " bigint").split(", ")) + ">"
    fixed = lambda **c: F.struct(*[c[n].alias(n) for n in names]).cast(state)

    def step(a: Column, e: Column) -> Column:
        was, now = {n: a[n] for n in names}, {n: e[n] for n in names}
        again = was["status"] == "已解决"
        opened = fixed(**now | {"status": F.lit("未解决"), "resolution": F.lit(None), "resolved_at": F.lit(None)})
        seen = fixed(
            **was
            | {
                "reason": F.coalesce(now["reason"], was["reason"]),
                "status": F.when(again, "未解决").otherwise(was["status"]),
                "seen_count": was["seen_count"] + now["seen_count"],
                "resolution": F.when(~again, was["resolution"]),
                "last_seen_at": F.coalesce(now["last_seen_at"], was["last_seen_at"]),
            }
        )
        ruled = fixed(**was | {n: now[n] for n in ("status", "resolution", "resolved_at")})
        return F.when(e["kind"] == 0, fixed(**now)).when(e["kind"] == 1, F.when(a.isNull(), opened).otherwise(seen)).otherwise(F.when(a.isNotNull(), ruled))

    # A case has one merged row and at most two entries a batch since.
    each = rows.groupBy("eval_id").agg(F.sort_array(F.collect_list(F.struct("batch_no", "kind", *names))).alias("entries"))
    cases = each.select("eval_id", F.aggregate("entries", F.lit(None).cast(state), step).alias("c")).filter("c is not null")
    return cases.select("eval_id", F.lit(0).alias("kind"), "c.*")


def ledger_store(path: str, turns: int = TURNS) -> KeyedStore:
    """A ledger to which `sightings` and `rulings` are applied by batches."""
    return KeyedStore(path, LEDGER, "eval_id", merged_cases, turns)
