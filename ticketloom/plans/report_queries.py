"""Queries of costs, audits, ledgers and runs, on the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import MISSED, STATUS
from ..operators import evaluation as E
from ..operators import observability as O
from ..sources import io
from ..sources.store import KeyedStore, newest
from .tables import Registry, read

QUERIES = Registry()
add = QUERIES.add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


@add(
    "o1_cost_by_intent",
    """with x as (select case when event_type = 'error' then 'UNKNOWN' else event_type end as intent, user_id as p, floor(value)::bigint as c from events),
    g as (select intent, count(*) as calls, sum(p)::bigint as prompt_tokens, sum(c)::bigint as completion_tokens from x group by 1)
    select *, prompt_tokens + completion_tokens as total_tokens, round(prompt_tokens * 2.5::double / 1e6 + completion_tokens * 10::double / 1e6, 6) as cost_usd, round((prompt_tokens + completion_tokens) * 100.0::double / sum(prompt_tokens + completion_tokens) over (), 2) as share from g""",
)
def o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces = events(spark, sf_dir).select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("intent"), F.col("user_id").alias("prompt_tokens"), F.floor("value").alias("completion_tokens"))
    return O.cost_by_intent(traces)


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    args = F.when(F.col("event_id") % 3 == 0, F.lit("plain")).otherwise(F.col("props"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("conversation_id"), F.col("event_type").alias("tool_name"), args.alias("arguments"), F.repeat(F.col("props"), 60).alias("result_summary"), F.repeat(F.col("event_type"), 120).alias("error_message"))


@add(
    "o2_audit_rows",
    """select event_id as id, case when event_id % 3 = 0 then '{"raw":"plain"}' else props end as arguments, substr(repeat(props, 60), 1, 500) as result_summary, substr(repeat(event_type, 120), 1, 512) as error_message from events""",
)
def o2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.audit_rows(audits(spark, sf_dir)).select("id", "arguments", "result_summary", "error_message")


@add("o3_latest_audit", "select user_id as conversation_id, max(event_id) as id, arg_max(event_type, event_id) as tool_name from events where event_type in ('click', 'view') group by 1")
def o3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.latest_audit(audits(spark, sf_dir), ["click", "view"]).select("conversation_id", "id", "tool_name")


_CODES = list(STATUS)
_CODES_SQL = "[" + ", ".join(f"'{c.lower()}'" for c in _CODES) + "]"
_WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in STATUS.values()) + "]"


@add("o5_status_words", f"select o_orderkey, case when o_orderkey % 22 = 20 then '已发货' when o_orderkey % 22 = 21 then o_orderstatus else {_WORDS_SQL}[o_orderkey % 22 + 1] end as said from orders")
def o5(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("o_orderkey") % 22).cast("int")
    code = F.when(k == 20, " 1 ").when(k == 21, F.col("o_orderstatus")).otherwise(F.concat(F.lit(" "), F.lower(F.element_at(F.array(*map(F.lit, [*_CODES, "", ""])), k + 1))))
    return read(spark, sf_dir, "orders").select("o_orderkey", O.translated(code, True).alias("said"))


@add(
    "o5_status_json",
    f"""with o as (select o_orderkey as k, o_orderkey % 22 as n, o_custkey as c, o_orderstatus as s from orders)
    select k as o_orderkey, case n % 3 when 0 then '{{"id": ' || k || ', "order": {{"Status": ' || case when n < 11 then '"已发货"' else '2' end || ', "count": 1, "log": [{{"state": ["已发货", "' || s || '"]}}, "' || {_WORDS_SQL}[least(n, 19) + 1] || '"]}}}}'
     when 1 then '["' || {_WORDS_SQL}[least(n, 19) + 1] || '", 1, ' || c || '.5, null, true]' else ' {{broken ' || k end as said from o""",
)
def o5j(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 22
    code = F.lower(F.element_at(F.array(*map(F.lit, _CODES)), (F.least(n, F.lit(19)) + 1).cast("int")))
    deep = F.concat(F.lit('{"id":'), k, F.lit(',"order":{"Status":'), F.when(n < 11, F.when(n % 2 == 0, "1").otherwise('" 1"')).otherwise("2"), F.lit(',"count":1,"log":[{"state":[1,"'), F.col("o_orderstatus"), F.lit('"]}, " '), code, F.lit(' "]}}'))
    flat = F.concat(F.lit('["'), code, F.lit('",1,'), F.col("o_custkey"), F.lit(".5,null,true]"))
    raw = F.when(n % 3 == 0, deep).when(n % 3 == 1, flat).otherwise(F.concat(F.lit(" {broken "), k))
    return read(spark, sf_dir, "orders").select("o_orderkey", O.translated_json(raw).alias("said"))


@add("o6_missed_results", f"""select event_id, event_id % 5 in (0, 1, 2) or (event_id % 5 = 4 and ({' or '.join(f"contains(props, '{m}')" for m in MISSED)})) as missed from events""")
def o6(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "{}").when(k == 1, '{"found": false}').when(k == 2, "查询完毕，未找到").when(k == 3, '{"total": 3}').otherwise(F.col("props"))
    return events(spark, sf_dir).select("event_id", O.missed(raw).alias("missed"))


def day_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    rows = events(spark, sf_dir).select(day.alias("day"), (F.col("value") / 100).alias("mrr"), (F.col("user_id") % 2).cast("double").alias("recall"))
    return E.run_record(rows, F.col("day"), ["mrr", "recall"])


_RUNS = "runs as (select date_diff('day', date '2024-01-01', ts::date) as id, count(*) as dataset_size, round(avg(value / 100), 4) as mrr, round(avg((user_id % 2)::double), 4) as recall from events group by 1)"


@add("e9_run_records", f"with {_RUNS} select id, dataset_size, mrr, recall from runs")
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_runs(spark, sf_dir).select("id", "dataset_size", F.col("metrics")["mrr"].alias("mrr"), F.col("metrics")["recall"].alias("recall"))


@add(
    "e10_run_trend",
    f"""with {_RUNS}, r as (select * from runs order by id desc limit 10), l as (select id, 'mrr' as metric, mrr as value from r union all select id, 'recall', recall from r),
    d as (select *, round(coalesce(value - lag(value) over (partition by metric order by id), 0), 4) as delta from l) select *, case when delta > 0 then 'up' when delta < 0 then 'down' else 'flat' end as trend from d""",
)
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.trend(day_runs(spark, sf_dir))


def ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cases of the first half of events as the ledger, those of the second half as a batch."""
    e = events(spark, sf_dir)
    empty = e.limit(0).select(F.col("user_id").cast("string").alias("eval_id"), F.col("props").alias("reason"), F.lit("").alias("status"), F.lit(0).cast("long").alias("seen_count"), F.lit("").alias("resolution"), F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_seen_at"), F.col("ts").alias("resolved_at"))
    batch = e.select(F.col("user_id").cast("string").alias("eval_id"), F.concat_ws(":", "event_type", "event_id").alias("reason"), F.col("ts").alias("seen_at"), (F.col("event_id") % 2).alias("half"))
    first = E.ledger_upsert(empty, batch.filter("half = 0"))
    decided = E.resolve(first, first.select("eval_id", F.when(F.col("eval_id").cast("long") % 3 == 0, "已解决").when(F.col("eval_id").cast("long") % 3 == 1, "无需解决").otherwise("?").alias("new_status"), F.lit("done").alias("note"), F.col("last_seen_at").alias("at")))
    return decided, batch.filter("half = 1")


_LEDGER = """a as (select user_id::varchar as eval_id, arg_max(event_type || ':' || event_id, ts) as reason, count(*) as n, min(ts) as f, max(ts) as l from events where event_id % 2 = 0 group by 1),
b as (select user_id::varchar as eval_id, arg_max(event_type || ':' || event_id, ts) as reason, count(*) as n, min(ts) as f, max(ts) as l from events where event_id % 2 = 1 group by 1),
led as (select *, case eval_id::bigint % 3 when 0 then '已解决' when 1 then '无需解决' else '未解决' end as status from a),
after as (select eval_id, coalesce(b.reason, led.reason) as reason, case when led.status is null or (led.status = '已解决' and b.n is not null) then '未解决' else led.status end as status, coalesce(led.n, 0) + coalesce(b.n, 0) as seen_count,
 case when led.status = '无需解决' or (led.status = '已解决' and b.n is null) then 'done' end as resolution, coalesce(led.f, b.f) as first_seen_at, coalesce(b.l, led.l) as last_seen_at, case when led.status in ('已解决', '无需解决') then led.l end as resolved_at from led full join b using (eval_id))"""


@add("e11_ledger_upsert", f"with {_LEDGER} select eval_id, reason, status, seen_count::bigint as seen_count, resolution, epoch_us(first_seen_at) as first_us, epoch_us(last_seen_at) as last_us from after")
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, batch = ledger(spark, sf_dir)
    return E.ledger_upsert(old, batch).select("eval_id", "reason", "status", "seen_count", "resolution", F.unix_micros(F.col("first_seen_at").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_seen_at").cast("timestamp")).alias("last_us"))


@add(
    "e12_ledger_report",
    f"""with {_LEDGER}, g as (select count(*) as total, count_if(status = '未解决')::bigint as unresolved, count_if(status = '已解决')::bigint as resolved, count_if(status = '无需解决')::bigint as dismissed, count_if(seen_count > 1)::bigint as recurrent from after)
    select *, round(total * 100.0::double / 300, 2) as judge_rate, round(unresolved * 100.0::double / 300, 2) as human_rate from g""",
)
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, batch = ledger(spark, sf_dir)
    return E.ledger_report(E.ledger_upsert(old, batch), F.lit(300))


@add(
    "e12_ledger_cases",
    f"with {_LEDGER}, c as (select *, eval_id::bigint as n from after where status = '未解决') select eval_id, seen_count::bigint as seen_count, seen_count > 1 as recurrent, (select count(*) from c) as total from c order by n desc limit 20 offset 20",
)
def e12l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of open cases."""
    old, batch = ledger(spark, sf_dir)
    cases = E.ledger_upsert(old, batch).withColumn("id", F.col("eval_id").cast("long"))
    return E.ledger_cases(cases, "未解决", None, 2, 20, "id").select("eval_id", "seen_count", "recurrent", "total")


@add("e12_cited_numbers", "select event_id, case when event_id % 2 = 0 then user_id || ',' || (user_id + 1) else user_id::varchar end as cited from events")
def e12c(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    said = F.concat(F.lit("见["), u, F.lit("]和["), F.when(F.col("event_id") % 2 == 0, u + 1).otherwise(u), F.lit("]，又["), u, F.lit("]"))
    return events(spark, sf_dir).select("event_id", F.array_join(F.transform(E.cited_numbers(said), lambda x: x.cast("string")), ",").alias("cited"))


@add("e13_ledger_resolution", f"with {_LEDGER} select eval_id, status, case when status <> '未解决' then 'done' end as resolution from led")
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir)[0].select("eval_id", "status", "resolution")


@add("s8_keyed_upsert", "select doc_id, case when doc_id % 3 = 0 then 'new' else 'old' end as chunk_text from documents")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id")
    old = d.select("doc_id", F.lit(1).alias("version"), F.lit("old").alias("chunk_text"))
    new = d.filter("doc_id % 3 = 0").select("doc_id", F.lit(2).alias("version"), F.lit(None).cast("string").alias("chunk_text"))
    return io.upserted(old, new, "doc_id", "version", F.lit("new")).select("doc_id", "chunk_text")


@add("s8_store_batches", "select doc_id, case when doc_id % 3 = 0 then 3 when doc_id % 3 = 1 and doc_id % 5 = 0 then 2 else 1 end::bigint as version, case when doc_id % 3 = 0 then 'third' when doc_id % 3 = 1 and doc_id % 5 = 0 then 'second' else 'first' end as chunk_text from documents")
def s8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches into a store: all documents, every fifth with a higher version, and every third: with one as high, later, or an older one that loses."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    batch = lambda rows, version, text: rows.select("doc_id", version.cast("long").alias("version"), F.lit(text).alias("chunk_text"))
    kept = KeyedStore(io.new_path(spark, "chunks"), "doc_id long, version long, chunk_text string", "doc_id", newest("doc_id", "version"), 4)
    batches = [
        batch(d, F.lit(1), "first"),
        batch(d.filter("doc_id % 5 = 0"), F.when(F.col("doc_id") % 3 < 2, 2).otherwise(0), "second"),
        batch(d.filter("doc_id % 3 = 0"), F.lit(3), "third"),
    ]
    for k, rows in enumerate(batches):
        kept.apply(rows, "load", k)
        kept.apply(rows, "load", k)  # comes again, changes nothing
    return kept.read(spark)


@add("e11_ledger_batches", f"with {_LEDGER} select eval_id, reason, status, seen_count::bigint as seen_count, resolution, epoch_us(first_seen_at) as first_us, epoch_us(last_seen_at) as last_us, epoch_us(resolved_at) as resolved_us from after")
def e11b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' first half, decisions on its cases, and its second half, as three batches of a stored ledger."""
    e = events(spark, sf_dir)
    seen = e.select(F.col("user_id").cast("string").alias("eval_id"), F.concat_ws(":", "event_type", "event_id").alias("reason"), F.col("ts").alias("seen_at"), (F.col("event_id") % 2).alias("half"))
    store = E.ledger_store(io.new_path(spark, "ledger"), 4)
    store.apply(E.sightings(seen.filter("half = 0")))
    n = F.col("eval_id").cast("long") % 3
    store.apply(E.rulings(store.read(spark).select("eval_id", F.when(n == 0, "已解决").when(n == 1, "无需解决").otherwise("?").alias("new_status"), F.lit("done").alias("note"), F.col("last_seen_at").alias("at"))))
    store.apply(E.sightings(seen.filter("half = 1")))
    us = lambda c: F.unix_micros(F.col(c))
    return store.read(spark).select("eval_id", "reason", "status", "seen_count", "resolution", us("first_seen_at").alias("first_us"), us("last_seen_at").alias("last_us"), us("resolved_at").alias("resolved_us"))
