"""Queries of conversation context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import BUDGET, COLLOQUIAL, GREETING_STARTS, GREETINGS, INTENT_ROUTES, REWRITE_PREFIXES
from ..operators import context as C
from .label_queries import strip_sql
from .tables import Registry, read

QUERIES = Registry()
add = QUERIES.add


def tokens_sql(c: str) -> str:
    """Tokens of texts whose wide characters are Han, kana, Hangul or full-width; the given tables hold none beyond these and the seven marks."""
    wide = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}“”‘’—…·]"
    space = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]"
    return f"coalesce((length({c}) - length(regexp_replace({c}, '{wide}', '', 'g')))::bigint + ceil(length(regexp_replace(regexp_replace({c}, '{wide}', '', 'g'), '{space}', '', 'g')) / 3.5)::bigint, 0)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


@add("c1_token_estimate", f"select doc_id, {tokens_sql('text')} as tokens from documents")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


_CALL = "'{\"name\":\"query_faq\",\"turn\":' || turn || '}'"


@add("c2_message_tokens", f"select conv_id, turn, {tokens_sql('text')} + case when role = 'assistant' then 2 * {tokens_sql(_CALL)} else 0 end as tokens from conversations")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.concat(F.lit('{"name":"query_faq","turn":'), F.col("turn"), F.lit("}"))
    calls = F.when(F.col("role") == "assistant", F.concat(F.lit("["), call, F.lit(","), call, F.lit("]")))
    return messages(spark, sf_dir).select("conv_id", "turn", C.message_tokens(F.col("text"), calls).alias("tokens"))


_FIXED = "(1500 + 5 * 500 + 250 + 500 + 2000 + 2000)"


@add(
    "c3_budget",
    f"""with x as (select distinct 8000 + user_id * 100 as w from events), a as (select w, w - {_FIXED} - 3600 as available from x), b as (select *, least(10000, greatest(0, available)) as h from a)
    select w::bigint as model_context_window, available::bigint as available, h::bigint as history, case when h = 5650 then 3954 else h - floor(h * 0.3) end::bigint as layer1, case when h = 5650 then 1695 else floor(h * 0.3) end::bigint as layer2, available >= 500 as usable from b""",
)
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = read(spark, sf_dir, "events").select((F.col("user_id") * 100 + 8000).alias("model_context_window")).distinct()
    for k, v in BUDGET.items():
        if k != "model_context_window":
            configs = configs.withColumn(k, F.lit(v).cast("long"))
    return C.budget(configs).select("model_context_window", *[F.col(c).cast("long").alias(c) for c in ("available", "history", "layer1", "layer2")], "usable")


_UPTO, _FROM = "conv_id % 3", "conv_id % 3 + 2"


@add("c4_layers", f"select conv_id, turn, case when turn <= {_UPTO} then 3 when turn <= {_FROM} then 2 else 1 end::bigint as layer from conversations")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("conv_id", "turn", C.layer(F.col("turn"), F.col("conv_id") % 3, F.col("conv_id") % 3 + 2).alias("layer"))


@add(
    "c5_layer1_anchor",
    f"""with t as (select conv_id, turn, {tokens_sql('text')} as tok from conversations), s as (select *, sum(tok) over (partition by conv_id order by turn desc) as suffix from t)
    select conv_id as conversation, max(turn) filter (suffix > 200) as anchor, coalesce(max(suffix) filter (suffix <= 200), 0)::bigint as kept_tokens from s group by 1""",
)
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.layer1_anchor(messages(spark, sf_dir), "conv_id", "turn", T.estimated_tokens(F.col("text")), F.lit(200))


@add(
    "c5_moved_anchor",
    f"""with t as (select conv_id, turn, {tokens_sql('text')} as tok, case when conv_id % 3 > 0 then conv_id % 3 end as was, case when conv_id % 2 = 0 then 1 + conv_id % 5 end as summed from conversations),
    s as (select *, sum(tok) over (partition by conv_id order by turn desc) as suffix from t where turn > coalesce(was, 0) and turn > case when was is null then 0 else coalesce(summed, 0) end or was is null),
    a as (select conv_id, max(turn) filter (suffix > 200) as last, max(suffix) filter (suffix <= 200) as kept from s group by 1) select conv_id as conversation, coalesce(any_value(a.last), max(was))::bigint as anchor, coalesce(any_value(a.kept), 0)::bigint as kept_tokens from t left join a using (conv_id) group by 1""",
)
def c5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three conversations have an anchor already, half of them a summary too, up to before or behind it."""
    m = messages(spark, sf_dir)
    was = m.filter("conv_id % 3 > 0").select(F.col("conv_id").alias("conversation"), (F.col("conv_id") % 3).cast("long").alias("layer1_from"), F.when(F.col("conv_id") % 2 == 0, F.col("conv_id") % 5 + 1).cast("long").alias("summary_upto")).distinct()
    got = C.layer1_anchor(m, "conv_id", "turn", T.estimated_tokens(F.col("text")), F.lit(200), was)
    return got.withColumn("anchor", F.col("anchor").cast("long"))


@add("c6_layer2_text", "select conv_id, turn, case when role = 'assistant' and length(text) > 60 then substr(text, 1, 60) || '...' else text end as shown from conversations")
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("conv_id", "turn", C.layer2_text(F.col("role"), F.col("text")).alias("shown"))


_LINE = "case when role = 'assistant' then '客服: ' else '用户: ' end"


@add(
    "c7_history_text",
    f"select conv_id as conversation, '历史摘要: ' || conv_id || chr(10) || string_agg({_LINE} || text, chr(10) order by turn) as history from conversations where role <> 'system' and {strip_sql('text')} <> '' group by 1",
)
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.history_text(messages(spark, sf_dir), "conv_id", "turn", "role", "text", F.col("conv_id").cast("string"))


@add(
    "c8_assembled",
    f"""with h as (select conv_id, string_agg({_LINE} || text, chr(10) order by turn) as l1 from conversations where role <> 'system' and {strip_sql('text')} <> '' group by 1), s as (select conv_id, max(text) filter (role = 'system') as sys, arg_max(text, turn) filter (role = 'user') as q from conversations group by 1)
    select conv_id as conversation, concat_ws(chr(10) || chr(10), nullif(sys, ''), nullif(l1, ''), nullif(q, '')) as context from h join s using (conv_id)""",
)
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    s = m.groupBy(F.col("conv_id").alias("conversation")).agg(F.max(F.when(F.col("role") == "system", F.col("text"))).alias("system"), F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("query"))
    h = C.history_text(m, "conv_id", "turn", "role", "text").withColumnRenamed("history", "layer1")
    return C.assembled(s.join(h, "conversation").withColumn("layer2", F.lit("")).withColumn("evidence", F.lit(None).cast("string")))


@add(
    "c9_recent_window",
    f"""with m as (select conv_id, turn, role, {strip_sql('text')} as t, last_value({strip_sql('text')}) over w as lastt, row_number() over (partition by conv_id order by turn desc) as r from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and unbounded following)),
    q as (select conv_id, arg_max({strip_sql('text')}, turn) filter (role = 'user') as q from conversations group by 1), a as (select m.*, row_number() over (partition by conv_id order by turn desc) as r2 from m join q using (conv_id) where not (r = 1 and t = q))
    select conv_id as conversation, string_agg({_LINE} || t, chr(10) order by turn) as window from a where r2 <= 8 and t <> '' and role <> 'system' group by 1""",
)
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    q = m.groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("q"))
    return C.recent_window(m.join(q, "conv_id"), "conv_id", "turn", "role", "text", F.coalesce("q", F.lit("")))


@add(
    "c10_trimmed_history",
    """with m as (select *, case when role = 'system' then 0 else length(text) // 2 + 4 end as t from conversations), s as (select *, sum(t) over (partition by conv_id order by turn desc) as suf from m),
    f as (select *, suf <= 150 and role <> 'system' as fits from s), g as (select *, min(turn) filter (fits and role = 'user') over (partition by conv_id) as st from f) select conv_id, turn, role from g where role = 'system' or (fits and turn >= st)""",
)
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.trimmed(messages(spark, sf_dir), "conv_id", "turn", "role", C.fallback_tokens(F.col("text")), 150).select("conv_id", "turn", "role")


@add(
    "c11_summary_ranges",
    f"""with m as (select conv_id, turn, {tokens_sql('text')} as tok from conversations where turn > conv_id % 3 and turn <= conv_id % 3 + 2) select conv_id as conversation, min(turn) as from_id, max(turn) as upto_id, sum(tok)::bigint as tokens from m group by 1 having sum(tok) > 100""",
)
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).select(F.col("conv_id").alias("conversation"), F.col("turn").alias("id"), T.estimated_tokens(F.col("text")).alias("tokens"))
    states = m.select("conversation").distinct().select("conversation", (F.col("conversation") % 3).alias("prev_upto"), (F.col("conversation") % 3 + 2).alias("layer1_from"))
    return C.summary_ranges(m, states, 100)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = messages(spark, sf_dir).filter("role = 'assistant'").select(F.col("conv_id").alias("conversation"), F.col("turn").alias("from_id"), F.col("turn").alias("upto_id"), F.col("text").alias("content"))
    none = a.filter("false").withColumn("seq", F.lit(0).cast("long"))
    first = C.append_summaries(none, a.filter("from_id < 3"))
    return C.append_summaries(first, a.filter("from_id >= 3"))


@add("c12_summaries", "select conv_id as conversation, string_agg(text, chr(10) || chr(10) order by turn) as summary, max(turn) as upto from conversations where role = 'assistant' group by 1")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.summary_text(summaries(spark, sf_dir))


@add(
    "c13_conversation_list",
    f"""with m as (select conv_id, count(*) as messages, max(turn) as updated, arg_min(text, turn) filter (role = 'user') as first from conversations group by 1)
    select conv_id % 7 as "user", conv_id as conversation, case conv_id % 4 when 0 then '已结束' when 1 then '已转人工' else '进行中' end as status, messages, coalesce(nullif(substr({strip_sql('first')}, 1, 25), ''), '新会话') as title, conv_id % 3 = 0 or conv_id % 5 = 0 as has_summary, updated from m""",
)
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, i = messages(spark, sf_dir), F.col("conversation")
    status = F.when(i % 4 == 0, "已结束").when(i % 4 == 1, "已转人工").when(i % 4 == 2, "进行中")
    rows = m.groupBy(F.col("conv_id").alias("conversation")).agg(F.max("turn").alias("updated"))
    rows = rows.select("conversation", (i % 7).alias("user"), status.alias("status"), F.when(i % 3 == 0, "s").when(i % 3 == 1, " ").alias("summary"), F.when(i % 5 == 0, 4).when(i % 5 == 1, 0).alias("summary_upto"), "updated")
    return C.conversation_list(rows, m, "conv_id", "turn", "role", "text")


@add("c14_timeline", "select conv_id, turn, case when role = 'assistant' then 'query_faq' end as tool from conversations")
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("tool_calls", F.when(F.col("role") == "assistant", F.lit('[{"name":"query_faq","args":"{}","id":"c1"}]')))
    return C.timeline(m).select("conv_id", "turn", F.try_element_at("tool_calls", F.lit(1))["name"].alias("tool"))


@add("c15_purge", "select conv_id, turn from conversations where conv_id % 4 <> 0")
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return C.purge(m, m.filter("conv_id % 4 = 0").select("conv_id"), "conv_id").select("conv_id", "turn")


@add("c15_unlink", "select o_orderkey, case when o_custkey % 4 <> 0 then o_custkey end as o_custkey from orders")
def c15u(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return C.unlink(o, o.filter("o_custkey % 4 = 0").select("o_custkey"), "o_custkey").select("o_orderkey", "o_custkey")


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_ASKED = f"asked as (select conv_id, turn, case turn % 4 when 0 then '你好' || substr(text, 1, conv_id::int % 4) when 1 then '谢谢！' when 2 then '这个' || substr(text, 1, 8) else text end as q from conversations)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = F.col("text"), F.col("turn") % 4
    return messages(spark, sf_dir).select("conv_id", "turn", F.when(n == 0, F.concat(F.lit("你好"), F.substring(t, F.lit(1), (F.col("conv_id") % 4).cast("int")))).when(n == 1, "谢谢！").when(n == 2, F.concat(F.lit("这个"), F.substring(t, 1, 8))).otherwise(t).alias("q"))


_GREET = f"(regexp_replace({strip_sql('q')}, '[!！?？~～呀啊吧呢哦]+$', '') in ({_quoted(GREETINGS)}) or {' or '.join(f'''(starts_with(q, '{g}') and length(q) <= {len(g) + 2})''' for g in GREETING_STARTS)})"


@add("c16_greetings", f"with {_ASKED} select conv_id, turn, {_GREET} as greeting, not {_GREET} and ({' or '.join(f'''contains(q, '{w}')''' for w in COLLOQUIAL)}) as rewrite from asked")
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("conv_id", "turn", C.is_greeting(F.col("q")).alias("greeting"), C.needs_rewrite(F.col("q")).alias("rewrite"))


# A model's wording: a prefix, quotes of either kind, a fence around quotes, or a prefix before quotes, which then stay.
@add(
    "c17_clean_rewrite",
    f"""with x as (select conv_id, turn, {strip_sql('text')} as t, (conv_id + turn) % 5 as n from conversations where not regexp_matches({strip_sql('text')}, '^["''“‘]|["''”’]$'))
    select conv_id, turn, case when n = 4 then '“' || t || '”' else t end as clean from x""",
)
def c17(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n, turn = T.strip(F.col("text")), (F.col("conv_id") + F.col("turn")) % 5, F.col("turn")
    prefix = F.element_at(F.array(*map(F.lit, REWRITE_PREFIXES)), (turn % len(REWRITE_PREFIXES) + 1).cast("int"))
    wrap = lambda a, b: F.concat(F.lit(a), t, F.lit(b))
    said = F.when(n == 0, F.concat(prefix, F.lit(" "), t)).when(n == 1, wrap(' "', '" ')).when(n == 2, wrap("“", "”")).when(n == 3, wrap('```\n"', '"\n```')).otherwise(F.concat(prefix, wrap("“", "”")))
    rows = messages(spark, sf_dir).filter(~t.rlike("^[\"'“‘]|[\"'”’]$"))
    return rows.select("conv_id", "turn", C.clean_rewrite(said).alias("clean"))


_INTENT = "case event_type when 'click' then '物流' when 'view' then '售后' when 'error' then '坏' else '闲聊' end"


@add("c18_intent_cascade", f"select event_id, case when value < 40 then '投诉' when event_type = 'error' then '投诉' else {_INTENT} end as intent from events")
def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    name = F.when(e == "click", "物流").when(e == "view", "售后").when(e == "error", "坏").otherwise("闲聊")
    small = F.concat(F.lit('```json\n{"intent": "'), name, F.lit('", "confidence": '), F.when(F.col("value") < 40, "0.5").otherwise("0.9"), F.lit("}\n```"))
    x = read(spark, sf_dir, "events").select("event_id", C.parsed_intent(small).alias("s"), C.parsed_intent(F.lit('{"intent": "投诉"}')).alias("l"))
    return x.select("event_id", C.cascade(F.col("s"), F.col("l"))["intent"].alias("intent"))


_ROUTE = "case " + " ".join(f"when intent = '{k}' then '{v}'" for k, v in INTENT_ROUTES.items()) + " else 'other_fallback' end"


@add("c19_routes", f"with x as (select event_id, {_INTENT} as intent from events) select event_id, {_ROUTE} as route from x")
def c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    name = F.when(e == "click", "物流").when(e == "view", "售后").when(e == "error", "坏").otherwise("闲聊")
    return read(spark, sf_dir, "events").select("event_id", C.route(name).alias("route"))


@add("c20_order_id", "select o_orderkey, case o_orderkey % 3 when 0 then 'TB' || o_orderkey when 1 then o_orderkey::varchar else case when length(o_orderkey::varchar) >= 4 then o_orderkey::varchar end end as found from orders")
def c20(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("我的TB"), k, F.lit("到哪了"))).when(k % 3 == 1, F.concat(F.lit("订单号是："), k, F.lit(" 退款3000元"))).otherwise(F.concat(F.lit("查 "), k, F.lit(" 谢谢")))
    return read(spark, sf_dir, "orders").select("o_orderkey", C.order_id(said).alias("found"))


@add(
    "c20_order_of_conversation",
    "with c as (select conv_id, max(turn) filter (role = 'user' and turn >= 2) as t from conversations group by 1) select conv_id as conversation, case when conv_id % 5 = 0 then '77' when t is not null then 'TB' || (1000 + t) end as order_id from c",
)
def c20o(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).select(F.col("conv_id").alias("conversation"), F.col("turn").alias("id"), "role", F.when(F.col("turn") >= 2, F.concat(F.lit("TB"), F.col("turn") + 1000)).otherwise("?").alias("content"))
    state = m.select("conversation").distinct().select("conversation", F.when(F.col("conversation") % 5 == 0, "77").alias("order_id"), F.lit(None).cast("string").alias("resolved"), F.lit("你好").alias("query"))
    return C.order_of(state, m)


@add(
    "c21_product_lookup",
    """with a as (select distinct asked from (select p_type as asked from part union all select p_partkey::varchar from part where p_partkey % 3 = 0 union all select 'see ' || p_name || ' ' || p_type || ' please' from part where p_partkey % 5 = 0)), p as (select p_partkey as id, p_name || ' ' || p_type as name from part)
    select asked, min(id) as id from a join p on contains(name, asked) or contains(asked, name) or lower(asked) = id::varchar group by 1""",
)
def c21(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.concat_ws(" ", "p_name", "p_type")
    asked = F.array_compact(F.array(F.col("p_type"), F.when(k % 3 == 0, k.cast("string")), F.when(k % 5 == 0, F.concat(F.lit("see "), name, F.lit(" please")))))
    return C.product_lookup(p.select(k.alias("id"), name.alias("name")), p.select(F.explode(asked).alias("asked")))


@add(
    "c21_order_lookup",
    "select case o_orderkey % 3 when 0 then ' ' || o_orderkey || ' ' when 1 then 'x' || o_orderkey else ' ' end as asked, case when o_orderkey % 3 = 0 then o_orderkey end as order_id, case when o_orderkey % 3 = 0 then o_orderstatus end as status, case when o_orderkey % 3 = 2 then '订单号不能为空' end as error from orders",
)
def c21o(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    asked = F.when(k % 3 == 0, F.concat(F.lit(" "), k, F.lit(" "))).when(k % 3 == 1, F.concat(F.lit("x"), k)).otherwise(" ")
    return C.order_lookup(o.select(k.alias("order_id"), F.col("o_orderstatus").alias("status")), o.select(asked.alias("asked")))


_VERDICTS = ["经核实，该订单不支持退款。", "您好，可点击下方“申请退款”按钮提交。", "**支持退款**。", "本商品不属于不支持退货的品类。可以退货。", "您好。", "超过7天。", "该商品已超出退换时效；", "您的商品在7天内！", "我们允许退换。", "不能退换。但可以退款。", "订单1002无法退货，但支持退款。", "可退。", "定制商品除外，并非无法退货。", "不支持七天。", "商品不予退换，抱歉。", ""]


def _any(c: str, patterns: list[str]) -> str:
    return "(" + " or ".join(f"regexp_matches({c}, '{p}')" for p in patterns) + ")"


def _holds(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


_EXEMPT = f"((contains(x, '{C.NOT_OF}') and {_holds('x', C.REFUSED)}) or ({_holds('x', C.EXCEPTIONS)} and {_holds('x', C.DENIED)}))"


@add(
    "c22_refund_verdict",
    f"""with r as (select conv_id, turn, {strip_sql(f"[{_quoted(_VERDICTS)}][(conv_id * 7 + turn) % {len(_VERDICTS)} + 1] || case when turn % 3 = 0 then text else '' end || case when turn % 2 = 0 then [{_quoted(_VERDICTS)}][(conv_id + turn * 5) % {len(_VERDICTS)} + 1] else '' end")} as t from conversations where role = 'assistant'),
    s as (select *, list_filter(string_split_regex(t, '{C.SENTENCE_BREAK}'), lambda x: {strip_sql('x')} <> '' and not {_EXEMPT}) as parts from r),
    v as (select *, coalesce(list_bool_or(list_transform(parts, lambda x: {_any('x', C.SENTENCE_NO)})), false) as no, coalesce(list_bool_or(list_transform(parts, lambda x: {_any('x', C.SENTENCE_YES)} and not {_any('x', [C.SENTENCE_NEGATED])})), false) as yes from s)
    select conv_id, turn, case when t = '' or {_any('t', C.REJECT_FIRST)} then false when {_any('t', [C.GUIDE.replace("'", "''")])} or {_any('t', C.APPROVE_FIRST)} then true when no <> yes then yes when {_holds('t', C.PHRASES_NO)} then false else {_holds('t', C.PHRASES_YES)} end as supported from v""",
)
def c22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply of the list, every third with the message behind it, every second with another reply at its end."""
    said = lambda i: F.element_at(F.array(*map(F.lit, _VERDICTS)), (i % len(_VERDICTS) + 1).cast("int"))
    c, turn = F.col("conv_id"), F.col("turn")
    reply = F.concat(said(c * 7 + turn), F.when(turn % 3 == 0, F.col("text")).otherwise(""), F.when(turn % 2 == 0, said(c + turn * 5)).otherwise(""))
    m = messages(spark, sf_dir).filter("role = 'assistant'")
    return m.select("conv_id", "turn", C.refund_supported(reply).alias("supported"))


@add(
    "c23_order_cards",
    """with i as (select l_orderkey, string_agg('part' || l_partkey || ' (数量: ' || l_quantity::bigint || ')', ', ' order by l_linenumber, 'part' || l_partkey, l_quantity::bigint::varchar) as items from lineitem group by 1)
    select o_orderkey as order_id, '【当前订单真实状态】' || chr(10) || '- 订单编号: ' || o_orderkey || chr(10) || '- 订单状态: ' || o_orderstatus || chr(10) || '- 支付金额: 未知' || chr(10) || '- 下单时间: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || '- 商品明细: ' || coalesce(items, '无明细') as card from orders left join i on o_orderkey = l_orderkey""",
)
def c23(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("part"), F.col("l_partkey")).alias("name"), F.col("l_quantity").cast("long").cast("string").alias("qty"), F.lit(None).cast("string").alias("price")))).alias("items"))
    o = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return C.order_card(o.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_time"), F.coalesce("items", F.expr("cast(array() as array<struct<l_linenumber:int,name:string,qty:string,price:string>>)")).alias("items")))
