"""Conversation context: token budgets, the three layers of a history, summaries, routing and reply rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import COLLOQUIAL, CORE_INTENTS, GREETING_STARTS, GREETINGS, INTENT_ROUTES, REWRITE_PREFIXES
from .retrieval import keyword_hits

#: Ids of a range of a conversation's messages.
RANGE_IDS = 4096
_NAMES = {"user": "用户", "assistant": "客服", "tool": "工具"}


def message_tokens(content: Column, tool_calls: Column | None = None) -> Column:
    """A message's tokens: its content, and each of its tool calls (a JSON array) as JSON text."""
    own = T.estimated_tokens(content)
    if tool_calls is None:
        return own
    calls = F.coalesce(F.from_json(tool_calls, "array<string>"), F.expr("cast(array() as array<string>)"))
    return own + F.aggregate(calls, F.lit(0).cast("long"), lambda a, c: a + T.estimated_tokens(c))


def budget(configs: DataFrame) -> DataFrame:
    """What a configuration leaves for history, and its split into layers; 5650 splits into 3954 and 1695 by rule."""
    c = F.col
    fixed = c("system_prompt_tokens") + c("rerank_top_k") * c("doc_tokens_per_chunk") + c("summary_max_tokens") + c("safety_margin_tokens") + c("max_output_tokens") + c("max_user_input_tokens")
    a = configs.withColumn("fixed", fixed).withColumn("peak", c("max_agent_steps") * c("tool_result_max_tokens")).withColumn("available", c("model_context_window") - c("fixed") - c("peak"))
    a = a.withColumn("history", F.least(c("target_history_turns") * c("steady_turn_tokens"), F.greatest(F.lit(0), c("available"))))
    second = F.when(c("history") == 5650, 1695).otherwise(F.floor(c("history") * 0.3)).cast("long")
    a = a.withColumn("layer2", second).withColumn("layer1", F.when(c("history") == 5650, 3954).otherwise(c("history") - c("layer2")).cast("long"))
    return a.withColumn("usable", c("available") >= c("steady_turn_tokens"))


def layer(message_id: Column, summary_upto: Column, layer1_from: Column) -> Column:
    """C4: 3 up to the summary's end, 2 up to the anchor, else 1; a message without id is new, so 1."""
    return F.when(message_id <= summary_upto, 3).when(message_id <= layer1_from, 2).otherwise(1).cast("long")


def layer1_anchor(messages: DataFrame, conversation: str, order: str, tokens: Column, most: Column, anchors: DataFrame | None = None) -> DataFrame:
    """(conversation, anchor, kept_tokens): the last message that must leave layer 1 for the rest to fit; null if all fit.

    anchors (conversation, layer1_from[, summary_upto]): what had left before, or is in a summary; messages up to there are
    not of layer 1, and the anchor stays where nothing more must leave.

    Sums of ranges of ids come first, then sums within a range, so a conversation is not one task: a window holds the ranges
    of a conversation, or the messages of a range.
    """
    m = messages.select(F.col(conversation).alias("conversation"), F.col(order).alias("o"), tokens.alias("tok"), most.alias("most"))
    kind = dict(m.dtypes)["o"]
    if anchors is None:
        m = m.withColumn("was", F.lit(None).cast(kind)).withColumn("out", F.lit(None).cast(kind))
    else:
        summed = F.col("summary_upto") if "summary_upto" in anchors.columns else F.lit(None).cast(kind)
        m = m.join(anchors.select("conversation", F.col("layer1_from").alias("was"), F.greatest("layer1_from", summed).alias("out")), "conversation", "left")
    here = F.col("out").isNull() | (F.col("o") > F.col("out"))
    s = newer_sums(m.withColumn("here", here), "conversation", "o", F.when(F.col("here"), F.col("tok")).otherwise(0), "suffix")
    last = F.max(F.when(F.col("here") & (F.col("suffix") > F.col("most")), F.col("o")))
    kept = F.max(F.when(F.col("here") & (F.col("suffix") <= F.col("most")), F.col("suffix")))
    return s.groupBy("conversation").agg(F.coalesce(last, F.max("was")).alias("anchor"), F.coalesce(kept, F.lit(0)).alias("kept_tokens"))


def newer_sums(rows: DataFrame, conversation: str, order: str, value: Column, name: str, width: int = RANGE_IDS) -> DataFrame:
    """`rows` with the sum of `value` over each row and all newer ones of its conversation; order: a whole number, different for each.

    Ids are cut into ranges of `width`. A range's own sum is a partial aggregate; a window adds up the sums of a
    conversation's newer ranges, and another the newer rows within a range.
    """
    r = rows.withColumn("_range", F.floor(F.col(order) / width)).withColumn("_value", value)
    sums = r.groupBy(conversation, "_range").agg(F.sum("_value").alias("_own"))
    newer = F.sum("_own").over(W.partitionBy(conversation).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(F.col(conversation).alias("_c"), F.col("_range").alias("_r"), F.coalesce(newer, F.lit(0)).alias("_newer"))
    both = r.join(sums, F.col(conversation).eqNullSafe(F.col("_c")) & F.col("_range").eqNullSafe(F.col("_r")))
    within = F.sum("_value").over(W.partitionBy(conversation, "_range").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(name, within + F.col("_newer")).drop("_range", "_value", "_c", "_r", "_newer")


def layer2_text(role: Column, content: Column, tool: Column | None = None) -> Column:
    """A user's words whole, 60 characters of a reply, a fixed line for a tool's result."""
    named = F.lit("[工具查询结果已由客服消化]") if tool is None else F.when(F.coalesce(tool, F.lit("")) != "", F.concat(F.lit("[工具查询: "), tool, F.lit(", 结果已由客服消化]"))).otherwise("[工具查询结果已由客服消化]")
    short = F.when(F.length(content) > 60, F.concat(F.substring(content, 1, 60), F.lit("..."))).otherwise(content)
    return F.when(role == "assistant", short).when(role == "tool", named).otherwise(content)


def _line(role: Column, content: Column) -> Column:
    name = reduce(lambda a, k: a.when(role == k, _NAMES[k]), list(_NAMES)[1:], F.when(role == "user", _NAMES["user"])).otherwise(_NAMES["user"])
    return F.concat(name, F.lit(": "), content)


def history_text(messages: DataFrame, conversation: str, order: str, role: str, content: str, summary: Column | None = None) -> DataFrame:
    """(conversation, history): lines in order, system messages left out, a summary first."""
    rows = messages.filter((F.col(role) != "system") & (F.coalesce(T.strip(F.col(content)), F.lit("")) != ""))
    g = rows.groupBy(F.col(conversation).alias("conversation")).agg(F.sort_array(F.collect_list(F.struct(F.col(order), _line(F.col(role), F.col(content)).alias("l")))).alias("ls"), (F.max(summary) if summary is not None else F.lit(None).cast("string")).alias("s"))
    lines = F.array_join(F.transform("ls", lambda x: x["l"]), "\n")
    return g.select("conversation", F.concat_ws("\n", F.when(F.coalesce("s", F.lit("")) != "", F.concat(F.lit("历史摘要: "), F.col("s"))), lines).alias("history"))


def assembled(parts: DataFrame) -> DataFrame:
    """(conversation, context): system, layer 2, layer 1, question and evidence, in this order; blank parts drop out."""
    order = ["system", "layer2", "layer1", "query", "evidence"]
    return parts.select("conversation", F.array_join(F.filter(F.array(*[F.col(c) for c in order]), lambda x: F.coalesce(x != "", F.lit(False))), "\n\n").alias("context"))


def recent_window(messages: DataFrame, conversation: str, order: str, role: str, content: str, query: Column, last: int = 8) -> DataFrame:
    """(conversation, window): the last turns before the current question, blank and system ones left out; an echo of the question at the end goes first."""
    w = W.partitionBy("conversation").orderBy(F.desc("o"))
    m = messages.select(F.col(conversation).alias("conversation"), F.col(order).alias("o"), F.col(role).alias("role"), T.strip(F.coalesce(F.col(content), F.lit(""))).alias("content"), T.strip(query).alias("q")).withColumn("r", F.row_number().over(w))
    m = m.filter(~((F.col("r") == 1) & (F.col("content") == F.col("q")))).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= last)
    m = m.filter((F.col("content") != "") & (F.col("role") != "system"))
    g = m.groupBy("conversation").agg(F.sort_array(F.collect_list(F.struct("o", _line(F.col("role"), F.col("content")).alias("l")))).alias("ls"))
    return g.select("conversation", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("window"))


def fallback_tokens(content: Column) -> Column:
    """Half the characters and four."""
    return (F.floor(F.length(content) / 2) + 4).cast("long")


def trimmed(messages: DataFrame, conversation: str, order: str, role: str, tokens: Column, most: int) -> DataFrame:
    """The newest messages that fit, from their first user turn on; system messages stay and aren't counted."""
    m = newer_sums(messages, conversation, order, F.when(F.col(role) == "system", 0).otherwise(tokens), "_newer_sum")
    m = m.withColumn("_fits", (F.col("_newer_sum") <= most) & (F.col(role) != "system"))
    start = m.filter(F.col("_fits") & (F.col(role) == "user")).groupBy(F.col(conversation).alias("_c")).agg(F.min(order).alias("_start"))
    m = m.join(start, F.col(conversation) == F.col("_c"), "left")
    return m.filter((F.col(role) == "system") | (F.col("_fits") & (F.col(order) >= F.col("_start")))).drop("_c", "_newer_sum", "_fits", "_start")


def summary_ranges(messages: DataFrame, states: DataFrame, most: int) -> DataFrame:
    """C11: (conversation, from_id, upto_id, tokens) of conversations whose layer 2 outgrows its budget.

    messages (conversation, id, tokens); states (conversation, prev_upto, layer1_from): the range that no summary covers.
    """
    s = messages.join(states, "conversation").filter("id > coalesce(prev_upto, 0) and id <= layer1_from")
    g = s.groupBy("conversation").agg(F.min("id").alias("from_id"), F.max("id").alias("upto_id"), F.sum("tokens").alias("tokens"))
    return g.filter(F.col("tokens") > most)


def append_summaries(summaries: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows (conversation, seq, from_id, upto_id, content); new ones follow the highest seq."""
    top = summaries.groupBy("conversation").agg(F.max("seq").alias("top"))
    n = F.row_number().over(W.partitionBy("conversation").orderBy("from_id"))
    add = new.join(top, "conversation", "left").withColumn("seq", (F.coalesce("top", F.lit(0)) + n).cast("long"))
    return summaries.unionByName(add.select(*summaries.columns))


def summary_text(summaries: DataFrame) -> DataFrame:
    """(conversation, summary, upto): contents in order of seq, a blank line between."""
    g = summaries.groupBy("conversation").agg(F.sort_array(F.collect_list(F.struct("seq", "content"))).alias("c"), F.max("upto_id").alias("upto"))
    return g.select("conversation", F.array_join(F.transform("c", lambda x: x["content"]), "\n\n").alias("summary"), "upto")


def conversation_list(conversations: DataFrame, messages: DataFrame, conversation: str, order: str, role: str, content: str) -> DataFrame:
    """(user, conversation, status, messages, title, has_summary, updated), each user's newest first: one aggregate, not a query for each row.

    conversations (conversation, user, status, summary, summary_upto, updated); the title is 25 characters of the first
    user text.
    """
    said = F.col(role) == "user"
    first = F.min_by(F.when(said, F.col(content)), F.when(said, F.col(order)))
    m = messages.groupBy(F.col(conversation).alias("conversation")).agg(F.count("*").alias("messages"), first.alias("first"))
    both = conversations.join(m, "conversation", "left")
    title = F.coalesce(F.nullif(F.substring(T.strip(F.col("first")), 1, 25), F.lit("")), F.lit("新会话"))
    summed = (F.coalesce(T.strip(F.col("summary")), F.lit("")) != "") | (F.coalesce("summary_upto", F.lit(0)) > 0)
    rows = both.select("user", "conversation", F.coalesce("status", F.lit("进行中")).alias("status"), F.coalesce("messages", F.lit(0)).alias("messages"), title.alias("title"), summed.alias("has_summary"), "updated")
    return rows.orderBy("user", F.desc("updated"), F.desc("conversation"))


def timeline(messages: DataFrame, tool_calls: str = "tool_calls") -> DataFrame:
    """C14: tool calls parsed; ordering is the reader's, by conversation and id."""
    return messages.withColumn(tool_calls, F.from_json(tool_calls, "array<struct<name:string,args:string,id:string>>"))


def purge(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose conversation isn't among `gone`."""
    return table.join(gone.select(F.col(key).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti")


def unlink(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """All rows; the key is null where its conversation is gone."""
    g = gone.select(F.col(key).alias("_gone")).distinct()
    return table.join(g, F.col(key) == F.col("_gone"), "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def is_greeting(query: Column) -> Column:
    """A greeting, particles at its end aside, or a beginning of one with two more characters at most."""
    bare = F.regexp_replace(T.strip(query), "[!！?？~～呀啊吧呢哦]+$", "")
    return bare.isin(GREETINGS) | reduce(lambda a, b: a | b, [query.startswith(g) & (F.length(query) <= len(g) + 2) for g in GREETING_STARTS])


def needs_rewrite(query: Column) -> Column:
    """Not a greeting, and it holds a colloquial or incomplete phrase."""
    return ~is_greeting(query) & T.contains_any(query, COLLOQUIAL)


def clean_rewrite(c: Column) -> Column:
    """C17: a model's rewording without fence, quotes and known beginnings. Each step uses the one before once, so the expression stays small."""
    c = F.regexp_replace(T.strip(c), "(?s)^```+(.*?)```+$", "$1")
    for pattern, kept in (("(?s)^(?:\"(.*)\"|'(.*)')$", "$1$2"), ("(?s)^(?:“(.*)”|‘(.*)’)$", "$1$2"), *((f"^{p}", "") for p in REWRITE_PREFIXES)):
        c = F.regexp_replace(T.strip(c), pattern, kept)
    return T.strip(c)


def parsed_intent(model: Column) -> Column:
    """struct<intent, confidence>: an unknown intent is 其他; without confidence 1; unreadable: 其他 with 0."""
    body = T.json_body(model)
    intent, conf = F.get_json_object(body, "$.intent"), F.get_json_object(body, "$.confidence").cast("double")
    ok = F.coalesce(intent.isin(*CORE_INTENTS), F.lit(False))
    return F.struct(F.when(ok, intent).otherwise("其他").alias("intent"), F.when(intent.isNull(), 0.0).otherwise(F.coalesce(conf, F.lit(1.0))).alias("confidence"))


def cascade(small: Column, large: Column, least: float = 0.85) -> Column:
    """The large model's answer where the small one is unsure or names no core intent."""
    return F.when((small["confidence"] < least) | ~small["intent"].isin(*CORE_INTENTS), large).otherwise(small)


def route(intent: Column) -> Column:
    """C19."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in INTENT_ROUTES.items() for x in kv])[intent], F.lit("other_fallback"))


#: How an order number is written, the first that matches counts.
ORDER_PATTERNS = [
    r"(?:退款)?(?:订单|单号)(?:编号|号)?(?:是|为)?[:：\s]*([A-Za-z0-9_-]+)",
    r"(?i)(?<![0-9a-zA-Z])(TB\d+)(?![0-9a-zA-Z])",
    r"(?<!\d)(100[1-3])(?!\d)",
    r"(?<!\d)(\d{4,})(?!\d|[年月号天分秒点时元块角毛件个支本双条台斤两克米折倍])",
]


def order_id(text: Column) -> Column:
    """C20: the order number of a text, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in ORDER_PATTERNS])


def order_of(state: DataFrame, messages: DataFrame) -> DataFrame:
    """C20: (conversation, order_id): given, else of the rewording, the question, or the newest user message that names one.

    state (conversation, order_id, resolved, query); messages (conversation, id, role, content).
    """
    said = messages.filter("role = 'user'").withColumn("found", order_id(F.col("content"))).filter("found is not null")
    last = said.groupBy("conversation").agg(F.max_by("found", "id").alias("said"))
    s = state.join(last, "conversation", "left")
    return s.select("conversation", F.coalesce(F.nullif(F.col("order_id"), F.lit("")), order_id(F.col("resolved")), order_id(F.col("query")), "said").alias("order_id"))


def product_lookup(products: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id): the first product (id, name) whose id is the text, or whose name holds it or lies in it.

    Names are searched for asked texts and asked texts for names, each in one pass or by rarest grams (`keyword_hits`); ids are joined.
    """
    a = asked.select("asked").filter("asked <> ''").distinct()
    within = keyword_hits(products.select("id", F.col("name").alias("text")), a.select(F.col("asked").alias("keyword")), 1).select(F.col("keyword").alias("asked"), "id")
    names = products.filter("name <> ''").groupBy("name").agg(F.min("id").alias("first"))
    around = keyword_hits(a.select(F.col("asked").alias("id"), F.col("asked").alias("text")), names.select(F.col("name").alias("keyword")))
    around = around.join(names, F.col("keyword") == F.col("name")).select(F.col("id").alias("asked"), F.col("first").alias("id"))
    exact = products.select("id", F.lower(F.col("id").cast("string")).alias("k")).join(a.withColumn("k", F.lower("asked")), "k").select("asked", "id")
    return within.unionByName(around).unionByName(exact).groupBy("asked").agg(F.min("id").alias("id"))


def order_lookup(orders: DataFrame, asked: DataFrame, key: str = "order_id") -> DataFrame:
    """(asked, the order's columns, error): each asked number, blanks aside, with its order; an error where it is blank, nulls where there is none."""
    a = asked.select("asked").withColumn("k", F.coalesce(T.strip(F.col("asked")), F.lit("")))
    o = orders.withColumn("k", F.col(key).cast("string"))
    found = a.filter("k <> ''").join(o, "k", "left").drop("k").withColumn("error", F.lit(None).cast("string"))
    return found.unionByName(a.filter("k = ''").drop("k").withColumn("error", F.lit("订单号不能为空")), allowMissingColumns=True)


#: Phrases that decide what a reply says about a refund, in the order in which they count.
REJECT_FIRST = [
    r"^\s*[*#\s]*不支持(?:申请|办理)?(?:退款|退货|退换|售后)",
    r"^\s*[*#\s]*(?:无法|不能|不可|不予)(?:办理|申请)?(?:退款|退货|退换)",
    r"^\s*[*#\s]*不符合(?:退款|退货|退换|售后|7天|七天)",
    r"(?:经核实|经核对|很抱歉|抱歉|非常抱歉)[^。\n]*?(?:不支持|无法|不能|不可)(?:办理|申请)?(?:退款|退货|退换)",
    r"(?:已超出|已超过|超过)(?:7天|七天|15天|十五天|售后|退货|退换)[^。\n]*?(?:不支持|无法|不能|不可)(?:退款|退货|退换)",
]
GUIDE = r"(?:点击|通过|在)下方.*?(?:“|\"|”)?申请退款(?:”|\"|')?.*?按钮|开启(?:了)?退款申请|点击下方.*?申请退款"
APPROVE_FIRST = [
    r"^\s*[*#\s]*支持(?:办理)?(?:退款|退货|退换|售后)",
    r"^\s*[*#\s]*(?:可以|可|允许)(?:办理|申请)?(?:退款|退货|退换)",
    r"^\s*[*#\s]*符合(?:7天|七天)?无理由(?:退货|退换)?",
    r"^\s*[*#\s]*符合(?:退款|退货|退换)条件",
]
SENTENCE_NO = [
    r"(?:本商品|该商品|该订单|您的订单|订单\s*\d+)[^，,。]*?(?:不支持|无法|不能|不可|不符合)(?:办理|申请)?(?:退款|退货|退换)",
    r"(?:不支持|无法|不能|不可)(?:办理|申请)?(?:退款|退货|退换)",
    r"超出(?:退货|退换|售后)时效",
    r"超过(?:7天|七天|15天|十五天)",
]
SENTENCE_YES = [
    r"(?:支持|可以|可|允许)(?:办理|申请)?(?:退款|退货|退换)",
    r"支持(?:7天|七天)",
    r"符合(?:7天|七天)?无理由(?:退款|退货|退换)",
    r"符合(?:退款|退货|退换)条件",
    r"在(?:7天|七天)无理由退货期内",
    r"在(?:7天|七天)内",
]
PHRASES_NO = ["不支持退", "不支持申请退", "无法退", "无法办理退", "无法申请退", "不能退", "不可退", "不予退", "不符合退", "拒绝退", "超出退货", "超出退换", "超过退货", "超过退换", "超出售后", "超过售后", "不满足退", "不满足7天", "超过7天", "无法支持", "不支持该"]
# Words that take a sentence out of the count: a double negation, or an exception with its negation.
NOT_OF, REFUSED = "不属于", ["不支持", "不可", "无法"]
EXCEPTIONS, DENIED = ["特殊品类", "除外", "免责", "例如定制", "定制商品"], ["不属于", "并非"]
SENTENCE_NEGATED = "(?:不|无法|不能|不可|不予)支持(?:7天|七天|退)"
SENTENCE_BREAK = "[。！!\n；;]+"
PHRASES_YES = ["支持退", "可以退", "符合退", "允许退", "申请退款", "办理退款", "可退", "支持7天", "支持七天"]


def refund_supported(reply: Column) -> Column:
    """Whether a reply supports a refund: leading refusal, guidance to the button, leading approval, sentences, phrases."""
    text = T.strip(reply)
    rlike = lambda c, ps: reduce(lambda a, b: a | b, [c.rlike(p) for p in ps])
    exempt = lambda s: (s.contains(NOT_OF) & T.contains_any(s, REFUSED)) | (T.contains_any(s, EXCEPTIONS) & T.contains_any(s, DENIED))
    parts = F.filter(F.split(text, SENTENCE_BREAK), lambda s: (T.strip(s) != "") & ~exempt(s))
    no = F.exists(parts, lambda s: rlike(s, SENTENCE_NO))
    yes = F.exists(parts, lambda s: rlike(s, SENTENCE_YES) & ~s.rlike(SENTENCE_NEGATED))
    verdict = F.when(rlike(text, REJECT_FIRST), False).when(text.rlike(GUIDE), True).when(rlike(text, APPROVE_FIRST), True)
    verdict = verdict.when(no & ~yes, False).when(yes & ~no, True).when(T.contains_any(text, PHRASES_NO), False).otherwise(T.contains_any(text, PHRASES_YES))
    return F.coalesce(F.when(text == "", False).otherwise(verdict), F.lit(False))


def order_card(orders: DataFrame) -> DataFrame:
    """(order_id, card): what the prompt says of an order; items array<struct<name, qty, price>>."""
    known = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("未知"))

    def item(x: Column) -> Column:
        more = F.concat_ws(", ", F.when(x["qty"].isNotNull(), F.concat(F.lit("数量: "), x["qty"])), F.when(F.coalesce(x["price"], F.lit("")) != "", F.concat(F.lit("单价: "), x["price"])))
        return F.concat(x["name"], F.when(more != "", F.concat(F.lit(" ("), more, F.lit(")"))).otherwise(""))

    items = F.when(F.size("items") > 0, F.array_join(F.transform("items", item), ", ")).otherwise("无明细")
    lines = [F.lit("【当前订单真实状态】"), F.concat(F.lit("- 订单编号: "), known("order_id")), F.concat(F.lit("- 订单状态: "), known("status")), F.concat(F.lit("- 支付金额: "), known("amount")), F.concat(F.lit("- 下单时间: "), known("order_time")), F.concat(F.lit("- 商品明细: "), items)]
    return orders.select("order_id", F.concat_ws("\n", *lines).alias("card"))
