"""Vocabularies and limits that results depend on, in their own order."""

# The classes of a question, in order, and their tiers with the F1 each must reach.
TAXONOMY = ["退换货", "物流", "尺码", "发票", "质量问题", "运费", "优惠活动", "价保", "支付", "订单修改", "库存补货", "商品信息", "保修维修", "账号", "会员积分", "评价", "其他"]
TIERS = {"strict": (TAXONOMY[:5], 0.90), "medium": (TAXONOMY[5:13], 0.80), "loose": (TAXONOMY[13:], None)}
OTHER = "其他"
CORE_CLASSES = 13
# What tells neighbouring classes apart; pairs (missed, extra) first, then a class alone.
BOUNDARIES = {
    ("保修维修", "退换货"): "修归保修维修、退归退换货",
    ("退换货", "保修维修"): "修归保修维修、退归退换货",
    ("物流", "运费"): "物流管货、运费管钱",
    ("运费", "物流"): "运费管钱、物流管货",
    ("价保", "优惠活动"): "价保是补差价、优惠活动是券和满减",
    ("优惠活动", "价保"): "优惠活动是券和满减、价保是补差价",
}
# Intents and where each goes.
INTENT_ROUTES = {"闲聊": "chitchat", "投诉": "complaint", "其他": "other_fallback", "商品咨询": "knowledge", "退款退货": "refund_subflow", "售后": "refund_subflow", "物流": "business_data", "订单": "business_data", "人工": "business_data"}
CORE_INTENTS = ["物流", "订单", "商品咨询", "退款退货", "售后", "投诉", "闲聊", "人工"]
# Greetings, their beginnings, and phrases that need their context.
GREETINGS = ["你好", "您好", "在吗", "在不在", "有人吗", "哈喽", "hello", "hi", "早", "早上好", "下午好", "晚上好", "谢谢", "多谢", "感谢", "再见", "拜拜"]
GREETING_STARTS = ["你好", "您好", "早安", "晚安", "哈喽", "嗨"]
COLLOQUIAL = ["老铁", "咋样", "走哪了", "到哪了", "算求", "这玩意", "这东西", "咋回事", "咋办", "能退吗", "发货没", "发了吗", "它", "这个", "那件", "前一个", "刚才那个", "那单"]
REWRITE_PREFIXES = ["改写后的提问：", "改写后的问题：", "改写后：", "改写结果：", "规范化提问：", "输出：", "改写："]
# Phrases that mark a key clause.
KEY_CLAUSES = ["【重要提示】", "【特别说明】", "【注意】", "【不可退换】", "重要提示", "特别说明", "不可退换", "不支持"]
# Signs that end a sentence and those that close one.
SENTENCE_ENDS, CLOSING = "。！？；!?;\n", "”\"'’）)]】 "
# Refusals, words beyond the shop's scope, words that carry no meaning in a question.
REFUSALS = ["抱歉", "暂未收录", "无法解答", "无法回答", "登记至后台", "人工处理"]
OUT_OF_SCOPE = ["火星", "飞船", "量子", "柴油", "航母", "外星", "造反"]
STOPWORDS = ["支持", "可以", "请问", "怎么", "如何", "能不能", "是否", "有没有", "什么", "哪些", "吗", "呢", "吧", "的", "了", "关于", "平台", "商城", "我想", "麻烦", "请", "问", "一下", "多少", "几天", "多久"]
# Promises that an answer may not make up, with the reason stated.
TRIGGERS = [
    ("私下补偿", "承诺私下向客户额外赔付"),
    ("100元代金券", "违规承诺赠送100元代金券"),
    ("代金券", "证据未提及代金券赠送政策"),
    ("立即到账", "违规承诺退款秒级立即到账"),
    ("秒级到账", "违规承诺退款秒级到账"),
    ("免单", "无依据承诺免单"),
    ("额外赠送", "未收录的额外赠品承诺"),
    ("永久免费", "未收录的永久免费承诺"),
    ("火星", "包含超出业务范围的超纲概念"),
]
# Misspellings, synonyms and particles of the labelled questions.
TYPOS = {"降介": "降价", "退款到长": "退款到账", "发标": "发票", "快弟": "快递", "尺玛": "尺码", "换货留程": "换货流程", "运费险低扣": "运费险抵扣"}
SYNONYMS = [("差价", "差额"), ("便宜", "优惠"), ("退款", "退钱"), ("发货", "寄出"), ("快递", "包裹"), ("质量", "品质"), ("怎么", "如何")]
PARTICLES = [("吗？", "呀？"), ("呢？", "吗？"), ("呀？", "呢？"), ("请问", "麻烦问下"), ("麻烦问下", "请问")]
# Status codes in words, keys under which 1 is a status, phrases of an empty result, errors of one.
STATUS = {"SHIPPED": "已发货", "PENDING": "待支付", "PAID": "已支付", "SIGNED": "已签收", "CANCELLED": "已取消", "COMPLETED": "已完成", "FINISHED": "已完成", "UNPAID": "未支付", "DELIVERING": "派送中", "TRANSPORTING": "运输中", "RECEIVED": "已揽收", "ACTIVE": "在保", "WARRANTY_ACTIVE": "在保", "EXPIRED": "已过保", "WARRANTY_EXPIRED": "已过保", "PROCESSING": "处理中", "REFUNDING": "退款处理中", "REFUNDED": "退款已完成", "AGREED": "已同意", "REJECTED": "已拒绝"}
STATUS_KEYS = ["status", "state", "order_status", "订单状态", "物流状态", "质保状态", "状态", "sign_status", "warranty_status", "ticket_status"]
MISSED = ["未找到", "未查到", "查无", "不存在", "无相关", "暂无", "没有找到", "不在保修期", "无退货记录", "无记录", "未查询到", "空结果", "not found"]
MISSED_ERRORS = ["未找到", "不存在", "查无", "无相关", "未查询到"]
# Limits of a model's context in tokens, and the least evidence for an answer.
BUDGET = {"model_context_window": 128000, "max_output_tokens": 2000, "max_user_input_tokens": 2000, "max_agent_steps": 3, "tool_result_max_tokens": 1200, "rerank_top_k": 5, "system_prompt_tokens": 1500, "doc_tokens_per_chunk": 500, "summary_max_tokens": 250, "safety_margin_tokens": 500, "target_history_turns": 20, "steady_turn_tokens": 500}
GATE = 0.40
BUCKETS = ["A_policy", "B_model", "C_colloquial", "E_multi", "D_absent"]
