"""Costs, audit rows, drift, status codes and empty results."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import MISSED, MISSED_ERRORS, STATUS, STATUS_KEYS

#: Parameters: USD for a million prompt and completion tokens.
PROMPT_PRICE, COMPLETION_PRICE = 2.5, 10.0


def cost_by_intent(traces: DataFrame, intent: str = "intent", prompt: str = "prompt_tokens", completion: str = "completion_tokens") -> DataFrame:
    """O1: (intent, calls, tokens, cost, share of tokens in %); a null or empty intent is UNKNOWN."""
    name = F.coalesce(F.nullif(F.col(intent), F.lit("")), F.lit("UNKNOWN"))
    g = traces.groupBy(name.alias("intent")).agg(F.count("*").alias("calls"), F.sum(F.coalesce(prompt, F.lit(0))).cast("long").alias("prompt_tokens"), F.sum(F.coalesce(completion, F.lit(0))).cast("long").alias("completion_tokens"))
    g = g.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    g = g.withColumn("cost_usd", F.round(F.col("prompt_tokens") * PROMPT_PRICE / 1e6 + F.col("completion_tokens") * COMPLETION_PRICE / 1e6, 6))
    total = g.agg(F.sum("total_tokens").alias("every"))
    return g.crossJoin(F.broadcast(total)).withColumn("share", F.when(F.col("every") > 0, F.round(F.col("total_tokens") * 100.0 / F.col("every"), 2)).otherwise(0.0)).drop("every")


def audit_rows(rows: DataFrame) -> DataFrame:
    """O2: result to 500 characters, error to 512; arguments that are no JSON object become {"raw": ...}."""
    ok = F.coalesce(F.try_parse_json("arguments").isNotNull() & T.strip(F.col("arguments")).startswith("{"), F.lit(False))
    args = F.when(F.col("arguments").isNull(), F.lit("{}")).when(ok, F.col("arguments")).otherwise(F.to_json(F.struct(F.col("arguments").alias("raw"))))
    return rows.withColumn("arguments", args).withColumn("result_summary", F.substring("result_summary", 1, 500)).withColumn("error_message", F.substring("error_message", 1, 512))


def latest_audit(rows: DataFrame, tools: list[str]) -> DataFrame:
    """O3: the row of the highest id for each conversation, of the given tools."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.filter(F.col("tool_name").isin(tools)).groupBy("conversation_id").agg(F.max_by(row, "id").alias("r")).select("r.*")


def drifted(recommended: Column, active: Column) -> Column:
    """O4."""
    return F.abs(recommended - active) > 0.001


def translated(code: Column, status_key: bool = False) -> Column:
    """A status code in words, blanks and case aside; under a status key, 1 is 已发货; anything else stays."""
    words = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    known = words[F.upper(T.strip(code))]
    one = F.when(T.strip(code) == "1", F.lit("已发货")) if status_key else F.lit(None).cast("string")
    return F.coalesce(known, one, code)


def translated_json(raw: Column) -> Column:
    """JSON objects and lists with the codes in their text values in words, however deep; under a status key 1 and "1" are 已发货.

    Numbers stay numbers and names stay as written; a text that is neither object nor list stays as it is.
    """

    def said(value: Any, key: str = "") -> Any:
        if isinstance(value, list):
            return [said(x, key) for x in value]
        text = value.strip() if isinstance(value, str) else value
        if isinstance(value, str) and text.upper() in STATUS:
            return STATUS[text.upper()]
        return "已发货" if key.lower() in STATUS_KEYS and (text == "1" or (isinstance(value, int) and value == 1)) else value

    def load(text: str) -> Any:  # objects are translated as they close, so an inner one is done before its outer one
        return json.loads(text, object_pairs_hook=lambda pairs: {k: said(v, k) for k, v in pairs})

    def one(text: str | None) -> str | None:
        if text is None or text.strip()[:1] + text.strip()[-1:] not in ("{}", "[]"):
            return text
        try:
            return json.dumps(said(load(text.strip())), ensure_ascii=False)
        except ValueError:
            return text

    @F.pandas_udf("string")
    def translate(s: pd.Series) -> pd.Series:
        return s.map(one, na_action=None)

    return translate(raw)


def missed(raw: Column) -> Column:
    """Whether a tool's result is empty: nothing, found or exists false, a total or count of 0, an error's or a text's wording."""
    text = T.strip(raw)
    at = lambda k: F.get_json_object(raw, f"$.{k}")
    flags = [at("found") == "false", at("exists") == "false", at("total") == "0", at("count") == "0", T.contains_any(at("error"), MISSED_ERRORS), T.contains_any(text, MISSED)]
    return raw.isNull() | text.isin("", "{}", "[]", "null", "None") | reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags])
