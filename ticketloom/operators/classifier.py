"""Evaluation of multi-label classifiers: confusion counts, thresholds, tiers, error accounting, calibration, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vocab import BOUNDARIES, CORE_CLASSES, TIERS


def confusion(scores: DataFrame, threshold: float, by: list[str] = ["class"]) -> DataFrame:  # noqa: B006
    """V1: (class, tp, fp, fn, tn) of rows (class, truth, score), predicted where score >= threshold."""
    p = F.col("score") >= threshold
    n = lambda c, name: F.count_if(c).cast("long").alias(name)
    return scores.groupBy(*by).agg(n(p & F.col("truth"), "tp"), n(p & ~F.col("truth"), "fp"), n(~p & F.col("truth"), "fn"), n(~p & ~F.col("truth"), "tn"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def rates(c: DataFrame) -> DataFrame:
    """V2: precision, recall and F1 of each row; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def averages(c: DataFrame, order: Column) -> DataFrame:
    """V2: one row: macro over all classes and over the first CORE_CLASSES, micro over all counts."""
    m = lambda x, name, core=False: F.round(F.avg(F.when(F.lit(not core) | (order < CORE_CLASSES), x)), 4).alias(name)
    g = rates(c).agg(m(F.col("precision"), "macro_p"), m(F.col("recall"), "macro_r"), m(F.col("f1"), "macro_f1"), m(F.col("f1"), "core_macro_f1", True), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    g = rates(g)
    return g.select("macro_p", "macro_r", "macro_f1", "core_macro_f1", F.round("precision", 4).alias("micro_p"), F.round("recall", 4).alias("micro_r"), F.round("f1", 4).alias("micro_f1"))


def _lines(low: int, high: int, step: int) -> list[int]:
    return list(range(low, high + 1, step))


def passed_lines(scores: DataFrame, lines: list[int], by: list[str]) -> DataFrame:
    """(by, line, tp, fp, positives, negatives): each score is counted once, by the lines that it passes, then summed from the top.

    Lines are hundredths. The counts are at most lines x groups rows, so the window over them stays small.
    """
    passed = reduce(lambda a, b: a + b, [(F.col("score") >= x / 100).cast("int") for x in lines])
    h = scores.groupBy(*by, passed.alias("k")).agg(F.count_if(F.col("truth")).cast("long").alias("p"), F.count_if(~F.col("truth")).cast("long").alias("n"))
    spread = h.withColumn("line", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x / 100).alias("t")) for i, x in enumerate(lines)])))
    over = F.col("k") > F.col("line.i")
    g = spread.groupBy(*by, F.col("line.t").alias("threshold")).agg(F.sum(F.when(over, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("fp"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return g.withColumn("fn", F.col("positives") - F.col("tp")).withColumn("tn", F.col("negatives") - F.col("fp"))


def threshold_sweep(scores: DataFrame, low: int = 30, high: int = 70, step: int = 5) -> DataFrame:
    """V3: (threshold, micro and macro F1, best): the best is the first of the highest micro F1."""
    c = rates(passed_lines(scores, _lines(low, high, step), ["class"]))
    g = c.groupBy("threshold").agg(F.round(F.avg("f1"), 4).alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    g = rates(g).select("threshold", "macro_f1", F.round("f1", 4).alias("micro_f1"))
    return g.withColumn("best", F.row_number().over(W.orderBy(F.desc("micro_f1"), "threshold")) == 1)  # a row for each line


#: A status' sign, and what is said of it.
_SIGNS = {"pass": "✅", "fail": "❌", "none": "—"}
_REACHED, _MISSED, _NO_LINE = "达标", "先回头搞数据 (F1: %.2f < %.2f)", "不设线（宽档）"


def redlines(c: DataFrame) -> DataFrame:
    """V4: (class, tier, f1, line, status, symbol, message): whether each class reaches its tier's F1; loose classes have no line."""
    rows = [(x, t, line) for t, (classes, line) in TIERS.items() for x in classes]
    tiers = c.sparkSession.createDataFrame(rows, "class string, tier string, line double")
    f1 = F.col("f1")
    status = F.when(F.col("line").isNull(), "none").when(f1 >= F.col("line"), "pass").otherwise("fail")
    signs = F.create_map(*[F.lit(x) for kv in _SIGNS.items() for x in kv])
    message = F.when(F.col("line").isNull(), _NO_LINE).when(f1 >= F.col("line"), _REACHED).otherwise(F.format_string(_MISSED, f1, "line"))
    return rates(c).join(F.broadcast(tiers), "class").select("class", "tier", F.round("f1", 4).alias("f1"), "line", status.alias("status"), signs[status].alias("symbol"), message.alias("message"))  # 17 rows


def errors(rows: DataFrame, truth: str = "true_labels", predicted: str = "pred_labels") -> DataFrame:
    """V5: each wrong row with its missed and extra labels in order, displaced pairs, what is under and over, penalty and a boundary note.

    The note joins what is known of each pair (missed, extra), or else of each missed label; — where nothing is known.
    """
    table = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    of_pair = table({f"{a} ↔ {b}": f"{a} ↔ {b}: {note}" for (a, b), note in BOUNDARIES.items()})
    alone = table({a: f"{a}: {note}" for (a, _), note in BOUNDARIES.items()})
    r = rows.withColumn("missed", F.array_sort(F.array_except(truth, predicted))).withColumn("extra", F.array_sort(F.array_except(predicted, truth))).filter("size(missed) > 0 or size(extra) > 0")
    a, b = F.size("missed"), F.size("extra")
    r = r.withColumn("displaced", F.least(a, b).cast("long")).withColumn("under", a - F.col("displaced")).withColumn("over", b - F.col("displaced"))
    pairs = F.flatten(F.transform("missed", lambda m: F.transform("extra", lambda e: of_pair[F.concat(m, F.lit(" ↔ "), e)])))
    joined = lambda notes: F.nullif(F.array_join(F.array_compact(notes), "；"), F.lit(""))
    note = F.coalesce(joined(pairs), joined(F.transform("missed", lambda m: alone[m])), F.lit("—"))
    return r.withColumn("penalty", F.col("under") + F.col("over") + 2 * F.col("displaced")).withColumn("note", note)


def error_totals(e: DataFrame) -> DataFrame:
    """V5: one row of totals."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return e.agg(F.count("*").alias("wrong"), s("under"), s("over"), s("displaced"), s("penalty"))


def balanced(e: DataFrame, c: DataFrame) -> DataFrame:
    """V6: whether the penalties are all false positives and negatives."""
    return error_totals(e).crossJoin(c.agg(F.sum(F.col("fp") + F.col("fn")).alias("fp_fn"))).withColumn("balanced", F.col("penalty") == F.col("fp_fn"))


def report(c: DataFrame, e: DataFrame, order: Column) -> DataFrame:
    """V7: (part, name, value) rows: summary, classes, error totals; rounded to 4."""
    def long(df: DataFrame, part: str, name: Column, cols: list[str]) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.concat(name, F.lit(x)).alias("name"), F.round(F.col(x).cast("double"), 4).alias("value")) for x in cols]))
        return df.select(F.lit(part).alias("part"), pairs.alias("p")).select("part", "p.name", "p.value")

    a = averages(c, order)
    t = error_totals(e)
    return long(a, "summary", F.lit(""), a.columns).unionByName(long(rates(c), "class", F.concat(F.col("class"), F.lit(".")), ["precision", "recall", "f1"])).unionByName(long(t, "errors", F.lit(""), t.columns))


def parity(a: DataFrame, b: DataFrame, threshold: float = 0.5, most: float = 1e-4) -> DataFrame:
    """V8: one row: the largest difference of two models' logits (id, class, logit), whether labels agree, and both."""
    j = a.join(b.withColumnRenamed("logit", "other"), ["id", "class"])
    on = lambda x: 1 / (1 + F.exp(-F.col(x))) >= threshold
    g = j.agg(F.round(F.max(F.abs(F.col("logit") - F.col("other"))), 8).alias("max_diff"), F.bool_and(on("logit") == on("other")).alias("same_labels"))
    return g.withColumn("passed", (F.col("max_diff") < most) & F.col("same_labels"))


def calibration(scores: DataFrame, active: float, low: int = 20, high: int = 80, step: int = 2) -> DataFrame:
    """V9: (threshold, tp, fp, tn, fn, youden, f1, recommended, mismatch): the first of the highest Youden J is recommended."""
    c = rates(passed_lines(scores, _lines(low, high, step), []))
    j = ratio(F.col("tp"), F.col("positives")) - ratio(F.col("fp"), F.col("negatives"))
    g = c.select("threshold", "tp", "fp", "tn", "fn", F.round(j, 4).alias("youden"), F.round("f1", 4).alias("f1"))
    g = g.withColumn("recommended", F.row_number().over(W.orderBy(F.desc("youden"), "threshold")) == 1)  # a row for each line
    return g.withColumn("mismatch", F.col("recommended") & (F.abs(F.col("threshold") - active) > 0.01))


def acceptance(leak: DataFrame, red: DataFrame, balance: DataFrame, sweep: DataFrame, recorded: float, classified: DataFrame) -> DataFrame:
    """(gate, status): pass, fail or missing of each data gate."""
    say = lambda c: F.when(c.isNull(), "missing").when(c, "pass").otherwise("fail").alias("status")
    parts = [
        ("leakage", leak.agg(F.bool_and("passed").alias("ok"))),
        ("redlines", red.agg(F.bool_and(F.col("status") != "fail").alias("ok"))),
        ("accounting", balance.agg(F.bool_and("balanced").alias("ok"))),
        ("threshold", sweep.filter("best").agg(F.bool_and(F.abs(F.col("threshold") - recorded) <= 1e-4).alias("ok"))),
        ("classified", classified.agg((F.count("*") > 0).alias("ok"))),
    ]
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("gate"), say(F.col("ok"))) for k, df in parts])
