"""Preparing labelled data: masking, augmentation, stratified split, leakage gate, encodings and weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import OTHER, PARTICLES, SYNONYMS, TAXONOMY, TYPOS
from ..sources.io import stored
from .textkeys import text_hash, text_keys


# How phones, order numbers and names behind a cue are written.
PHONE = r"(?:(?:\+|00)86)?(?<!\d)1[3-9]\d{9}(?!\d)"
ORDER_NUMBER = r"(?<!\d)\d{14,24}(?!\d)"
NAME = r"(我叫|我是|姓名[：:\s]*|用户[：:\s]*)([\u4e00-\u9fa5]{2,4})"


def cleaned(c: Column) -> Column:
    """Phones, order numbers and names masked, misspellings mended, white space to single blanks."""
    c = F.coalesce(c, F.lit(""))
    c = F.regexp_replace(c, PHONE, "[手机号]")
    c = F.regexp_replace(c, ORDER_NUMBER, "[订单号]")
    c = F.regexp_replace(c, NAME, "$1[姓名]")
    for wrong, right in TYPOS.items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return T.strip(F.regexp_replace(c, f"{T.SPACE}+", " "))


def _replaced_once(c: Column, a: str, b: str) -> Column:
    at = F.instr(c, a)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(b), F.substring(c, at + len(a), F.length(c))))


def augmented(train: DataFrame, id: str, text: str, most: int = 1, seed: int = 42, hashed: Callable[[Column], Column] = text_hash) -> DataFrame:
    """The training rows and up to `most` variants of each, one substitution apart, whose text is new; `variant` tells them.

    A text that several rows could give goes to the lowest id. Ids are unique and not null.
    """
    c = F.col(text)
    ways = [F.coalesce(_replaced_once(c, a, b), _replaced_once(c, b, a)) for a, b in SYNONYMS] + [_replaced_once(c, a, b) for a, b in PARTICLES]
    cand = train.withColumn("_new", F.explode(F.array_distinct(F.array_compact(F.array(*ways)))))
    order = F.xxhash64(F.lit(seed), F.col(id), "_new")
    cand = stored(cand.withColumn("_at", F.struct(F.lit(1).alias("of"), F.col(id).alias("id"), order.alias("h"), F.md5("_new").alias("m"))), "variants")
    # Variants and training texts get a key each; a variant whose key a training text has is not new.
    own = train.select(F.struct(F.lit(0).alias("of"), F.col(id).alias("id"), F.lit(0).cast("long").alias("h"), F.lit("").alias("m")).alias("_at"), c.alias("_new"))
    keyed = text_keys(own.unionByName(cand.select("_at", "_new")), "_at", F.col("_new"), hashed).filter("id.of = 1 and first.of = 1")
    best = keyed.withColumn("_r", F.row_number().over(W.partitionBy("id.id").orderBy("id.h", "id.m"))).filter(F.col("_r") <= most)  # the variants of a row
    best = best.groupBy("first").agg(F.min("id").alias("_at")).select("_at")
    new = cand.join(best, "_at", "left_semi")
    return train.withColumn("variant", F.lit(False)).unionByName(new.withColumn(text, F.col("_new")).drop("_new", "_at").withColumn("variant", F.lit(True)))


def stratified_split(rows: DataFrame, id: str, labels: str, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """D3: `split` by first label: floor(0.8 n) train, floor(0.1 n) validation, the rest test, in hash order of the ids.

    Ranks come from counts of hash ranges and ranks within a range, so a label that most rows share isn't one task's.
    """
    first = F.coalesce(F.try_element_at(F.col(labels), F.lit(1)), F.lit(OTHER))
    r = rows.withColumn("_l", first).withColumn("_h", F.xxhash64(F.lit(seed), id)).withColumn("_b", F.shiftright("_h", 54))
    sizes = r.groupBy("_l", "_b").agg(F.count("*").alias("_n"))  # at most 1024 rows a label
    w = W.partitionBy("_l").orderBy("_b")
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(W.partitionBy("_l"))).drop("_n")
    r = r.join(sizes, ["_l", "_b"]).withColumn("_r", F.col("_before") + F.row_number().over(W.partitionBy("_l", "_b").orderBy("_h", id)))
    a, b = F.floor(F.col("_all") * train), F.floor(F.col("_all") * val)
    return r.withColumn("split", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= a + b, "val").otherwise("test")).drop("_l", "_h", "_b", "_before", "_all", "_r")


def leakage(rows: DataFrame, text: str, split: str = "split", id: str = "doc_id", hashed: Callable[[Column], Column] = text_hash) -> DataFrame:
    """One row: sizes of the splits as sets of trimmed texts, their overlaps, and whether there is none.

    Texts are told apart by their hashes, and compared where hashes meet; `id` is unique and not null.
    """
    keyed = text_keys(rows, id, T.strip(F.col(text)), hashed, False).select(F.col("id").alias("_id"), "first").join(rows.select(F.col(id).alias("_id"), split), "_id")
    has = lambda s: F.max((F.col(split) == s).cast("int"))
    g = keyed.groupBy("first").agg(has("train").alias("a"), has("val").alias("b"), has("test").alias("c"))
    n = lambda e, name: F.count_if(F.expr(e)).cast("long").alias(name)
    s = g.agg(n("a = 1", "train"), n("b = 1", "val"), n("c = 1", "test"), n("a + b = 2", "train_val"), n("a + c = 2", "train_test"), n("b + c = 2", "val_test"))
    return s.withColumn("passed", F.col("train_val") + F.col("train_test") + F.col("val_test") == 0)


def multi_hot(labels: Column, classes: list[str] = TAXONOMY) -> Column:
    """array<double> of 0 and 1 by class."""
    return F.transform(F.array(*map(F.lit, classes)), lambda c: F.array_contains(labels, c).cast("double"))


def positive_weights(rows: DataFrame, labels: str, classes: list[str] = TAXONOMY) -> DataFrame:
    """(class, n, weight): the root of negatives by positives, between 1 and 5."""
    counts = rows.select(F.explode(F.array_distinct(labels)).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    names = rows.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    x = names.join(counts, "class", "left").withColumn("n", F.coalesce("n", F.lit(0))).crossJoin(total)
    return x.select("class", "n", F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.sqrt((F.col("total") - F.col("n")) / F.greatest("n", F.lit(1))))).alias("weight"))


def inventory(rows: DataFrame, text: str, split: str = "split", id: str = "doc_id") -> DataFrame:
    """(split, n, chars, bytes, leaked, passed): of each split its rows, characters and bytes of text, texts that it shares with other splits, and whether no split shares any."""
    own = rows.groupBy(split).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"), F.sum(F.octet_length(text)).alias("bytes"))
    leak = leakage(rows, text, split, id)
    shared = {"train": F.col("train_val") + F.col("train_test"), "val": F.col("train_val") + F.col("val_test"), "test": F.col("train_test") + F.col("val_test")}
    each = leak.select(F.explode(F.array(*[F.struct(F.lit(k).alias(split), v.alias("leaked")) for k, v in shared.items()])).alias("s"), "passed").select("s.*", "passed")  # three rows
    return own.join(F.broadcast(each), split)
