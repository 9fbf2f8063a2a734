"""The given tables in the shapes that operators take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import TAXONOMY

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry(dict):
    """name -> (query, SQL or None)."""

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self[name] = (f, sql)
            return f

        return put


#: Classes of the label tables' rows, made from ids: every third row has a second class; scores fall with the distance.
CLASSES = TAXONOMY


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, labels, quality, toxic): one class by id modulo 17, a second one for ids that 3 divides."""
    names = F.array(*map(F.lit, CLASSES))
    at = lambda x: F.element_at(names, (x % 17 + 1).cast("int"))
    two = F.when(F.col("doc_id") % 3 == 0, F.array(at(F.col("doc_id")), at(F.col("doc_id") + 5))).otherwise(F.array(at(F.col("doc_id"))))
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), two.alias("labels"), "quality", "toxic")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, class, ord, truth, score): a score in hundredths for each class, high for true ones but for a few."""
    rows = labelled(spark, sf_dir)
    each = rows.select("id", "labels", F.posexplode(F.array(*map(F.lit, CLASSES))).alias("ord", "class"))
    truth = F.array_contains("labels", F.col("class"))
    hash_ = (F.col("id") * 37 + F.col("ord") * 101) % 1000
    return each.select("id", "class", "ord", truth.alias("truth"), F.when(truth, 0.25 + hash_ / 1333.0).otherwise(hash_ / 2500.0).alias("score"))


#: The same in SQL, as common table expressions `labelled` and `scored`.
CLASSES_SQL = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
LABELLED_SQL = f"labelled as (select doc_id as id, case when doc_id % 3 = 0 then [{CLASSES_SQL}[doc_id % 17 + 1], {CLASSES_SQL}[(doc_id + 5) % 17 + 1]] else [{CLASSES_SQL}[doc_id % 17 + 1]] end as labels, quality, toxic from labels)"
SCORED_SQL = f"""{LABELLED_SQL}, cls as (select unnest({CLASSES_SQL}) as class, generate_subscripts({CLASSES_SQL}, 1) - 1 as ord),
scored as (select id, class, ord, list_contains(labels, class) as truth,
  case when list_contains(labels, class) then 0.25 + ((id * 37 + ord * 101) % 1000) / 1333.0 else ((id * 37 + ord * 101) % 1000) / 2500.0 end as score from labelled, cls)"""
