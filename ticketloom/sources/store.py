"""A store of one row a key that grows by batches: each batch writes its own rows, and folds one share of the store in turn."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame], DataFrame]
#: Shares of a store. A batch folds one of them, so it reads and writes about 1 / TURNS of the store beside its own rows.
TURNS = 32


@dataclass(frozen=True)
class KeyedStore:
    """Rows of `schema` under `path`, in buckets of the key's hash.

    merge: rows of any number a key, with the number `batch_no` of the batch that brought each, into one row a key (or
    none); a merged row takes part in later merges under the number up to which it was merged. At most one row a key
    should come in a batch, or few, as a merge may gather a key's rows: at most those of `turns` batches are unmerged.

    Rows of batch k are under rows/batch_no=k/bucket_no=b. Batch k then merges bucket k mod turns, its rows since it was
    merged last with what they were merged to, into folded/batch_no=k. So no file is rewritten, a batch costs what it
    holds and a fixed share of the store, whichever keys it holds, and which folders hold a bucket follows from the
    number of the last batch. A batch counts once its commit is written, as the last of its writes; one that failed
    before is written anew in its own folders. Folders no longer read are kept.
    """

    path: str
    schema: str
    key: str
    merge: Merge
    turns: int = TURNS

    def _commits(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.schema("source string, number long, batch_no long").parquet(f"{self.path}/commits")
        except AnalysisException:  # no batch yet
            return None

    def last(self, spark: SparkSession) -> int:
        """The number of the last batch, -1 before the first."""
        commits = self._commits(spark)
        return -1 if commits is None else commits.agg(F.coalesce(F.max("batch_no"), F.lit(-1))).first()[0]

    def applied(self, spark: SparkSession, source: str) -> int:
        """The largest number of a source's batches that were applied, -1 before its first."""
        commits = self._commits(spark)
        return -1 if commits is None else commits.filter(F.col("source") == source).agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0]

    def _read(self, spark: SparkSession, kind: str, numbers: range, keep: Column | None = None) -> DataFrame:
        """Rows that batches of these numbers wrote, all of whose folders exist."""
        held = [f"{self.path}/{kind}/batch_no={k}" for k in numbers if k >= 0]
        more = ", bucket_no int" if kind == "rows" else ""
        schema = f"{self.schema}{more}, batch_no long"
        if not held:
            return spark.createDataFrame([], schema).drop("bucket_no")
        rows = spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*held)
        return (rows if keep is None else rows.filter(keep)).drop("bucket_no")

    def bucket(self) -> Column:
        """The bucket of a row's key."""
        return F.pmod(F.xxhash64(self.key), F.lit(self.turns)).cast("int")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows (with the key) in partitions of few buckets each, all rows of a key in one: columns `_bucket` and `_share` are added, by which they are dealt.

        What groups by `_bucket`, `_share` and the key then needs no other shuffle, nor does a batch made of it (`apply`).
        """
        shares = -(-4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // self.turns)
        share = F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(shares)).cast("int")
        return rows.withColumn("_bucket", self.bucket()).withColumn("_share", share).repartition("_bucket", "_share")

    def apply(self, rows: DataFrame, source: str = "", number: int | None = None, dealt: bool = False) -> bool:
        """Apply a batch; one of a number that the source has reached already changes nothing and gives False.

        dealt: the rows are in partitions of few buckets each already and are written from there.
        """
        spark = rows.sparkSession
        if number is not None and number <= self.applied(spark, source):
            return False
        k = self.last(spark) + 1
        columns = spark.createDataFrame([], self.schema).columns
        own = rows.select(*columns).withColumn("bucket_no", self.bucket())
        # Rebalanced by bucket: a small batch makes few files, and a large one's buckets are split over tasks.
        own = own if dealt else own.hint("rebalance", "bucket_no")
        own.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket_no").parquet(f"{self.path}/rows/batch_no={k}")
        turn = k % self.turns
        before = self._read(spark, "folded", range(k - self.turns, k - self.turns + 1))
        since = self._read(spark, "rows", range(k - self.turns + 1, k + 1), F.col("bucket_no") == turn)
        self.merge(before.unionByName(since)).select(*columns).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/folded/batch_no={k}")
        commit = spark.range(1).select(F.lit(source).alias("source"), F.lit(number).cast("long").alias("number"))
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch_no={k}")
        return True

    def read(self, spark: SparkSession, take: list[str | Column] | None = None) -> DataFrame:
        """The store as it stands: each bucket's folded rows and those that came since, merged.

        take: the columns that are merged and given, for a merge that takes any (`newest`, with its own ones among them):
        what is left out or made smaller here isn't shuffled.
        """
        last = self.last(spark)
        recent = range(last - self.turns + 1, last + 1)
        folded_at = F.lit(last) - F.pmod(F.lit(last) - F.col("bucket_no"), F.lit(self.turns))
        rows = self._read(spark, "folded", recent).unionByName(self._read(spark, "rows", recent, F.col("batch_no") > folded_at))
        rows = rows if take is None else rows.select(*take, "batch_no")
        return self.merge(rows).drop("batch_no") if take is not None else self.merge(rows).select(*spark.createDataFrame([], self.schema).columns)


def newest(key: str, version: str | None = None, gone: str | None = None) -> Merge:
    """For each key the row of the highest version, a null one being 0, and of the latest batch on a tie; keys whose row is `gone` go."""

    def merge(rows: DataFrame) -> DataFrame:
        row = F.struct(*[F.col(c) for c in rows.columns])
        by = [F.col("batch_no")] if version is None else [F.coalesce(F.col(version).cast("long"), F.lit(0)), F.col("batch_no")]
        best = rows.groupBy(key).agg(F.max_by(row, F.struct(*by)).alias("r")).select("r.*")
        return best if gone is None else best.filter(~F.coalesce(F.col(gone), F.lit(False)))

    return merge
