"""Sources and sinks: labelled JSONL, Markdown folders, relational tables, score files, reports, keyed upserts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED = "text string, labels array<string>"
SCORES = "samples array<struct<text:string,true_labels:array<string>,scores:map<string,double>>>"


_fallback: list[str] = []


def one_process(spark: SparkSession) -> bool:
    """Driver and executors are one process: master local, not a local cluster."""
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share.

    Where that is unset, Spark in one process (master local) gets a temporary folder; on a cluster it is an error, since
    executors would write to disks that others can't read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not one_process(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="ticketloom-"))
        found = _fallback[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Lower the number of rows handed to Python at once to at most `rows`, as texts may be long; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of text and labels; blank lines give no row."""
    return spark.read.schema(LABELLED).json(path).filter("text is not null or labels is not null")


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8, nothing escaped that needn't be."""
    df.write.mode("overwrite").json(path)


def read_markdown(spark: SparkSession, folder: str, names: str = "*.md") -> DataFrame:
    """S3: (file, text) of every file of the given names, whole; sorting by name is the reader's."""
    rows = spark.read.option("pathGlobFilter", names).text(folder, wholetext=True)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))


def inventory(spark: SparkSession, folder: str, size: int, overlap: int, names: str = "*.md") -> DataFrame:
    """(file, bytes, modified, chunks) of every file of the given names; files of one name in different folders are apart."""
    from ..operators.kb import split_documents

    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder)
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))
    counts = split_documents(named, "path", "text", size, overlap).groupBy("doc").agg(F.count("*").alias("chunks"))
    return named.join(counts, F.col("path") == F.col("doc"), "left").select("file", "bytes", "modified", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def key_ranges(keys: DataFrame, key: str, parts: int, name: str | None = None, error: float = 0.001) -> list[str]:
    """SQL conditions of at most `parts` ranges of a numeric key that hold about as many rows each, and of null keys.

    Bounds come from a sketch of the key's quantiles, so gaps and hot stretches don't make one range large; a single key
    is never cut. Together the conditions hold each row once. name: the key as the database writes it.
    """
    name = name or key
    at = [i / parts for i in range(1, parts)]
    bounds = sorted({int(x) for x in keys.approxQuantile(key, at, error)}) if parts > 1 else []
    edges = [None, *bounds, None]
    inside = lambda a, b: " and ".join([f"{name} >= {a}"] * (a is not None) + [f"{name} < {b}"] * (b is not None)) or f"{name} is not null"
    return [inside(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)] + [f"{name} is null"]


def read_relational(spark: SparkSession, url: str, table: str, conditions: list[str], **options: str) -> DataFrame:
    """A JDBC table, a partition for each condition (`key_ranges`)."""
    return spark.read.jdbc(url, table, predicates=conditions, properties=options)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(text, true_labels, scores) of a file {samples: [...]}."""
    return spark.read.schema(SCORES).json(path, multiLine=True).select(F.explode("samples").alias("s")).select("s.*")


def class_scores(samples: DataFrame, classes: list[str]) -> DataFrame:
    """A row for each class of each sample; labels beyond the classes are ignored, a missing score is 0."""
    each = samples.withColumn("class", F.explode(F.array(*map(F.lit, classes))))
    return each.withColumn("truth", F.array_contains("true_labels", F.col("class"))).withColumn("score", F.coalesce(F.col("scores")[F.col("class")], F.lit(0.0)))


def write_report(df: DataFrame, path: str) -> None:
    """A small result as JSON lines in one file; only for results whose size doesn't follow the input's."""
    df.coalesce(1).write.mode("overwrite").json(path)


def upserted(old: DataFrame, new: DataFrame, key: str, version: str, default_text: Column | None = None, text: str = "chunk_text") -> DataFrame:
    """Old and new rows, for each key that of the highest version, a new one on a tie; a null text gets its default.

    The choice is a maximum of (version, newness) before the rows meet by key; only keys are shuffled for it.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*[F.col(c) for c in old.columns])
    best = both.groupBy(key).agg(F.max_by(row, F.struct(F.coalesce(F.col(version), F.lit(0)), "_new")).alias("r")).select("r.*")
    return best if default_text is None else best.withColumn(text, F.coalesce(F.col(text), default_text))
