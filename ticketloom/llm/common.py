"""Shared helpers: connected components, batch sizes for some jobs; tables in the shared folder come from `sources.io`."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import bounded_batches, new_path, shared_dir  # noqa: F401
from ..sources.io import stored as table

@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Another Arrow batch size for the jobs that run inside; the session's own comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by contraction: (node, component), component = smallest node reachable.

    Each round renames every node to its smallest neighbour (a partial minimum, so hubs don't gather) and drops
    edges inside one name. A component's smallest node never changes its name, so it is the last one left.
    Only nodes with an edge are returned. Edges of a node with itself are ignored; nulls link with nothing.
    """
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    live = table(live, "edges")
    names = None
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("name"), F.least("a", "m").alias("to"))
        step = table(step, "step")
        if names is None:
            names = step.select(F.col("name").alias("node"), F.col("to").alias("component"))
        else:
            names = table(
                names.join(step, F.col("component") == F.col("name"), "left").select("node", F.coalesce("to", "component").alias("component")),
                "names",
            )
        x = step.select(F.col("name").alias("a"), F.col("to").alias("na"))
        y = step.select(F.col("name").alias("b"), F.col("to").alias("nb"))
        live = live.join(x, "a").join(y, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).filter("a <> b").distinct()
        live = table(live, "edges")
    if names is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return names
