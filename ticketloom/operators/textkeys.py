"""Set operations on long texts: texts are hashed once, hashes are shuffled, and texts meet only to confirm equal hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import stored


def text_hash(c: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(c))


def text_keys(rows: DataFrame, id: str, key: Column, hashed: Callable[[Column], Column] = text_hash, blank: bool = True) -> DataFrame:
    """Stored (id, first, n): of each row the smallest id whose key is the same text, and how many rows have it; null keys are left out, and empty ones unless `blank`.

    Keys are hashed once and their hashes grouped. Rows that share a hash with another are compared with the text of the
    hash's first row; those that differ, for which there is no need but a collision, are grouped by hash and text. The
    id of a row is unique and not null.
    """
    # Written once, as keys are costly to make: what follows reads them.
    all_ = stored(rows.select(F.col(id).alias("id"), key.alias("_key")), "text-keys").filter("_key is not null" if blank else "_key <> ''")
    narrow = stored(all_.select("id", hashed(F.col("_key")).alias("_hash")), "text-hashes")
    groups = narrow.groupBy("_hash").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    known = stored(narrow.join(groups, "_hash"), "text-groups")
    shared = known.filter("n > 1")
    texts = all_.join(shared.select("id"), "id", "left_semi")
    # The text of a hash's first row goes to its other rows; Spark splits a first row that very many share.
    firsts = texts.join(shared.select("id", "first").filter("id = first").select("id"), "id", "left_semi").select(F.col("id").alias("first"), F.col("_key").alias("_first_key"))
    same = shared.filter("id <> first").select("id", "first", "_hash").join(texts, "id").join(firsts, "first")
    other = stored(same.filter("_key <> _first_key").select("id", "_hash", "_key"), "text-collisions")
    if not other.limit(1).count():
        return known.select("id", "first", "n")
    apart = other.groupBy("_hash", "_key").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    apart = other.join(apart, ["_hash", "_key"]).select("id", "first", "n")
    left = apart.join(known.select("id", "_hash"), "id").groupBy("_hash").agg(F.count("*").alias("gone"))
    own = known.join(apart.select("id"), "id", "left_anti").join(left, "_hash", "left")
    return stored(own.select("id", "first", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")).unionByName(apart), "text-groups")
