"""Embeddable units: what changed since the last run, merges by key, and stale rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.functions import text as T

KEY = ["video_id", "chunk_id", "sampler_id"]


def with_hash(units: DataFrame, content: str = "content") -> DataFrame:
    return units.withColumn("text_hash", T.content_hash(F.coalesce(F.col(content), F.lit(""))))


def carry_over(units: DataFrame, previous: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """units with the stored vector where the content is unchanged, and `reused`."""
    p = previous.select(*keys, F.col("text_hash").alias("__h"), F.col("vector").alias("__v"))
    same = F.col("text_hash") == F.col("__h")
    return units.join(p, keys, "left").withColumn("reused", F.coalesce(same, F.lit(False))).withColumn("vector", F.when(F.col("reused"), F.col("__v"))).drop("__h", "__v")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of new in place of those of the same key."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and the rows of new whose key it doesn't have."""
    return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti"))


def stale(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key is no longer current."""
    return stored.join(current.select(*keys).distinct(), keys, "left_anti")
