"""Vector expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector counts as one of norm 1, so its similarity is 0."""
    na, nb = norm(a), norm(b)
    return dot(a, b) / (F.when(na == 0, 1.0).otherwise(na) * F.when(nb == 0, 1.0).otherwise(nb))


def unit(v: Column) -> Column:
    """v with norm 1; shorter than 1e-12 counts as that."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(as_double(v), lambda x: x / n)


def mean_vector(vectors: Column) -> Column:
    """The mean of an array of equally long vectors."""
    total = F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), as_double(F.element_at(vectors, 1)), lambda s, v: F.zip_with(s, as_double(v), lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vectors))


def hash_embed(rows: DataFrame, keys: list[str], text: str, dims: int = 16) -> DataFrame:
    """A deterministic stand-in for a text embedder: tokens are counted at the first 4 bytes of their SHA-256 modulo
    dims, and the counts are normalised.  Adds `vector` to keys; texts without tokens get zeros."""
    tokens = F.filter(F.split(F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))), r"\s+"), lambda t: t != "")
    slots = F.transform(tokens, lambda t: (F.conv(F.substring(F.sha2(t.cast("binary"), 256), 1, 8), 16, 10).cast("long") % dims).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(F.col("__slots"), lambda s: s == d)).cast("double"))
    out = rows.withColumn("__slots", slots).withColumn("__counts", counts)
    n = norm(F.col("__counts"))
    return out.select(*keys, F.transform("__counts", lambda x: x / F.when(n == 0, 1.0).otherwise(n)).alias("vector"))
