"""Similarity of mentions by what was answered about them: closed vocabularies, shared details, texts by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlake.functions import text as T
from momentlake.functions import vectors as V
from momentlake.operators.linking import all_pairs

#: Answers that say nothing either way.
UNKNOWN = ["", "unclear", "covered"]
#: Free texts share a detail from this share of their words on.
OVERLAP = 0.3


def _disagreement(key: str, near: list[tuple[str, str]]) -> Column:
    """1 where both sides answered differently, a half for near answers, 0 where a side couldn't tell."""
    a, b = (F.coalesce(F.col(f"{s}.{key}").cast("string"), F.lit("")) for s in ("l", "r"))
    close = reduce(lambda x, y: x | y, [((a == p) & (b == q)) | ((a == q) & (b == p)) for p, q in near], F.lit(False))
    return F.when(a.isin(UNKNOWN) | b.isin(UNKNOWN) | (a == b), 0.0).when(close, 0.5).otherwise(1.0)


def _in_common(key: str, is_list: bool) -> Column:
    """How many values two lists share, or whether two texts share enough words."""
    a, b = F.col(f"l.{key}"), F.col(f"r.{key}")
    n = F.size(F.array_intersect(a, b))
    if is_list:
        return F.coalesce(n.cast("double"), F.lit(0.0))
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (n / F.size(F.array_union(a, b)) >= OVERLAP), 1.0).otherwise(0.0)


def attribute_similarity(mentions: DataFrame, by: list[str], apart: str, attributes: dict[str, float], shared: dict[str, float] | None = None, near: list[tuple[str, str]] = ()) -> DataFrame:
    """by, i, j, similarity and different of the pairs i < j of a block (one recording's mentions of one kind).

    Every attribute on which two mentions disagree costs its weight, half of it for near answers; every shared detail
    gives its weight back.  Words of free texts are split once a mention, before the pairs are made."""
    kinds, shared = dict(mentions.dtypes), shared or {}
    details = [(F.col(k) if kinds[k].startswith("array") else T.words(F.coalesce(F.col(k), F.lit("")))).alias(k) for k in shared]
    side = mentions.select(*by, "mention", F.col(apart).alias("__apart"), *attributes, *details)
    p = all_pairs(side, by, "mention")
    cost = reduce(lambda x, y: x + y, [w * _disagreement(k, list(near)) for k, w in attributes.items()], F.lit(0.0))
    gain = reduce(lambda x, y: x + y, [w * _in_common(k, kinds[k].startswith("array")) for k, w in shared.items()], F.lit(0.0))
    return p.select(*by, F.col("l.mention").alias("i"), F.col("r.mention").alias("j"), (gain - cost).alias("similarity"), (F.col("l.__apart") == F.col("r.__apart")).alias("different"))


def keyed_similarity(mentions: DataFrame, by: list[str], weights: dict[str, float], unknown: list[float]) -> DataFrame:
    """by, i, j and similarity: the weighted mean, over all keys, of the cosines of each key's vectors.

    A null vector, that of a blank text, counts as `unknown`, the vector of the text that stands for it."""
    none = F.array(*[F.lit(float(x)) for x in unknown])
    side = mentions.select(*by, "mention", *[F.coalesce(V.as_double(F.col(k)), none).alias(k) for k in weights])
    score = sum((w * V.cosine(F.col(f"l.{k}"), F.col(f"r.{k}")) for k, w in weights.items()), F.lit(0.0)) / float(sum(weights.values()))
    return all_pairs(side, by, "mention").select(*by, F.col("l.mention").alias("i"), F.col("r.mention").alias("j"), score.alias("similarity"))
