"""A stored inverted index of units' texts, and an exact top-k that reads a query's lexemes only, the best blocks first.

A posting is a lexeme of a unit with its positions.  Postings are kept by bucket (of the lexeme's hash) and level, the
logarithm of how often the lexeme occurs in the unit, in files sorted by lexeme and unit: a level is a block of postings
whose greatest score is known from its name.  Beside them stands how many postings each lexeme has in each level, and which
keys a unit has: a posting names its unit by a hash, which is seen to be a unit's own before any posting is written.

A search reads levels from the top.  What is unread of a lexeme occurs less than 2^level times in a unit, which bounds
the score of units that weren't met, or not by all lexemes; once the limit-th score beats the bound of units that
weren't met, the few that can still qualify get their final scores by reading their own postings in the lower levels.
Lexemes of phrases and of excluded terms are read whole.

Scores, matching and ties are those of `search.text_rank`: the same rows for the same units.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.errors import Refused
from momentlake.functions import text as T
from momentlake.lineage import shared_dir
from momentlake.operators import search as S

BUCKETS = 64
#: Units whose postings are looked up by a list of their hashes; more are joined.
LISTED = 1000
#: Units whose postings of a bucket and level are one file.
FILE_UNITS = 500_000


@dataclass(frozen=True)
class TextIndex:
    """Where an index is, what names its units, and how its lexemes were made."""

    folder: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS
    stemmed: bool = True

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/postings")

    def units(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/units")

    def levels(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/levels")


def bucket_of(lexeme: str, buckets: int) -> int:
    return zlib.crc32(lexeme.encode()) % buckets


def build(units: DataFrame, keys: list[str], folder: str | None = None, content: str = "content", buckets: int = BUCKETS, stemmed: bool = True) -> TextIndex:
    """The index of every unit with a text.  keys name a unit; rows of equal keys count as one unit with all their words.

    A level of a bucket is dealt by units to as many parts as there are FILE_UNITS, so that a lexeme of most units is written by
    many tasks.  Texts stay where they are; of a posting the lexeme, the unit's hash and the positions are shuffled."""
    if buckets < 1:
        raise Refused("an index has at least one bucket")
    spark = units.sparkSession
    index = TextIndex(folder or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", tuple(keys), buckets, stemmed)
    for seed in count():
        u = F.xxhash64(F.lit(seed), *[x for k in keys for x in (F.col(k), F.col(k).isNull())])
        units.groupBy(*keys).agg(F.count("*").alias("rows")).select(*keys, u.alias("u"), "rows").write.mode("overwrite").parquet(f"{index.folder}/units")
        known = index.units(spark)
        if known.groupBy("u").count().filter("count > 1").isEmpty():
            break  # no two units have one hash
    words = T.lexemes(F.coalesce(F.col(content), F.lit("")), stemmed)
    rows = S.tallies(units.select(u.alias("u"), content), ["u"], words, known.filter("rows > 1").select("u"))
    level = F.floor(F.log2(F.size("positions"))).cast("int")
    bucket = F.pmod(F.crc32(F.col("lexeme").cast("binary")), F.lit(buckets)).cast("int")
    part = F.pmod(F.col("u"), F.lit(1 + known.count() // FILE_UNITS))
    order = ["bucket", "level", "lexeme", "u"]
    dealt = rows.repartition(bucket, level, part).withColumns({"level": level, "bucket": bucket})
    dealt.sortWithinPartitions(*order).write.partitionBy("bucket", "level").parquet(f"{index.folder}/postings")
    sizes = index.postings(spark).groupBy("bucket", "lexeme", "level").agg(F.count("*").alias("units"))
    sizes.repartitionByRange("bucket", "lexeme").sortWithinPartitions("bucket", "lexeme").write.partitionBy("bucket").parquet(f"{index.folder}/levels")
    return index


class _Query:
    """A query's terms against an index: what is read whole, what each other lexeme weighs, and the score of a unit."""

    def __init__(self, text: str, stemmed: bool):
        self.terms = S.query_terms(text, stemmed)
        self.lexemes = list(dict.fromkeys(w for found, _ in self.terms for w in found))
        self.single = Counter(found[0] for found, negated in self.terms if len(found) == 1 and not negated)
        self.whole = {w for found, negated in self.terms for w in found if len(found) > 1 or negated}
        self.least = min(2, len(self.lexemes))

    def scored(self, rows: DataFrame, bounds: dict[str, int]) -> DataFrame:
        """u, matched, tf, hit and most (the greatest tf that unread postings may make of it), from postings."""
        one = {w: F.first(F.when(F.col("lexeme") == w, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, w in enumerate(self.lexemes)}
        at = {w: F.coalesce(F.col(f"p{i}"), F.array().cast("array<int>")) for i, w in enumerate(self.lexemes)}
        units = rows.groupBy("u").agg(*one.values())

        def occurrences(found: list[str]) -> Column:
            rest = list(enumerate(found[1:], 1))
            if not rest:
                return F.size(at[found[0]]).cast("long")
            follows = lambda p: reduce(lambda x, y: x & y, [F.array_contains(at[w], p + k) for k, w in rest])
            return F.size(F.filter(at[found[0]], follows)).cast("long")

        add = lambda x: sum(x, F.lit(0).cast("long"))
        tf = add(occurrences(found) for found, negated in self.terms if not negated)
        absent = F.lit(False)
        for found, negated in self.terms:
            absent = absent | (occurrences(found) == 0) if negated else absent
        matched = add((F.size(at[w]) > 0).cast("long") for w in self.lexemes)
        unread = add(F.when(F.size(at[w]) == 0, F.lit(b)).otherwise(0) for w, b in bounds.items())
        out = units.select("u", matched.alias("matched"), tf.alias("tf"), absent.alias("absent"), unread.alias("unread"))
        hit = (F.col("matched") >= self.least) & ((F.col("tf") > 0) | F.col("absent"))
        return out.select("u", "matched", "tf", hit.alias("hit"), (F.col("tf") + F.col("unread")).alias("most"))


def top(spark: SparkSession, index: TextIndex, text: str, limit: int, seen: list | None = None) -> DataFrame:
    """keys, matched, tf and text_rank of the best `limit` units.  seen: gets the levels that the search went down to."""
    query, keys = _Query(text, index.stemmed), index.keys
    every = index.postings(spark)
    if not query.lexemes:
        return index.units(spark).select(*keys, F.lit(0).cast("long").alias("matched"), F.lit(0).cast("long").alias("tf"), F.lit(1).cast("long").alias("text_rank")).filter(F.lit(False))
    own = F.col("bucket").isin(*sorted({bucket_of(w, index.buckets) for w in query.lexemes})) & F.col("lexeme").isin(*query.lexemes)
    postings = every.filter(own)
    # at most some thirty rows a lexeme of the query
    sizes = {(r.lexeme, r.level): r.units for r in index.levels(spark).filter(own).collect()}
    levels = sorted({level for w, level in sizes if w in query.single and w not in query.whole}, reverse=True)
    named = index.units(spark).select("u", *keys)
    rank = lambda rows, units: S._ranked(rows.filter("hit").select("u", "matched", "tf").join(units, "u").select(*keys, "matched", "tf"), [F.desc("tf"), *map(F.col, keys)], limit, "text_rank")
    for level in [x for x in levels if x > 0]:
        if sum(n for (_, x), n in sizes.items() if x >= level) < limit:
            continue
        bounds = {}
        for w, weight in query.single.items():
            below = [x for (v, x) in sizes if v == w and x < level]
            if w not in query.whole and below:
                bounds[w] = weight * (2 ** (max(below) + 1) - 1)
        read = F.col("level") >= level
        if query.whole:
            read = read | F.col("lexeme").isin(*query.whole)
        if seen is not None:
            seen.append(level)
        known = query.scored(postings.filter(read), bounds)
        best = [r.tf for r in known.filter("hit").select("tf").orderBy(F.desc("tf")).limit(limit).collect()]
        if len(best) < limit or sum(bounds.values()) >= best[-1]:
            continue  # a unit that wasn't met may be one of the best
        left = known.filter(F.col("most") >= best[-1]).select("u")
        few = [r.u for r in left.limit(LISTED + 1).collect()]
        those = (lambda rows: rows.filter(F.col("u").isin(*few))) if len(few) <= LISTED else (lambda rows: rows.join(left.distinct(), "u", "left_semi"))
        return rank(query.scored(those(postings), {}), those(named))
    if seen is not None:
        seen.append(0)
    return rank(query.scored(postings, {}), named)
