"""Connected components of a table of links, by alternating stars.

Large-star links every node's greater neighbours to its least neighbour, small-star its lesser ones; the links turn
into stars around the least node of each component within a few rounds.  Each half round is written to the shared
folder, so its plan stays short and a lost executor costs one half round at most.  Nothing is collected.  Least
neighbours are aggregated on the map side and joined back as a written table, so that the optimizer may broadcast
them, or split the rows of a node with very many links between tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.llm.common import cut, discard


def _figures(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def _large(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
    out = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    done = cut(out.filter(F.col("u") != F.col("v")).groupBy("u", "v").agg(F.lit(1).alias("x")).select("u", "v"), "large")
    discard(least)
    return done


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "least")
    out = down.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
    out = out.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    done = cut(out.groupBy("u", "v").agg(F.lit(1).alias("x")).select("u", "v"), "small")
    discard(least)
    return done


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its least node) of every node that a link (u, v) touches; u and v are longs."""
    now = cut(links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).groupBy("u", "v").agg(F.lit(1).alias("x")).select("u", "v"), "links")
    before = None
    for _ in range(rounds):
        large = _large(now)
        discard(now)
        now = _small(large)
        discard(large)
        figures = _figures(now)
        if figures == before:
            break
        before = figures
    else:
        raise RuntimeError("the links didn't settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).groupBy("node", "component").agg(F.lit(1).alias("x")).select("node", "component")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
