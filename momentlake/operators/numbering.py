"""Places and running sums in an order, without a task that holds all of it.

Keys alone are dealt by ranges of the order and written; a partition numbers its own rows, and what comes before a partition
is the sum of the partitions' totals before it, of which there is one a partition.  Rows are not moved: callers join the
places back by their keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlake.lineage import cut


def same(names: list[str], a: str, b: str) -> Column:
    """Equal columns of two aliased tables, nulls too."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names], F.lit(True))


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name of sums, the total of its column over the rows before in `order` (ascending, null first)
    among those of equal `by`; 0 for the first, null counts as 0.

    Rows should be keys, and the order without ties: every column given is written once."""
    names = {s: f"__n{k}" for k, s in enumerate(sums)}
    valued = rows.withColumns({names[s]: F.coalesce(c, F.lit(0)) for s, c in sums.items()})
    dealt = cut(valued.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*by, "__part").agg(*[F.sum(n).alias(n) for n in names.values()])
    kinds = dict(totals.dtypes)
    # one entry a partition and group
    lists = totals.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__part", *names.values()))).alias("__all"))
    each = lists.select(*by, "__all", F.explode("__all").alias("__own"))
    before = lambda n: F.aggregate(F.filter("__all", lambda x: x["__part"] < F.col("__own.__part")), F.lit(0).cast(kinds[n]), lambda a, x: a + x[n])
    bases = each.select(*by, F.col("__own.__part").alias("__part"), *[before(n).alias(n) for n in names.values()])
    own = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({n: F.coalesce(F.sum(n).over(own), F.lit(0)) for n in names.values()})
    joined = local.alias("a").join(bases.alias("b"), same([*by, "__part"], "a", "b"))
    return joined.select(*[F.col(f"a.`{c}`") for c in rows.columns], *[(F.col(f"a.{n}") + F.col(f"b.{n}")).alias(s) for s, n in names.items()])


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """rows with their place, from 0, among those of equal `by`."""
    return running(rows, by, order, {name: F.lit(1).cast("long")})
