"""Mixing sources to target weights (9): weighted sampling without replacement by exponential keys.

Every document gets the key -ln(u) / w, u a hash of its id in (0, 1) and w its quality weight: the posterior of the
quality classifier (2), rounded to LEAST at least.  Sources share the total by weight; a source's target stops at
`most` times its size and the excess goes to the others by weight.  A source first gives all its documents
floor(target / size) times; the rest of the target is filled with its documents in the order of their keys, while the
sum of sizes up to the middle of the next document stays within it.

The running sums don't put a source into one task: documents go into a few times STEPS intervals of the key by source, the
intervals' sums are summed first, and each interval is then sorted alone.  As the choice is "place up to that of the
last chosen", it is applied to the documents by a table of one row per source.

Defined results: null and empty texts have size 0 and take 0; a null doc_id hashes as an empty string; a null source
is a source of its own, the last; ties of the key go by doc_id, then size; repeated rows are taken one by one, like
different documents; with no words at all every target is 0; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentlake.llm.common import cut, discard, small_side, table
from momentlake.llm.quality import judged
from momentlake.operators.numbering import numbered, running

WEIGHTS = (5, 2, 1)
MOST = 3
STEPS = 4096
SEED = "mix"
#: The least weight of a document, and the step to which weights are rounded, so that reruns agree.
LEAST = 1e-4


def keyed(rows: DataFrame, size: Column, weight: Column) -> DataFrame:
    """rows (doc_id, source and others) as a written table with __size, __at, the place in the order of keys, and __row.

    Repeated rows share a place; __row numbers them."""
    w = F.greatest(F.round(weight / LEAST) * LEAST, F.lit(LEAST))
    u = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{SEED}"))), 1, 12), 16, 10).cast("double")
    key = -F.log((u + 0.5) / float(1 << 48)) / w
    out = rows.withColumn("__size", size.cast("long")).withColumn("__row", F.monotonically_increasing_id())
    return cut(out.withColumn("__at", F.struct(key.alias("k"), F.col("doc_id").cast("string").alias("d"), F.col("__size").alias("n"))), "keyed")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target, from source and source_size; sources may be very many, so they are numbered and
    summed up by ranges (`running`), and only the level is one value.

    With r = most * size / weight, the sources under the level x are at their limit and the others get x * weight;
    x is the only level at which all targets sum to the total.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = numbered(sizes.withColumn("__last", F.col("source").isNull()), [], ["__last", "source"], "__rank").drop("__last").withColumn("__w", w)
    ranked = ranked.withColumn("__r", most * F.col("source_size") / F.col("__w"))
    total = ranked.agg(F.sum("source_size").alias("size"), F.sum("__w").alias("w")).first()
    if total.size is None:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    ranked = cut(running(ranked, [], ["__r", "__rank"], {"__full": most * F.col("source_size"), "__before": F.col("__w")}), "ranked")
    ranked = ranked.withColumn("__x", (F.lit(total.size) - F.col("__full")) / (F.lit(total.w) - F.col("__before")))
    # the level is the first that doesn't exceed its own source's limit
    level = ranked.filter(F.col("__x") <= F.col("__r")).agg(F.min(F.struct("__r", "__rank", "__x")).alias("m")).first().m
    x = F.lit(level["__x"]) if level else F.col("__r")
    target = F.least((most * F.col("source_size")).cast("double"), x * F.col("__w"))
    return ranked.select("source", "source_size", target.alias("target"))


def _step(key: Column) -> Column:
    """The interval of a key: even for keys of full weight, and by the logarithm for the large keys of slight weights."""
    return F.floor(STEPS * (1 - F.exp(-key)) + STEPS / 16 * F.log2(1 + key))


def plan(narrow: DataFrame, most: int = MOST) -> DataFrame:
    """Per source: its target, the number of complete epochs, and for the fractional one the last place, and the last
    row of those that share it (null: all).

    narrow: source, __size, __at and __row of all documents, read several times.  Rows that share a place are one
    item with a count before anything is sorted, so that no number of repeated rows makes a task long."""
    sizes = cut(narrow.groupBy("source").agg(F.sum("__size").alias("source_size")), "sources")
    t = targets(sizes, most=most)
    full = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size") + 1e-9))).otherwise(0)
    t = cut(t.withColumn("epochs", full.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    items = narrow.groupBy("source", "__at").agg(F.count("*").alias("m"))
    items = cut(items.withColumn("step", _step(F.col("__at.k"))).withColumn("sum", F.col("m") * F.col("__at.n")), "items")
    steps = items.groupBy("source", "step").agg(F.sum("sum").alias("sum"))
    before = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("source", "step", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "step").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    run = items.withColumn("run", F.coalesce(F.sum("sum").over(inside), F.lit(0)))
    s, p, q = run.alias("s"), steps.alias("p"), t.alias("q")
    joined = s.join(small_side(p), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.step") == F.col("p.step")))
    joined = joined.join(small_side(q), F.col("s.source").eqNullSafe(F.col("q.source"))).filter(F.col("q.epochs") < most)
    rest, n = F.col("q.rest") - F.col("p.base") - F.col("s.run"), F.col("s.__at.n")
    # the copies whose middle is within the rest
    fit = F.when(n > 0, F.floor(rest / n - 0.5) + 1).otherwise(F.when(rest >= 0, F.col("s.m")).otherwise(0))
    chosen = joined.select(F.col("s.source").alias("source"), "s.__at", "s.m", F.least(fit, F.col("s.m")).alias("fit")).filter(F.col("fit") > 0)
    last = cut(chosen.groupBy("source").agg(F.max(F.struct("__at", "fit", "m")).alias("last")).select("source", "last.*"), "last")
    a, b = t.alias("a"), last.alias("b")
    out = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "a.source_size", "a.target", "a.epochs", F.col("b.__at").alias("last"))
    partial = last.filter(F.col("fit") < F.col("m"))
    if partial.isEmpty():
        return out.withColumn("last_row", F.lit(None).cast("long"))
    c, d = out.alias("c"), _last_rows(narrow, partial).alias("d")
    return c.join(d, F.col("c.source").eqNullSafe(F.col("d.source")), "left").select("c.*", "d.last_row")


def _last_rows(narrow: DataFrame, partial: DataFrame) -> DataFrame:
    """source and last_row: the fit-th of the rows at the place of partial (source, __at, fit), by their numbers.

    The rows are counted by the task that numbered them first; only those of one task are ranked."""
    a, b = narrow.alias("a"), small_side(partial).alias("b")
    tied = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & F.col("a.__at").eqNullSafe(F.col("b.__at")))
    tied = cut(tied.select("a.source", "a.__row", "b.fit", F.shiftright("a.__row", 33).alias("task")), "tied")
    up = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tied.groupBy("source", "task").agg(F.count("*").alias("n"), F.max("fit").alias("fit"))
    tasks = tasks.withColumn("left", F.col("fit") - F.coalesce(F.sum("n").over(up), F.lit(0)))
    tasks = tasks.filter((F.col("left") > 0) & (F.col("left") <= F.col("n")))
    x, y = tied.alias("x"), small_side(tasks).alias("y")
    rows = x.join(y, F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.task") == F.col("y.task"))).select("x.source", "x.__row", "y.left")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("__row"))
    return rows.withColumn("rank", rank).filter(F.col("rank") == F.col("left")).select("source", F.col("__row").alias("last_row"))


def copies(docs: DataFrame, plan_: DataFrame) -> DataFrame:
    """docs, as keyed, with __source_size, __target and __copies: how often the mix takes the document."""
    p = plan_.select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("epochs").alias("__epochs"), F.col("last").alias("__last"), F.col("last_row").alias("__last_row"))
    out = docs.join(small_side(p), F.col("source").eqNullSafe(F.col("__s")), "left")
    within = (F.col("__at") < F.col("__last")) | (F.col("__at") == F.col("__last")) & (F.col("__last_row").isNull() | (F.col("__row") <= F.col("__last_row")))
    taken = F.when(F.col("__last").isNotNull() & within, 1).otherwise(0)
    return out.withColumn("__copies", F.coalesce(F.col("__epochs"), F.lit(0)) + taken).drop("__s", "__epochs", "__last", "__last_row")


def mix(rows: DataFrame, size: Column, weight: Column) -> DataFrame:
    """rows (doc_id, source and others) with __size, __source_size, __target and __copies."""
    at = keyed(rows, size, weight)
    return copies(at, cut(plan(at.select("source", "__size", "__at", "__row")), "plan"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id", "source"])
    out = mix(seen.select("doc_id", "source", "__words", "__good"), F.col("__words"), F.col("__good"))
    discard(seen)  # the mix has a table of its own
    return out.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
    )


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; a document without words stays once an epoch.

    Null and empty texts have size 0; a null source is a source of its own; repeated rows are taken one by one; an
    empty table stays empty.
    """
    seen = judged(docs, table(spark, sf_dir, "labels"), docs.columns)
    out = mix(seen, F.col("__words"), F.col("__good"))
    discard(seen)  # the mix has a table of its own
    return out.filter(F.col("__copies") > 0).withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op9_mixing": op9_mixing}
