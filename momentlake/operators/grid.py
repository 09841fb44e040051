"""Time grids: building them, and finding the chunk of a time.

A grid has as many rows as its recordings have chunks, which the optimizer takes for the size of the durations that it is
made of: joins with one are told to shuffle and merge, as it would be broadcast whole otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlake.errors import Refused, UnknownOption
from momentlake.functions.numbers import rounded

TAIL = 0.25


def uniform(durations: DataFrame, chunk_s: float = 20.0) -> DataFrame:
    """video_id, chunk_id, start_ts, end_ts: equal chunks; a last one under a quarter of chunk_s joins the one before."""
    if chunk_s <= 0:
        raise Refused("a chunk lasts longer than nothing")
    n = F.greatest(F.ceil(F.col("duration_s") / chunk_s), F.lit(1)).cast("long")
    tail = F.col("duration_s") - (F.col("n") - 1) * chunk_s
    d = durations.select("video_id", "duration_s", n.alias("n"))
    d = d.withColumn("n", F.when((F.col("n") > 1) & (tail < TAIL * chunk_s), F.col("n") - 1).otherwise(F.col("n")))
    g = d.select("video_id", "duration_s", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("chunk_id"))
    g = g.select("video_id", "chunk_id", (F.col("chunk_id") * chunk_s).alias("start_ts"), F.when(F.col("chunk_id") == F.col("n") - 1, F.col("duration_s")).otherwise((F.col("chunk_id") + 1) * chunk_s).alias("end_ts"))
    return g.hint("merge")


def spans_between(cuts: DataFrame, durations: DataFrame) -> DataFrame:
    """Spans between 0, the cuts inside the recording and its end; position counts them."""
    ends = durations.select("video_id", F.col("duration_s").alias("at")).unionByName(durations.select("video_id", F.lit(0.0).alias("at")))
    inside = cuts.join(durations, "video_id").filter((F.col("at") > 0) & (F.col("at") < F.col("duration_s"))).select("video_id", "at")
    w = Window.partitionBy("video_id").orderBy("at")
    edges = ends.unionByName(inside).distinct()
    return (
        edges.select("video_id", (F.row_number().over(w) - 1).cast("long").alias("position"), F.col("at").alias("start_ts"), F.lead("at").over(w).alias("end_ts"))
        .filter(F.col("end_ts").isNotNull())
    )


def merge_short(spans: DataFrame, min_s: float) -> DataFrame:
    """Spans shorter than min_s join the one before; a short first one takes in the next."""
    w = Window.partitionBy("video_id").orderBy("start_ts")
    opens = (F.col("end_ts") - F.col("start_ts") >= min_s) | (F.row_number().over(w) == 1)
    merged = spans.withColumn("opens", opens).withColumn("island", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("video_id", "island").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    first = F.min(F.when((F.col("island") == 1) & (F.col("end_ts") - F.col("start_ts") < min_s), 1)).over(Window.partitionBy("video_id"))
    merged = merged.withColumn("island", F.when(first.isNotNull() & (F.col("island") == 2), 1).otherwise(F.col("island")))
    return merged.groupBy("video_id", "island").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts")).drop("island")


def split_long(spans: DataFrame, max_s: float) -> DataFrame:
    """Spans longer than max_s in as few equal parts as fit."""
    n = F.greatest(F.ceil((F.col("end_ts") - F.col("start_ts")) / max_s), F.lit(1)).cast("long")
    s = spans.withColumn("n", n).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    step = (F.col("end_ts") - F.col("start_ts")) / F.col("n")
    return s.select("video_id", (F.col("start_ts") + F.col("part") * step).alias("start_ts"), F.when(F.col("part") == F.col("n") - 1, F.col("end_ts")).otherwise(F.col("start_ts") + (F.col("part") + 1) * step).alias("end_ts")).hint("merge")


def merge_tail(spans: DataFrame, least: float) -> DataFrame:
    """A last span shorter than `least` joins the one before it; then chunk_id counts."""
    w = Window.partitionBy("video_id").orderBy("start_ts")
    last = F.lead("start_ts").over(w).isNull()
    s = spans.withColumn("is_last", last).withColumn("at", F.row_number().over(w))
    joins = F.col("is_last") & (F.col("at") > 1) & (F.col("end_ts") - F.col("start_ts") < least)
    s = s.withColumn("group", F.when(joins, F.col("at") - 1).otherwise(F.col("at")))
    s = s.groupBy("video_id", "group").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    return s.select("video_id", (F.row_number().over(w) - 1).cast("long").alias("chunk_id"), "start_ts", "end_ts")


def from_cuts(cuts: DataFrame, durations: DataFrame, min_s: float = 5.0, max_s: float = 30.0) -> DataFrame:
    """The grid of a content policy: spans between cuts, guarded by a shortest and a longest chunk."""
    if min_s < 0 or max_s <= 0 or min_s > max_s:
        raise Refused("0 <= min_s <= max_s and max_s > 0 are needed")
    return merge_tail(split_long(merge_short(spans_between(cuts, durations), min_s), max_s), min_s)


def build(policy: str, durations: DataFrame, cuts: DataFrame | None = None, chunk_s: float = 20.0, min_s: float = 5.0, max_s: float | None = None) -> DataFrame:
    """The grid by a policy; longest chunks default to chunk_s."""
    if policy == "uniform":
        return uniform(durations, chunk_s)
    if policy not in ("scene", "vad", "speaker"):
        raise UnknownOption("policy", policy, ("uniform", "scene", "vad", "speaker"))
    if cuts is None:
        raise Refused(f"policy {policy} needs cuts")
    return from_cuts(cuts, durations, min_s, max_s or chunk_s)


def _by_bucket(rows: DataFrame, spans: DataFrame, at: str, bucket_s: float | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a bucket of time as one more join key, so that a row meets the few spans of its bucket instead of
    all of its recording's, and a long recording is dealt out to many tasks.  The spans are for a merge join."""
    if not bucket_s:
        return rows, spans.hint("merge"), []
    number = lambda c: F.floor(F.col(c) / bucket_s)
    return rows.withColumn("__b", number(at)), spans.withColumn("__c", F.explode(F.sequence(number("__s"), number("__e")))).hint("merge"), ["__b", "__c"]


def with_chunk(rows: DataFrame, grid: DataFrame, at: str, how: str = "inner", bucket_s: float | None = None) -> DataFrame:
    """rows with the chunk_id of their time: half-open chunks, the last owns its end.  An equi-join on video_id, and on a
    bucket of bucket_s seconds (about a chunk's length) if given, with a range condition."""
    last = F.max("chunk_id").over(Window.partitionBy("video_id"))
    g = grid.withColumn("__last", F.col("chunk_id") == last).select(F.col("video_id").alias("__v"), "chunk_id", F.col("start_ts").alias("__s"), F.col("end_ts").alias("__e"), "__last")
    rows, g, more = _by_bucket(rows, g, at, bucket_s)
    inside = (F.col(at) >= F.col("__s")) & ((F.col(at) < F.col("__e")) | (F.col("__last") & (F.col(at) == F.col("__e"))))
    same = F.col("video_id") == F.col("__v")
    return rows.join(g, (same & (F.col("__b") == F.col("__c")) if more else same) & inside, how).drop("__v", "__s", "__e", "__last", *more)


def nearest_chunk(rows: DataFrame, grid: DataFrame, at: str, bucket_s: float | None = None) -> DataFrame:
    """As with_chunk, but times outside of the grid go to its first or last chunk."""
    ends = grid.groupBy("video_id").agg(F.min("start_ts").alias("__low"), F.max("end_ts").alias("__high"))
    near = rows.join(ends, "video_id").withColumn("__at", F.least(F.greatest(F.col(at), F.col("__low")), F.col("__high")))
    return with_chunk(near, grid, "__at", bucket_s=bucket_s).drop("__at", "__low", "__high")


def chunks_overlapping(grid: DataFrame, after: float | None, before: float | None) -> DataFrame:
    """Chunks that overlap the window [after, before]."""
    out = grid
    if after is not None:
        out = out.filter(F.col("end_ts") > after)
    if before is not None:
        out = out.filter(F.col("start_ts") < before)
    return out


def widened(chunks: DataFrame, grid: DataFrame, window: int) -> DataFrame:
    """Distinct chunk ids within `window` of the given ones, up to the longest grid's end."""
    top = grid.agg(F.max("chunk_id")).scalar()
    ids = chunks.select("chunk_id").distinct().select(F.explode(F.sequence(F.col("chunk_id") - window, F.col("chunk_id") + window)).alias("chunk_id")).distinct()
    return ids.filter((F.col("chunk_id") >= 0) & (F.col("chunk_id") <= top))


def span_of(rows: DataFrame, by: list[str], ids: str, grid: DataFrame, missing: Column | None = None) -> DataFrame:
    """Start and end of a set of chunk ids per row group; ids outside of the grid don't count."""
    hit = rows.select("video_id", *by, F.explode_outer(ids).alias("chunk_id")).join(grid, ["video_id", "chunk_id"], "left")
    pick = (lambda c: F.coalesce(c, missing)) if missing is not None else (lambda c: c)
    return hit.groupBy("video_id", *by).agg(pick(F.min("start_ts")).alias("start_ts"), pick(F.max("end_ts")).alias("end_ts"))


def threshold_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: cuts, cuts per score and the upper median of gaps between cuts of a video.

    The median is read off a histogram of the gaps, so that no threshold's gaps are sorted in one task."""
    t = scores.select("video_id", "at", "score", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    n = t.groupBy("threshold").agg(F.count("*").alias("scored"), F.count_if(F.col("score") >= F.col("threshold")).alias("cuts"))
    w = Window.partitionBy("threshold", "video_id").orderBy("at")
    gaps = t.filter(F.col("score") >= F.col("threshold")).select("threshold", (F.col("at") - F.lag("at").over(w)).alias("gap")).filter("gap IS NOT NULL")
    counts = gaps.groupBy("threshold", "gap").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("threshold").orderBy("gap"))
    total = F.sum("m").over(Window.partitionBy("threshold"))
    median = counts.withColumn("upto", upto).withColumn("total", total).filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("threshold").agg(F.min("gap").alias("median_gap"))
    return n.join(median, "threshold", "left").select("threshold", "cuts", (F.col("cuts") / F.col("scored")).alias("rate"), "median_gap")


#: Thresholds that a calibration reports, on the scale of scene scores and of seconds of silence.
SCENE_THRESHOLDS = [5.0, 10.0, 15.0, 20.0, 27.0, 35.0, 45.0, 60.0, 80.0]
SILENCE_THRESHOLDS = [0.25, 0.5, 0.65, 1.0, 1.5, 2.0, 3.0]


def calibrate(scores: DataFrame, source: str = "video", thresholds: list[float] | None = None) -> DataFrame:
    """What each threshold would cut, from stored scores; reports and doesn't choose."""
    return threshold_sweep(scores, thresholds or (SCENE_THRESHOLDS if source == "video" else SILENCE_THRESHOLDS))


def retune(scores: DataFrame, threshold: float) -> DataFrame:
    """The cuts (video_id, at, score) of another threshold over stored scores."""
    return scores.filter(F.col("score") >= threshold).select("video_id", "at", "score")


def boundary_stats(grid: DataFrame) -> DataFrame:
    """Per video: chunks, shortest and longest chunk, duration."""
    length = F.col("end_ts") - F.col("start_ts")
    return grid.groupBy("video_id").agg(F.count("*").alias("chunks"), rounded(F.min(length), 3).alias("shortest_s"), rounded(F.max(length), 3).alias("longest_s"), rounded(F.max("end_ts"), 3).alias("duration_s"))
