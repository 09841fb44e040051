"""Segmentation of a sequence of vectors: gap similarities, depths, boundaries, and merges to a floor and a ceiling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.errors import Refused
from momentlake.functions import vectors as V
from momentlake.functions.numbers import rounded


def gap_similarity(rows: DataFrame, by: str = "video_id", order: str = "position", vector: str = "vector") -> DataFrame:
    """For the gap after each row but the last: the cosine of the means of up to two unit vectors on either side."""
    w = Window.partitionBy(by).orderBy(order)
    u = rows.select(by, order, V.unit(F.col(vector)).alias("u"))
    u = u.withColumn("l", F.collect_list("u").over(w.rowsBetween(-1, 0))).withColumn("r", F.collect_list("u").over(w.rowsBetween(1, 2))).filter(F.size("r") > 0)
    return u.select(by, order, V.cosine(V.mean_vector(F.col("l")), V.mean_vector(F.col("r"))).alias("similarity"))


def depths(gaps: DataFrame, by: str = "video_id", order: str = "position", value: str = "similarity") -> DataFrame:
    """How deep each gap lies under the peaks that are reached by climbing without a descent to either side."""
    w = Window.partitionBy(by).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = gaps.withColumn("p", F.lag(value).over(w))
    d = d.withColumn("up", F.sum(F.when(F.col(value) > F.col("p"), 1).otherwise(0)).over(run)).withColumn("down", F.sum(F.when(F.col(value) < F.col("p"), 1).otherwise(0)).over(run))
    left = F.first(value).over(Window.partitionBy(by, "up").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    right = F.last(value).over(Window.partitionBy(by, "down").orderBy(order).rowsBetween(0, Window.unboundedFollowing))
    return d.select(by, order, value, ((left - F.col(value)) + (right - F.col(value))).alias("depth"))


def boundaries(deep: DataFrame, by: str = "video_id", order: str = "position", value: str = "similarity") -> DataFrame:
    """Valleys (no higher than their neighbours, under at least one peak) at least as deep as the valleys' mean depth
    less half of its deviation."""
    w = Window.partitionBy(by).orderBy(order)
    local = (F.coalesce(F.lag(value).over(w), F.col(value)) >= F.col(value)) & (F.coalesce(F.lead(value).over(w), F.col(value)) >= F.col(value))
    valleys = deep.withColumn("valley", local & (F.col("depth") > 0)).filter("valley")
    p = Window.partitionBy(by)
    bar = F.avg("depth").over(p) - F.stddev_pop("depth").over(p) / 2
    return valleys.withColumn("bar", bar).filter(F.col("depth") >= F.col("bar")).select(by, order, "depth")


def merge_segments(seconds: list[float], sums: np.ndarray, rows: list[int], shortest: float = 0.0, most: int | None = None) -> list[int]:
    """Segments by number after merging: one shorter than `shortest` joins its more alike neighbour (the left of
    equals), the shortest first; then the most alike neighbours merge until at most `most` are left.

    sums, rows: of each segment the sum of its rows' unit vectors and their number, so that the centre of a merged
    segment is that of all its rows.  Returns the number of the new segment of each old one."""
    if most is not None and most < 1:
        raise Refused("at least one segment is left")
    size, total, count = list(seconds), [np.asarray(v, float) for v in sums], list(rows)
    members = [[i] for i in range(len(size))]

    def alike(i: int) -> float:  # i and i + 1
        a, b = total[i] / count[i], total[i + 1] / count[i + 1]
        return float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))

    def merge(i: int) -> None:
        for held in (size, total, count, members):
            held[i] = held[i] + held.pop(i + 1)

    while len(size) > 1 and min(size) < shortest:
        i = size.index(min(size))
        merge(0 if i == 0 else i - 1 if i == len(size) - 1 or alike(i - 1) >= alike(i) else i)
    while most is not None and len(size) > most:
        merge(max(range(len(size) - 1), key=alike))
    out = [0] * len(seconds)
    for k, own in enumerate(members):
        for i in own:
            out[i] = k
    return out


def segment(rows: DataFrame, shortest: float = 30.0, most: int | None = None) -> DataFrame:
    """video_id, position, segment.  rows: video_id, position, seconds, vector.

    Gaps, depths and boundaries are windows; only the merges, over the few segments of one video, run in Python."""
    cuts = boundaries(depths(gap_similarity(rows))).select("video_id", "position", F.lit(1).alias("cut"))
    w = Window.partitionBy("video_id").orderBy("position")
    s = rows.join(cuts, ["video_id", "position"], "left")
    s = s.withColumn("raw", F.coalesce(F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    flat = s.select("video_id", "raw", F.posexplode(V.unit(F.col("vector"))).alias("d", "x"))
    sums = flat.groupBy("video_id", "raw", "d").agg(F.sum("x").alias("x")).groupBy("video_id", "raw").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("m"))
    sizes = s.groupBy("video_id", "raw").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("rows"))
    per = sums.join(sizes, ["video_id", "raw"]).select("video_id", "raw", "seconds", "rows", F.transform("m", lambda e: e["x"]).alias("sum"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("raw").reset_index(drop=True)
        pdf["segment"] = merge_segments(pdf["seconds"].tolist(), np.array(pdf["sum"].tolist()), pdf["rows"].tolist(), shortest, most)
        return pdf[["video_id", "raw", "segment"]]

    final = per.groupBy("video_id").applyInPandas(run, "video_id string, raw long, segment long")
    return s.join(final, ["video_id", "raw"]).select("video_id", "position", "segment")


def chunks_of(starts: DataFrame, grid: DataFrame) -> DataFrame:
    """grid with the segment of every chunk: a segment goes on to the chunk before the next one's first, the first
    begins at the grid's start.  starts: video_id, segment, chunk_id (its first row's chunk)."""
    w = Window.partitionBy("video_id").orderBy("chunk_id")
    first = starts.groupBy("video_id", "segment").agg(F.min("chunk_id").alias("chunk_id"))
    g = grid.join(first, ["video_id", "chunk_id"], "left")
    held = F.last("segment", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    g = g.withColumn("segment", F.coalesce(held, F.min("segment").over(Window.partitionBy("video_id"))))
    return g.filter("segment IS NOT NULL").select("video_id", "chunk_id", "start_ts", "end_ts", "segment")


def chapters(rows: DataFrame, grid: DataFrame, shortest: float = 30.0, most: int | None = None, name: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row a span: video_id, segment, chunk_ids, start_ts, end_ts, count (the video's spans), covers_all, uncovered,
    and what `name` adds.

    rows: video_id, chunk_id, position, seconds, vector and, for names, text.  name: (video_id, segment, count, texts)
    -> (video_id, segment, fields ...), a DataFrame step behind which a model may be."""
    found = rows.join(segment(rows, shortest, most), ["video_id", "position"])
    placed = chunks_of(found.select("video_id", "segment", "chunk_id"), grid)
    spans = placed.groupBy("video_id", "segment").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"), rounded(F.min("start_ts"), 3).alias("start_ts"), rounded(F.max("end_ts"), 3).alias("end_ts"))
    missing = grid.join(placed.select("video_id", "chunk_id"), ["video_id", "chunk_id"], "left_anti").groupBy("video_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("uncovered"))
    spans = spans.withColumn("count", F.count("*").over(Window.partitionBy("video_id"))).join(missing, "video_id", "left")
    spans = spans.withColumn("uncovered", F.coalesce("uncovered", F.array().cast("array<bigint>"))).withColumn("covers_all", F.size("uncovered") == 0)
    if name is None:
        return spans
    texts = found.groupBy("video_id", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda e: e["text"]).alias("texts"))
    counted = texts.join(spans.select("video_id", "segment", "count"), ["video_id", "segment"])
    return spans.join(name(counted), ["video_id", "segment"], "left")
