"""Stored pictures: a table of frames and of the views that samplers made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A frame itself has no sampler and the number 0; the images that a sampler made of it count from 1.
KEY = ["video_id", "frame_index", "sampler_id", "view"]


def as_frames(images: DataFrame) -> DataFrame:
    """Rows of KEY and image from decoded frames (video_id, frame_index, image)."""
    return images.select("video_id", "frame_index", F.lit("").alias("sampler_id"), F.lit(0).alias("view"), "image")


def numbered_views(views: DataFrame) -> DataFrame:
    """views with their number: 0 for the frame itself, the images made from it by 1, 2, ... in order.

    views: video_id, frame_index, sampler_id, position, is_frame."""
    w = Window.partitionBy("video_id", "frame_index", "sampler_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    made = F.sum(F.when(F.col("is_frame"), 0).otherwise(1)).over(w)
    return views.withColumn("view", F.when(F.col("is_frame"), 0).otherwise(made).cast("int"))


def store(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """stored and those of new that it doesn't have; repeated ones once."""
    new = new.dropDuplicates(KEY)
    return new if stored is None else stored.unionByName(new.join(stored.select(*KEY), KEY, "left_anti"))


def prune(stored: DataFrame, keep: DataFrame) -> DataFrame:
    """The stored frames and views that keep (KEY) names."""
    return stored.join(keep.select(*KEY).distinct(), KEY, "left_semi")


def images_for(sampled: DataFrame, stored: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """The images that are shown for each sampled frame, in order; one that the store doesn't hold is an error when read.

    sampled: video_id, chunk_id, sampler_id, frame_index; views: as numbered, with label; a sampled frame without views is
    shown itself."""
    keys = ["video_id", "sampler_id", "frame_index"]
    shown = sampled if views is None else sampled.join(views.select(*keys, "position", "is_frame", "view", "label"), keys, "left")
    if views is None:
        shown = shown.withColumns({"position": F.lit(0), "view": F.lit(0), "label": F.lit(None).cast("string"), "is_frame": F.lit(True)})
    shown = shown.withColumn("view", F.coalesce("view", F.lit(0))).withColumn("position", F.coalesce("position", F.lit(0)))
    own = F.when(F.col("view") == 0, "").otherwise(F.col("sampler_id"))
    s = stored.select(F.col("video_id").alias("__v"), F.col("frame_index").alias("__f"), F.col("sampler_id").alias("__s"), F.col("view").alias("__n"), "image")
    j = shown.withColumn("__own", own).join(s, (F.col("video_id") == F.col("__v")) & (F.col("frame_index") == F.col("__f")) & (F.col("__own") == F.col("__s")) & (F.col("view") == F.col("__n")), "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("not stored: frame"), F.col("frame_index").cast("string"), F.lit("of"), F.col("video_id"), F.col("__own"), F.col("view").cast("string")))
    return j.withColumn("image", F.when(F.col("image").isNotNull(), F.col("image")).otherwise(missing)).drop("__v", "__f", "__s", "__n", "__own", "is_frame")


def recreated(sampled: DataFrame, decoded: DataFrame) -> DataFrame:
    """The frames that a manifest names, from frames decoded anew; each once."""
    wanted = sampled.select("video_id", "frame_index").distinct()
    return as_frames(decoded.join(wanted, ["video_id", "frame_index"], "left_semi"))


def verified(stored: DataFrame, again: DataFrame) -> DataFrame:
    """KEY and problem (missing, extra, different) of what two stores don't have alike, byte by byte."""
    a, b = (d.select(*KEY, F.sha2("image", 256).alias(n)) for d, n in ((stored, "a"), (again, "b")))
    j = a.join(b, KEY, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return j.select(*KEY, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("different").alias("problem"))
