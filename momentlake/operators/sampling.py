"""Samplers over recorded frames.  What depends on a count or a maximum is a window; what depends on the last kept
frame is a greedy pass over one chunk's frames in order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.errors import Refused, UnknownOption


def media_clock(frames: DataFrame, raw: str = "raw", gap_s: float = 2.0, step: float = 0.0) -> DataFrame:
    """media_ts that goes on where the raw clock jumps back, rewinds so far, and whether there is a gap before."""
    w = Window.partitionBy("video_id").orderBy("arrival")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = frames.withColumn("delta", F.col(raw) - F.lag(raw).over(w)).withColumn("origin", F.first(raw).over(run))
    back = F.col("delta") < 0
    d = d.withColumn("shift", F.sum(F.when(back, F.lit(step) - F.col("delta")).otherwise(0.0)).over(run)).withColumn("rewinds", F.sum(F.when(back, 1).otherwise(0)).over(run))
    return d.withColumn("media_ts", F.col(raw) - F.col("origin") + F.col("shift")).withColumn("gap_before", F.coalesce(back | (F.col("delta") > gap_s), F.lit(False))).drop("delta", "origin", "shift")


def decimate(frames: DataFrame, per_second: float, ts: str = "media_ts") -> DataFrame:
    """The first frame of each 1/per_second of media time that is later than all before."""
    if per_second <= 0:
        raise Refused("a rate is over 0")
    w = Window.partitionBy("video_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)
    b = frames.withColumn("bucket", F.col(ts) * per_second).withColumn("bucket", F.col("bucket").cast("long"))
    return b.withColumn("seen", F.max("bucket").over(w)).filter(F.col("seen").isNull() | (F.col("bucket") > F.col("seen"))).drop("bucket", "seen")


def local_index(frames: DataFrame) -> DataFrame:
    w = Window.partitionBy("video_id", "chunk_id").orderBy("frame_index")
    return frames.withColumn("chunk_local_index", (F.row_number().over(w) - 1).cast("long"))


def every_nth(frames: DataFrame, n: int, max_per_chunk: int | None = None) -> DataFrame:
    """Of each chunk the frames 0, n, 2n, ...; at most max_per_chunk of them."""
    out = local_index(frames).filter(F.col("chunk_local_index") % n == 0)
    return out.filter(F.col("chunk_local_index") < n * max_per_chunk) if max_per_chunk else out


class Sampler:
    """Keeps frames of a chunk in order.  Subclasses say what a frame looks like and when it differs from the last kept
    one; the first frame of a chunk is always kept, limits are tested before a frame is looked at."""

    name = "sampler"
    max_per_chunk: int | None = None
    min_interval_s = 0.0

    def __init__(self, max_per_chunk: int | None = None, min_interval_s: float = 0.0):
        self.max_per_chunk, self.min_interval_s = max_per_chunk, min_interval_s
        self.reset()

    def reset(self) -> None:
        self.kept, self.last_ts, self.reference, self.last_score = 0, None, None, None

    def propose(self, value) -> bool:
        raise NotImplementedError

    def remember(self, value) -> None:
        self.reference = value

    def offer(self, ts: float, value) -> bool:
        if self.max_per_chunk is not None and self.kept >= self.max_per_chunk:
            return False
        if self.last_ts is not None and ts - self.last_ts < self.min_interval_s:
            return False
        if self.kept and not self.propose(value):
            return False
        if not self.kept:
            self.last_score = None
        self.remember(value)
        self.kept, self.last_ts = self.kept + 1, ts
        return True


class ChangeSampler(Sampler):
    """Keeps a frame whose vector's cosine with the reference falls below a threshold."""

    name = "clip"

    def __init__(self, threshold: float = 0.96, consecutive: bool = False, **limits):
        super().__init__(**limits)
        self.threshold, self.consecutive = threshold, consecutive

    def propose(self, value) -> bool:
        a, b = np.asarray(self.reference, float), np.asarray(value, float)
        self.last_score = float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))
        if self.consecutive:
            self.reference = value
        return self.last_score < self.threshold


class ScalarSampler(Sampler):
    """Keeps a frame whose score differs from the reference by at least `least`."""

    name = "scalar"

    def __init__(self, least: float, **limits):
        super().__init__(**limits)
        self.least = least

    def propose(self, value) -> bool:
        self.last_score = abs(float(value) - float(self.reference))
        return self.last_score >= self.least


class DetectionSampler(Sampler):
    """Keeps a frame in which an object is unlike all objects of the reference, or all of one class are gone.

    A frame without objects leaves the reference; a reference without objects lets any frame pass.  A value is a list
    of (class, box); likeness is that of the boxes, by overlap or by nearness, within a class or whatever the class."""

    name = "objects"

    def __init__(self, threshold: float = 0.3, metric: str = "iou", class_aware: bool = True, **limits):
        super().__init__(**limits)
        if metric not in ("iou", "proximity"):
            raise UnknownOption("metric", metric, ("iou", "proximity"))
        self.threshold, self.alike, self.class_aware = threshold, iou if metric == "iou" else nearness, class_aware

    def propose(self, value) -> bool:
        if not value:
            return False
        if not self.reference:
            return True
        best = [max((self.alike(b, r) if c == k or not self.class_aware else 0.0 for k, r in self.reference), default=0.0) for c, b in value]
        self.last_score = min(best)
        return self.last_score < self.threshold

    def remember(self, value) -> None:
        if value:
            self.reference = value

    def views(self, value, mode: str = "frame+crops") -> list[tuple[str, object]]:
        """What is shown of a kept frame: (label, box), a box of None being the frame itself."""
        if mode not in ("frame", "frame+crops", "crops"):
            raise UnknownOption("views", mode, ("frame", "frame+crops", "crops"))
        whole = [("frame", None)] if mode != "crops" or not value else []
        crops = [] if mode == "frame" else [(f"{c} {k} of {len(value)}", b) for k, (c, b) in enumerate(value, 1)]
        return whole + crops


class DescriptorSampler(Sampler):
    """Keeps a frame in which somebody is unlike everybody of the reference, by the cosine of their descriptors.

    A value is a list of vectors, one for each that is seen.  The score is the weakest best match, so one who is new is
    enough, however many others stay.  A frame without any leaves the reference; a reference without any lets a frame with
    some pass."""

    name = "yolo"

    def __init__(self, threshold: float = 0.83, **limits):
        super().__init__(**limits)
        self.threshold = threshold

    def propose(self, value) -> bool:
        if value is None or not len(value):
            self.last_score = 1.0
            return False
        if self.reference is None or not len(self.reference):
            self.last_score = 0.0
            return True
        unit = lambda x: (v := np.asarray(x, float)) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        self.last_score = float((unit(value) @ unit(self.reference).T).max(1).min())
        return self.last_score < self.threshold

    def remember(self, value) -> None:
        if value is not None and len(value):
            self.reference = value


class LayoutSampler(ChangeSampler):
    """Keeps a frame whose text stands elsewhere or reads otherwise: the cosine of masked pictures, see `text_layout`.

    A frame without text leaves the reference."""

    name = "text"

    def __init__(self, threshold: float = 0.92, **limits):
        super().__init__(threshold, **limits)

    def propose(self, value) -> bool:
        if value is None or not len(value):
            return False
        if self.reference is None or not len(self.reference):
            return True
        return super().propose(value)

    def remember(self, value) -> None:
        if value is not None and len(value):
            self.reference = value


# the ready samplers over detections, with their fixed thresholds


def people(threshold: float = 0.83, **limits) -> DescriptorSampler:
    """Over the descriptors of the people that are seen, one each (see `crops`)."""
    return DescriptorSampler(threshold, **limits)


def objects(threshold: float = 0.30, metric: str = "proximity", **limits) -> DetectionSampler:
    return DetectionSampler(threshold, metric, True, **limits)


def text(threshold: float = 0.92, **limits) -> LayoutSampler:
    return LayoutSampler(threshold, **limits)


def crops(picture: np.ndarray, boxes: list, embed, pad: float = 0.08, batch: int = 64) -> list[np.ndarray]:
    """The descriptor of each box's part of a picture (rows x columns, with or without colours), padded by a share of its
    size and cut at the edges.  embed: a list of pictures -> their vectors; it gets at most `batch` at a time."""
    h, w = picture.shape[:2]
    parts = []
    for x1, y1, x2, y2 in boxes:
        px, py = (x2 - x1) * pad, (y2 - y1) * pad
        left, top = int(max(0, min(x1 - px, w - 1))), int(max(0, min(y1 - py, h - 1)))
        parts.append(picture[top : max(top + 1, int(min(h, y2 + py))), left : max(left + 1, int(min(w, x2 + px)))])
    return [v for k in range(0, len(parts), batch) for v in embed(parts[k : k + batch])]


def text_layout(picture: np.ndarray, boxes: list, grid: int = 128, pad: float = 0.04) -> np.ndarray:
    """A grey picture (rows x columns) masked to its text boxes, on a grid x grid raster, centred, of norm 1; empty without boxes."""
    if not boxes:
        return np.zeros(0, np.float32)
    h, w = picture.shape
    mask = np.zeros((h, w), bool)
    for x1, y1, x2, y2 in boxes:
        px, py = (x2 - x1) * pad, (y2 - y1) * pad
        mask[int(max(0, y1 - py)) : int(min(h, y2 + py)), int(max(0, x1 - px)) : int(min(w, x2 + px))] = True
    shown = np.where(mask, picture, 0).astype(np.float64)
    # means over the cells of the raster, from sums up to each pixel
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = shown.cumsum(0).cumsum(1)
    r, c = (np.linspace(0, n, grid + 1).round().astype(int) for n in (h, w))
    area = np.maximum(np.outer(np.diff(r), np.diff(c)), 1)
    small = (total[np.ix_(r[1:], c[1:])] - total[np.ix_(r[:-1], c[1:])] - total[np.ix_(r[1:], c[:-1])] + total[np.ix_(r[:-1], c[:-1])]) / area
    v = small.ravel() - small.mean()
    n = np.linalg.norm(v)
    return (v / n if n > 1e-6 else np.zeros_like(v)).astype(np.float32)


def nearness(a, b) -> float:
    """1 for one box, falling with the distance of the centres in units of the mean diagonal, times the areas' agreement."""
    centre = lambda x: np.array([(x[0] + x[2]) / 2, (x[1] + x[3]) / 2])
    diagonal = lambda x: float(np.hypot(x[2] - x[0], x[3] - x[1]))
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    scale = max((diagonal(a) + diagonal(b)) / 2, 1e-9)
    return min(size(a), size(b)) / max(size(a), size(b), 1e-9) / (1 + float(np.linalg.norm(centre(a) - centre(b))) / scale)


def plane_change(planes, previous) -> float:
    """The mean, over planes such as hue, saturation and value, of the mean absolute difference of their pixels."""
    return float(np.mean([np.abs(np.asarray(a, float) - np.asarray(b, float)).mean() for a, b in zip(planes, previous, strict=True)]))


#: Pictures of a recording that one run of `picture_scores` reads in order.
PICTURES = 256


def picture_scores(frames: DataFrame, planes: Callable[[bytes], np.ndarray], stride: int = 1, span: int = PICTURES) -> DataFrame:
    """video_id, at and score: how much every stride-th picture differs from the one scored before; the first has none.

    frames: video_id, frame_index, media_ts and image; planes: an image -> its planes (3 x rows x columns).  A recording is
    cut into spans of `span` pictures, each with the last picture before it, so that a long one is read by many tasks."""
    if stride < 1:
        raise Refused("every first frame at least")

    def run(batches):
        at = before = None
        for b in batches:
            out = []
            for v, part, ts, image in zip(b["video_id"], b["span"], b["media_ts"], b["image"], strict=True):
                now = planes(bytes(image))
                if (v, part) == at:
                    out.append((v, ts, plane_change(now, before)))
                at, before = (v, part), now
            yield pd.DataFrame(out, columns=["video_id", "at", "score"])

    key = ["video_id", "frame_index"]
    rows = frames.filter(F.col("frame_index") % stride == 0).select(*key, F.floor(F.col("frame_index") / (stride * span)).alias("span"), "media_ts", "image")
    lasts = rows.groupBy("video_id", "span").agg(F.max("frame_index").alias("frame_index"))
    after = F.lead("span").over(Window.partitionBy("video_id").orderBy("span"))  # one row a span
    carried = rows.drop("span").join(lasts.select(*key, after.alias("span")).filter("span IS NOT NULL"), key).select(*rows.columns)
    order = ["video_id", "span", "frame_index"]
    return rows.unionByName(carried).repartition("video_id", "span").sortWithinPartitions(*order).drop("frame_index").mapInPandas(run, "video_id string, at double, score double")


def iou(a, b) -> float:
    """Intersection over union of boxes (x1, y1, x2, y2)."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0.0) * max(h, 0.0)
    area = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / area if area > 0 else 0.0


def sample(frames: DataFrame, make: Callable[[], list[Sampler]], value: str) -> DataFrame:
    """The frames that each sampler keeps, of all samplers in one pass; they start anew with every chunk, so a long recording
    spreads over tasks.  Chunks are many and short: a task reads its own ones in order, many to a batch."""

    def run(batches):
        at, samplers = None, []
        for b in batches:
            out = []
            for video, chunk, index, ts, v in zip(b["video_id"], b["chunk_id"], b["frame_index"], b["media_ts"], b["value"], strict=True):
                chunk = None if chunk != chunk else int(chunk)
                if (video, chunk) != at:
                    at, samplers = (video, chunk), make()
                    for s in samplers:
                        s.reset()
                out += [(video, chunk, s.name, index, ts, s.last_score) for s in samplers if s.offer(ts, v)]
            yield pd.DataFrame(out, columns=["video_id", "chunk_id", "sampler", "frame_index", "media_ts", "change"])

    key = ["video_id", "chunk_id"]
    small = frames.select(*key, "frame_index", "media_ts", F.col(value).alias("value"))
    return small.repartition(*key).sortWithinPartitions(*key, "frame_index").mapInPandas(run, "video_id string, chunk_id long, sampler string, frame_index long, media_ts double, change double")


def context(frames: DataFrame, before: int, after: int) -> DataFrame:
    """Every frame with the indexes of its neighbours in order, fewer at the ends."""
    w = Window.partitionBy("video_id").orderBy("frame_index")
    return frames.withColumn("before", F.collect_list("frame_index").over(w.rowsBetween(-before, -1))).withColumn("after", F.collect_list("frame_index").over(w.rowsBetween(1, after)))


def top_crops(boxes: DataFrame, most: int) -> DataFrame:
    """Per frame the `most` largest boxes, numbered from left to right."""
    w = Window.partitionBy("video_id", "frame_index")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    big = boxes.withColumn("r", F.row_number().over(w.orderBy(F.desc(area), "x1", "y1"))).filter(F.col("r") <= most).drop("r")
    return big.withColumn("crop", (F.row_number().over(w.orderBy("x1", "y1", "x2", "y2")) - 1).cast("long"))


def scene_scores(frames: DataFrame, stride: int = 1, value: str = "score") -> DataFrame:
    """The change of the value against the scored frame before; every stride-th frame is scored, the first has none."""
    w = Window.partitionBy("video_id").orderBy("frame_index")
    return frames.filter(F.col("frame_index") % stride == 0).withColumn("change", F.abs(F.col(value) - F.lag(value).over(w)))


def manifest_stats(sampled: DataFrame, decimated: DataFrame) -> DataFrame:
    s = sampled.groupBy("video_id").agg(F.count("*").alias("sampled"), F.countDistinct("chunk_id").alias("chunks_with_frames"), F.countDistinct("frame_index").alias("stored"))
    return decimated.groupBy("video_id").agg(F.count("*").alias("decimated")).join(s, "video_id", "left")
