"""The live side: media clock, decimation and sampling as one stateful stream, load shedding and sinks."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from momentlake.errors import Refused
from momentlake.operators.sampling import Sampler

KEPT = "video_id string, sampler string, chunk_id long, frame_index long, media_ts double, gap_before boolean, rewinds long"


class LiveSampler(StatefulProcessor):
    """Per stream: a clock that goes on after a rewind, the first frame of each slice, a tumbling chunk, and samplers
    that start anew with every chunk.  The state is one row: clock, last slice, chunk, and the samplers' own."""

    def __init__(self, samplers: Callable[[], list[Sampler]], per_second: float, chunk_s: float, gap_s: float = 2.0, step: float = 0.0):
        self.samplers, self.per_second, self.chunk_s, self.gap_s, self.step = samplers, per_second, chunk_s, gap_s, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "blob binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import pickle

        if self.state.exists():
            s = pickle.loads(self.state.get()[0])  # noqa: S301  written by this class only
        else:
            s = {"origin": None, "last": None, "shift": 0.0, "bucket": None, "chunk": None, "rewinds": 0, "index": 0, "samplers": self.samplers()}
        out = []
        held = pd.concat(list(rows), ignore_index=True)  # one stream's frames of a micro-batch, which the trigger bounds
        held = held.sort_values("arrival", kind="stable")
        for raw, value in zip(held["raw"], held["value"], strict=True):
            gap = False
            if s["origin"] is None:
                s["origin"] = raw
            else:
                delta = raw - s["last"]
                gap = delta < 0 or delta > self.gap_s
                if delta < 0:
                    s["shift"] += self.step - delta
                    s["rewinds"] += 1
            s["last"] = raw
            ts = raw - s["origin"] + s["shift"]
            index, s["index"] = s["index"], s["index"] + 1
            bucket = int(ts * self.per_second)
            if s["bucket"] is not None and bucket <= s["bucket"]:
                continue
            s["bucket"] = bucket
            chunk = int(ts // self.chunk_s)
            if chunk != s["chunk"]:
                s["chunk"] = chunk
                for x in s["samplers"]:
                    x.reset()
            out += [(key[0], x.name, chunk, index, ts, gap, s["rewinds"]) for x in s["samplers"] if x.offer(ts, value)]
        self.state.update((pickle.dumps(s),))
        yield pd.DataFrame(out, columns=["video_id", "sampler", "chunk_id", "frame_index", "media_ts", "gap_before", "rewinds"])

    def close(self) -> None:
        return None


def live_frames(stream: DataFrame, samplers: Callable[[], list[Sampler]], per_second: float = 1.0, chunk_s: float = 20.0, gap_s: float = 2.0) -> DataFrame:
    """The kept frames of a stream of (video_id, arrival, raw, value)."""
    return stream.groupBy("video_id").transformWithStateInPandas(LiveSampler(samplers, per_second, chunk_s, gap_s), KEPT, "Append", "None")


FRAME = "video_id string, arrival long, raw double, value double"


def source(spark: SparkSession, url: str, files: int = 100) -> DataFrame:
    """Lines of a live source as a stream with `line`: tcp://host:port, a folder of files (file://... or a path of any
    store), or rate://n for n lines a second that stand for frames."""
    scheme, _, rest = url.partition("://")
    if scheme == "tcp":
        host, _, port = rest.partition(":")
        if not host or not port.isdigit():
            raise Refused(f"{url!r} names no host and port")
        return spark.readStream.format("socket").option("host", host).option("port", int(port)).load().select(F.col("value").alias("line"))
    if scheme == "rate":
        r = spark.readStream.format("rate").option("rowsPerSecond", int(rest or 1)).load()
        return r.select(F.to_json(F.struct(F.lit("rate").alias("video_id"), F.col("value").alias("arrival"), F.col("value").cast("double").alias("raw"), F.col("value").cast("double").alias("value"))).alias("line"))
    return spark.readStream.option("maxFilesPerTrigger", files).text(url).select(F.col("value").alias("line"))


def parsed(lines: DataFrame, video_id: str | None = None) -> DataFrame:
    """FRAME and `corrupt` of every line: one that is no frame has corrupt and nothing else."""
    f = F.from_json("line", FRAME)
    bad = f["raw"].isNull()
    name = F.lit(video_id) if video_id else f["video_id"]
    return lines.select(F.when(~bad, name).alias("video_id"), f["arrival"].alias("arrival"), f["raw"].alias("raw"), f["value"].alias("value"), bad.alias("corrupt"))


def recorded(lines: DataFrame, folder: str, checkpoint: str):
    """Start a query that keeps the lines of a source as they come, beside what else reads it."""
    return lines.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frames(spark: SparkSession, url: str, samplers: Callable[[], list[Sampler]], per_second: float = 1.0, chunk_s: float = 20.0, gap_s: float = 2.0, video_id: str | None = None) -> DataFrame:
    """The kept frames of a live source; lines that are no frames are skipped."""
    return live_frames(parsed(source(spark, url), video_id).filter("NOT corrupt").drop("corrupt"), samplers, per_second, chunk_s, gap_s)


CONTEXT = "video_id string, frame_index long, media_ts double, before array<long>, after array<long>, flushed boolean"


class ContextBuffer(StatefulProcessor):
    """Kept frames with the indexes of the frames before and after them.

    Rows are frames in order of arrival, `kept` or not; a kept frame goes out once the frames after it have come.  A row
    whose frame_index is null ends the stream: what still waits goes out with what there is, flushed."""

    def __init__(self, before: int, after: int):
        self.before, self.after = before, after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "blob binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import pickle

        ring, waiting = pickle.loads(self.state.get()[0]) if self.state.exists() else ([], [])  # noqa: S301  written by this class only
        out = []
        for x in pd.concat(list(rows), ignore_index=True).sort_values("arrival", kind="stable").itertuples():
            if pd.isna(x.frame_index):
                out += [(key[0], i, ts, b, a, len(a) < self.after) for i, ts, b, a in waiting]
                ring, waiting = [], []
                continue
            index = int(x.frame_index)
            for ask in waiting:
                ask[3].append(index)
            out += [(key[0], i, ts, b, a, False) for i, ts, b, a in waiting if len(a) >= self.after]
            waiting = [ask for ask in waiting if len(ask[3]) < self.after]
            if x.kept:
                ask = (index, float(x.media_ts), list(ring), [])
                if self.after:
                    waiting.append(ask)
                else:
                    out.append((key[0], *ask, False))
            ring = [*ring, index][-self.before :] if self.before else []
        self.state.update((pickle.dumps((ring, waiting)),))
        yield pd.DataFrame(out, columns=["video_id", "frame_index", "media_ts", "before", "after", "flushed"])

    def close(self) -> None:
        return None


def live_context(stream: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """The kept frames of a stream of (video_id, arrival, frame_index, media_ts, kept) with their neighbours."""
    return stream.groupBy("video_id").transformWithStateInPandas(ContextBuffer(before, after), CONTEXT, "Append", "None")


def shed(batch: DataFrame, by: str, newest: list, room: int) -> tuple[DataFrame, DataFrame]:
    """A micro-batch cut down to the newest `room` rows of each stream, and what was dropped."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in newest])
    r = batch.withColumn("__r", F.row_number().over(w))
    return r.filter(F.col("__r") <= room).drop("__r"), r.filter(F.col("__r") > room).drop("__r")


def answer(rows: DataFrame, model: Callable[[pd.DataFrame], list[str]], schema: str, concurrency: int = 1) -> DataFrame:
    """rows with `description` from a model by batches, and `error` in place of it where the model failed.

    With a concurrency, a batch is asked in that many parts at a time."""

    def ask(pdf: pd.DataFrame) -> tuple[list, list]:
        try:
            return list(model(pdf)), [None] * len(pdf)
        except Exception:  # noqa: BLE001  one row's failure mustn't lose the batch
            said, wrong = [], []
            for k in range(len(pdf)):
                try:
                    said.append(model(pdf.iloc[[k]])[0])
                    wrong.append(None)
                except Exception as e:  # noqa: BLE001
                    said.append(None)
                    wrong.append(str(e))
            return said, wrong

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for pdf in batches:
                step = max(1, -(-len(pdf) // max(1, concurrency)))
                found = list(pool.map(ask, [pdf.iloc[k : k + step] for k in range(0, len(pdf), step)]))
                yield pdf.assign(description=[x for said, _ in found for x in said], error=[x for _, wrong in found for x in wrong])

    return rows.mapInPandas(run, f"{schema}, description string, error string")


class StopStream(Exception):  # noqa: N818  a request, no failure
    """Raised by a writer of a stream to end it after the present micro-batch."""


def pump(kept: DataFrame, checkpoint: str, room: int, write: Callable[[DataFrame], None], dropped: Callable[[DataFrame], None] | None = None, every: str | None = None):
    """Start a query that sheds load, then hands each micro-batch to `write`; it runs what is there and ends or, with
    `every`, goes on at that interval until it is stopped (see `until`)."""
    stop = threading.Event()

    def batch(df: DataFrame, _: int) -> None:
        if stop.is_set():
            return
        df = df.persist()
        keep, lost = shed(df, "video_id", ["media_ts", "frame_index"], room)
        try:
            write(keep)
            if dropped:
                dropped(lost)
        except StopStream:
            stop.set()
        finally:
            df.unpersist()

    writer = kept.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    query.stop_requested = stop
    return query


def until(query, stop_after_s: float | None = None, event: threading.Event | None = None, finish: Callable[[], None] | None = None, poll: float = 0.2) -> str:
    """Wait for a query to end, and why it did: end, time, event, callback or error.

    It ends by itself, after so many seconds, when the event is set, or when a writer raised StopStream.  finish (writing
    the documents) runs in any case; only then is an error of the query raised."""
    began, why = time.monotonic(), "end"
    try:
        while not query.awaitTermination(poll):
            asked = getattr(query, "stop_requested", None)
            if asked is not None and asked.is_set():
                why = "callback"
            elif event is not None and event.is_set():
                why = "event"
            elif stop_after_s is not None and time.monotonic() - began >= stop_after_s:
                why = "time"
            else:
                continue
            query.stop()
            break
        asked = getattr(query, "stop_requested", None)
        if why == "end" and asked is not None and asked.is_set():
            why = "callback"
    finally:
        if finish is not None:
            finish()
    return why


def jsonl_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows as lines of JSON; a batch that is tried again replaces its own file folder."""
    return lambda batch, number: batch.write.mode("overwrite").json(f"{folder.rstrip('/')}/batch-{number:09d}")


def counters(frames: DataFrame) -> DataFrame:
    """Per stream: frames read, rewinds, gaps, and, where they are known, corrupt and unrecorded packets.

    frames: video_id, rewinds, gap_before and perhaps corrupt and unrecorded (running counts)."""
    more = [F.max(c).alias(c) for c in ("corrupt", "unrecorded") if c in frames.columns]
    return frames.groupBy("video_id").agg(F.count("*").alias("frames"), F.max("rewinds").alias("rewinds"), F.count_if("gap_before").alias("gaps"), *more)


def send(rows: DataFrame, folder: str, speed: float = 1.0, slice_s: float = 1.0, order: str = "media_ts") -> int:
    """A tool for tests: write rows as files of slice_s seconds of media time each, paced at `speed` times real time;
    how many files there are."""
    if speed <= 0 or slice_s <= 0:
        raise Refused("speed and slices are over 0")
    top = rows.agg(F.max(F.floor(F.col(order) / slice_s))).first()[0]
    n = 0 if top is None else int(top) + 1
    for k in range(n):
        began = time.monotonic()
        rows.filter(F.floor(F.col(order) / slice_s) == k).coalesce(1).write.json(f"{folder.rstrip('/')}/slice-{k:06d}")
        time.sleep(max(0.0, slice_s / speed - (time.monotonic() - began)))
    return n


def finished(observations: DataFrame, chunk_s: float, durations: DataFrame | None = None, name: str | None = None) -> dict[str, DataFrame]:
    """A live log as the tables of a batch run: videos, timelines, chunks, chunk_samplers, descriptions (each chunk's
    answers joined in order of time, their fields merged) and lags.

    observations: as the log has them; durations: video_id, duration_s, else to the end of the last chunk."""
    from momentlake.operators.aggregates import lag_figures, merged_fields

    key = ["video_id", "chunk_id", "sampler_id"]
    top = observations.groupBy("video_id").agg(F.max("chunk_id").cast("long").alias("top"))
    if durations is not None:
        top = top.join(durations.select("video_id", "duration_s"), "video_id", "left")
    else:
        top = top.withColumn("duration_s", F.lit(None).cast("double"))
    top = top.withColumn("duration_s", F.coalesce("duration_s", (F.col("top") + 1) * F.lit(float(chunk_s))))
    chunks = top.select("video_id", "duration_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("chunk_id"))
    chunks = chunks.select("video_id", "chunk_id", (F.col("chunk_id") * float(chunk_s)).alias("start_ts"), F.least((F.col("chunk_id") + 1) * float(chunk_s), F.col("duration_s")).alias("end_ts"))
    o = observations.withColumn("chunk_id", F.col("chunk_id").cast("long")).withColumn("said", F.concat(F.lit("At "), F.format_string("%.1f", "media_ts"), F.lit("s: "), F.coalesce("description", F.lit(""))))
    item = F.struct("media_ts", "frame_index", "said")
    own = F.struct("media_ts", "frame_index", "frames", "description", "structured", "lag_s")
    d = o.groupBy(*key).agg(
        F.first("sampler").alias("sampler"), F.first("question").alias("question"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["said"]), " ").alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("frames")))).alias("frame_indexes"), F.array_sort(F.collect_list(own)).alias("observations"),
    )
    merged = merged_fields(o, key, ["media_ts", "frame_index"])
    d = d.join(merged, key, "left").withColumn("structured", F.coalesce("structured", F.lit("{}"))).withColumn("frame_count", F.size("frame_indexes"))
    return {
        "videos": top.select("video_id", F.lit("live").alias("container_format"), "duration_s", F.lit(name).alias("name") if name else F.col("video_id").alias("name")),
        "timelines": top.select("video_id", F.lit("uniform").alias("policy"), F.lit("grid").alias("derived_from"), "duration_s", (F.col("top") + 1).alias("chunk_count")),
        "chunks": chunks,
        "chunk_samplers": d.select(*key, "sampler", "question", "frame_indexes", "frame_count"),
        "descriptions": d,
        "lags": lag_figures(observations.filter("lag_s IS NOT NULL"), ["video_id"], "lag_s"),
    }


def alerts(observations: DataFrame, query: DataFrame, least: float = 0.85) -> DataFrame:
    """Observations at least so similar to a query vector; works on streams and tables."""
    from momentlake.functions import vectors as V
    from momentlake.operators.search import query_literal

    return observations.withColumn("similarity", V.cosine(F.col("vector"), query_literal(query))).filter(F.col("similarity") >= least)
