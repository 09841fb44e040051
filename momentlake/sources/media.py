"""Recordings as files: what a container holds, its frames and its sound.

Decoders are functions of the caller (a library of codecs is no part of this engine); one for WAV comes along.  Files
are read by Spark's binary source, a file a row, so any store that Spark reads will do.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.errors import MissingArtifact, Refused
from momentlake.functions import times

#: Samples a second of decoded sound, and the loudness under which a track counts as silent.
SAMPLE_RATE, SILENCE_RMS = 16_000, 1e-3
STREAMS = "container_format string, duration_s double, video struct<codec:string,rate:double,width:int,height:int,frames:long>, audio struct<codec:string,rate:int,channels:int>, tags map<string,string>"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, video_id (the name without its ending), size and content of the files below a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return rows.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("video_id"), F.col("length").alias("size"), "content")


def recordings(spark: SparkSession, folder: str, document: str = "embedded.json") -> DataFrame:
    """video_id of the folders that hold an index; those whose name begins with _ are no recordings."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", document).option("recursiveFileLookup", "true").load(folder).select("path")
    except Exception as e:
        raise MissingArtifact(f"no folder {folder}") from e
    name = F.element_at(F.split("path", "/"), -2)
    return found.select(name.alias("video_id")).filter(~F.col("video_id").startswith("_")).distinct()


def answer_files(spark: SparkSession, folder: str) -> DataFrame:
    """video_id, aggregate_id and document (JSON) of the answers stored as <video>/answers/<id>.json, `:` in an id being `.`."""
    rows = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(folder).select("value", F.input_file_name().alias("path"))
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")
    return rows.select(F.element_at(parts, -3).alias("video_id"), F.translate(stem, ".", ":").alias("aggregate_id"), F.col("value").alias("document"))


def describe_wav(content: bytes) -> dict:
    with wave.open(io.BytesIO(content)) as w:
        rate, n, channels = w.getframerate(), w.getnframes(), w.getnchannels()
    return {"container_format": "wav", "duration_s": n / rate if rate else None, "video": None, "audio": {"codec": "pcm", "rate": rate, "channels": channels}, "tags": {}}


def probe(rows: DataFrame, describe: Callable[[bytes], dict] = describe_wav, name: str | None = None, recorded_at: str | None = None) -> DataFrame:
    """What each file holds: video_id, name, container, duration, streams, recorded_at and source, a fingerprint that
    doesn't depend on where the file is.  A file that can't be read, or has neither picture nor sound, has `problem`.

    name and recorded_at, if given, replace the file's own; recorded_at is a date and time after 1970."""
    if name is not None and not name.strip():
        raise Refused("a name isn't empty")
    given = times.stamp(recorded_at, "recorded_at")
    if given is not None and int(given[:4]) <= 1970:
        raise Refused("recorded_at is after 1970")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content in b["content"]:
                try:
                    d, problem = describe(bytes(content)), None
                    if d.get("video") is None and d.get("audio") is None:
                        problem = "neither picture nor sound"
                except Exception as e:  # noqa: BLE001  one unreadable file mustn't lose the others
                    d, problem = {}, f"can't be opened: {type(e).__name__}"
                out.append({**{k: d.get(k) for k in ("container_format", "duration_s", "video", "audio")}, "tags": d.get("tags") or {}, "problem": problem})
            yield pd.concat([b.drop(columns="content").reset_index(drop=True), pd.DataFrame(out, columns=["container_format", "duration_s", "video", "audio", "tags", "problem"])], axis=1)

    found = rows.mapInPandas(run, f"path string, name string, video_id string, size long, {STREAMS}, problem string")
    source = F.substring(F.sha2(F.to_json(F.struct("size", "duration_s", "container_format", "video", "audio")).cast("binary"), 256), 1, 16)
    when = F.lit(given) if given else times.iso_millis(times.tagged_time(F.col("tags")))
    return found.select("video_id", "path", F.lit(name.strip()).alias("name") if name else F.col("name"), "container_format", "duration_s", "video", "audio", when.alias("recorded_at"), F.when(F.col("problem").isNull(), source).alias("source"), "problem")


def frames(rows: DataFrame, decode: Callable[[bytes, Callable[[float], bool]], Iterator[tuple]], per_second: float | None = None, after: float | None = None, before: float | None = None) -> DataFrame:
    """video_id, frame_index, media_ts, pts and image of the frames of files, one after another.

    decode(content, wanted) yields (frame_index, media_ts, pts, make) for every frame; make(), which costs the pixels, is
    called for wanted frames only: those inside [after, before) and, with per_second, the first of each slice."""
    if per_second is not None and per_second <= 0:
        raise Refused("a rate is over 0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for video, content in zip(b["video_id"], b["content"], strict=True):
                seen, held = None, []

                def wanted(ts: float) -> bool:
                    return (after is None or ts >= after) and (before is None or ts < before) and (per_second is None or seen is None or int(ts * per_second) > seen)

                for index, ts, pts, make in decode(bytes(content), wanted):
                    if not wanted(ts):
                        continue
                    if per_second is not None:
                        seen = int(ts * per_second)
                    held.append((video, index, ts, pts, make()))
                    if len(held) >= 64:
                        yield pd.DataFrame(held, columns=["video_id", "frame_index", "media_ts", "pts", "image"])
                        held = []
                yield pd.DataFrame(held, columns=["video_id", "frame_index", "media_ts", "pts", "image"])

    return rows.select("video_id", "content").mapInPandas(run, "video_id string, frame_index long, media_ts double, pts long, image binary")


def load_wav(content: bytes, rate: int = SAMPLE_RATE) -> np.ndarray:
    """The sound of a WAV file, mono at `rate`, as float32 in [-1, 1]."""
    with wave.open(io.BytesIO(content)) as w:
        own, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        raw = w.readframes(w.getnframes())
    if width not in (1, 2, 4):
        raise Refused(f"samples of {width} bytes")
    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(1) if channels > 1 else x
    if own != rate and len(x):
        x = np.interp(np.arange(int(len(x) * rate / own)) * own / rate, np.arange(len(x)), x).astype(np.float32)
    return x


def track_of(samples: np.ndarray, rate: int = SAMPLE_RATE) -> dict:
    rms = float(np.sqrt(np.mean(samples.astype(float) ** 2))) if len(samples) else 0.0
    peak = float(np.abs(samples).max()) if len(samples) else 0.0
    return {"rate": rate, "duration_s": round(len(samples) / rate, 3), "samples": len(samples), "rms": round(rms, 6), "peak": round(peak, 6), "silent": rms < SILENCE_RMS}


TRACK = "rate int, duration_s double, samples long, rms double, peak double, silent boolean"
HEARD = "kind string, position int, word_position int, start double, end double, text string, speaker string"


def listen(rows: DataFrame, transcribe: Callable[[np.ndarray], tuple[list, list]], diarize: Callable[[np.ndarray], list] | None = None, load: Callable[[bytes], np.ndarray] = load_wav) -> tuple[DataFrame, DataFrame]:
    """The whole audio pass over files: tracks (video_id and TRACK), and what was heard (video_id and HEARD: rows of kind
    segment, word or turn).

    transcribe: samples -> (segments (start, end, text), words (segment, start, end, text)); diarize: samples -> turns
    (start, end, speaker).  A silent track is given to no model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for video, content in zip(b["video_id"], b["content"], strict=True):
                samples = load(bytes(content))
                t = track_of(samples)
                out.append((video, "track", 0, 0, float(t["rms"]), float(t["peak"]), None, None, t["rate"], t["duration_s"], t["samples"], t["silent"]))
                if t["silent"]:
                    continue
                none = (None, None, None, None)
                segments, words = transcribe(samples)
                out += [(video, "segment", k, 0, s, e, x, None, *none) for k, (s, e, x) in enumerate(segments)]
                at: dict[int, int] = {}
                for k, s, e, x in words:
                    out.append((video, "word", k, at.get(k, 0), s, e, x, None, *none))
                    at[k] = at.get(k, 0) + 1
                out += [(video, "turn", k, 0, s, e, None, who, *none) for k, (s, e, who) in enumerate(diarize(samples) if diarize else [])]
            yield pd.DataFrame(out, columns=["video_id", "kind", "position", "word_position", "start", "end", "text", "speaker", "rate", "duration_s", "samples", "silent"])

    every = rows.select("video_id", "content").mapInPandas(run, f"video_id string, {HEARD}, rate int, duration_s double, samples long, silent boolean")
    tracks = every.filter("kind = 'track'").select("video_id", "rate", "duration_s", "samples", F.col("start").alias("rms"), F.col("end").alias("peak"), "silent")
    return tracks, every.filter("kind <> 'track'").drop("rate", "duration_s", "samples", "silent")


def attributed(heard: DataFrame, bucket_s: float | None = 20.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """words, segments and turns of what was heard, each word with the speaker whose turn holds its middle, each segment
    with the one who holds it longest."""
    from momentlake.operators import speech

    of = lambda kind, *cols: heard.filter(F.col("kind") == kind).select("video_id", *cols)
    turns = of("turn", "position", "speaker", "start", "end")
    words = speech.word_speakers(of("word", "position", "word_position", "text", "start", "end"), turns, bucket_s)
    holder = speech.segment_speakers(words, ["video_id", "position"]).select("video_id", "position", "speaker")
    segments = of("segment", "position", "start", "end", "text").join(holder, ["video_id", "position"], "left")
    return words, segments, turns
