"""One recording's documents opened together, and what whole-recording answers are cached by."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from momentlake.errors import Refused
from momentlake.plans.batch import Record
from momentlake.sources import documents as D

log = logging.getLogger("momentlake")


def open_record(spark: SparkSession, timeline: str, descriptions: str | None = None, transcript: str | None = None, manifest: str | None = None) -> Record:
    """The documents at these paths as a Record.  Documents of another recording, or cut on another grid, are refused.

    A path may be a pattern, so that a record holds many recordings; every other document then needs its timeline."""
    t = D.read(spark, timeline, "timeline")
    grids = t.select("video_id", F.col("fingerprint").alias("__grid"))
    found: dict[str, DataFrame] = {}
    for kind, path in (("descriptions", descriptions), ("transcript", transcript), ("manifest", manifest)):
        if path is None:
            continue
        rows = D.maybe(spark, path, kind)
        j = rows.join(grids, "video_id", "left")
        bad = j.filter(F.col("__grid").isNull() | ((F.coalesce("timeline_fingerprint", F.lit("")) != "") & (F.col("timeline_fingerprint") != F.col("__grid"))))
        wrong = bad.select("video_id", F.col("__grid").isNull().alias("other")).limit(1).collect()
        if wrong:
            raise Refused(f"{kind} of {wrong[0].video_id!r} {'belong to no timeline here' if wrong[0].other else 'were cut on another grid'}")
        found[kind] = rows
    spoken = turns = None
    if "transcript" in found:
        c = found["transcript"].select("video_id", F.explode("chunks").alias("c"))
        spoken = c.select("video_id", F.col("c.chunk_id").cast("long").alias("chunk_id"), F.col("c.text").alias("text"), F.col("c.word_count").cast("long").alias("word_count"))
        turns = c.select("video_id", F.col("c.chunk_id").cast("long").alias("chunk_id"), F.posexplode("c.turns").alias("turn", "t"))
        turns = turns.select("video_id", (F.col("chunk_id") * 1_000_000 + F.col("turn")).alias("position"), "t.speaker", "t.start", "t.end", "t.text")
    return Record(
        grid=D.timeline_chunks(t).select("video_id", "chunk_id", "start_ts", "end_ts"),
        frames=D.manifest_frames(found["manifest"]).withColumnRenamed("sampler_id", "sampler") if "manifest" in found else None,
        turns=turns,
        answers=D.description_rows(found["descriptions"]) if "descriptions" in found else None,
        spoken=spoken,
    )


def fingerprint(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by and inputs_fingerprint: a hash of a group's rows whatever their order; partial sums come before the shuffle."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(h).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), *columns)).alias("b"))
    return g.select(*by, F.substring(F.sha2(F.concat_ws(":", "n", "a", "b").cast("binary"), 256), 1, 16).alias("inputs_fingerprint"))


def due(wanted: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The answers to make: those that aren't stored with the same inputs, definition version and model.

    wanted, stored: source_id, aggregate_id, inputs_fingerprint, version and model."""
    if stored is None:
        return wanted
    keys = ["source_id", "aggregate_id", "inputs_fingerprint", "version", "model"]
    w, s = wanted.alias("w"), stored.select(*keys).distinct().alias("s")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}"))
    return w.join(s, same, "left_anti")


def model_key(**parts: object) -> str:
    """Twelve hex digits of who makes an answer and how: models, embedder, caps, rules."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:12]


@contextmanager
def step(name: str, **about: object) -> Iterator[dict]:
    """Log a step when it begins and ends, with its seconds and what it puts into the dict."""
    said: dict = {}
    began = time.monotonic()
    log.info("%s begins %s", name, about)
    try:
        yield said
    except Exception:
        log.exception("%s failed after %.1f s", name, time.monotonic() - began)
        raise
    log.info("%s took %.1f s %s", name, time.monotonic() - began, said)


def observed(rows: DataFrame, name: str, **figures) -> tuple[DataFrame, Observation]:
    """rows that count and measure themselves while they are written; the figures are in the observation's `get` then."""
    o = Observation(name)
    return rows.observe(o, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in figures.items()]), o


class Progress(StreamingQueryListener):
    """Tells of a stream's micro-batches: tell(event, facts)."""

    def __init__(self, tell: Callable[[str, dict], None] | None = None):
        self.tell = tell or (lambda event, facts: log.info("%s %s", event, facts))

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.tell("started", {"id": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.tell("progress", {"batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond, "observed": {k: r.asDict() for k, r in (p.observedMetrics or {}).items()}})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        return None

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell("ended", {"id": str(event.id), "error": event.exception})
