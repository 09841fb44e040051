"""Several recordings on one clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.errors import Refused
from momentlake.functions.numbers import rounded
from momentlake.operators.numbering import running


#: The figures of a manifest that are counts, and so add up.
COUNTS = ["frames_decimated", "frames_sampled", "chunks", "chunks_with_frames", "stored_frames", "stored_mb", "elapsed_s"]

#: Chunk ids of a join key of `origin`.
SPAN = 64


def offsets(grids: DataFrame, into: str) -> DataFrame:
    """Per recording, in order of id: its first combined chunk, its chunks, and the seconds before it."""
    g = grids.groupBy("video_id").agg(F.count("*").alias("chunk_count"), F.max("end_ts").alias("duration_s"))
    g = running(g, [], ["video_id"], {"first_chunk": F.col("chunk_count"), "offset_s": F.col("duration_s")})
    return g.select(F.lit(into).alias("source_id"), "video_id", "first_chunk", "chunk_count", "offset_s", "duration_s")


def combined_grid(grids: DataFrame, members: DataFrame) -> DataFrame:
    j = grids.join(members.drop("duration_s", "chunk_count"), "video_id")
    return j.select(F.col("source_id").alias("video_id"), (F.col("first_chunk") + F.col("chunk_id")).alias("chunk_id"), (F.col("start_ts") + F.col("offset_s")).alias("start_ts"), (F.col("end_ts") + F.col("offset_s")).alias("end_ts"))


def combined_turns(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Turns on the combined clock; speakers of different recordings are different."""
    j = turns.join(members.select("video_id", "source_id", "offset_s"), "video_id")
    return j.select(F.col("source_id").alias("video_id"), F.concat_ws(":", "video_id", "speaker").alias("speaker"), (F.col("start") + F.col("offset_s")).alias("start"), (F.col("end") + F.col("offset_s")).alias("end"), "text")


def renumbered(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows by chunk (answers, sampled frames, transcripts) on the combined grid."""
    m = members.select("video_id", "source_id", "first_chunk")
    own = [c for c in rows.columns if c not in ("video_id", "chunk_id")]
    return rows.join(m, "video_id").select(F.col("source_id").alias("video_id"), (F.col("first_chunk") + F.col("chunk_id")).alias("chunk_id"), *own)


def combined_transcript(grids: DataFrame, spoken: DataFrame, members: DataFrame) -> DataFrame:
    """video_id, chunk_id, text and word_count of every combined chunk; chunks of recordings without a transcript are silent."""
    s = spoken.select("video_id", "chunk_id", "text", "word_count")
    every = grids.select("video_id", "chunk_id").join(s, ["video_id", "chunk_id"], "left")
    return renumbered(every.select("video_id", "chunk_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("word_count").cast("long"), F.lit(0).cast("long")).alias("word_count")), members)


def combined_timeline(timelines: DataFrame, members: DataFrame) -> DataFrame:
    """One row a combination: its policy (mixed, if its recordings' differ), duration, chunks and members in order."""
    t = timelines.select("video_id", "policy").join(members, "video_id")
    item = F.struct("first_chunk", F.struct("video_id", "first_chunk", "chunk_count", rounded("offset_s", 3).alias("offset_s"), rounded("duration_s", 3).alias("duration_s"), "policy").alias("m"))
    one = F.when(F.min("policy") == F.max("policy"), F.min("policy")).otherwise("mixed")
    return t.groupBy(F.col("source_id").alias("video_id")).agg(one.alias("policy"), F.lit("combined").alias("derived_from"), F.sum("duration_s").alias("duration_s"), F.sum("chunk_count").alias("chunk_count"), F.transform(F.array_sort(F.collect_list(item)), lambda i: i["m"]).alias("combined"))


def combine(tables: dict[str, DataFrame], into: str, counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Several recordings' tables (chunks, and any of timelines, turns, spoken, descriptions, chunk_samplers) as one
    recording's; a recording that a table doesn't hold is silent there.

    counts: video_id and some of COUNTS, which are added up as `stats`."""
    members = offsets(tables["chunks"], into)
    out = {"chunks": combined_grid(tables["chunks"], members), "members": members}
    if "timelines" in tables:
        out["timelines"] = combined_timeline(tables["timelines"], members)
    if "turns" in tables:
        out["turns"] = combined_turns(tables["turns"], members)
    if "spoken" in tables:
        out["spoken"] = combined_transcript(tables["chunks"], tables["spoken"], members)
    for name in ("descriptions", "chunk_samplers"):
        if name in tables:
            out[name] = renumbered(tables[name], members)
    if counts is not None:
        known = [c for c in COUNTS if c in counts.columns]
        out["stats"] = counts.join(members.select("video_id", "source_id"), "video_id").groupBy(F.col("source_id").alias("video_id")).agg(*[F.round(F.sum(c), 3).alias(c) for c in known])
    return out


def origin(chunks: DataFrame, members: DataFrame) -> DataFrame:
    """The recording and own chunk id of combined chunks; with start_ts and end_ts also those on its own clock.

    A recording meets the chunks of its spans of SPAN chunk ids only, so a chunk meets at most SPAN recordings."""
    span = lambda c: F.floor(c / SPAN).cast("long")
    last = F.col("first_chunk") + F.col("chunk_count") - 1
    m = members.filter("chunk_count > 0").select(F.col("source_id").alias("__s"), F.col("video_id").alias("member"), "first_chunk", "chunk_count", "offset_s", F.explode(F.sequence(span(F.col("first_chunk")), span(last))).alias("__span"))
    inside = (F.col("video_id") == F.col("__s")) & (span(F.col("chunk_id")) == F.col("__span")) & (F.col("chunk_id") >= F.col("first_chunk")) & (F.col("chunk_id") < F.col("first_chunk") + F.col("chunk_count"))
    own = [rounded(F.col(c) - F.col("offset_s"), 3).alias(f"member_{c}") for c in ("start_ts", "end_ts") if c in chunks.columns]
    return chunks.join(m, inside).select("video_id", "chunk_id", "member", (F.col("chunk_id") - F.col("first_chunk")).alias("member_chunk_id"), *own)


def combination_id(video_ids: list[str]) -> str:
    import hashlib

    if len(set(video_ids)) != len(video_ids):
        raise Refused("a recording can't be combined with itself")
    return "combined-" + hashlib.sha256("\n".join(sorted(video_ids)).encode()).hexdigest()[:8]
