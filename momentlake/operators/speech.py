"""Speech: attribution of words, cuts at silences and speaker changes, transcripts on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.functions.numbers import rounded
from momentlake.operators.grid import _by_bucket, with_chunk


def midpoint():
    return (F.col("start") + F.col("end")) / 2


def silence_cuts(spans: DataFrame, gap_s: float) -> DataFrame:
    """A cut at the middle of every silence of at least gap_s between neighbours by (start, end)."""
    w = Window.partitionBy("video_id").orderBy("start", "end")
    s = spans.withColumn("before", F.lag("end").over(w)).filter(F.col("start") - F.col("before") >= gap_s)
    return s.select("video_id", ((F.col("before") + F.col("start")) / 2).alias("at"), (F.col("start") - F.col("before")).alias("score"))


def speaker_cuts(turns: DataFrame) -> DataFrame:
    """A cut at every change of speaker: the middle of the gap, or the new start if they overlap."""
    w = Window.partitionBy("video_id").orderBy("start", "position")
    t = turns.withColumn("p", F.lag("speaker").over(w)).withColumn("e", F.lag("end").over(w)).withColumn("i", F.row_number().over(w))
    t = t.filter((F.col("i") > 1) & ~F.col("speaker").eqNullSafe(F.col("p")))
    gap = F.col("start") - F.col("e")
    return t.select("video_id", F.when(gap > 0, (F.col("e") + F.col("start")) / 2).otherwise(F.col("start")).alias("at"), F.greatest(gap, F.lit(0.0)).alias("score"))


def speech_spans(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """Turns of a video if it has any, else its segments."""
    has = turns.select("video_id").distinct()
    return turns.select("video_id", "start", "end").unionByName(segments.join(has, "video_id", "left_anti").select("video_id", "start", "end"))


def word_speakers(words: DataFrame, turns: DataFrame, bucket_s: float | None = None) -> DataFrame:
    """words with the speaker of the first turn, in list order, that holds their middle; null if none does.

    bucket_s: seconds of a bucket of time, about a turn's length, as one more key of the join."""
    t = turns.select(F.col("video_id").alias("tv"), F.col("position").alias("turn"), F.col("speaker"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    w, t, more = _by_bucket(words.withColumn("__mid", midpoint()), t, "__mid", bucket_s)
    holds = (F.col("video_id") == F.col("tv")) & (F.col("__mid") >= F.col("__s")) & (F.col("__mid") <= F.col("__e"))
    j = w.join(t, (F.col("__b") == F.col("__c")) & holds if more else holds, "left")
    keys = ["video_id", "position", "word_position"]
    return j.groupBy(*keys).agg(F.first("text").alias("text"), F.first("start").alias("start"), F.first("end").alias("end"), F.min_by("speaker", "turn").alias("speaker"))


def segment_speakers(words: DataFrame, by: list[str]) -> DataFrame:
    """Per segment the speaker who holds it longest; the first heard of equals."""
    held = words.filter(F.col("speaker").isNotNull()).groupBy(*by, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("held"), F.min("word_position").alias("first"))
    w = Window.partitionBy(*by).orderBy(F.desc("held"), "first")
    return held.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*by, "speaker", "held")


def islands(words: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Runs of one speaker (null is one) inside a group: first start, last end, texts put together and trimmed."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    new = F.when(first | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)), 1).otherwise(0)
    s = words.withColumn("new", new)
    s = s.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct(*order, "end", "text")
    g = s.groupBy(*by, "island").agg(F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.array_sort(F.collect_list(item)).alias("items"))
    return g.select(*by, (F.col("island") - 1).alias("turn"), "speaker", "start", F.element_at("items", -1)["end"].alias("end"), F.trim(F.array_join(F.transform("items", lambda i: i["text"]), "")).alias("text"))


def transcript_chunks(words: DataFrame, grid: DataFrame, bucket_s: float | None = None) -> DataFrame:
    """The transcript on a grid: every chunk with its text and word_count, silent ones too."""
    placed = with_chunk(words.withColumn("mid", midpoint()), grid, "mid", bucket_s=bucket_s)
    said = placed.groupBy("video_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("start", "position", "word_position", "text"))).alias("w"))
    said = said.select("video_id", "chunk_id", F.trim(F.array_join(F.transform("w", lambda x: x["text"]), " ")).alias("text"), F.size("w").cast("long").alias("word_count"))
    out = grid.join(said, ["video_id", "chunk_id"], "left")
    return out.select("video_id", "chunk_id", "start_ts", "end_ts", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("word_count", F.lit(0).cast("long")).alias("word_count"))


def transcript_stats(words: DataFrame, grid: DataFrame) -> DataFrame:
    chunks = transcript_chunks(words, grid).groupBy("video_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("word_count") > 0).alias("chunks_with_speech"), F.sum("word_count").alias("words"))
    total = words.groupBy("video_id").agg(F.count("*").alias("words_in_transcript"))
    out = chunks.join(total, "video_id", "left").withColumn("words_in_transcript", F.coalesce("words_in_transcript", F.lit(0).cast("long")))
    return out.withColumn("words_outside_grid", F.col("words_in_transcript") - F.col("words"))


def chunk_turns(words: DataFrame, grid: DataFrame, bucket_s: float | None = None) -> DataFrame:
    """video_id, chunk_id, turn, speaker, start, end and text: the turns of each chunk's own words, times rounded to
    milliseconds.  words: video_id, position, word_position, text, start, end, speaker."""
    placed = with_chunk(words.withColumn("mid", midpoint()), grid, "mid", bucket_s=bucket_s)
    t = islands(placed, ["video_id", "chunk_id"], ["start", "position", "word_position"])
    return t.withColumn("start", rounded("start", 3)).withColumn("end", rounded("end", 3))


def raw_transcript_stats(words: DataFrame, segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Per video: segments, words, words with a speaker, turns, speakers, and the seconds of all turns."""
    w = words.groupBy("video_id").agg(F.count("*").alias("words"), F.count("speaker").alias("attributed"))
    s = segments.groupBy("video_id").agg(F.count("*").alias("segments"))
    t = turns.groupBy("video_id").agg(F.count("*").alias("turns"), F.countDistinct("speaker").alias("speakers"), rounded(F.sum(F.col("end") - F.col("start")), 3).alias("speech_s"))
    out = s.join(w, "video_id", "full_outer").join(t, "video_id", "full_outer")
    zero = {c: 0 for c in ("segments", "words", "attributed", "turns", "speakers")} | {"speech_s": 0.0}
    return out.fillna(zero)
