"""Whole-recording answers that need no model: statistics, speakers, coverage, merges; and the batching of those that do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.functions.numbers import rounded
from momentlake.lineage import cut
from momentlake.operators.numbering import numbered, same


def upper_median(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """The element at n div 2 of the sorted values of each group, without collecting a group."""
    w = Window.partitionBy(*by)
    r = rows.select(*by, value, F.row_number().over(w.orderBy(value)).alias("i"), F.count("*").over(w).alias("n"))
    return r.filter(F.col("i") == F.floor(F.col("n") / 2) + 1).select(*by, F.col(value).alias(name))


def video_stats(grid: DataFrame, frames: DataFrame) -> DataFrame:
    """Per video: duration, chunks, least, upper median and most chunk length, sampled frames and kinds of sampler."""
    length = grid.withColumn("len", F.col("end_ts") - F.col("start_ts"))
    g = length.groupBy("video_id").agg(F.max("end_ts").alias("duration_s"), F.count("*").alias("chunks"), F.min("len").alias("chunk_min"), F.max("len").alias("chunk_max"))
    f = frames.groupBy("video_id").agg(F.count("*").alias("frames_sampled"), F.countDistinct("sampler").alias("samplers"))
    return g.join(upper_median(length, ["video_id"], "len", "chunk_median"), "video_id").join(f, "video_id", "left")


def speaker_shares(turns: DataFrame) -> DataFrame:
    """Per video and speaker: turns, seconds, share of the speech and whether the speaker dominates (ties: first heard)."""
    s = turns.filter(F.col("speaker").isNotNull()).groupBy("video_id", "speaker").agg(F.count("*").alias("turns"), F.sum(F.col("end") - F.col("start")).alias("seconds"), F.min("position").alias("first"))
    w = Window.partitionBy("video_id")
    total = F.sum("seconds").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("seconds"), "first"))
    return s.select("video_id", "speaker", "turns", "seconds", F.when(total > 0, F.col("seconds") / total).alias("share"), (rank == 1).alias("dominant"))


def handovers(turns: DataFrame) -> DataFrame:
    """Per video: changes of speaker between neighbouring turns that have one."""
    w = Window.partitionBy("video_id").orderBy("position")
    t = turns.filter(F.col("speaker").isNotNull()).withColumn("before", F.lag("speaker").over(w))
    return t.groupBy("video_id").agg(F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("speaker"))).alias("handovers"), F.count("*").alias("turns"))


def counted(rows: DataFrame, by: list[str], label: str, name: str) -> DataFrame:
    """Per group a map of how often each label occurs, by label."""
    n = rows.groupBy(*by, label).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias(name))


def stats(grid: DataFrame, frames: DataFrame | None = None, answers: DataFrame | None = None, spoken: DataFrame | None = None, timelines: DataFrame | None = None) -> DataFrame:
    """One row a video, whatever is known of it: duration, chunks and their lengths, frames, answers by sampler, words.

    frames: the sampled frames; answers: a row a chunk and sampler_id; spoken: a row a chunk with word_count; timelines:
    video_id, policy and derived_from.  What isn't given counts as nothing."""
    key, length = ["video_id"], F.col("end_ts") - F.col("start_ts")
    g = grid.withColumn("len", length)
    out = g.groupBy(*key).agg(F.max("end_ts").alias("d"), F.count("*").alias("chunks"), rounded(F.min("len"), 3).alias("chunk_min"), rounded(F.max("len"), 3).alias("chunk_max"))
    out = out.join(upper_median(g, key, "len", "m").select("video_id", rounded("m", 3).alias("chunk_median")), key)
    if timelines is not None:
        out = out.join(timelines.select("video_id", "policy", "derived_from"), key, "left")
    if frames is not None:
        out = out.join(frames.groupBy(*key).agg(F.count("*").alias("frames_sampled")), key, "left")
    if answers is not None:
        out = out.join(counted(answers, key, "sampler_id", "descriptions_by_sampler"), key, "left")
    if spoken is not None:
        out = out.join(spoken.groupBy(*key).agg(F.sum("word_count").alias("words"), F.count_if(F.col("word_count") > 0).alias("chunks_with_speech")), key, "left")
    zero = F.lit(0).cast("long")
    have = lambda c: F.coalesce(F.col(c), zero) if c in out.columns else zero
    by_sampler = F.coalesce("descriptions_by_sampler", F.create_map().cast("map<string,bigint>")) if answers is not None else F.create_map().cast("map<string,bigint>")
    named = [F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in ("policy", "derived_from")]
    return out.select(
        "video_id", rounded("d", 3).alias("duration_s"), "chunks", "chunk_min", "chunk_median", "chunk_max", *named, have("frames_sampled").alias("frames_sampled"), by_sampler.alias("descriptions_by_sampler"),
        have("words").alias("words"), have("chunks_with_speech").alias("chunks_with_speech"), F.when(F.col("d") > 0, rounded(have("words") / (F.col("d") / 60), 1)).otherwise(0.0).alias("words_per_minute"),
    )


def speakers(turns: DataFrame, durations: DataFrame) -> DataFrame:
    """One row a video: how many speak, turns, handovers, seconds and share of speech, each speaker's part by seconds,
    and who dominates (ties: first heard).  durations: video_id, duration_s; a video without turns has a row too."""
    said = speaker_shares(turns)
    item = F.struct((-F.col("seconds")).alias("k"), "first", "speaker", "seconds", "share")
    shares = said.join(turns.groupBy("video_id", "speaker").agg(F.min("position").alias("first")), ["video_id", "speaker"])
    by = shares.groupBy("video_id").agg(F.count("*").alias("speakers"), F.sum("seconds").alias("speech"), F.array_sort(F.collect_list(item)).alias("items"))
    out = durations.select("video_id", "duration_s").join(by, "video_id", "left").join(handovers(turns), "video_id", "left").fillna({"speakers": 0, "speech": 0.0, "handovers": 0, "turns": 0})
    parts = F.transform(F.col("items"), lambda i: F.struct(i["speaker"].alias("speaker"), rounded(i["seconds"], 3).alias("seconds"), F.coalesce(rounded(i["share"], 4), F.lit(0.0)).alias("share")))
    return out.select(
        "video_id", "speakers", "turns", "handovers", ((F.col("speakers") <= 1) & (F.col("handovers") == 0)).alias("monologue"), rounded("speech", 3).alias("speech_s"),
        F.when(F.col("duration_s") > 0, rounded(F.col("speech") / F.col("duration_s"), 4)).otherwise(0.0).alias("speech_ratio"), parts.alias("by_speaker"), F.col("items")[0]["speaker"].alias("dominant"),
    )


def coverage_summary(covered: DataFrame) -> DataFrame:
    """Per video the chunks of each kind of coverage, and the ids of those that nothing covers."""
    count = lambda kind: F.count_if(F.col("coverage") == kind).alias(kind)
    silent = F.sort_array(F.collect_list(F.when(F.col("coverage") == "neither", F.col("chunk_id"))))
    return covered.groupBy("video_id").agg(count("both"), count("picture_only"), count("sound_only"), count("neither"), silent.alias("silent_chunks"))


def coverage(grid: DataFrame, answers: DataFrame, spoken: DataFrame) -> DataFrame:
    """Per chunk: whether it has an answer (an empty one counts), speech, and which sources."""
    key = ["video_id", "chunk_id"]
    a = answers.groupBy(*key).agg(F.sort_array(F.collect_set("sampler")).alias("sources"))
    s = spoken.filter(F.col("word_count") > 0).select(*key, F.lit(True).alias("sound")).distinct()
    out = grid.select(*key).join(a, key, "left").join(s, key, "left")
    picture, sound = F.col("sources").isNotNull(), F.coalesce("sound", F.lit(False))
    kind = F.when(picture & sound, "both").when(picture, "picture_only").when(sound, "sound_only").otherwise("neither")
    return out.select(*key, kind.alias("coverage"), F.coalesce(F.array_join("sources", ","), F.lit("")).alias("sources"))


def lag_figures(rows: DataFrame, by: list[str], lag: str) -> DataFrame:
    """Median, the value at int(0.95 n) (at most the last) and the greatest lag."""
    w = Window.partitionBy(*by)
    r = rows.select(*by, lag, (F.row_number().over(w.orderBy(lag)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    p95 = F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)), F.col(lag)))
    return r.groupBy(*by).agg(F.median(lag).alias("p50"), p95.alias("p95"), F.max(lag).alias("max_lag"))


def merged_answers(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Per group: texts in order, distinct values in first-seen order, and the value if all agree."""
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("items"))
    values = F.array_distinct(F.transform("items", lambda i: i[value]))
    return g.select(*by, F.array_join(F.transform("items", lambda i: i[value]), " ").alias("description"), F.array_join(values, ",").alias("seen"), F.when(F.size(values) == 1, values[0]).alias("agreed"))


def turning_points(scores: DataFrame, by: list[str], order: str, signed: str) -> DataFrame:
    """Rows whose sign differs from the one before; zero counts as not negative."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(signed).over(w)
    return scores.withColumn("__b", before).filter(F.col("__b").isNotNull() & ((F.col("__b") < 0) != (F.col(signed) < 0))).drop("__b")


def weighted_mean(rows: DataFrame, by: list[str], score: str, weight: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(score) * F.col(weight)) / F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))


def sentiment_chunks(pieces: DataFrame, signed: str = "signed", text: str = "piece") -> DataFrame:
    """Per chunk the tone of its pieces, weighted by their length: label, score, signed (rounded) and how many pieces."""
    size = F.length(text)
    g = pieces.groupBy("video_id", "chunk_id").agg((F.sum(F.col(signed) * size) / F.sum(size)).alias("s"), F.count("*").alias("pieces"))
    return g.select("video_id", "chunk_id", F.when(F.col("s") >= 0, "positive").otherwise("negative").alias("label"), rounded(F.abs("s"), 4).alias("score"), rounded("s", 4).alias("signed"), "pieces")


def sentiment(per_chunk: DataFrame) -> DataFrame:
    """Per video the mean tone of its chunks, how many are positive and negative, and where the tone turns.

    Tones have four decimals, so the mean is one of whole numbers: the same in whatever order they are added up."""
    total, n = F.sum(F.round(F.col("signed") * 10000).cast("long")), F.count("signed")
    mean = F.signum(total) * F.floor((2 * F.abs(total) + n) / (2 * n)) / 10000
    turns = turning_points(per_chunk, ["video_id"], "chunk_id", "signed").groupBy("video_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("turning_points"))
    g = per_chunk.groupBy("video_id").agg((mean + F.lit(0.0)).alias("mean"), F.count_if(F.col("signed") > 0).alias("positive_chunks"), F.count_if(F.col("signed") < 0).alias("negative_chunks"), F.count("*").alias("chunks_read"))
    return g.join(turns, "video_id", "left").withColumn("turning_points", F.coalesce("turning_points", F.array().cast("array<bigint>")))


def merged_fields(rows: DataFrame, by: list[str], order: list[str], structured: str = "structured") -> DataFrame:
    """by and structured: several answers' JSON objects as one, by key in first-seen order.

    Lists are put together without repeats; a value that all agree on stays as it is; values that differ are listed.
    Blank values (null, "", []) say nothing.  Values are compared by their canonical JSON, that of VARIANT."""
    spark = rows.sparkSession
    v = rows.select(*by, F.struct(*order).alias("o"), F.try_parse_json(F.col(structured)).alias("v")).filter("v IS NOT NULL")
    fields = v.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(*by, "o", "pos", "key", F.col("value").alias("x"))
    fields = fields.filter(~F.to_json("x").isin("null", '""', "[]")).withColumn("list", F.schema_of_variant("x").startswith("ARRAY"))
    flat = fields.groupBy(*by, "key").agg(F.min("list").alias("flat"))
    fields = fields.join(flat, [*by, "key"])
    whole = fields.filter(~F.col("flat")).select(*by, "key", "flat", "o", "pos", F.lit(0).alias("at"), F.to_json("x").alias("item"))
    listed = fields.filter("flat").select(*by, F.col("key").alias("k"), "flat", "o", F.col("pos").alias("p"), "x").lateralJoin(spark.tvf.variant_explode(F.col("x").outer()))
    items = whole.unionByName(listed.select(*by, F.col("k").alias("key"), "flat", "o", F.col("p").alias("pos"), F.col("pos").alias("at"), F.to_json("value").alias("item")))
    once = items.groupBy(*by, "key", "flat", "item").agg(F.min(F.struct("o", "pos", "at")).alias("first"))
    one = once.groupBy(*by, "key", "flat").agg(F.min("first").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("first", "item"))), lambda i: i["item"]).alias("items"))
    several = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    said = one.withColumn("said", F.concat(F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(":"), F.when(F.col("flat") | (F.size("items") > 1), several).otherwise(F.col("items")[0])))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first", "key", "said"))), lambda i: i["said"])
    return said.groupBy(*by).agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("structured"))


def combined_stats(stats: DataFrame, by: str, counts: list[str]) -> DataFrame:
    """The sums, rounded to thousandths, of counts over the recordings of a combination; absent ones don't count."""
    return stats.groupBy(by).agg(*[F.round(F.sum(c), 3).alias(c) for c in counts])


def items_of_windows(rows: DataFrame, grid: DataFrame, ask: Callable[[DataFrame], DataFrame], size: int = 100) -> DataFrame:
    """What a model finds in windows of `size` rows, each item on the span of the chunk that it cites, in order of time.

    rows: video_id, chunk_id, line; ask: (video_id, window, lines) -> (video_id, window, chunk_id, fields ...), a DataFrame step."""
    w = windows_of(rows, "video_id", "chunk_id", size)
    lines = w.groupBy("video_id", "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "line"))), lambda i: i["line"]).alias("lines"))
    found = ask(lines).join(grid.select("video_id", "chunk_id", rounded("start_ts", 3).alias("start_ts"), rounded("end_ts", 3).alias("end_ts")), ["video_id", "chunk_id"], "left")
    return found.withColumn("position", F.row_number().over(Window.partitionBy("video_id").orderBy("start_ts", "window", "chunk_id")) - 1)


def fold(rows: DataFrame, by: str, order: str, text: str, reduce, batch: int = 25):
    """Hierarchical reduction: batches of 25 by position become one row each until every group has at most 25, then one.

    `order` numbers a group's rows and has no ties.  Places are found on keys alone; texts move to their batch.

    reduce(rows) turns the texts of a batch, in order, into one text; it is a DataFrame step, so a level is one shuffle.
    Each level is written before the next begins, so that a model behind reduce is asked once a batch.  Yields (layer,
    DataFrame of by, position, text); the last layer has one row a group."""
    keys = numbered(rows.select(by, order), [by], [order], "__place")
    now = rows.select(by, order, F.col(text).alias("text")).alias("a").join(keys.alias("b"), same([by, order], "a", "b")).select(f"a.{by}", F.col("b.__place").alias("position"), "a.text")
    most = rows.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    layer = 0
    while True:
        final = most <= batch
        step = F.lit(0).cast("long") if final else F.floor(F.col("position") / batch)
        grouped = now.withColumn("batch", step).groupBy(by, "batch").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("items"))
        made = reduce(grouped.select(by, F.col("batch").alias("position"), F.transform("items", lambda i: i["text"]).alias("texts")))
        now = cut(made.select(by, "position", "text"), "fold")
        most, layer = -(-most // batch), layer + 1
        yield layer, now
        if final:
            return


def windows_of(rows: DataFrame, by: str, order: str, size: int = 100) -> DataFrame:
    """rows with the window (of `size` rows by position) that a windowed model call reads."""
    keys = numbered(rows.select(by, order), [by], [order], "__place").withColumn("window", F.floor(F.col("__place") / size).cast("long"))
    return rows.alias("a").join(keys.alias("b"), same([by, order], "a", "b")).select("a.*", "b.window")


def entity_summary(mentions: DataFrame, grid: DataFrame, order: str = "signature") -> DataFrame:
    """Per linked group: label (longest signature, of equals the first by chunk and `order`), appearances (chunks), their
    ids, first start, last end, observed seconds, and an id by appearances and start.

    Mentions of one chunk are reduced first, so that a group seen in very many chunks is small when it meets."""
    best = F.min(F.struct((-F.length("signature")).alias("n"), "chunk_id", F.col(order).alias("o"), F.col("signature").alias("s")))
    j = mentions.groupBy("video_id", "group", "chunk_id").agg(best.alias("best")).join(grid, ["video_id", "chunk_id"])
    g = j.groupBy("video_id", "group").agg(
        F.min("best")["s"].alias("label"), F.count("*").alias("appearances"), F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"),
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum(F.col("end_ts") - F.col("start_ts")).alias("observed_s"),
    )
    w = Window.partitionBy("video_id").orderBy(F.desc("appearances"), "start_ts", "group")
    return g.withColumn("entity_id", F.format_string("e%03d", F.row_number().over(w) - 1))


def together(mentions: DataFrame, most: int = 50) -> DataFrame:
    """Pairs of groups seen in the same chunk, by how many chunks they share, and these; the first `most` of each video."""
    m = mentions.select("video_id", "chunk_id", "group").distinct()
    a, b = m.withColumnRenamed("group", "a"), m.withColumnRenamed("group", "b")
    pairs = a.join(b, ["video_id", "chunk_id"]).filter(F.col("a") < F.col("b")).groupBy("video_id", "a", "b").agg(F.count("*").alias("shared"))
    w = Window.partitionBy("video_id").orderBy(F.desc("shared"), "a", "b")
    best = pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("place")
    where = best.join(a, ["video_id", "a"]).join(b, ["video_id", "b", "chunk_id"]).groupBy("video_id", "a", "b").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))
    return best.join(where, ["video_id", "a", "b"])


def too_many_images(rows: DataFrame, by: list[str], images: str, most: int) -> DataFrame:
    """Units with more images than a model takes, the worst first."""
    return rows.groupBy(*by).agg(F.sum(images).alias("images")).filter(F.col("images") > most).orderBy(F.desc("images"), *by)
