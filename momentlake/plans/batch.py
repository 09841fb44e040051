"""Whole runs: from frames and cuts to stored units, and from stored answers to results about whole recordings.

Every function builds DataFrames and writes tables of a store; the driver holds names and receipts only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.errors import EngineError, Refused, UnknownOption
from momentlake.functions import text as T
from momentlake.models import reduce_with, stub_reduce
from momentlake.operators import aggregates, answers, entities, grid, sampling, segments, units
from momentlake.operators.selection import excerpt, parse
from momentlake.sources.store import Store

POLICIES = ("uniform", "scene", "vad", "speaker")
#: What a result costs: nothing, a local model, a hosted one.
TIERS = ("free", "local", "llm")


@dataclass(frozen=True)
class Record:
    """What is known of recordings, one table a kind; a kind that is missing is None."""

    grid: DataFrame
    frames: DataFrame | None = None
    turns: DataFrame | None = None
    answers: DataFrame | None = None
    spoken: DataFrame | None = None

    def has(self, kind: str) -> bool:
        return getattr(self, kind) is not None


@dataclass(frozen=True)
class Aggregator:
    name: str
    tier: str
    needs: tuple[str, ...]
    run: Callable[[Record], DataFrame]


def _described(r: Record) -> DataFrame | None:
    if r.answers is None:
        return None
    who = F.col("sampler_id") if "sampler_id" in r.answers.columns else T.answer_id(F.col("sampler"), F.col("question"))
    return r.answers.select("video_id", "chunk_id", who.alias("sampler_id")).distinct()


def _stats(r: Record) -> DataFrame:
    return aggregates.stats(r.grid, r.frames, _described(r), r.spoken)


def _speakers(r: Record) -> DataFrame:
    return aggregates.speakers(r.turns, r.grid.groupBy("video_id").agg(F.max("end_ts").alias("duration_s")))


def _coverage(r: Record) -> DataFrame:
    answered = (_described(r) if r.answers is not None else r.grid.limit(0).withColumn("sampler_id", F.lit(""))).withColumnRenamed("sampler_id", "sampler")
    spoken = r.spoken if r.spoken is not None else r.grid.limit(0).withColumn("word_count", F.lit(0))
    return aggregates.coverage_summary(aggregates.coverage(r.grid, answered, spoken))


def lines(r: Record, selection: str = "*") -> DataFrame:
    """video_id, chunk_id, start_ts, end_ts, text and line of what a selection's first input says of each chunk."""
    one = parse(selection)[0]
    rows = excerpt(one, r.grid, r.answers, r.spoken)
    return rows.withColumn("line", T.row_line(F.col("chunk_id"), F.col("start_ts"), F.col("end_ts"), F.col("text")))


def sentiment(classify: Callable[[DataFrame], DataFrame], limit: int = 1500, selection: str = "*") -> Aggregator:
    """classify: (video_id, chunk_id, piece_no, piece) -> the same with signed, the tone of a piece in [-1, 1]."""
    run = lambda r: aggregates.sentiment(aggregates.sentiment_chunks(classify(T.pieces(lines(r, selection), ["video_id", "chunk_id"], "text", limit))))
    return Aggregator("sentiment", "local", ("answers", "spoken"), run)


def chapters(embed: Callable[[DataFrame], DataFrame], name: Callable[[DataFrame], DataFrame] | None = None, shortest: float = 30.0, most: int | None = None, selection: str = "*") -> Aggregator:
    """embed: rows with text -> the same with vector."""

    def run(r: Record) -> DataFrame:
        rows = embed(lines(r, selection)).withColumn("seconds", F.col("end_ts") - F.col("start_ts")).withColumn("position", F.col("chunk_id"))
        return segments.chapters(rows.select("video_id", "chunk_id", "position", "seconds", "vector", F.col("line").alias("text")), r.grid, shortest, most, name)

    return Aggregator("chapters", "llm", ("answers", "spoken"), run)


def items(name: str, ask: Callable[[DataFrame], DataFrame], size: int = 100, selection: str = "*") -> Aggregator:
    """Events and the like: what a model lists from windows of lines."""
    return Aggregator(name, "llm", ("answers", "spoken"), lambda r: aggregates.items_of_windows(lines(r, selection), r.grid, ask, size))


def custom(name: str, kind: str, selection: str = "*", **how) -> Aggregator:
    """A definition of the user's own, by its kind: fold (reduce), spans (embed, name), items (ask) or link (profile, embed)."""
    if kind == "fold":
        made = summary(how.get("reduce"))
    elif kind == "spans":
        made = chapters(how["embed"], how.get("name"), how.get("shortest", 30.0), how.get("most"), selection)
    elif kind == "items":
        made = items(name, how["ask"], how.get("size", 100), selection)
    elif kind == "link":
        made = linked(how["profile"], how["embed"], how.get("tell"))
    else:
        raise UnknownOption("kind", kind, ("fold", "spans", "items", "link"))
    return Aggregator(name, made.tier, made.needs, made.run)


def linked(profile: entities.Profile, embed: Callable[[DataFrame], DataFrame], tell: Callable[[DataFrame], DataFrame] | None = None) -> Aggregator:
    """The entities of a link profile.  embed: mentions -> the same with vector (of the signature)."""

    def run(r: Record) -> DataFrame:
        found, heard = entities.sightings(profile, r.answers, r.spoken)
        return entities.linked(profile, embed(entities.numbered(found)), r.grid, tell, heard).entities

    return Aggregator(f"entities:{profile.name}", "llm", ("answers",), run)


def summary(reduce: Callable[[DataFrame], DataFrame] | None = None) -> Aggregator:
    """A summary by layers of at most 25 texts; without a reducer the deterministic stand-in."""

    def run(r: Record) -> DataFrame:
        rows, last = r.answers.select("video_id", F.col("chunk_id").alias("position"), F.col("description").alias("text")), None
        for _, last in aggregates.fold(rows, "video_id", "position", "text", reduce or reduce_with(stub_reduce)):
            pass
        return last

    return Aggregator("summary", "llm", ("answers",), run)


def ner(recognise: Callable, limit: int = 1000) -> Aggregator:
    return Aggregator("ner", "local", ("answers",), lambda r: answers.ner(r.answers, "video_id", "chunk_id", "description", recognise, limit))


BUILTIN = {
    a.name: a
    for a in (
        Aggregator("stats", "free", (), _stats),
        Aggregator("speakers", "free", ("turns",), _speakers),
        Aggregator("coverage", "free", (), _coverage),
        summary(),
    )
}


def available(tier: str = "llm", extra: dict[str, Aggregator] | None = None) -> list[Aggregator]:
    """Aggregators up to a tier, the cheapest first."""
    if tier not in TIERS:
        raise UnknownOption("tier", tier, TIERS)
    known = {**BUILTIN, **(extra or {})}
    return sorted((a for a in known.values() if TIERS.index(a.tier) <= TIERS.index(tier)), key=lambda a: (TIERS.index(a.tier), a.name))


def validate_aggregate(names: list[str], extra: dict[str, Aggregator] | None = None) -> list[str]:
    """What is wrong with a request; no data are touched."""
    known = {**BUILTIN, **(extra or {})}
    twice = sorted({n for n in names if names.count(n) > 1})
    return [f"no aggregator {n!r}" for n in names if n not in known] + [f"{n!r} is asked twice" for n in twice]


@dataclass
class Results:
    """Lazy results by name, and the reason for each that was skipped."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)


def aggregate(record: Record, names: list[str] | None = None, tier: str = "llm", extra: dict[str, Aggregator] | None = None) -> Results:
    """The named aggregators, or all up to a tier; one whose input is missing is skipped with the reason."""
    if names and (problems := validate_aggregate(names, extra)):
        raise Refused("; ".join(problems))
    known, out = {**BUILTIN, **(extra or {})}, Results()
    for a in [known[n] for n in names] if names else available(tier, extra):
        missing = [k for k in a.needs if not record.has(k)]
        if missing:
            out.skipped[a.name] = f"needs {', '.join(missing)}"
        else:
            out.tables[a.name] = a.run(record)
    return out


@dataclass(frozen=True)
class Extraction:
    """How recordings become chunks, frames and answers."""

    policy: str = "uniform"
    chunk_s: float = 20.0
    min_s: float = 5.0
    max_s: float | None = None
    per_second: float = 1.0
    samplers: Callable[[], list[sampling.Sampler]] | None = None
    value: str = "score"
    limit: int | None = None


def validate(how: Extraction, has_cuts: bool) -> list[str]:
    """What is wrong with an extraction; no data are touched."""
    out = []
    if how.policy not in POLICIES:
        out.append(f"policy is one of {', '.join(POLICIES)}")
    elif how.policy != "uniform" and not has_cuts:
        out.append(f"policy {how.policy} needs cuts")
    if how.chunk_s <= 0 or how.per_second <= 0:
        out.append("chunk_s and per_second are positive")
    if how.max_s is not None and how.max_s < how.min_s:
        out.append("max_s is at least min_s")
    return out


def extract(store: Store, durations: DataFrame, frames: DataFrame, questions: DataFrame, describe: Callable[[DataFrame], DataFrame], how: Extraction = Extraction(), cuts: DataFrame | None = None) -> list[str]:
    """Write chunks, sampled frames' calls, descriptions and units of recordings; returns the tables written.

    durations: video_id, duration_s; frames: video_id, frame_index, media_ts and the sampled value; describe: calls ->
    calls with description.  Calls that the store has answers to aren't made again."""
    if problems := validate(how, cuts is not None):
        raise Refused("; ".join(problems))
    chunks = grid.build(how.policy, durations, cuts, how.chunk_s, how.min_s, how.max_s)
    store.write("chunks", chunks)
    placed = grid.with_chunk(sampling.decimate(frames, how.per_second), chunks, "media_ts")
    sampled = sampling.sample(placed, how.samplers, how.value) if how.samplers else placed.withColumn("sampler", F.lit("uniform"))
    planned = answers.calls(sampled, questions)
    store.write("chunk_samplers", planned.select("video_id", "chunk_id", "sampler_id", "sampler", "question", "frame_indexes", "frame_count"))
    try:
        have = store.read("descriptions").select(*answers.CALL)
    except EngineError:
        have = None
    planned = store.read("chunk_samplers") if store.implements("read") else planned
    said = describe(answers.due(planned, have, how.limit))
    store.write("descriptions", said.select(*answers.CALL, "sampler", "question", "frame_indexes", "frame_count", "description"))
    texts = store.read("descriptions").filter(F.trim("description") != "")
    made = units.with_hash(texts.select(*answers.CALL, "sampler", "question", T.plain(F.array("description")).alias("content"), F.lit("none").alias("embedder")))
    store.write("embeddings", made)
    return ["chunks", "chunk_samplers", "descriptions", "embeddings"]


def media(store: Store, files: DataFrame, describe: Callable[[bytes], dict] | None = None) -> DataFrame:
    """Probe files and store what they are; files that can't be read come back with their problem."""
    from momentlake.sources import media as M

    found = M.probe(files, describe or M.describe_wav)
    store.write("videos", found.filter("problem IS NULL").drop("problem"))
    return found.filter("problem IS NOT NULL").select("video_id", "path", "problem")


def audio(store: Store, files: DataFrame, transcribe: Callable, diarize: Callable | None = None, load: Callable | None = None, bucket_s: float = 20.0) -> None:
    """The audio pass: transcribe, tell who speaks, and store the transcript on the stored grid, silent chunks too."""
    from momentlake.operators import speech
    from momentlake.sources import media as M

    tracks, heard = M.listen(files, transcribe, diarize, load or M.load_wav)
    words, found, turns = M.attributed(heard, bucket_s)
    store.write("transcripts", tracks.join(speech.raw_transcript_stats(words, found, turns), "video_id", "left"))
    chunks = store.read("chunks").select("video_id", "chunk_id", "start_ts", "end_ts")
    said = speech.transcript_chunks(words, chunks.join(tracks.select("video_id"), "video_id", "left_semi"), bucket_s)
    store.write("transcript_chunks", said.drop("start_ts", "end_ts"))


def glance(store: Store, shown: DataFrame, embedder) -> None:
    """Embed the images of sampled frames, a unit a chunk and sampler; one whose images are the same keeps its vector.

    shown: video_id, chunk_id, sampler_id, sampler, position, frame_index and image.  More images than the model takes are
    refused before any is embedded."""
    by = ["video_id", "chunk_id", "sampler_id", "sampler"]
    over = aggregates.too_many_images(shown.withColumn("n", F.lit(1)), by, "n", embedder.max_images).limit(3).collect()
    if over:
        raise Refused("more images than the model takes: " + ", ".join(f"{r.video_id} {r.chunk_id} {r.sampler_id} ({r.images})" for r in over))
    item = F.struct("frame_index", "position", "image")
    g = shown.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["image"]).alias("images"))
    g = g.withColumn("text_hash", F.substring(F.sha2(F.array_join(F.transform("images", lambda i: F.sha2(i, 256)), ",").cast("binary"), 256), 1, 16)).withColumn("embedder", F.lit(embedder.key)).withColumn("question", F.lit("image"))
    try:
        old = store.read("embeddings").filter(F.col("embedder") == embedder.key)
    except EngineError:
        old = None
    if old is not None and "vector" in old.columns:
        g = units.carry_over(g, old)
        made = g.filter("reused").unionByName(embedder.embed(g.filter("NOT reused").drop("vector")).select(*g.columns))
    else:
        made = embedder.embed(g)
    store.write("embeddings", made.select(*by, "question", "embedder", "text_hash", "vector"))


def embed(store: Store, embedder, transcript: bool = True) -> None:
    """Embed what is said of chunks: descriptions and, with transcript, the transcript, all as units; those whose text is
    unchanged keep their vector, those whose text is gone leave the store."""
    d = store.read("descriptions")
    structured = F.col("structured") if "structured" in d.columns else F.lit(None).cast("string")
    rows = d.select(*answers.CALL, "sampler", "question", T.rendered(F.col("description"), structured).alias("content"))
    if transcript:
        try:
            t = store.read("transcript_chunks")
            rows = rows.unionByName(t.select("video_id", "chunk_id", F.lit("transcript").alias("sampler_id"), F.lit("transcript").alias("sampler"), F.lit("transcript").alias("question"), F.trim(F.coalesce("text", F.lit(""))).alias("content")))
        except EngineError:
            pass
    now = units.with_hash(rows.filter(F.trim("content") != "")).withColumn("embedder", F.lit(embedder.key))
    try:
        old = store.read("embeddings").filter(F.col("embedder") == embedder.key)
    except EngineError:
        old = None
    if old is not None and "vector" in old.columns:
        now = units.carry_over(now, old)
        made = now.filter("reused").drop("reused").unionByName(embedder.embed(now.filter("NOT reused").drop("vector", "reused")).select(*[c for c in now.columns if c != "reused"]))
    else:
        made = embedder.embed(now)
    if hasattr(store, "replace"):
        store.replace("embeddings", made, now.select("video_id").withColumn("embedder", F.lit(embedder.key)), ["video_id", "embedder"])
    else:
        store.write("embeddings", made)


def workflow(store: Store, record: Callable[[Store], Record], tier: str = "free", **extraction) -> Results:
    """Extraction, then every aggregator up to a tier over what is stored."""
    extract(store, **extraction)
    return aggregate(record(store), tier=tier)
