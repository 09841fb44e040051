"""Answers about whole recordings as rows of a store: sources, answers, items, mentions, units, and those of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.errors import Refused
from momentlake.functions import text as T
from momentlake.functions.numbers import rounded
from momentlake.operators import units as U
from momentlake.operators.grid import span_of

#: The level at which an answer's items are searched, by the kind of its definition.
LEVEL = {"fold": "source", "spans": "span", "link": "entity"}


def sources(grid: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """source_id, video_ids, members, duration_s and chunk_count: one row a grid.

    members: source_id, video_id, first_chunk, chunk_count and offset_s of combinations; a grid without is its own member."""
    g = grid.groupBy(F.col("video_id").alias("source_id")).agg(F.count("*").alias("chunk_count"), rounded(F.max("end_ts"), 3).alias("duration_s"))
    member = lambda v, f, n, o: F.struct(v.alias("video_id"), f.cast("long").alias("first_chunk"), n.cast("long").alias("chunk_count"), o.cast("double").alias("offset_s"))
    own = F.array(member(F.col("source_id"), F.lit(0), F.col("chunk_count"), F.lit(0.0)))
    if members is not None:
        item = F.struct("first_chunk", member(F.col("video_id"), F.col("first_chunk"), F.col("chunk_count"), rounded("offset_s", 3)).alias("m"))
        held = members.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["m"]).alias("members"))
        g = g.join(held, "source_id", "left").withColumn("members", F.coalesce("members", own))
    else:
        g = g.withColumn("members", own)
    return g.select("source_id", F.transform("members", lambda m: m["video_id"]).alias("video_ids"), "members", "duration_s", "chunk_count")


def answer_rows(results: DataFrame) -> DataFrame:
    """source_id, aggregate_id, aggregator, tier, payload and who made it from what; absent columns are null, the tier free."""
    have = lambda c, default=None: F.col(c) if c in results.columns else F.lit(default).cast("string").alias(c)
    return results.select("source_id", "aggregate_id", T.definition_of(F.col("aggregate_id")).alias("aggregator"), have("tier", "free"), have("payload"), have("inputs"), have("model"), have("version"), have("inputs_fingerprint", ""))


def items(found: DataFrame, grid: DataFrame, name: str, kind: str, fields: list[str]) -> DataFrame:
    """Rows of items of an answer named `name` (its key, in the plural): source_id, aggregate_id, item_id, item_kind,
    label (the first field), text, chunk_ids, start_ts, end_ts and data (a map).

    found: source_id, aggregate_id, position, chunk_ids and the fields; the span is that of the valid chunk ids."""
    one = name.removesuffix("s")
    own = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f).cast("string") for f in fields])) if fields else F.create_map().cast("map<string,string>")
    rows = found.select(
        F.col("source_id").alias("video_id"), "aggregate_id", F.concat_ws("-", F.lit(one), F.col("position").cast("string")).alias("item_id"), F.lit(one).alias("item_kind"),
        F.coalesce(F.col(fields[0]).cast("string"), F.lit("")).alias("label") if fields else F.lit("").alias("label"), "chunk_ids", own.alias("data"),
    )
    text = T.render(F.col("data")["summary"], F.map_filter("data", lambda k, _: k != "summary"))
    spans = span_of(rows, ["aggregate_id", "item_id"], "chunk_ids", grid).select("video_id", "aggregate_id", "item_id", rounded("start_ts", 3).alias("start_ts"), rounded("end_ts", 3).alias("end_ts"))
    return rows.withColumn("text", text).join(spans, ["video_id", "aggregate_id", "item_id"], "left").withColumnRenamed("video_id", "source_id").withColumn("kind", F.lit(kind))


def entity_items(entities: DataFrame, seen: DataFrame, aggregate_id: str) -> tuple[DataFrame, DataFrame]:
    """The items and the mentions of linked entities, as `entities.linked` gives them."""
    data = F.map_from_arrays(F.array(*map(F.lit, ("field", "appearances", "observed_s"))), F.array("field", F.col("appearances").cast("string"), rounded("observed_s", 3).cast("string")))
    made = entities.select(
        F.col("video_id").alias("source_id"), F.lit(aggregate_id).alias("aggregate_id"), F.col("entity_id").alias("item_id"), F.lit("entity").alias("item_kind"), F.coalesce("label", F.lit("")).alias("label"),
        "chunk_ids", data.alias("data"), T.account_text(F.col("account"), F.col("label")).alias("text"), rounded("start_ts", 3).alias("start_ts"), rounded("end_ts", 3).alias("end_ts"), F.lit("link").alias("kind"),
    )
    mentions = seen.select(F.col("video_id").alias("source_id"), F.lit(aggregate_id).alias("aggregate_id"), F.col("entity_id").alias("item_id"), F.col("key").alias("mention_key"), "chunk_id", "sampler_id", "entry", "doubt")
    return made, mentions


def units(made: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """What of answers is searched: source_id, aggregate_id, level, item_id, content, start_ts, end_ts and text_hash.

    made: items of kinds spans and link; others aren't searched.  summaries: source_id, aggregate_id, summary and fields
    (a map) of the last layer of a fold.  Blank texts are left out."""
    level = F.create_map(*[F.lit(x) for pair in LEVEL.items() for x in pair])[F.col("kind")]
    rows = made.filter(F.col("kind").isin("spans", "link")).select("source_id", "aggregate_id", level.alias("level"), "item_id", F.col("text").alias("content"), "start_ts", "end_ts")
    if summaries is not None:
        none = F.lit(None).cast("double")
        whole = summaries.filter(F.trim(F.coalesce("summary", F.lit(""))) != "").select("source_id", "aggregate_id", F.lit("source").alias("level"), F.lit("").alias("item_id"), T.render(F.col("summary"), F.col("fields")).alias("content"), none.alias("start_ts"), none.alias("end_ts"))
        rows = rows.unionByName(whole)
    return U.with_hash(rows.filter(F.trim("content") != ""))


def check_width(rows: DataFrame, vector: str = "vector", by: str = "embedder") -> DataFrame:
    """rows, refused when they are read if an embedder's vectors differ in length from the first width it has."""
    width = rows.filter(F.col(vector).isNotNull()).groupBy(by).agg(F.min(F.size(vector)).alias("__low"), F.max(F.size(vector)).alias("__high"))
    j = rows.join(width, by, "left")
    wrong = F.raise_error(F.concat(F.lit("vectors of several lengths by "), F.col(by)))
    return j.withColumn(vector, F.when(F.coalesce(F.col("__low") == F.col("__high"), F.lit(True)), F.col(vector)).otherwise(wrong)).drop("__low", "__high")


def export(store, grid: DataFrame, results: DataFrame, made: DataFrame, mentions: DataFrame | None = None, members: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, embedder: str = "none", summaries: DataFrame | None = None, definitions: DataFrame | None = None) -> tuple[list[str], int]:
    """Write sources, answers, items, mentions, definitions and, with `embed`, units; (problems, units written).

    Sources come first: if they fail nothing else is tried.  An answer's items and mentions are replaced whole, with it.
    embed: (key columns, content) -> the same rows with vector."""
    try:
        store.write("sources", sources(grid, members))
    except Exception as e:  # noqa: BLE001  reported, as the rest depends on it
        return [f"sources: {e}"], 0
    problems = []
    answers = answer_rows(results)
    of = ["source_id", "aggregate_id"]
    for table, rows in (("answers", answers), ("items", made.drop("kind")), ("mentions", mentions), ("definitions", definitions)):
        if rows is None:
            continue
        try:
            if table in ("items", "mentions") and hasattr(store, "replace"):
                store.replace(table, rows, answers.select(*of), of)
            else:
                store.write(table, rows)
        except Exception as e:  # noqa: BLE001  one table that fails mustn't keep the others from being written
            problems.append(f"{table}: {e}")
    if embed is None or not store.implements("write"):
        return problems, 0
    try:
        vectors = check_width(embed(units(made, summaries)).withColumn("embedder", F.lit(embedder)))
        if hasattr(store, "replace"):
            store.replace("aggregate_units", vectors, answers.select(*of).withColumn("embedder", F.lit(embedder)), [*of, "embedder"])
        else:
            store.write("aggregate_units", vectors)
        return problems, store.read("aggregate_units").filter(F.col("embedder") == embedder).join(answers.select(*of).distinct(), of, "left_semi").count()
    except Exception as e:  # noqa: BLE001
        return [*problems, f"aggregate_units: {e}"], 0


def document_tables(media: DataFrame | None = None, timelines: DataFrame | None = None, transcripts: DataFrame | None = None, descriptions: DataFrame | None = None, manifests: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rows of a store's tables by name, from typed documents; kinds that aren't given are left out."""
    from momentlake.sources import documents as D

    out = {}
    if media is not None:
        out["videos"] = media.drop("document", "version")
    if timelines is not None:
        out["timelines"] = timelines.drop("document", "version", "chunks")
        out["chunks"] = D.timeline_chunks(timelines)
    if transcripts is not None:
        out["transcripts"] = transcripts.drop("document", "version", "chunks")
        out["transcript_chunks"] = transcripts.select("video_id", F.explode("chunks").alias("c")).select("video_id", F.col("c.chunk_id").cast("long").alias("chunk_id"), "c.text", "c.word_count", "c.turns")
    if manifests is not None:
        out["manifests"] = manifests.drop("document", "version", "chunks")
        f = D.manifest_frames(manifests)
        out["chunk_samplers"] = f.groupBy("video_id", "chunk_id", "sampler_id").agg(F.count("*").alias("frame_count"), F.sort_array(F.collect_list("frame_index")).alias("frame_indexes"))
    if descriptions is not None:
        out["descriptions"] = D.description_rows(descriptions)
    return out


def write_units(store, rows: DataFrame, embedder: str) -> None:
    """Write embedded units of recordings, and drop the units of the same embedder whose chunk and answer are gone.

    rows: video_id, chunk_id, sampler_id, embedder and what else is stored; the recordings in rows are the ones replaced."""
    if "embedder" not in rows.columns:
        raise Refused("units name their embedder")
    store.replace("embeddings", check_width(rows.filter(F.col("embedder") == embedder)), rows.select("video_id").withColumn("embedder", F.lit(embedder)), ["video_id", "embedder"])
