"""More queries over the test tables: whole-recording documents, search over stored answers, live logs, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentlake import fixtures as X
from momentlake.functions import boxes, times
from momentlake.functions import text as T
from momentlake.functions.numbers import rounded
from momentlake.models import stub_sentiment
from momentlake.operators import aggregates, combine, export, grid, search, segments, selection, speech
from momentlake.plans.catalogue import FG, PLACED, RANKED, SEQ, TG, WORD_SPEAKER, _grid, _placed, _sequence, _turn_grid, query

# -- whole recordings


@query(
    f"""{PLACED}, l AS (SELECT *, end_ts - start_ts AS len FROM grid), r AS (SELECT video_id, len, row_number() OVER (PARTITION BY video_id ORDER BY len) AS i, count(*) OVER (PARTITION BY video_id) AS n FROM l),
g AS (SELECT video_id, max(end_ts) AS d, count(*) AS chunks, round(min(len), 3) AS chunk_min, round(max(len), 3) AS chunk_max FROM l GROUP BY video_id),
f AS (SELECT video_id, count(*) AS frames_sampled FROM frames GROUP BY video_id),
a AS (SELECT video_id, string_agg(sampler || '=' || n, ',' ORDER BY sampler) AS described FROM (SELECT video_id, sampler, count(DISTINCT chunk_id) AS n FROM placed GROUP BY ALL) GROUP BY video_id)
SELECT g.video_id, round(d, 3) AS duration_s, chunks, chunk_min, round(r.len, 3) AS chunk_median, chunk_max, frames_sampled, described FROM g JOIN r ON g.video_id = r.video_id AND r.i = r.n // 2 + 1 JOIN f ON f.video_id = g.video_id JOIN a ON a.video_id = g.video_id"""
)
def stats_document(spark, d):
    f, p = X.frames(spark, d), _placed(spark, d)
    s = aggregates.stats(_grid(f), f, p.select("video_id", "chunk_id", F.col("sampler").alias("sampler_id")).distinct())
    text = F.array_join(F.transform(F.map_entries("descriptions_by_sampler"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.withColumn("described", text).select("video_id", "duration_s", "chunks", "chunk_min", "chunk_median", "chunk_max", "frames_sampled", "described")


@query(
    f"""{TG}, w AS (SELECT video_id, sum(word_count)::BIGINT AS words, count(*) FILTER (word_count > 0) AS chunks_with_speech FROM spoken GROUP BY video_id), g AS (SELECT video_id, max(end_ts) AS d, count(*) AS chunks FROM grid GROUP BY video_id)
SELECT video_id, chunks, words, chunks_with_speech, CASE WHEN d > 0 THEN round(words / (d / 60), 1) ELSE 0.0 END AS words_per_minute FROM g JOIN w USING (video_id)"""
)
def words_document(spark, d):
    g = _turn_grid(X.turns(spark, d))
    s = aggregates.stats(g, spoken=speech.transcript_chunks(X.words(spark, d), g, X.TURN_CHUNK))
    return s.select("video_id", "chunks", "words", "chunks_with_speech", "words_per_minute")


@query(
    f"""WITH {X.TURNS}, s AS (SELECT video_id, speaker, sum("end" - start) AS seconds, min(position) AS f FROM turns GROUP BY ALL), d AS (SELECT video_id, max("end") AS d FROM turns GROUP BY video_id),
l AS (SELECT *, lag(speaker) OVER (PARTITION BY video_id ORDER BY position) AS b FROM turns), h AS (SELECT video_id, count(*) AS turns, count(*) FILTER (b <> speaker) AS handovers FROM l GROUP BY video_id),
g AS (SELECT video_id, count(*) AS speakers, sum(seconds) AS speech, first(speaker ORDER BY seconds DESC, f) AS dominant FROM s GROUP BY video_id),
p AS (SELECT video_id, string_agg(speaker || '=' || round(seconds, 3)::DECIMAL(18,3) || '=' || round(seconds / speech, 4)::DECIMAL(18,4), ',' ORDER BY seconds DESC, f) AS by_speaker FROM s JOIN g USING (video_id) GROUP BY video_id)
SELECT video_id, speakers, turns, handovers, speakers <= 1 AND handovers = 0 AS monologue, round(speech, 3) AS speech_s, round(speech / d, 4) AS speech_ratio, by_speaker, dominant FROM g JOIN h USING (video_id) JOIN d USING (video_id) JOIN p USING (video_id)"""
)
def speakers_document(spark, d):
    t = X.turns(spark, d)
    s = aggregates.speakers(t, t.groupBy("video_id").agg(F.max("end").alias("duration_s")))
    part = lambda e: F.concat_ws("=", e["speaker"], e["seconds"].cast("decimal(18,3)").cast("string"), e["share"].cast("decimal(18,4)").cast("string"))
    return s.withColumn("by_speaker", F.array_join(F.transform("by_speaker", part), ","))


def _covered(spark, d):
    t = X.turns(spark, d)
    g = _turn_grid(t)
    answered = t.filter("speaker = 'assistant'").select("video_id", F.floor(F.col("start") / X.TURN_CHUNK).cast("long").alias("chunk_id"), F.col("speaker").alias("sampler"))
    return aggregates.coverage(g, answered, speech.transcript_chunks(X.words(spark, d), g, X.TURN_CHUNK))


@query(
    f"""{TG}, ans AS (SELECT DISTINCT video_id, start::BIGINT // 500 AS chunk_id FROM turns WHERE speaker = 'assistant'), s AS (SELECT video_id, chunk_id FROM spoken WHERE word_count > 0),
k AS (SELECT g.video_id, g.chunk_id, a.chunk_id IS NOT NULL AS pic, s.chunk_id IS NOT NULL AS snd FROM grid g LEFT JOIN ans a USING (video_id, chunk_id) LEFT JOIN s ON s.video_id = g.video_id AND s.chunk_id = g.chunk_id)
SELECT video_id, count(*) FILTER (pic AND snd) AS "both", count(*) FILTER (pic AND NOT snd) AS picture_only, count(*) FILTER (snd AND NOT pic) AS sound_only, count(*) FILTER (NOT pic AND NOT snd) AS neither,
coalesce(string_agg(CASE WHEN NOT pic AND NOT snd THEN chunk_id::VARCHAR END, ',' ORDER BY chunk_id), '') AS silent_chunks FROM k GROUP BY video_id"""
)
def coverage_document(spark, d):
    return aggregates.coverage_summary(_covered(spark, d)).withColumn("silent_chunks", F.array_join(F.transform("silent_chunks", lambda c: c.cast("string")), ","))


SIGNED = """s AS (SELECT conv_id::VARCHAR AS video_id, turn // 3 AS chunk_id, text, length(text) AS n, (length(text) % 7 - 3) / 3.0::DOUBLE AS signed FROM conversations),
c AS (SELECT video_id, chunk_id, sum(signed * n) / sum(n) AS s, count(*) AS pieces FROM s GROUP BY ALL)"""


def _tones(spark, d):
    t = X.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("video_id"), F.floor(F.col("turn") / 3).cast("long").alias("chunk_id"), F.col("text").alias("piece"))
    return aggregates.sentiment_chunks(t.withColumn("signed", stub_sentiment(F.col("piece"))))


@query(f"WITH {SIGNED} SELECT video_id, chunk_id, CASE WHEN s >= 0 THEN 'positive' ELSE 'negative' END AS label, round(abs(s), 4) AS score, round(s, 4) AS signed, pieces FROM c")
def sentiment_chunks(spark, d):
    return _tones(spark, d)


@query(
    f"""WITH {SIGNED}, r AS (SELECT video_id, chunk_id, round(s, 4) AS signed FROM c), l AS (SELECT *, lag(signed) OVER (PARTITION BY video_id ORDER BY chunk_id) AS b FROM r)
SELECT video_id, sign(sum(round(signed * 10000)::BIGINT)) * ((2 * abs(sum(round(signed * 10000)::BIGINT)) + count(*)) // (2 * count(*)))::DOUBLE / 10000 + 0.0 AS mean,
count(*) FILTER (signed > 0) AS positive_chunks, count(*) FILTER (signed < 0) AS negative_chunks, count(*) AS chunks_read,
coalesce(string_agg(CASE WHEN b IS NOT NULL AND (b < 0) <> (signed < 0) THEN chunk_id::VARCHAR END, ',' ORDER BY chunk_id), '') AS turning_points FROM l GROUP BY video_id"""
)
def sentiment_document(spark, d):
    return aggregates.sentiment(_tones(spark, d)).withColumn("turning_points", F.array_join(F.transform("turning_points", lambda c: c.cast("string")), ","))


@query(f"{FG} SELECT video_id, count(*) AS chunks, round(min(end_ts - start_ts), 3) AS shortest_s, round(max(end_ts - start_ts), 3) AS longest_s, round(max(end_ts), 3) AS duration_s FROM grid GROUP BY video_id")
def boundary_stats(spark, d):
    return grid.boundary_stats(_grid(X.frames(spark, d)))


@query(f"WITH {X.FRAMES} SELECT video_id, media_ts AS at, score FROM frames WHERE score >= 180")
def retuned_cuts(spark, d):
    return grid.retune(X.frames(spark, d).select("video_id", F.col("media_ts").alias("at"), "score"), 180.0)


@query(
    f"""{WORD_SPEAKER}, w AS (SELECT video_id, count(*) AS words, count(speaker) AS attributed FROM ws GROUP BY video_id), t AS (SELECT video_id, count(*) AS turns, count(DISTINCT speaker) AS speakers, round(sum("end" - start), 3) AS speech_s FROM turns GROUP BY video_id)
SELECT video_id, turns AS segments, words, attributed, turns, speakers, speech_s FROM w JOIN t USING (video_id)"""
)
def raw_transcript_stats(spark, d):
    t = X.turns(spark, d)
    return speech.raw_transcript_stats(speech.word_speakers(X.words(spark, d), t, X.TURN_CHUNK), t, t)


@query(
    f"""{WORD_SPEAKER}, p AS (SELECT ws.*, g.chunk_id FROM ws JOIN (SELECT *, chunk_id = max(chunk_id) OVER (PARTITION BY video_id) AS last FROM grid) g ON ws.video_id = g.video_id AND (start + "end") / 2 >= g.start_ts AND ((start + "end") / 2 < g.end_ts OR g.last AND (start + "end") / 2 = g.end_ts)),
l AS (SELECT *, row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w AS new FROM p WINDOW w AS (PARTITION BY video_id, chunk_id ORDER BY start, position, word_position)),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY video_id, chunk_id ORDER BY start, position, word_position ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT video_id, chunk_id, (island - 1)::BIGINT AS turn, first(speaker) AS speaker, round(min(start), 3) AS start, round(arg_max("end", (start, position, word_position)), 3) AS "end", trim(string_agg(text, '' ORDER BY start, position, word_position)) AS text FROM i GROUP BY video_id, chunk_id, island"""
)
def chunk_turns(spark, d):
    t = X.turns(spark, d)
    return speech.chunk_turns(speech.word_speakers(X.words(spark, d), t, X.TURN_CHUNK), _turn_grid(t), X.TURN_CHUNK)


# -- search

GRIDS = "grids AS (SELECT source AS video_id, (doc_id // 4)::BIGINT AS chunk_id, min(doc_id) * 5.0::DOUBLE AS start_ts, max(doc_id) * 5.0::DOUBLE + 5 AS end_ts FROM documents GROUP BY ALL)"


def _unit_grid(spark, d):
    c = X.table(spark, d, "documents").groupBy(F.col("source").alias("video_id"), F.floor(F.col("doc_id") / 4).cast("long").alias("chunk_id"))
    return c.agg((F.min("doc_id") * 5.0).alias("start_ts"), (F.max("doc_id") * 5.0 + 5).alias("end_ts"))


@query(
    RANKED.replace("WITH ", f"WITH {GRIDS}, hit AS (SELECT DISTINCT chunk_id FROM grids WHERE end_ts > 400 AND start_ts < 600), wide AS (SELECT DISTINCT c AS chunk_id FROM (SELECT unnest(range(chunk_id - 2, chunk_id + 3)) AS c FROM hit) WHERE c >= 0 AND c <= (SELECT max(chunk_id) FROM grids)), ", 1).replace(
        "WHERE vector IS NOT NULL", "WHERE vector IS NOT NULL AND chunk_id IN (SELECT chunk_id FROM wide)"
    )
    + """, placed AS (SELECT *, 1.0::DOUBLE / (10 + rank) AS s, row_number() OVER (PARTITION BY video_id, chunk_id ORDER BY rank) AS place FROM ranked WHERE rank <= 20),
m AS (SELECT video_id, chunk_id, max(s) FILTER (place = 1) + 0.5 * coalesce(max(s) FILTER (place = 2), 0) AS score, count(*) AS hits FROM placed GROUP BY video_id, chunk_id ORDER BY score DESC, video_id, chunk_id LIMIT 5)
SELECT m.*, start_ts, end_ts FROM m LEFT JOIN grids USING (video_id, chunk_id)"""
)
def moments_window(spark, d):
    return search.search(X.units(spark, d), X.query_vector(spark, d), search.SearchRequest(limit=5, after=400.0, before=600.0, window=2), grid=_unit_grid(spark, d))


@query(
    f"""{RANKED.replace('WITH ', f'WITH {GRIDS}, ', 1)}, v AS (SELECT video_id, chunk_id, sampler_id, sampler, n_chars, rank AS vector_rank, 1.0::DOUBLE / (60 + rank) AS score FROM ranked WHERE rank <= 10)
SELECT v.video_id, v.chunk_id, sampler_id, vector_rank, score, sampler, start_ts, end_ts FROM v LEFT JOIN grids g ON g.video_id = v.video_id AND g.chunk_id = v.chunk_id"""
)
def vector_search_rows(spark, d):
    found = search.hybrid_search(X.units(spark, d), _unit_grid(spark, d), X.query_vector(spark, d), None, search.SearchRequest(limit=10))
    return found.select(*search.UNIT, "vector_rank", "score", "sampler", "start_ts", "end_ts")


def _stored_answers(spark, d):
    """Documents as units of stored answers: of a source's chapters in one language, of entities in others."""
    u = X.units(spark, d).withColumn("level", F.when(F.col("sampler") == "en", "span").when(F.col("sampler") == "de", "entity").otherwise("source"))
    units = u.select(F.col("video_id").alias("source_id"), F.col("sampler").alias("aggregate_id"), F.concat(F.lit("i-"), F.col("doc_id").cast("string")).alias("item_id"), "level", "embedder", "content", "vector", F.col("doc_id").cast("double").alias("start_ts"))
    sources = units.select("source_id").distinct().withColumn("video_ids", F.array("source_id"))
    items = units.filter("item_id LIKE '%5'").select("source_id", "aggregate_id", "item_id", F.upper("item_id").alias("label"))
    return units, sources, items


@query(
    f"""{RANKED.replace("WHERE vector IS NOT NULL", "WHERE vector IS NOT NULL AND sampler = 'en'").replace("video_id, chunk_id, sampler_id) AS rank", "video_id, sampler, 'i-' || doc_id) AS rank")}
SELECT video_id AS source_id, sampler AS aggregate_id, 'i-' || doc_id AS item_id, rank AS vector_rank, 1.0::DOUBLE / (60 + rank) AS score, 'span' AS level, doc_id::DOUBLE AS start_ts, CASE WHEN doc_id % 10 = 5 THEN 'I-' || doc_id END AS label, video_id AS videos FROM ranked WHERE rank <= 5"""
)
def aggregate_search(spark, d):
    found = search.search_aggregates(*_stored_answers(spark, d), X.query_vector(spark, d), level="span", limit=5, embedder="fixture:64")
    return found.select(*search.ITEM, "vector_rank", "score", "level", "start_ts", "label", F.array_join("video_ids", ",").alias("videos"))


# -- segments


@query(
    f"""WITH {SEQ}, s AS (SELECT video_id, position, position // 7 AS segment FROM seq), f AS (SELECT video_id, segment, min(position) * 2 AS first FROM s GROUP BY ALL),
b AS (SELECT *, CASE WHEN segment = 0 THEN 0 ELSE first END AS lo, coalesce(lead(first) OVER (PARTITION BY video_id ORDER BY segment), 1000000) AS hi FROM f),
g AS (SELECT video_id, unnest(range(2 * max(position) + 5)) AS chunk_id FROM seq GROUP BY video_id) SELECT g.video_id, g.chunk_id, segment FROM g JOIN b ON g.video_id = b.video_id AND chunk_id >= lo AND chunk_id < hi"""
)
def segment_chunks(spark, d):
    s = _sequence(spark, d)
    starts = s.select("video_id", F.floor(F.col("position") / 7).alias("segment"), (F.col("position") * 2).alias("chunk_id"))
    g = s.groupBy("video_id").agg(F.max("position").alias("top")).select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top") * 2 + 4)).alias("chunk_id"))
    g = g.withColumn("start_ts", F.col("chunk_id") * 1.0).withColumn("end_ts", F.col("chunk_id") + 1.0)
    return segments.chunks_of(starts, g).select("video_id", "chunk_id", "segment")


# -- answers, exports, live logs


@query(
    f"""{PLACED}, k AS (SELECT video_id, chunk_id, sampler, structured->>'$.k' AS v, min(frame_index) AS f FROM placed GROUP BY ALL),
m AS (SELECT video_id, chunk_id, sampler, count(*) AS n, string_agg(v, ',' ORDER BY f) AS vs FROM k GROUP BY ALL)
SELECT video_id, chunk_id, sampler, CASE WHEN n = 1 THEN '{{"k":' || vs || '}}' ELSE '{{"k":[' || vs || ']}}' END AS structured FROM m"""
)
def merged_fields(spark, d):
    return aggregates.merged_fields(_placed(spark, d), ["video_id", "chunk_id", "sampler"], ["frame_index"])


@query(f"WITH {X.TURNS} SELECT video_id, string_agg(speaker || '=' || n, ',' ORDER BY speaker) AS by_speaker FROM (SELECT video_id, speaker, count(*) AS n FROM turns GROUP BY ALL) GROUP BY video_id")
def speaker_counts(spark, d):
    c = aggregates.counted(X.turns(spark, d), ["video_id"], "speaker", "m")
    return c.select("video_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("by_speaker"))


OFFSETS = f"""{TG}, g AS (SELECT video_id, count(*) AS chunk_count, max(end_ts) AS duration_s FROM grid GROUP BY video_id),
members AS (SELECT 'all' AS source_id, video_id, coalesce(sum(chunk_count) OVER w, 0)::BIGINT AS first_chunk, chunk_count, coalesce(sum(duration_s) OVER w, 0.0) AS offset_s, duration_s FROM g WINDOW w AS (ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    f"""{OFFSETS}, heard AS (SELECT * FROM spoken WHERE video_id::INT % 2 = 0)
SELECT 'all' AS video_id, m.first_chunk + g.chunk_id AS chunk_id, coalesce(h.text, '') AS text, coalesce(h.word_count, 0) AS word_count FROM grid g JOIN members m USING (video_id) LEFT JOIN heard h ON h.video_id = g.video_id AND h.chunk_id = g.chunk_id"""
)
def combined_transcript(spark, d):
    g = _turn_grid(X.turns(spark, d))
    spoken = speech.transcript_chunks(X.words(spark, d), g, X.TURN_CHUNK).filter(F.col("video_id").cast("int") % 2 == 0)
    return combine.combined_transcript(g, spoken, combine.offsets(g, "all"))


@query(
    f"""{TG}, s AS (SELECT video_id AS id, sum(word_count) AS words, count(*) FILTER (word_count > 0) AS speech FROM spoken GROUP BY video_id) SELECT 'all' AS source_id, sum(words)::DOUBLE AS words, sum(speech)::DOUBLE AS chunks_with_speech FROM s"""
)
def combined_stats(spark, d):
    g = _turn_grid(X.turns(spark, d))
    s = aggregates.stats(g, spoken=speech.transcript_chunks(X.words(spark, d), g, X.TURN_CHUNK)).withColumn("source_id", F.lit("all"))
    return aggregates.combined_stats(s.withColumn("words", F.col("words").cast("double")).withColumn("chunks_with_speech", F.col("chunks_with_speech").cast("double")), "source_id", ["words", "chunks_with_speech"])


@query(
    f"""{OFFSETS} SELECT video_id AS source_id, video_id AS videos, round(duration_s, 3) AS duration_s, chunk_count FROM members
UNION ALL SELECT 'all', string_agg(video_id, ',' ORDER BY first_chunk), round(sum(duration_s), 3), sum(chunk_count)::BIGINT FROM members"""
)
def source_rows(spark, d):
    g = _turn_grid(X.turns(spark, d))
    m = combine.offsets(g, "all")
    both = g.unionByName(combine.combined_grid(g, m))
    s = export.sources(both, m)
    return s.select("source_id", F.array_join("video_ids", ",").alias("videos"), "duration_s", "chunk_count")


@query(
    f"""{TG}, i AS (SELECT video_id, position, start::BIGINT // 500 AS c, speaker FROM turns)
SELECT i.video_id AS source_id, 'events' AS aggregate_id, 'event-' || position AS item_id, 'event' AS item_kind, speaker AS label, 'speaker: ' || speaker || '. turn: ' || position AS text, round(g.start_ts, 3) AS start_ts, round(g.end_ts, 3) AS end_ts
FROM i LEFT JOIN grid g ON g.video_id = i.video_id AND g.chunk_id = i.c"""
)
def item_rows(spark, d):
    t = X.turns(spark, d)
    found = t.select(F.col("video_id").alias("source_id"), F.lit("events").alias("aggregate_id"), "position", F.array(F.floor(F.col("start") / X.TURN_CHUNK).cast("long")).alias("chunk_ids"), "speaker", F.col("position").alias("turn"))
    out = export.items(found, _turn_grid(t), "events", "items", ["speaker", "turn"])
    return out.select("source_id", "aggregate_id", "item_id", "item_kind", "label", "text", "start_ts", "end_ts")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || '+00:00' AS seen_at FROM events")
def arrival_stamps(spark, d):
    return X.table(spark, d, "events").select("event_id", times.iso_millis(F.col("ts").cast("timestamp")).alias("seen_at"))


BOXES = "b AS (SELECT event_id, user_id, (value % 50)::DOUBLE AS x1, (value % 30)::DOUBLE AS y1, (value % 50 + 5 + event_id % 20)::DOUBLE AS x2, (value % 30 + 4 + event_id % 10)::DOUBLE AS y2 FROM events)"


@query(
    f"""WITH {BOXES}, p AS (SELECT a.event_id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.* EXCLUDE (event_id, user_id) FROM b a JOIN b ON a.user_id = b.user_id AND b.event_id = a.event_id + 1),
k AS (SELECT *, greatest(least(ax2, x2) - greatest(ax1, x1), 0) * greatest(least(ay2, y2) - greatest(ay1, y1), 0) AS i, (ax2 - ax1) * (ay2 - ay1) AS s, (x2 - x1) * (y2 - y1) AS t FROM p)
SELECT event_id, round(i / (s + t - i), 6) AS iou, round(least(s, t) / greatest(s, t) / (1 + sqrt(((ax1 + ax2) / 2 - (x1 + x2) / 2) ** 2 + ((ay1 + ay2) / 2 - (y1 + y2) / 2) ** 2) / ((sqrt((ax2 - ax1) ** 2 + (ay2 - ay1) ** 2) + sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) / 2)), 6) AS proximity FROM k""".replace("a.user_id = b.user_id AND ", "")
)
def box_similarity(spark, d):
    e = X.table(spark, d, "events")
    at = lambda m, plus: (F.col("value") % m + plus).cast("double")
    box = F.struct(at(50, 0).alias("x1"), at(30, 0).alias("y1"), at(50, 5 + F.col("event_id") % 20).alias("x2"), at(30, 4 + F.col("event_id") % 10).alias("y2"))
    b = e.select("event_id", box.alias("a"))
    p = b.join(b.select((F.col("event_id") - 1).alias("event_id"), F.col("a").alias("b")), "event_id")
    return p.select("event_id", rounded(boxes.iou(F.col("a"), F.col("b")), 6).alias("iou"), rounded(boxes.proximity(F.col("a"), F.col("b")), 6).alias("proximity"))


@query("SELECT event_id, '[' || user_id || '] ' || round_even(value, 0)::BIGINT || '-' || round_even(value + 10, 0)::BIGINT || 's  ' || event_type || ': ' || props AS line FROM events")
def row_lines(spark, d):
    e = X.table(spark, d, "events")
    return e.select("event_id", T.row_line(F.col("user_id"), F.col("value"), F.col("value") + 10, F.concat_ws(": ", "event_type", "props")).alias("line"))


@query(
    """WITH a AS (SELECT lang, source, doc_id, unnest(['size', 'part ' || doc_id % 7]) AS k FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
v AS (SELECT lang AS sampler, 'q' || doc_id % 3 AS question, source AS field, k FROM a UNION ALL SELECT lang, 'q' || doc_id % 3, 'note.n', NULL FROM a)
SELECT sampler, question, field, coalesce(string_agg(DISTINCT k, ',' ORDER BY k), '') AS keys FROM v GROUP BY ALL"""
)
def vocabulary(spark, d):
    """Answers made of the documents: a field named by the source that lists an entry, and one with a dot in its name."""
    t = X.table(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    entry = F.create_map(F.lit("size"), F.col("n_chars").cast("string"), F.concat(F.lit("part "), F.col("doc_id") % 7), F.col("lang"))
    fields = F.to_json(F.create_map("source", F.array(entry)))
    structured = F.concat(F.expr("left(s, length(s) - 1)"), F.lit(',"note.n":"said"}'))
    a = t.withColumn("s", fields).select(F.col("lang").alias("sampler"), F.concat(F.lit("q"), F.col("doc_id") % 3).alias("question"), structured.alias("structured"))
    return selection.vocabulary(a).withColumn("keys", F.array_join("keys", ","))
