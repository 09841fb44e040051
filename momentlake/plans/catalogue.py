"""All queries of the engine's own operators over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake import fixtures as X
from momentlake.functions import text as T
from momentlake.functions import vectors as V
from momentlake.functions.numbers import rounded
from momentlake.models import reduce_with, stub_reduce, stub_sentiment
from momentlake.operators import aggregates, answers, attributes, combine, grid, linking, sampling, search, segments, speech, text_index, units
from momentlake.session import ship

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _grid(frames: DataFrame) -> DataFrame:
    d = frames.groupBy("video_id").agg((F.max("media_ts") + 1).alias("duration_s"))
    return grid.uniform(d, X.CHUNK_S)


GRID = f"""durations AS (SELECT video_id, max(media_ts) + 1 AS duration_s FROM frames GROUP BY video_id),
counted AS (SELECT *, greatest(ceil(duration_s / {X.CHUNK_S}), 1)::BIGINT AS n0 FROM durations),
tailed AS (SELECT video_id, duration_s, CASE WHEN n0 > 1 AND duration_s - (n0 - 1) * {X.CHUNK_S} < 0.25 * {X.CHUNK_S} THEN n0 - 1 ELSE n0 END AS n FROM counted),
grid AS (SELECT video_id, chunk_id, (chunk_id * {X.CHUNK_S})::DOUBLE AS start_ts, CASE WHEN chunk_id = n - 1 THEN duration_s ELSE (chunk_id + 1) * {X.CHUNK_S} END AS end_ts
  FROM (SELECT *, unnest(range(n)) AS chunk_id FROM tailed))"""
FG = f"WITH {X.FRAMES}, {GRID}"
PLACED = f"""{FG}, placed AS (SELECT f.*, g.chunk_id FROM frames f JOIN (SELECT *, chunk_id = max(chunk_id) OVER (PARTITION BY video_id) AS last FROM grid) g
  ON f.video_id = g.video_id AND f.media_ts >= g.start_ts AND (f.media_ts < g.end_ts OR g.last AND f.media_ts = g.end_ts))"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    f = X.frames(spark, d)
    return grid.with_chunk(f, _grid(f), "media_ts", bucket_s=X.CHUNK_S)


# -- search

RANKED = f"""WITH {X.UNITS}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
scored AS (SELECT u.*, list_dot_product(vector::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))) AS similarity
  FROM units u, q WHERE vector IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, video_id, chunk_id, sampler_id) AS rank FROM scored)"""


@query(f"{RANKED} SELECT video_id, chunk_id, sampler_id, rank AS vector_rank, round(similarity, 5) AS similarity FROM ranked WHERE rank <= 40")
def vector_topk(spark, d):
    out = search.vector_rank(X.units(spark, d), X.query_vector(spark, d), search.UNIT, search.over_fetch(10))
    return out.withColumn("similarity", rounded("similarity", 5))


MOMENTS = """, placed AS (SELECT *, 1.0::DOUBLE / (10 + rank) AS s, row_number() OVER (PARTITION BY video_id, chunk_id ORDER BY rank) AS place FROM ranked WHERE rank <= 20)
SELECT video_id, chunk_id, max(s) FILTER (place = 1) + 0.5 * coalesce(max(s) FILTER (place = 2), 0) AS score, count(*) AS hits FROM placed
GROUP BY video_id, chunk_id ORDER BY score DESC, video_id, chunk_id LIMIT 5"""


@query(RANKED + MOMENTS)
def moments_dense(spark, d):
    return search.search(X.units(spark, d), X.query_vector(spark, d), search.SearchRequest(limit=5, candidates=20))


@query(
    f"""{RANKED}, placed AS (SELECT *, 1.0::DOUBLE / (10 + rank) AS s, row_number() OVER (PARTITION BY video_id, chunk_id ORDER BY rank) AS place FROM ranked WHERE rank <= 20),
best AS (SELECT video_id, chunk_id, max(s) FILTER (place = 1) + 0.5 * coalesce(max(s) FILTER (place = 2), 0) AS score FROM placed GROUP BY video_id, chunk_id ORDER BY score DESC, video_id, chunk_id LIMIT 5)
SELECT video_id, chunk_id, round(score, 6) AS score, place - 1 AS at, sampler_id, rank AS vector_rank, question, length(content) AS characters FROM placed JOIN best USING (video_id, chunk_id)"""
)
def moments_hits(spark, d):
    found = search.search(X.units(spark, d), X.query_vector(spark, d), search.SearchRequest(limit=5, candidates=20), details=True)
    hit = found.select("video_id", "chunk_id", rounded("score", 6).alias("score"), F.posexplode("found").alias("at", "hit"))
    return hit.select("video_id", "chunk_id", "score", F.col("at").cast("long").alias("at"), "hit.sampler_id", "hit.vector_rank", "hit.question", F.length("hit.content").cast("long").alias("characters"))


@query(RANKED.replace("WHERE vector IS NOT NULL", "WHERE vector IS NOT NULL AND sampler = 'en' AND question IN ('3')") + MOMENTS)
def moments_filtered(spark, d):
    return search.search(X.units(spark, d), X.query_vector(spark, d), search.SearchRequest(limit=5, candidates=20, sampler="en", question="3"))


@query(f"WITH {X.FRAMES} SELECT event_id, video_id, frame_index FROM frames WHERE structured->>'$.k' = '7'")
def filter_struct(spark, d):
    return X.frames(spark, d).filter(search.structured_matches(F.col("structured"), {"k": "7"})).select("event_id", "video_id", "frame_index")


@query(f"{FG} SELECT video_id, chunk_id FROM grid WHERE end_ts > 100000 AND start_ts < 300000")
def filter_time_window(spark, d):
    return grid.chunks_overlapping(_grid(X.frames(spark, d)), 100_000.0, 300_000.0).select("video_id", "chunk_id")


@query(f"{FG} SELECT DISTINCT chunk_id FROM (SELECT unnest(range(chunk_id - 1, chunk_id + 2)) AS chunk_id FROM grid WHERE end_ts > 100000 AND start_ts < 200000) WHERE chunk_id >= 0 AND chunk_id <= (SELECT max(chunk_id) FROM grid)")
def chunks_widened(spark, d):
    g = _grid(X.frames(spark, d))
    return grid.widened(grid.chunks_overlapping(g, 100_000.0, 200_000.0), g, 1)


TEXT = "ration the and that ononble"
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
DETAIL_STOPS = ", ".join(f"'{w}'" for w in T.DETAIL_STOP_WORDS)
POSTINGS = f"""{X.UNITS}, words AS (SELECT video_id, chunk_id, sampler_id, unnest(w) AS lexeme, unnest(range(len(w))) AS position FROM (
  SELECT *, list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN ({STOPS})) AS w FROM units)),
postings AS (SELECT video_id, chunk_id, sampler_id, lexeme, count(*) AS tf, min(position) AS first_position FROM words GROUP BY ALL)"""


@query(f"WITH {POSTINGS} SELECT video_id, chunk_id, sampler_id, lexeme, tf, first_position::INT AS first_position FROM postings")
def postings(spark, d):
    return search.postings(X.units(spark, d), search.UNIT)


QUERY_TEXT = "thonor ention then tion"
TEXT_RANKED = f"""{POSTINGS}, wanted AS (SELECT unnest(['thonor', 'ention', 'tion']) AS lexeme),
hits AS (SELECT video_id, chunk_id, sampler_id, count(*) AS matched, sum(tf)::BIGINT AS tf FROM postings JOIN wanted USING (lexeme) GROUP BY ALL HAVING count(*) >= 2),
by_text AS (SELECT *, row_number() OVER (ORDER BY tf DESC, video_id, chunk_id, sampler_id) AS text_rank FROM hits QUALIFY text_rank <= 40)"""


@query(f"WITH {TEXT_RANKED} SELECT video_id, chunk_id, sampler_id, matched, tf, text_rank FROM by_text")
def text_topk(spark, d):
    return search.text_rank(X.texts(spark, d), QUERY_TEXT, search.UNIT, 40)


INDEXED = 'thonor ention "tion the" -eaing'
INDEX_SQL = f"""WITH {X.UNITS}, w AS (SELECT video_id, chunk_id, sampler_id, list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN ({STOPS})) AS w FROM units),
c AS (SELECT *, len(list_filter(w, lambda x: x = 'thonor')) AS a, len(list_filter(w, lambda x: x = 'ention')) AS b, len(list_filter(w, lambda x: x = 'tion')) AS p, len(list_filter(w, lambda x: x = 'eaing')) AS n FROM w),
hits AS (SELECT video_id, chunk_id, sampler_id, ((a > 0)::INT + (b > 0)::INT + (p > 0)::INT + (n > 0)::INT)::BIGINT AS matched, (a + b + p)::BIGINT AS tf, n FROM c)
SELECT video_id, chunk_id, sampler_id, matched, tf, row_number() OVER (ORDER BY tf DESC, video_id, chunk_id, sampler_id) AS text_rank FROM hits
WHERE matched >= 2 AND (tf > 0 OR n = 0) QUALIFY text_rank <= 40"""


@query(INDEX_SQL)
def index_search(spark, d):
    """The best 40 units by a stored index, built of all texts.  The phrase's second word is a stop word, so it is one word."""
    index = text_index.build(X.texts(spark, d), search.UNIT, stemmed=False)
    return text_index.top(spark, index, INDEXED, 40)


@query()
def index_search_stems(spark, d):
    index = text_index.build(X.texts(spark, d), search.UNIT)
    return text_index.top(spark, index, "thonors entions tion", 40)


@query(
    f"""WITH {TEXT_RANKED}, {RANKED.removeprefix('WITH ').replace(X.UNITS + ', ', '')},
by_vector AS (SELECT video_id, chunk_id, sampler_id, rank AS vector_rank FROM ranked WHERE rank <= 40)
SELECT video_id, chunk_id, sampler_id, vector_rank, text_rank, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + text_rank), 0) AS score
FROM by_vector FULL JOIN by_text USING (video_id, chunk_id, sampler_id) ORDER BY score DESC, vector_rank NULLS LAST, video_id, chunk_id, sampler_id LIMIT 10"""
)
def hybrid_rrf(spark, d):
    return search.hybrid(X.units(spark, d), X.query_vector(spark, d), QUERY_TEXT, search.UNIT, 10, X.texts(spark, d))


def _observations(spark, d):
    e = X.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    f = X.frames(spark, d).withColumn("slot", F.col("event_id") % e.select(F.max("vec_id") + 1).scalar())  # every vector has its events
    content = F.concat_ws(" ", "sampler", "structured")
    return f.join(e, F.col("slot") == F.col("vec_id")).select("video_id", F.col("sampler").alias("sampler_id"), "frame_index", "media_ts", F.col("pts").alias("seen_at"), content.alias("content"), "vector", "structured")


SEEN = f"""WITH {X.FRAMES}, o AS (SELECT video_id, sampler AS sampler_id, frame_index, media_ts, structured, sampler || ' ' || structured AS content, embedding AS vector
  FROM frames JOIN embeddings ON event_id % (SELECT max(vec_id) + 1 FROM embeddings) = vec_id),
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
near AS (SELECT *, list_dot_product(vector::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))) AS similarity FROM o, q),
byv AS (SELECT video_id, frame_index, sampler_id, row_number() OVER (ORDER BY similarity DESC, video_id, frame_index, sampler_id) AS vector_rank FROM near WHERE media_ts >= 1000 AND media_ts < 200000 QUALIFY vector_rank <= 40)"""


@query(f"{SEEN} SELECT *, 1.0::DOUBLE / (60 + vector_rank) AS score FROM byv WHERE vector_rank <= 10")
def search_observations(spark, d):
    found = search.search_observations(_observations(spark, d), X.query_vector(spark, d), 10, after=1000.0, before=200_000.0)
    return found.select(*search.SEEN, "vector_rank", "score")


@query(
    f"""{SEEN}, w AS (SELECT *, list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)})) AS w FROM o WHERE media_ts >= 1000 AND media_ts < 200000),
h AS (SELECT video_id, frame_index, sampler_id, len(list_filter(w, lambda x: x IN ('purchase', 'k', '7'))) AS tf FROM w WHERE len(list_intersect(w, ['purchase', 'k', '7'])) >= 2),
byt AS (SELECT video_id, frame_index, sampler_id, row_number() OVER (ORDER BY tf DESC, video_id, frame_index, sampler_id) AS text_rank FROM h QUALIFY text_rank <= 40)
SELECT video_id, frame_index, sampler_id, vector_rank, text_rank, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + text_rank), 0) AS score
FROM byv FULL JOIN byt USING (video_id, frame_index, sampler_id) ORDER BY score DESC, vector_rank NULLS LAST, video_id, frame_index, sampler_id LIMIT 10"""
)
def search_observations_text(spark, d):
    found = search.search_observations(_observations(spark, d), X.query_vector(spark, d), 10, after=1000.0, before=200_000.0, text="purchase k 7")
    return found.select(*search.SEEN, "vector_rank", "text_rank", "score")


@query(
    f"""{RANKED}, h AS (SELECT *, row_number() OVER (PARTITION BY sampler ORDER BY rank, video_id, chunk_id, sampler_id) AS space_rank FROM ranked WHERE rank <= 40)
SELECT sampler, video_id, chunk_id, sampler_id, space_rank::INT AS space_rank, 1.0::DOUBLE / (60 + space_rank) AS score FROM h"""
)
def vector_spaces(spark, d):
    u = X.units(spark, d)
    hits = search.vector_rank(u, X.query_vector(spark, d), [*search.UNIT, "sampler"], 40).withColumnRenamed("vector_rank", "rank")
    return search.spaces(hits, "sampler").select("sampler", *search.UNIT, "space_rank", "score")


# -- grids and sampling


@query(f"{FG} SELECT * FROM grid")
def uniform_grid(spark, d):
    return _grid(X.frames(spark, d))


CUTS = "cuts AS (SELECT video_id, media_ts AS pos FROM frames WHERE score >= 150)"
SPANS = f"""WITH {X.FRAMES}, {CUTS}, durations AS (SELECT video_id, max(media_ts) + 1 AS duration_s FROM frames GROUP BY video_id),
edges AS (SELECT video_id, 0.0::DOUBLE AS pos FROM durations UNION SELECT video_id, duration_s FROM durations UNION SELECT c.video_id, pos FROM cuts c JOIN durations USING (video_id) WHERE pos > 0 AND pos < duration_s),
spans AS (SELECT video_id, row_number() OVER w - 1 AS position, pos AS start_ts, lead(pos) OVER w AS end_ts FROM edges WINDOW w AS (PARTITION BY video_id ORDER BY pos) QUALIFY end_ts IS NOT NULL)"""
MIN_S, MAX_S = 20_000.0, 90_000.0
GUARDED = f"""{SPANS}, i0 AS (SELECT *, sum(CASE WHEN end_ts - start_ts >= {MIN_S} OR position = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_ts ROWS UNBOUNDED PRECEDING) AS island FROM spans),
i1 AS (SELECT video_id, island, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM i0 GROUP BY ALL),
i2 AS (SELECT *, CASE WHEN island = 2 AND min(CASE WHEN island = 1 AND end_ts - start_ts < {MIN_S} THEN 1 END) OVER (PARTITION BY video_id) IS NOT NULL THEN 1 ELSE island END AS g FROM i1),
i3 AS (SELECT video_id, g, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM i2 GROUP BY ALL)"""
SPLIT = f"""{GUARDED}, n AS (SELECT *, greatest(ceil((end_ts - start_ts) / {MAX_S}), 1)::BIGINT AS n FROM i3),
parts AS (SELECT *, unnest(range(n)) AS part FROM n),
s AS (SELECT video_id, start_ts + part * ((end_ts - start_ts) / n) AS start_ts, CASE WHEN part = n - 1 THEN end_ts ELSE start_ts + (part + 1) * ((end_ts - start_ts) / n) END AS end_ts FROM parts),
t AS (SELECT *, row_number() OVER w AS pos, lead(start_ts) OVER w IS NULL AS last FROM s WINDOW w AS (PARTITION BY video_id ORDER BY start_ts)),
u AS (SELECT *, CASE WHEN last AND pos > 1 AND end_ts - start_ts < {MIN_S} THEN pos - 1 ELSE pos END AS g FROM t),
v AS (SELECT video_id, g, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM u GROUP BY ALL)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_ts) - 1 AS chunk_id, start_ts, end_ts FROM v"""


def _cuts(spark, d):
    f = X.frames(spark, d)
    return f.filter("score >= 150").select("video_id", F.col("media_ts").alias("at")), f.groupBy("video_id").agg((F.max("media_ts") + 1).alias("duration_s"))


@query(f"{SPANS} SELECT * FROM spans")
def grid_from_cuts(spark, d):
    return grid.spans_between(*_cuts(spark, d))


@query(f"{GUARDED} SELECT video_id, start_ts, end_ts FROM i3")
def grid_min_guard(spark, d):
    return grid.merge_short(grid.spans_between(*_cuts(spark, d)), MIN_S)


@query(SPLIT)
def grid_guards(spark, d):
    return grid.from_cuts(*_cuts(spark, d), min_s=MIN_S, max_s=MAX_S)


@query(f"{PLACED} SELECT event_id, video_id, frame_index, chunk_id FROM placed")
def chunk_assign(spark, d):
    return _placed(spark, d).select("event_id", "video_id", "frame_index", "chunk_id")


@query(f"{PLACED} SELECT video_id, chunk_id, count(*) AS frames, count(DISTINCT sampler) AS samplers FROM placed GROUP BY ALL")
def chunk_counts(spark, d):
    return _placed(spark, d).groupBy("video_id", "chunk_id").agg(F.count("*").alias("frames"), F.countDistinct("sampler").alias("samplers"))


@query(f"{FG} SELECT video_id, event_id, greatest(0, least(floor((media_ts - 50000) / {X.CHUNK_S})::BIGINT, (SELECT max(chunk_id) FROM grid g WHERE g.video_id = f.video_id))) AS chunk_id FROM frames f")
def chunk_nearest(spark, d):
    f = X.frames(spark, d)
    return grid.nearest_chunk(f.withColumn("at", F.col("media_ts") - 50_000), _grid(f), "at", X.CHUNK_S).select("video_id", "event_id", "chunk_id")


@query(
    f"""WITH {X.FRAMES}, b AS (SELECT *, trunc(media_ts * 0.0001)::BIGINT AS bucket FROM frames),
m AS (SELECT *, max(bucket) OVER (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b)
SELECT video_id, frame_index, media_ts FROM m WHERE seen IS NULL OR bucket > seen"""
)
def decimate(spark, d):
    return sampling.decimate(X.frames(spark, d), 0.0001).select("video_id", "frame_index", "media_ts")


CLOCK = f"""WITH {X.FRAMES}, raw AS (SELECT video_id, frame_index AS arrival, CASE WHEN frame_index % 40 >= 25 THEN media_ts - 150000 ELSE media_ts END AS raw FROM frames),
l AS (SELECT *, raw - lag(raw) OVER w AS delta, first(raw) OVER w AS origin FROM raw WINDOW w AS (PARTITION BY video_id ORDER BY arrival ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, sum(CASE WHEN delta < 0 THEN 0.0 - delta ELSE 0.0 END) OVER w AS shift, sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) OVER w AS rewinds FROM l WINDOW w AS (PARTITION BY video_id ORDER BY arrival ROWS UNBOUNDED PRECEDING))"""


def _raw(spark, d):
    f = X.frames(spark, d)
    return f.select("video_id", F.col("frame_index").alias("arrival"), F.when(F.col("frame_index") % 40 >= 25, F.col("media_ts") - 150_000).otherwise(F.col("media_ts")).alias("raw"))


@query(f"{CLOCK} SELECT video_id, arrival, round(raw - origin + shift, 3) AS media_ts, rewinds::BIGINT AS rewinds FROM s")
def media_clock(spark, d):
    return sampling.media_clock(_raw(spark, d), gap_s=7200.0).select("video_id", "arrival", rounded("media_ts", 3).alias("media_ts"), "rewinds")


@query(f"{CLOCK} SELECT video_id, arrival FROM s WHERE delta < 0 OR delta > 7200")
def gap_flags(spark, d):
    return sampling.media_clock(_raw(spark, d), gap_s=7200.0).filter("gap_before").select("video_id", "arrival")


@query(f"{PLACED} SELECT video_id, chunk_id, frame_index, i AS chunk_local_index FROM (SELECT *, row_number() OVER (PARTITION BY video_id, chunk_id ORDER BY frame_index) - 1 AS i FROM placed) WHERE i % 3 = 0 AND i < 15")
def uniform_sampler(spark, d):
    return sampling.every_nth(_placed(spark, d), 3, 5).select("video_id", "chunk_id", "frame_index", "chunk_local_index")


@query()
def greedy_sampler(spark, d):
    return sampling.sample(_placed(spark, d), lambda: [sampling.ScalarSampler(100.0, max_per_chunk=4, min_interval_s=600.0)], "score")


@query(
    f"""WITH {X.FRAMES} SELECT video_id, frame_index, list(frame_index) OVER b AS before, list(frame_index) OVER a AS after FROM frames
WINDOW b AS (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)""".replace(
        "list(frame_index) OVER b AS before, list(frame_index) OVER a AS after", "coalesce(array_to_string(list(frame_index) OVER b, ','), '') AS before, coalesce(array_to_string(list(frame_index) OVER a, ','), '') AS after"
    )
)
def context_frames(spark, d):
    c = sampling.context(X.frames(spark, d), 2, 2)
    text = lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ",").alias(x)
    return c.select("video_id", "frame_index", text("before"), text("after"))


@query(f"WITH {X.FRAMES} SELECT video_id, frame_index, abs(score - lag(score) OVER (PARTITION BY video_id ORDER BY frame_index)) AS change FROM frames WHERE frame_index % 2 = 0")
def scene_scores(spark, d):
    return sampling.scene_scores(X.frames(spark, d), 2).select("video_id", "frame_index", "change")


@query(f"WITH {X.FRAMES} SELECT video_id, media_ts AS at FROM frames WHERE score >= 150")
def scene_threshold(spark, d):
    return _cuts(spark, d)[0]


@query(
    f"""WITH {X.FRAMES}, t AS (SELECT video_id, media_ts AS pos, score, unnest([100.0, 200.0, 300.0, 400.0, 1000.0])::DOUBLE AS threshold FROM frames),
n AS (SELECT threshold, count(*) FILTER (score >= threshold) AS cuts, count(*) FILTER (score >= threshold)::DOUBLE / count(*) AS rate FROM t GROUP BY threshold),
g AS (SELECT threshold, pos - lag(pos) OVER (PARTITION BY threshold, video_id ORDER BY pos) AS gap FROM t WHERE score >= threshold),
r AS (SELECT threshold, gap, row_number() OVER (PARTITION BY threshold ORDER BY gap) AS i, count(*) OVER (PARTITION BY threshold) AS c FROM g WHERE gap IS NOT NULL)
SELECT n.*, r.gap AS median_gap FROM n LEFT JOIN r ON n.threshold = r.threshold AND r.i = r.c // 2 + 1"""
)
def threshold_sweep(spark, d):
    f = X.frames(spark, d).withColumnRenamed("media_ts", "at")
    return grid.threshold_sweep(f, [100, 200, 300, 400, 1000])


@query(
    f"""{PLACED}, s AS (SELECT *, row_number() OVER (PARTITION BY video_id, chunk_id ORDER BY frame_index) - 1 AS i FROM placed)
SELECT video_id, count(*) AS decimated, count(*) FILTER (i % 3 = 0) AS sampled, count(DISTINCT chunk_id) FILTER (i % 3 = 0) AS chunks_with_frames, count(DISTINCT frame_index) FILTER (i % 3 = 0) AS stored FROM s GROUP BY video_id"""
)
def manifest_stats(spark, d):
    p = _placed(spark, d)
    return sampling.manifest_stats(sampling.every_nth(p, 3), p)


@query(
    f"""WITH {X.FRAMES}, b AS (SELECT video_id, frame_index // 5 AS frame_index, score AS x1, score / 2 AS y1, score + (event_id % 7 + 1) AS x2, score / 2 + (event_id % 5 + 1) AS y2 FROM frames),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY (x2 - x1) * (y2 - y1) DESC, x1, y1) AS r FROM b QUALIFY r <= 2)
SELECT video_id, frame_index, x1, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY x1, y1, x2, y2) - 1 AS crop FROM r"""
)
def top_crops(spark, d):
    f = X.frames(spark, d)
    b = f.select("video_id", F.floor(F.col("frame_index") / 5).alias("frame_index"), F.col("score").alias("x1"), (F.col("score") / 2).alias("y1"), (F.col("score") + (F.col("event_id") % 7 + 1)).alias("x2"), (F.col("score") / 2 + (F.col("event_id") % 5 + 1)).alias("y2"))
    return sampling.top_crops(b, 2).select("video_id", "frame_index", "x1", "crop")


# -- speech

TG = f"""WITH {X.TURNS}, durations AS (SELECT video_id, max("end") AS duration_s FROM turns GROUP BY video_id),
counted AS (SELECT *, greatest(ceil(duration_s / {X.TURN_CHUNK}), 1)::BIGINT AS n0 FROM durations),
tailed AS (SELECT video_id, duration_s, CASE WHEN n0 > 1 AND duration_s - (n0 - 1) * {X.TURN_CHUNK} < 0.25 * {X.TURN_CHUNK} THEN n0 - 1 ELSE n0 END AS n FROM counted),
grid AS (SELECT video_id, chunk_id, (chunk_id * {X.TURN_CHUNK})::DOUBLE AS start_ts, CASE WHEN chunk_id = n - 1 THEN duration_s ELSE (chunk_id + 1) * {X.TURN_CHUNK} END AS end_ts FROM (SELECT *, unnest(range(n)) AS chunk_id FROM tailed)),
{X.WORDS},
cut AS (SELECT w.*, g.chunk_id FROM words w JOIN (SELECT *, chunk_id = max(chunk_id) OVER (PARTITION BY video_id) AS last FROM grid) g
  ON w.video_id = g.video_id AND (w.start + w."end") / 2 >= g.start_ts AND ((w.start + w."end") / 2 < g.end_ts OR g.last AND (w.start + w."end") / 2 = g.end_ts)),
said AS (SELECT video_id, chunk_id, trim(string_agg(text, ' ' ORDER BY start, position, word_position)) AS text, count(*) AS word_count FROM cut GROUP BY ALL),
spoken AS (SELECT g.*, coalesce(s.text, '') AS text, coalesce(word_count, 0) AS word_count FROM grid g LEFT JOIN said s USING (video_id, chunk_id))"""


def _turn_grid(turns: DataFrame) -> DataFrame:
    return grid.uniform(turns.groupBy("video_id").agg(F.max("end").alias("duration_s")), X.TURN_CHUNK)


@query(f'WITH {X.TURNS}, l AS (SELECT *, lag("end") OVER (PARTITION BY video_id ORDER BY start, "end") AS e FROM turns) SELECT video_id, (e + start) / 2 AS at, start - e AS score FROM l WHERE start - e >= 10')
def vad_cuts(spark, d):
    return speech.silence_cuts(X.turns(spark, d), 10.0)


@query(
    f"""WITH {X.TURNS}, l AS (SELECT *, lag(speaker) OVER w AS p, lag("end") OVER w AS e, row_number() OVER w AS i FROM turns WINDOW w AS (PARTITION BY video_id ORDER BY start, position))
SELECT video_id, CASE WHEN start - e > 0 THEN (e + start) / 2 ELSE start END AS at, greatest(start - e, 0.0) AS score FROM l WHERE i > 1 AND speaker IS DISTINCT FROM p"""
)
def speaker_cuts(spark, d):
    return speech.speaker_cuts(X.turns(spark, d))


WORD_SPEAKER = f"""{TG}, j AS (SELECT w.*, t.speaker, t.position AS turn FROM words w LEFT JOIN turns t ON w.video_id = t.video_id AND (w.start + w."end") / 2 BETWEEN t.start AND t."end"),
ws AS (SELECT video_id, position, word_position, first(text) AS text, first(start) AS start, first("end") AS "end", arg_min(speaker, turn) AS speaker FROM j GROUP BY video_id, position, word_position)"""


@query(f"{WORD_SPEAKER} SELECT * FROM ws")
def word_speaker(spark, d):
    return speech.word_speakers(X.words(spark, d), X.turns(spark, d), X.TURN_CHUNK)


@query(
    f"""{WORD_SPEAKER}, h AS (SELECT video_id, position, speaker, sum("end" - start) AS held, min(word_position) AS f FROM ws WHERE speaker IS NOT NULL GROUP BY ALL)
SELECT video_id, position, speaker, held FROM h QUALIFY row_number() OVER (PARTITION BY video_id, position ORDER BY held DESC, f) = 1"""
)
def segment_speaker(spark, d):
    return speech.segment_speakers(speech.word_speakers(X.words(spark, d), X.turns(spark, d), X.TURN_CHUNK), ["video_id", "position"])


@query(
    f"""WITH {X.TURNS}, l AS (SELECT *, row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w AS new FROM turns WINDOW w AS (PARTITION BY video_id ORDER BY position)),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY video_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT video_id, (island - 1)::BIGINT AS turn, first(speaker) AS speaker, min(start) AS start, arg_max("end", position) AS "end", trim(string_agg(text, '' ORDER BY position)) AS text FROM i GROUP BY video_id, island"""
)
def speaker_turns(spark, d):
    return speech.islands(X.turns(spark, d), ["video_id"], ["position"])


@query(f"{TG} SELECT * FROM spoken")
def cut_words(spark, d):
    t = X.turns(spark, d)
    return speech.transcript_chunks(X.words(spark, d), _turn_grid(t), X.TURN_CHUNK)


@query(
    f"""{TG}, a AS (SELECT video_id, count(*) AS chunks, count(*) FILTER (word_count > 0) AS chunks_with_speech, sum(word_count)::BIGINT AS words FROM spoken GROUP BY video_id),
b AS (SELECT video_id, count(*) AS words_in_transcript FROM words GROUP BY video_id)
SELECT a.*, coalesce(words_in_transcript, 0) AS words_in_transcript, coalesce(words_in_transcript, 0) - words AS words_outside_grid FROM a LEFT JOIN b USING (video_id)"""
)
def transcript_stats(spark, d):
    t = X.turns(spark, d)
    return speech.transcript_stats(X.words(spark, d), _turn_grid(t))


@query(f"WITH {X.TURNS}, l AS (SELECT *, lag(speaker) OVER (PARTITION BY video_id ORDER BY position) AS b FROM turns WHERE speaker IS NOT NULL) SELECT video_id, count(*) FILTER (b IS NOT NULL AND b <> speaker) AS handovers, count(*) AS turns FROM l GROUP BY video_id")
def handovers(spark, d):
    return aggregates.handovers(X.turns(spark, d))


@query(
    f"""WITH {X.TURNS}, s AS (SELECT video_id, speaker, count(*) AS turns, sum("end" - start) AS seconds, min(position) AS f FROM turns WHERE speaker IS NOT NULL GROUP BY ALL)
SELECT video_id, speaker, turns, seconds, CASE WHEN sum(seconds) OVER (PARTITION BY video_id) > 0 THEN seconds / sum(seconds) OVER (PARTITION BY video_id) END AS share,
row_number() OVER (PARTITION BY video_id ORDER BY seconds DESC, f) = 1 AS dominant FROM s"""
)
def speaker_share(spark, d):
    return aggregates.speaker_shares(X.turns(spark, d))


# -- whole recordings


@query(
    f"""{FG}, l AS (SELECT *, end_ts - start_ts AS len FROM grid), r AS (SELECT video_id, len, row_number() OVER (PARTITION BY video_id ORDER BY len) AS i, count(*) OVER (PARTITION BY video_id) AS n FROM l),
g AS (SELECT video_id, max(end_ts) AS duration_s, count(*) AS chunks, min(len) AS chunk_min, max(len) AS chunk_max FROM l GROUP BY video_id),
f AS (SELECT video_id, count(*) AS frames_sampled, count(DISTINCT sampler) AS samplers FROM frames GROUP BY video_id)
SELECT g.*, r.len AS chunk_median, frames_sampled, samplers FROM g JOIN r ON g.video_id = r.video_id AND r.i = r.n // 2 + 1 LEFT JOIN f ON g.video_id = f.video_id"""
)
def video_stats(spark, d):
    f = X.frames(spark, d)
    return aggregates.video_stats(_grid(f), f)


@query(
    f"""{TG}, ans AS (SELECT DISTINCT video_id, start::BIGINT // 500 AS chunk_id, speaker AS sampler FROM turns WHERE speaker = 'assistant'),
a AS (SELECT video_id, chunk_id, string_agg(sampler, ',' ORDER BY sampler) AS sources FROM ans GROUP BY ALL), s AS (SELECT video_id, chunk_id FROM spoken WHERE word_count > 0)
SELECT g.video_id, g.chunk_id, CASE WHEN a.sources IS NOT NULL AND s.chunk_id IS NOT NULL THEN 'both' WHEN a.sources IS NOT NULL THEN 'picture_only' WHEN s.chunk_id IS NOT NULL THEN 'sound_only' ELSE 'neither' END AS coverage,
coalesce(a.sources, '') AS sources FROM grid g LEFT JOIN a USING (video_id, chunk_id) LEFT JOIN s ON s.video_id = g.video_id AND s.chunk_id = g.chunk_id"""
)
def coverage(spark, d):
    t = X.turns(spark, d)
    g = _turn_grid(t)
    answered = t.filter("speaker = 'assistant'").select("video_id", F.floor(F.col("start") / X.TURN_CHUNK).cast("long").alias("chunk_id"), F.col("speaker").alias("sampler"))
    return aggregates.coverage(g, answered, speech.transcript_chunks(X.words(spark, d), g, X.TURN_CHUNK))


@query(
    f"""{PLACED}, g AS (SELECT video_id, chunk_id, string_agg(sampler, ' ' ORDER BY frame_index) AS description FROM placed GROUP BY ALL),
f AS (SELECT video_id, chunk_id, sampler, min(frame_index) AS fi FROM placed GROUP BY ALL),
h AS (SELECT video_id, chunk_id, string_agg(sampler, ',' ORDER BY fi) AS seen, CASE WHEN count(*) = 1 THEN first(sampler) END AS agreed FROM f GROUP BY ALL)
SELECT * FROM g JOIN h USING (video_id, chunk_id)"""
)
def merge_lists(spark, d):
    return aggregates.merged_answers(_placed(spark, d), ["video_id", "chunk_id"], ["frame_index"], "sampler")


@query(f"WITH {X.FRAMES} SELECT video_id, array_to_string(list_sort(list(DISTINCT sampler)), ',') AS samplers FROM frames GROUP BY video_id")
def distinct_samplers(spark, d):
    return X.frames(spark, d).groupBy("video_id").agg(F.array_join(F.sort_array(F.collect_set("sampler")), ",").alias("samplers"))


@query(
    f"""WITH {X.FRAMES}, r AS (SELECT sampler, score, row_number() OVER (PARTITION BY sampler ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY sampler) AS n FROM frames)
SELECT sampler, median(score) AS p50, max(score) FILTER (i = least(n - 1, floor(n * 0.95)::BIGINT)) AS p95, max(score) AS max_lag FROM r GROUP BY sampler"""
)
def lag_figures(spark, d):
    return aggregates.lag_figures(X.frames(spark, d), ["sampler"], "score")


SIGNED = "s AS (SELECT conv_id::VARCHAR AS video_id, turn AS position, length(text) AS weight, (length(text) % 7 - 3) / 3.0::DOUBLE AS signed FROM conversations)"


def _signed(spark, d):
    t = X.turns(spark, d)
    return t.select("video_id", "position", F.length("text").alias("weight"), stub_sentiment(F.col("text")).alias("signed"))


@query(f"WITH {SIGNED} SELECT video_id, round(sum(signed * weight) / sum(weight), 9) AS mean, sum(weight)::BIGINT AS weight FROM s GROUP BY video_id")
def sentiment_mean(spark, d):
    return aggregates.weighted_mean(_signed(spark, d), ["video_id"], "signed", "weight").withColumn("mean", rounded("mean", 9))


@query(f"WITH {SIGNED}, l AS (SELECT *, lag(signed) OVER (PARTITION BY video_id ORDER BY position) AS b FROM s) SELECT video_id, position FROM l WHERE b IS NOT NULL AND (b < 0) <> (signed < 0)")
def turning_points(spark, d):
    return aggregates.turning_points(_signed(spark, d), ["video_id"], "position", "signed").select("video_id", "position")


@query(f"WITH {X.TURNS} SELECT video_id, w AS window, count(*) AS rows, min(start) AS start_ts FROM (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY position) - 1) // 3 AS w FROM turns) GROUP BY ALL")
def event_windows(spark, d):
    return aggregates.windows_of(X.turns(spark, d), "video_id", "position", 3).groupBy("video_id", "window").agg(F.count("*").alias("rows"), F.min("start").alias("start_ts"))


@query()
def stub_summary(spark, d):
    t = X.table(spark, d, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").alias("position"), "text")
    last = None
    for _, last in aggregates.fold(t, "video_id", "position", "text", reduce_with(stub_reduce)):
        pass
    return last


# -- entities

PAIRS = f"""WITH {X.MENTIONS}, pairs AS (SELECT a.video_id, a.mention AS i, b.mention AS j, a.chunk_id AS chunk_id_i, b.chunk_id AS chunk_id_j, a.chunk_id = b.chunk_id AS different,
list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[]) / (sqrt(list_dot_product(a.vector::DOUBLE[], a.vector::DOUBLE[])) * sqrt(list_dot_product(b.vector::DOUBLE[], b.vector::DOUBLE[]))) AS similarity
FROM mentions a JOIN mentions b ON a.video_id = b.video_id AND a.mention < b.mention), bars AS (SELECT video_id, quantile_cont(similarity, 0.95) AS bar, count(*) AS calibration_pairs FROM pairs WHERE different GROUP BY video_id)"""


def _pairs(spark, d):
    return linking.pairs(X.mentions(spark, d), ["video_id"], ["chunk_id"])


@query(f"{PAIRS} SELECT video_id, i, j, different, round(similarity, 5) AS similarity FROM pairs")
def pair_scores(spark, d):
    return _pairs(spark, d).select("video_id", "i", "j", "different", rounded("similarity", 5).alias("similarity"))


@query(f"{PAIRS} SELECT video_id, round(bar, 5) AS bar, calibration_pairs FROM bars")
def calibrated_threshold(spark, d):
    return linking.threshold(_pairs(spark, d), ["video_id"], 0.95).withColumn("bar", rounded("bar", 5))


@query(
    f"""{PAIRS}, w AS (SELECT video_id, avg(similarity) AS m, stddev_pop(similarity) AS s FROM pairs WHERE different GROUP BY video_id)
SELECT video_id, i, j, round((similarity - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 4) + 0.0 AS z FROM pairs JOIN w USING (video_id)"""
)
def standardised_scores(spark, d):
    return linking.standardised(_pairs(spark, d), ["video_id"]).select("video_id", "i", "j", (rounded("z", 4) + F.lit(0.0)).alias("z"))


@query(
    f"""{PAIRS}, o AS (SELECT p.* FROM pairs p JOIN bars USING (video_id) WHERE NOT different AND similarity > bar)
SELECT video_id, i, j FROM o QUALIFY row_number() OVER (PARTITION BY video_id, i, chunk_id_j ORDER BY similarity DESC, j) = 1 AND row_number() OVER (PARTITION BY video_id, j, chunk_id_i ORDER BY similarity DESC, i) = 1"""
)
def mutual_best(spark, d):
    return linking.mutual_links(X.mentions(spark, d), ["video_id"], ["chunk_id"], 0.95).select("video_id", "i", "j")


@query()
def linker_groups(spark, d):
    return linking.link(X.mentions(spark, d), quantile=0.95)


TOGETHER = "m AS (SELECT DISTINCT user_id::VARCHAR AS video_id, value::BIGINT // 50 AS chunk_id, event_type AS g FROM events)"


@query(
    f"""WITH {TOGETHER}, p AS (SELECT a.video_id, a.g AS a, b.g AS b, count(*) AS shared, string_agg(a.chunk_id::VARCHAR, ',' ORDER BY a.chunk_id) AS chunk_ids FROM m a JOIN m b ON a.video_id = b.video_id AND a.chunk_id = b.chunk_id AND a.g < b.g GROUP BY ALL)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY shared DESC, a, b) <= 50""".replace("value::BIGINT // 50", "floor(value / 50)::BIGINT")
)
def together(spark, d):
    e = X.table(spark, d, "events")
    m = e.select(F.col("user_id").cast("string").alias("video_id"), F.floor(F.col("value") / 50).alias("chunk_id"), F.col("event_type").alias("group"))
    return aggregates.together(m).withColumn("chunk_ids", F.array_join(F.transform("chunk_ids", lambda c: c.cast("long").cast("string")), ","))


@query(
    f"""{PLACED}, l AS (SELECT DISTINCT video_id, sampler AS grp, chunk_id FROM placed),
n AS (SELECT video_id, sampler AS grp, first(structured ORDER BY length(structured) DESC, chunk_id, structured) AS label FROM placed GROUP BY ALL),
g AS (SELECT video_id, grp, count(*) AS appearances, min(start_ts) AS start_ts, max(end_ts) AS end_ts, round(sum(end_ts - start_ts), 3) AS observed_s, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id) AS chunk_ids FROM l JOIN grid USING (video_id, chunk_id) GROUP BY video_id, grp)
SELECT video_id, grp AS "group", label, appearances, chunk_ids, start_ts, end_ts, observed_s, 'e' || lpad((row_number() OVER (PARTITION BY video_id ORDER BY appearances DESC, start_ts, grp) - 1)::VARCHAR, 3, '0') AS entity_id FROM g JOIN n USING (video_id, grp)"""
)
def entity_summary(spark, d):
    f = X.frames(spark, d)
    g = _grid(f)
    m = grid.with_chunk(f, g, "media_ts", bucket_s=X.CHUNK_S).select("video_id", "chunk_id", F.col("sampler").alias("group"), F.col("structured").alias("signature"))
    out = aggregates.entity_summary(m, g).withColumn("observed_s", rounded("observed_s", 3))
    return out.withColumn("chunk_ids", F.array_join(F.transform("chunk_ids", lambda c: c.cast("string")), ","))


# -- segments

SEQ = """seq AS (SELECT (vec_id % 4)::VARCHAR AS video_id, vec_id // 4 AS position, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT video_id, position, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u FROM seq),
w AS (SELECT *, lag(u) OVER o AS p, lead(u) OVER o AS f1, lead(u, 2) OVER o AS f2 FROM n WINDOW o AS (PARTITION BY video_id ORDER BY position)),
m AS (SELECT video_id, position, CASE WHEN p IS NULL THEN u ELSE list_transform(list_zip(p, u), lambda z: (z[1] + z[2]) / 2) END AS l, CASE WHEN f2 IS NULL THEN f1 ELSE list_transform(list_zip(f1, f2), lambda z: (z[1] + z[2]) / 2) END AS r FROM w WHERE f1 IS NOT NULL),
gaps AS (SELECT video_id, position, list_dot_product(l, r) / (sqrt(list_dot_product(l, l)) * sqrt(list_dot_product(r, r))) AS similarity FROM m)"""


def _sequence(spark, d):
    return X.table(spark, d, "embeddings").select((F.col("vec_id") % 4).cast("string").alias("video_id"), F.floor(F.col("vec_id") / 4).cast("long").alias("position"), F.col("embedding").alias("vector"), F.lit(10.0).alias("seconds"))


@query(f"WITH {SEQ} SELECT video_id, position, round(similarity, 5) AS similarity FROM gaps")
def gap_similarity(spark, d):
    return segments.gap_similarity(_sequence(spark, d)).withColumn("similarity", rounded("similarity", 5))


DEEP = f"""WITH {X.FRAMES}, a AS (SELECT *, lag(score) OVER (PARTITION BY video_id ORDER BY frame_index) AS p FROM frames),
b AS (SELECT *, sum(CASE WHEN score > p THEN 1 ELSE 0 END) OVER w AS up, sum(CASE WHEN score < p THEN 1 ELSE 0 END) OVER w AS down FROM a WINDOW w AS (PARTITION BY video_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, first(score) OVER (PARTITION BY video_id, up ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS l, last(score) OVER (PARTITION BY video_id, down ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM b),
deep AS (SELECT video_id, frame_index, score, (l - score) + (r - score) AS depth FROM c)"""


@query(f"{DEEP} SELECT video_id, frame_index, score, round(depth, 6) AS depth FROM deep")
def valley_depths(spark, d):
    return segments.depths(X.frames(spark, d), order="frame_index", value="score").withColumn("depth", rounded("depth", 6))


@query(
    f"""{DEEP}, k AS (SELECT *, coalesce(lag(score) OVER o, score) >= score AND coalesce(lead(score) OVER o, score) >= score AS local FROM deep WINDOW o AS (PARTITION BY video_id ORDER BY frame_index)),
valleys AS (SELECT *, avg(depth) OVER p - stddev_pop(depth) OVER p / 2 AS bar FROM k WHERE local AND depth > 0 WINDOW p AS (PARTITION BY video_id)) SELECT video_id, frame_index FROM valleys WHERE depth >= bar"""
)
def segment_boundaries(spark, d):
    return segments.boundaries(segments.depths(X.frames(spark, d), order="frame_index", value="score"), order="frame_index", value="score").select("video_id", "frame_index")


@query()
def segments_merged(spark, d):
    return segments.segment(_sequence(spark, d), shortest=60.0, most=12)


# -- combinations, units, text

OFFSETS = f"""{TG}, g AS (SELECT video_id, count(*) AS chunk_count, max(end_ts) AS duration_s FROM grid GROUP BY video_id),
members AS (SELECT 'all' AS source_id, video_id, coalesce(sum(chunk_count) OVER w, 0)::BIGINT AS first_chunk, chunk_count, coalesce(sum(duration_s) OVER w, 0.0) AS offset_s, duration_s FROM g WINDOW w AS (ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _members(spark, d):
    g = _turn_grid(X.turns(spark, d))
    return g, combine.offsets(g, "all")


@query(f"{OFFSETS} SELECT * FROM members")
def combine_offsets(spark, d):
    return _members(spark, d)[1]


@query(f"{OFFSETS} SELECT 'all' AS video_id, first_chunk + chunk_id AS chunk_id, video_id AS member, chunk_id AS member_chunk_id, round(start_ts, 3) AS member_start_ts, round(end_ts, 3) AS member_end_ts FROM grid JOIN members USING (video_id)")
def combine_origin(spark, d):
    g, m = _members(spark, d)
    return combine.origin(combine.combined_grid(g, m), m)


#: An earlier state of the store: without French documents, and with other texts of the German ones.
OLD = "old AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || '!' ELSE text END AS content FROM documents WHERE lang <> 'fr')"


def _docs(spark, d):
    return X.table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("content"))


def _old(spark, d):
    return _docs(spark, d).filter("lang <> 'fr'").withColumn("content", F.when(F.col("lang") == "de", F.concat("content", F.lit("!"))).otherwise(F.col("content")))


@query(f"WITH {OLD} SELECT d.doc_id, substr(sha256(d.text), 1, 16) AS text_hash, coalesce(sha256(d.text) = sha256(o.content), false) AS reused FROM documents d LEFT JOIN old o USING (doc_id)")
def carry_over(spark, d):
    previous = units.with_hash(_old(spark, d)).withColumn("vector", F.array(F.lit(1.0)))
    return units.carry_over(units.with_hash(_docs(spark, d)), previous, ["doc_id"]).select("doc_id", "text_hash", "reused")


@query(f"WITH {OLD} SELECT doc_id, length(content)::INT AS n FROM old WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang IN ('fr', 'de')) UNION ALL SELECT doc_id, length(text)::INT FROM documents WHERE lang IN ('fr', 'de')")
def upsert_merge(spark, d):
    return units.upsert(_old(spark, d), _docs(spark, d).filter("lang IN ('fr', 'de')"), ["doc_id"]).select("doc_id", F.length("content").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 7)")
def stale_rows(spark, d):
    current = X.table(spark, d, "embeddings").filter("label < 7").select(F.col("vec_id").alias("doc_id"))
    return units.stale(_docs(spark, d), current, ["doc_id"]).select("doc_id")


@query("SELECT doc_id, CASE WHEN s = '' THEN 'all' ELSE s END AS slug FROM (SELECT doc_id, substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48) AS s FROM documents)")
def slugs(spark, d):
    return _docs(spark, d).select("doc_id", T.slug(F.col("content")).alias("slug"))


@query("SELECT event_id, 'event ' || event_type || '. k: ' || (props->>'$.k') || '. user: ' || user_id AS content FROM events")
def rendered_units(spark, d):
    e = X.table(spark, d, "events")
    fields = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("none"), F.lit(" "))
    return e.select("event_id", T.render(F.concat(F.lit("event "), F.col("event_type")), fields).alias("content"))


@query(
    """WITH t AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS tok FROM benchmark),
c AS (SELECT item_id, (('0x' || substr(sha256(tok), 1, 8))::BIGINT % 16) AS slot, count(*) AS n FROM t GROUP BY ALL)
SELECT item_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS weight FROM c"""
)
def hash_embedding(spark, d):
    v = V.hash_embed(X.table(spark, d, "benchmark"), ["item_id"], "text", 16)
    return v.select("item_id", F.posexplode("vector").alias("slot", "weight")).filter("weight > 0").select("item_id", F.col("slot").cast("long").alias("slot"), rounded("weight", 6).alias("weight"))


@query(f"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x NOT IN ({DETAIL_STOPS}))))::INT AS n_words FROM documents")
def word_sets(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.words(F.col("content"))).alias("n_words"))


@query()
def sentence_pieces(spark, d):
    return T.pieces(_docs(spark, d), ["doc_id"], "content", 400)


# -- answers

BANDS = "CASE WHEN value < 50 THEN 'low' WHEN value < 150 THEN 'mid' WHEN value < 250 THEN 'unclear' ELSE 'high' END"


@query(
    f"""WITH m AS (SELECT user_id::VARCHAR AS video_id, event_id AS mention, floor(value / 50)::BIGINT AS chunk, event_type AS kind, {BANDS} AS band FROM events),
p AS (SELECT a.video_id, a.mention AS i, b.mention AS j, a.chunk = b.chunk AS different,
  CASE WHEN a.kind = b.kind THEN 0 WHEN least(a.kind, b.kind) = 'click' AND greatest(a.kind, b.kind) = 'view' THEN 0.5 ELSE 1 END
  + 2 * CASE WHEN a.band = 'unclear' OR b.band = 'unclear' OR a.band = b.band THEN 0 ELSE 1 END AS cost,
  (a.kind = b.kind)::INT + (a.band = b.band AND a.band <> a.kind)::INT AS in_common
  FROM m a JOIN m b ON a.video_id = b.video_id AND a.mention < b.mention)
SELECT video_id, i, j, different, (0.25 * in_common - cost)::DOUBLE AS similarity FROM p"""
)
def attribute_scores(spark, d):
    e = X.table(spark, d, "events")
    m = e.select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("mention"), F.floor(F.col("value") / 50).alias("chunk"), F.col("event_type").alias("kind"), F.expr(BANDS).alias("band"))
    m = m.withColumn("tags", F.array("kind", "band"))
    return attributes.attribute_similarity(m, ["video_id"], "chunk", {"kind": 1.0, "band": 2.0}, {"tags": 0.25}, [("view", "click")])


@query(
    f"""{PLACED}, q AS (SELECT DISTINCT sampler, unnest([sampler, 'people']) AS question FROM frames),
c AS (SELECT video_id, chunk_id, p.sampler, question, CASE WHEN p.sampler = question THEN question ELSE p.sampler || ':' || question END AS sampler_id, count(DISTINCT frame_index)::INT AS frame_count, min(frame_index) AS first_frame
  FROM placed p JOIN q ON p.sampler = q.sampler GROUP BY ALL)
SELECT video_id, chunk_id, sampler_id, frame_count, first_frame FROM c WHERE NOT (question = 'people' AND chunk_id % 2 = 0)"""
)
def describe_plan(spark, d):
    placed = _placed(spark, d)
    configs = placed.select("sampler").distinct().withColumn("questions", F.array("sampler", F.lit("people")))
    planned = answers.calls(placed, answers.questions_of_configs(configs))
    done = planned.filter("question = 'people' AND chunk_id % 2 = 0")
    return answers.due(planned, done).select(*answers.CALL, "frame_count", F.col("frame_indexes")[0].alias("first_frame"))


def _capitalised(texts: list[str]) -> list[list[tuple[str, str]]]:
    """A deterministic recogniser: capitalised words, labelled by their length."""
    return [[(w, "long" if len(w) > 6 else "short") for w in re.findall(r"[A-Z][a-z]+", t)] for t in texts]


@query(
    """WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS "text" FROM conversations),
g AS (SELECT conv_id, "text", CASE WHEN length("text") > 6 THEN 'long' ELSE 'short' END AS label, count(*) AS mentions, count(DISTINCT turn)::INT AS chunks FROM w GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY mentions DESC, lower("text"), "text", label) AS rank FROM g"""
)
def ner_mentions(spark, d):
    found = answers.ner(X.table(spark, d, "conversations"), "conv_id", "turn", "text", _capitalised)
    return found.select("conv_id", "text", "label", "mentions", F.size("chunk_ids").alias("chunks"), F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, 'event-' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS item_id FROM events")
def item_numbers(spark, d):
    return answers.item_ids(X.table(spark, d, "events"), ["user_id"], "events", ["ts", "event_id"]).select("event_id", "item_id")


@query("SELECT doc_id, 'de' || '/' || source || '/' || lang AS leaves FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def json_leaves(spark, d):
    doc = F.to_json(F.struct(F.struct(F.lit("de").alias("x"), F.lit(3).alias("n")).alias("a"), F.array(F.array("source")).alias("b"), F.col("lang").alias("c")))
    rows = X.table(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    return rows.select("doc_id", F.array_join(answers.string_leaves(doc), "/").alias("leaves"))


@query("SELECT event_id, props->>'$.k' AS k FROM events")
def fenced_replies(spark, d):
    fence = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone {}."))).otherwise(F.concat(F.lit("It is "), "props", F.lit(".")))
    return X.table(spark, d, "events").select("event_id", F.get_json_object(answers.fenced(fence), "$.k").alias("k"))


# -- general relational coverage over the star schema


@query("SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def revenue_by_segment(spark, d):
    o, c = X.table(spark, d, "orders"), X.table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("orders"), rounded(F.sum("o_totalprice"), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def customers_without_large_orders(spark, d):
    c, o = X.table(spark, d, "customer"), X.table(spark, d, "orders").filter("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark, d):
    return X.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("sum_qty"), rounded(F.avg("l_discount"), 6).alias("avg_disc"))


# more queries register themselves in the same tables
from momentlake.plans import catalogue_documents  # noqa: E402, F401
