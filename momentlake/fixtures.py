"""Engine tables built from the general test tables, lazily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame an event: video_id is the user, media_ts counts seconds from the user's first event."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").withColumn("us", micros("ts"))
    return e.select(
        F.col("user_id").cast("string").alias("video_id"),
        (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("frame_index"),
        ((F.col("us") - F.min("us").over(w)) / 1e6).alias("media_ts"),
        F.col("us").alias("pts"),
        F.col("value").alias("score"),
        F.col("event_type").alias("sampler"),
        F.col("props").alias("structured"),
        "event_id",
    )


FRAMES = """frames AS (SELECT user_id::VARCHAR AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS media_ts, epoch_us(ts) AS pts, value AS score,
  event_type AS sampler, props AS structured, event_id FROM events)"""

#: Seconds of a chunk and of the pause between turns, in the units of the fixtures.
CHUNK_S, PAUSE, TURN_CHUNK = 86400.0, 10, 500.0


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn a message: it starts where the text so far and a pause per turn ends, and lasts as long as its text."""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("long"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + PAUSE * (F.row_number().over(w) - 1)
    c = c.withColumn("start", before.cast("double"))
    return c.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("position"), F.col("role").alias("speaker"), "start", (F.col("start") + F.col("n")).alias("end"), "text")


TURNS = f"""turns AS (SELECT conv_id::VARCHAR AS video_id, turn AS position, role AS speaker, start, start + n AS "end", text FROM (
  SELECT *, (coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + {PAUSE} * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1))::DOUBLE AS start
  FROM (SELECT *, length(text) AS n FROM conversations)))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every turn, ten units each from the turn's start."""
    t = turns(spark, sf_dir)
    w = t.select("video_id", "position", "speaker", "start", F.posexplode(F.split(F.trim("text"), " +")).alias("word_position", "text"))
    start = F.col("start") + 10.0 * F.col("word_position")
    return w.select("video_id", "position", F.col("word_position").cast("long").alias("word_position"), "text", start.alias("start"), (start + 8.0).alias("end"))


WORDS = """words AS (SELECT video_id, position, word_position, text, start + 10.0 * word_position AS start, start + 10.0 * word_position + 8.0 AS "end" FROM (
  SELECT video_id, position, start, unnest(p) AS text, unnest(range(len(p))) AS word_position FROM (
    SELECT *, string_split_regex(trim(text), ' +') AS p FROM turns)))"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit a document: four neighbouring ids of a source share a chunk; the vector is that of the same id, if there
    is one.  No window: a filter on sampler or video_id is one on the scan of documents."""
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "embeddings")
    return d.join(e, d.doc_id == e.vec_id, "left").select(
        F.col("source").alias("video_id"),
        F.floor(F.col("doc_id") / 4).cast("long").alias("chunk_id"),
        F.concat_ws(":", "lang", F.col("doc_id").cast("string")).alias("sampler_id"),
        F.col("lang").alias("sampler"),
        F.col("label").cast("string").alias("question"),
        F.lit("fixture:64").alias("embedder"),
        F.col("text").alias("content"),
        F.col("embedding").alias("vector"),
        "doc_id",
        "n_chars",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the units, without their vectors."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("video_id"), F.floor(F.col("doc_id") / 4).cast("long").alias("chunk_id"), F.concat_ws(":", "lang", F.col("doc_id").cast("string")).alias("sampler_id"), F.col("text").alias("content"))


UNITS = """units AS (SELECT source AS video_id, (doc_id // 4)::BIGINT AS chunk_id, lang || ':' || doc_id AS sampler_id, lang AS sampler, label::VARCHAR AS question,
  text AS content, embedding AS vector, doc_id, n_chars FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row with the query's vector."""
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as mentions: a hundred to a video and five to a chunk, those of a chunk being provably different."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 100).cast("string").alias("video_id"), F.floor(F.col("vec_id") % 100 / 5).cast("long").alias("chunk_id"), F.col("vec_id").alias("mention"), F.col("embedding").alias("vector"))


MENTIONS = "mentions AS (SELECT (vec_id // 100)::VARCHAR AS video_id, vec_id % 100 // 5 AS chunk_id, vec_id AS mention, embedding AS vector FROM embeddings)"
