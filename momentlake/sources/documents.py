"""Typed JSON documents and append-only logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.errors import MissingArtifact, UnknownOption
from momentlake.schemas import DOCUMENTS, OBSERVATION


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Documents of one kind from a path or pattern; rows of another tag are refused when they are read."""
    if kind not in DOCUMENTS:
        raise UnknownOption("document", kind, DOCUMENTS)
    if not exists(spark, path):
        raise MissingArtifact(f"no {kind} at {path}")
    df = spark.read.schema(DOCUMENTS[kind]).option("multiLine", True).json(path)
    right = F.coalesce(F.col("document") == kind, F.lit(False))
    return df.withColumn("document", F.when(right, F.col("document")).otherwise(F.raise_error(F.concat(F.lit(f"not a {kind}: "), F.coalesce("document", F.lit("null"))))))


def maybe(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """As read, but nothing there gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], DOCUMENTS[kind])
    return read(spark, path, kind)


def timeline_chunks(timelines: DataFrame) -> DataFrame:
    return timelines.select("video_id", "fingerprint", F.explode("chunks").alias("c")).select("video_id", "fingerprint", F.col("c.chunk_id").cast("long").alias("chunk_id"), "c.start_ts", "c.end_ts")


def manifest_frames(manifests: DataFrame) -> DataFrame:
    m = manifests.select("video_id", F.explode("chunks").alias("c")).select("video_id", F.col("c.chunk_id").cast("long").alias("chunk_id"), F.explode("c.samplers").alias("sampler_id", "b"))
    return m.select("video_id", "chunk_id", "sampler_id", F.explode("b.frames").alias("f")).select("video_id", "chunk_id", "sampler_id", F.col("f.index").alias("frame_index"), "f.media_ts", "f.chunk_local_index", "f.score")


def description_rows(descriptions: DataFrame) -> DataFrame:
    d = descriptions.select("video_id", F.explode("chunks").alias("c")).select("video_id", F.col("c.chunk_id").cast("long").alias("chunk_id"), F.explode("c.samplers").alias("sampler_id", "b"))
    return d.select("video_id", "chunk_id", "sampler_id", "b.*")


def embedded_units(embedded: DataFrame) -> DataFrame:
    return embedded.select("video_id", "embedder", F.explode("units").alias("u")).select("video_id", "embedder", "u.*")


def cut_scores(cuts: DataFrame) -> DataFrame:
    z = cuts.select("video_id", F.explode(F.arrays_zip(F.col("scores.at").alias("at"), F.col("scores.values").alias("score"))).alias("z"))
    return z.select("video_id", "z.at", "z.score")


def observations(spark: SparkSession, path: str) -> DataFrame:
    """An append-only log of observations; torn or malformed lines are skipped whole."""
    return spark.read.schema(OBSERVATION).option("mode", "DROPMALFORMED").json(path)


def observation_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    parsed = spark.readStream.option("maxFilesPerTrigger", files).text(path).select(F.from_json("value", OBSERVATION).alias("o"))
    return parsed.filter(F.col("o.video_id").isNotNull()).select("o.*")
