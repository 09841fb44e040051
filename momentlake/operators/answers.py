"""What models are asked and what they answer: plans of calls, tolerant reading, named entities, items."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from momentlake.functions import text as T

#: Pieces of texts that a recogniser sees at a time.
PIECES = 512

CALL = ["video_id", "chunk_id", "sampler_id"]


def calls(sampled: DataFrame, questions: DataFrame) -> DataFrame:
    """One call a chunk, sampler and question, with its frames in order.

    sampled: video_id, chunk_id, sampler, frame_index; questions: sampler, question, position (few rows)."""
    runs = sampled.groupBy("video_id", "chunk_id", "sampler").agg(F.array_sort(F.collect_set("frame_index")).alias("frame_indexes"))
    asked = runs.join(questions, "sampler")
    return asked.withColumn("sampler_id", T.answer_id(F.col("sampler"), F.col("question"))).withColumn("frame_count", F.size("frame_indexes"))


def due(planned: DataFrame, answered: DataFrame | None, limit: int | None = None, same: tuple[str, ...] = ()) -> DataFrame:
    """Calls that have no answer yet; an answer counts if the columns `same` (fingerprints, the describer) agree too.

    With a limit, the first calls by recording, chunk, sampler and question: a top-k, no full sort."""
    out = planned
    if answered is not None:
        out = out.join(answered.select(*CALL, *same).distinct(), [*CALL, *same], "left_anti")
    return out if limit is None else out.orderBy(*CALL).limit(limit)


def fenced(text: Column) -> Column:
    """The JSON of a reply: inside a code fence if there is one, else from the first brace to the last; null without braces."""
    inside = F.regexp_extract(text, r"(?s)```[a-zA-Z]*\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(inside != "", inside).when(bare != "", bare)


def _leaves(x) -> Iterator[str]:
    todo = [x]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, dict):
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)


def string_leaves(document: Column) -> Column:
    """Every string value of JSON at any depth, in order; none of null or malformed JSON."""

    def one(s):
        try:
            return list(_leaves(json.loads(s))) if s else []
        except ValueError:
            return []

    @F.pandas_udf("array<string>")
    def leaves(documents: pd.Series) -> pd.Series:
        return documents.map(one)

    return leaves(document)


def ner(rows: DataFrame, by: str, chunk: str, text: str, recognise: Callable[[list[str]], list[list[tuple[str, str]]]], limit: int = 1000) -> DataFrame:
    """by, text, label, mentions, chunk_ids and rank of the named entities of all texts.

    recognise: texts -> for each, (entity, label) pairs; it sees at most PIECES pieces of at most `limit` characters at a time.
    Entities are counted before they are shuffled; ranks are by mentions, then by text in lower case."""
    named = rows.select(by, chunk, F.col(text).alias("text"))
    schema = StructType(named.schema.fields[:2]).add("text", "string").add("label", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in T.parts(b.column(2)):
                pieces = [(start + k, p) for k, t in enumerate(texts) for p in T.split_pieces(t, limit)]
                for a in range(0, len(pieces), PIECES):
                    own = pieces[a : a + PIECES]
                    found = [(k, e, label) for (k, _), es in zip(own, recognise([p for _, p in own]), strict=True) for e, label in es]
                    of = pa.array([k for k, _, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array([e for _, e, _ in found], pa.string()), pa.array([x for _, _, x in found], pa.string())], schema.names)

    seen = named.mapInArrow(run, schema)
    out = seen.groupBy(by, "text", "label").agg(F.count("*").alias("mentions"), F.sort_array(F.collect_set(chunk)).alias("chunk_ids"))
    w = Window.partitionBy(by).orderBy(F.desc("mentions"), F.lower("text"), "text", "label")
    return out.withColumn("rank", F.row_number().over(w))


def item_ids(items: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """items with item_id: the singular of the answer's name and a number from 1 in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return items.withColumn("item_id", F.concat_ws("-", T.singular(F.lit(name)), F.row_number().over(w).cast("string")))


def questions_of_configs(configs: DataFrame) -> DataFrame:
    """sampler, question and position; a sampler that declares no questions asks the one of its own name."""
    asked = F.when(F.size("questions") > 0, F.col("questions")).otherwise(F.array("sampler"))
    return configs.select("sampler", F.posexplode(asked).alias("position", "question"))
