"""A training corpus from `documents` in five stages, each written as Parquet and read again by the next.

ORACLE_SQL is None: trained classifiers and SentencePiece can't be expressed in SQL; a test holds the rows of run() against
plain loops, the sentencepiece library and SQL for the mix, and others hold every stage against brute force.

Defined results: documents with a null or empty text go with the first stage; repeated rows and equal texts become one
document, rows without a doc_id are never duplicates of others; a null source is a source of its own; extra columns go
along, whatever their names, up to the last stage; an empty table gives an empty corpus.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from momentlake.llm.common import shared_dir, table
from momentlake.llm.language_id import stage_language_id
from momentlake.llm.minhash_dedup import stage_dedup
from momentlake.llm.mixing import stage_mixing
from momentlake.llm.pieces import stage_pieces
from momentlake.llm.quality import stage_quality

STAGES = [
    ("language_id", stage_language_id),
    ("quality", stage_quality),
    ("minhash_dedup", stage_dedup),
    ("mixing", stage_mixing),
    ("pieces", stage_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
