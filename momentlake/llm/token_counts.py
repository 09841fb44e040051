"""Token counts (1): an exact histogram of encoded lengths, and suffix sums over it.

`lengths` encodes whole texts; `histogram` aggregates documents by encoded length; `suffix_sums` adds to each length
what every context limit needs.  The histogram has at most as many rows as there are different lengths, so totals,
quantiles and truncated totals never touch the documents again.

Defined results: a null or empty text has length 0; a repeated row counts each time; an empty table gives an empty
histogram; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentlake.llm import encoder as E
from momentlake.llm.common import cut, ship, table

#: Neighbouring lengths that one task of the suffix sums holds.
SPAN = 64


def lengths(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """n_tokens of every row of docs, in no order: the number of ids of the whole text, without special tokens."""
    ship(docs.sparkSession)
    path = path or E.default_path()

    def run(batches):
        enc = E.encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(enc.lengths(b.column(0)))], ["n_tokens"])

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "n_tokens long")


def histogram(lens: DataFrame) -> DataFrame:
    """n_docs by n_tokens; counted on the map side first."""
    return lens.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length L: documents and tokens of all lengths >= L and < L, and the total if texts are cut to L tokens.

    Sums go over spans of SPAN lengths, then over the spans' totals, so that no task holds the whole histogram.
    """
    h = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / SPAN).alias("span"))
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    spans = spans.select(
        "span",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(total).alias("total_docs"),
        F.sum("t").over(total).alias("total_tokens"),
    )
    down = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = (
        h.withColumn("d_in", F.sum("n_docs").over(down))
        .withColumn("t_in", F.sum("tokens").over(down))
        .join(spans, "span")
        .withColumn("docs_at_least", F.col("d_in") + F.col("d_above"))
        .withColumn("tokens_at_least", F.col("t_in") + F.col("t_above"))
    )
    below = F.col("total_tokens") - F.col("tokens_at_least")
    return out.select(
        "n_tokens",
        "n_docs",
        "tokens",
        "docs_at_least",
        "tokens_at_least",
        (below + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        "total_docs",
        "total_tokens",
    )


def total(sums: DataFrame) -> int:
    """All tokens."""
    row = sums.agg(F.max("total_tokens").alias("n")).first()
    return int(row.n or 0)


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left if every text is cut to its first `limit` tokens, for any limit >= 0."""
    row = (
        sums.filter(F.col("n_tokens") >= limit).agg(F.max("docs_at_least").alias("d"), F.max("tokens_at_least").alias("t")).first()
    )
    return total(sums) - int(row.t or 0) + limit * int(row.d or 0)


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length L such that at least the share q of documents has length <= L; None without documents."""
    at_most = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    row = sums.filter(at_most >= F.lit(q) * F.col("total_docs")).agg(F.min("n_tokens").alias("n")).first()
    return None if row.n is None else int(row.n)


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    return suffix_sums(cut(histogram(lengths(docs, text, path)), "lengths"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op1_token_counts": op1_token_counts}
