"""Exact top-k search (4) by aggregation without random access.

The components of a vector are quantised to floor(256 x); the score is their integer inner product.  Queries and
vectors are dealt into blocks, and every pair of a block of queries and a block of vectors is one task:

* for each dimension the block's vectors are sorted once, a list read from its top for queries with a positive
  component there and from its bottom for the others;
* all lists are read to the same depth, which doubles each round up to the middle; from there each round reads half of
  what is left.  A vector's lower bound is the sum of what was read of it plus the worst that each other list holds;
  its upper bound takes the list's place of reading instead;
* vectors whose upper bound is under the k-th lower bound can't qualify and don't come back.  Reading stops when few
  others are left, or few of each list; these get their final scores.

On vectors without structure the bounds leave nearly all until more than half of each list is read.

The block results, k rows a query and block, are ranked once more.  Bounds of a whole block are matrix products.

Defined results: vectors that are null or hold a null or non-finite component take no part, as query or candidate;
scores are between vectors of one length, also of none.  Every row stands for itself: all rows but the query's own are
its candidates, so repeated rows are candidates of each other, and a repeated query row gets its ranks once for each
time that it occurs; rows without vec_id are candidates, the last among equal scores, and are no queries.  Fewer than k
candidates are all returned; equal scores go to the smaller vec_id.  Sums that floats don't hold exactly (from 2^52 on) are
taken with whole numbers, without bounds; a score beyond the range of a long is its nearest end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from momentlake.llm.common import cut, ship, table

K, EVERY = 5, 50
Q_BLOCK, V_BLOCK = 2048, 16384
#: Reading starts with this share of each list; at this many candidates a query their final scores are cheaper.
FIRST, FEW = 1 / 32, 64


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """row (a number of its own), vec_id and v (array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(v.isNotNull() & ~bad)
    return own.withColumn("row", F.monotonically_increasing_id())


def _exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The integer inner products of rows that floats can't sum exactly; beyond the range of a long, its nearest end."""
    whole = [int(x) for x in q.tolist()]
    sums = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in v.tolist()]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)


def search_block(q_row: np.ndarray, q: np.ndarray, row: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, first: float = FIRST, few: int = FEW, scored: list | None = None):
    """Of each query the k best of this block but its own row: arrays of query index, vector index and score.

    row: the vectors' own numbers, q_row those of the queries; vid: their ids, by which equal scores are ranked.
    scored: gets how many candidates of each query were left when their final scores were summed.
    """
    n, dims = v.shape
    exact = max(np.abs(q).max(initial=0), 1) * max(np.abs(v).max(initial=0), 1) * dims < 2.0**52
    order = np.argsort(v, 0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], 0)
    ascending = np.take_along_axis(v, order, 0)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    out_q, out_v, out_s = [], [], []
    for a in range(0, len(q), 256):
        todo = np.arange(a, min(a + 256, len(q)))
        depth = max(4 * k, int(n * first))
        alive = q_row[todo][:, None] != row[None, :]
        while len(todo):
            last = not exact or n - depth <= max(few, 1)
            if not last:
                top, bottom = rank >= n - depth, rank < depth
                u, d = up[todo], down[todo]
                lower = u @ np.where(top, v, ascending[0]).T + d @ np.where(bottom, v, ascending[-1]).T
                upper = u @ np.where(top, v, ascending[n - depth]).T + d @ np.where(bottom, v, ascending[depth - 1]).T
                lower[q_row[todo][:, None] == row[None, :]] = -np.inf
                bar = np.partition(lower, n - k, 1)[:, n - k] if n > k else np.full(len(todo), -np.inf)
                alive &= upper >= bar[:, None]
            left = alive.sum(1)
            ready = (left <= max(few, k)) | last
            for r in np.flatnonzero(ready):
                c = np.flatnonzero(alive[r])
                if scored is not None:
                    scored.append(len(c))
                if exact:
                    score = (v[c] @ q[todo[r]]).astype(np.int64)
                else:
                    score = _exact(v[c], q[todo[r]])
                best = np.lexsort((vid[c], -score))[:k]
                out_q.append(np.full(len(best), todo[r]))
                out_v.append(c[best])
                out_s.append(score[best])
            todo, alive = todo[~ready], alive[~ready]
            depth = min(2 * depth, (n + depth) // 2)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(out_q), join(out_v), join(out_s)


def _matrix(t: pa.Table, dims: int) -> np.ndarray:
    flat = t.column("v").combine_chunks()
    return np.floor(256 * np.asarray(flat.flatten()).reshape(len(t), dims))


def top_k(rows: DataFrame, is_query: F.Column, k: int = K, vector: str = "embedding", q_block: int = Q_BLOCK, v_block: int = V_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors of every row where is_query holds."""
    ship(rows.sparkSession)
    all_ = cut(usable(rows, vector), "vectors").withColumn("dims", F.size("v"))  # written once, so that a row keeps its number
    asks = F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull()
    n = all_.agg(F.count("*").alias("n"), F.count_if(asks).alias("q")).first()
    n_v, n_q = max(1, -(-n.n // v_block)), max(1, -(-n.q // q_block))
    vb, qb = F.pmod(F.xxhash64("row"), F.lit(n_v)).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_q)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    vectors = all_.withColumn("vb", vb).withColumn("qb", spread(n_q))
    queries = all_.filter(asks).withColumn("qb", qb).withColumn("vb", spread(n_v))

    def run(key, left, right):
        schema = pa.schema([("q_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        dims = int(key[0].as_py())
        q_row, row = left["row"].to_numpy(), right["row"].to_numpy()
        vid = right["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        a, b, s = search_block(q_row, _matrix(left, dims), row, vid, _matrix(right, dims), k)
        return pa.Table.from_arrays([pa.array(q_row[a]), left["vec_id"].take(pa.array(a)), pa.array(row[b]), right["vec_id"].take(pa.array(b)), pa.array(s)], schema=schema)

    by = ["dims", "qb", "vb"]
    found = queries.groupBy(*by).cogroup(vectors.groupBy(*by)).applyInArrow(run, "q_row long, query_id long, row long, vec_id long, score long")
    w = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op4_topk": op4_topk}

ORACLE = {
    "op4_topk": """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.r, c.vec_id, coalesce(list_dot_product(q.v, c.v), 0)::BIGINT AS score
  FROM e q JOIN e c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, r))::INT AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""
}
