"""Embedding near-dedup (5) by an epsilon grid order join.

Vectors of equal label and length are compared by cosine; for unit vectors a cosine of at least c is a distance of at
most eps = sqrt(2 - 2 c).  The unit vectors are projected on their leading principal directions, which never makes a
distance longer, and put in epsilon grid order: sorted by the cells, of width eps, of those coordinates in turn.

1. Equal vectors of one label (by 128 bits of hash) become one class with a count, so a large group of copies is one
   point; vectors themselves aren't joined with anything again.
2. The order is cut into blocks of at most BLOCK classes, wherever the label changes or a block is full, each with the
   box of its coordinates.  Two blocks of a label are joined unless their boxes are further apart than eps in the
   first two coordinates (an equi-join on their cells) or in all (the distance of the boxes).  A block meets its
   neighbours in groups of GROUP, so that no block of a crowded label makes a task long, and is sent once a group.
3. A pair of blocks is joined recursively: intervals whose boxes are provably too far apart are skipped, others are
   halved until they are small, and small ones are compared by exact cosines in double precision.

Per pair of blocks come the number of links of each class and a spanning forest of the links; the counts are added
up and the forests joined to components.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or whose label is null,
link with nothing and keep themselves, as do rows without vec_id (their component_id is null); components may be of any size that doubles have; repeated rows count
as vectors of their own that are linked with each other; ties don't arise, as the bound is inclusive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.llm.common import cut, discard, extended, scaled, ship, table
from momentlake.llm.components import components

COSINE = 0.98
DIRECTIONS = 8
BLOCK, LEAF = 1024, 128
#: Neighbours of a block that one group of a task compares with it.
GROUP = 64
MAX_FIT = 20_000
#: So many lengths of vectors, the commonest, get directions of their own; others go by their first coordinates.
FITTED = 1000


def directions(rows: DataFrame, dims: int, k: int = DIRECTIONS, max_fit: int = MAX_FIT) -> np.ndarray:
    """dims x k, orthonormal: the leading principal directions of at most about max_fit unit vectors of that length.

    Any orthonormal directions give a right result; these give the shortest intervals."""
    some = rows.filter(F.size("v") == dims).select("v")
    n = some.count()
    some = some.filter(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < F.lit(max(1, max_fit * 1_000_000 // max(n, 1)))) if n > max_fit else some

    def moments(batches):
        total, square, count = np.zeros(dims), np.zeros((dims, dims)), 0
        for b in batches:
            x = scaled(np.asarray(b.column(0).flatten()).reshape(-1, dims))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            total, square, count = total + x.sum(0), square + x.T @ x, count + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array([r.tolist() for r in [*square, total]]), pa.array(np.full(dims + 1, count))], ["i", "r", "n"])

    got = some.mapInArrow(moments, "i long, r array<double>, n long").groupBy("i").agg(*[F.sum(F.col("r")[j]).alias(f"r{j}") for j in range(dims)], F.sum("n").alias("n")).toPandas()
    got = got.sort_values("i").drop(columns=["i"]).to_numpy(dtype=float)
    count = max(got[0, -1], 1.0) if len(got) else 1.0
    if not len(got):
        return np.eye(dims)[:, :k]
    mean = got[dims, :dims] / count
    _, vectors = np.linalg.eigh(got[:dims, :dims] / count - np.outer(mean, mean))
    return vectors[:, ::-1][:, : min(k, dims)]


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def join_blocks(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, same: bool, cosine: float = COSINE, leaf: int = LEAF, compared: list | None = None):
    """Pairs (i, j) with cosine(x[i], y[j]) >= cosine, as two arrays; i < j if both sides are the same block.

    px, py: the coordinates that the order goes by.  Yields one small piece after another; compared gets how many cosines
    were computed."""
    eps = np.sqrt(2 - 2 * cosine) + 1e-7
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    todo = [(0, len(x), 0, len(y))]
    done = 0
    while todo:
        a, b, c, d = todo.pop()
        if same and a >= d:
            continue  # the mirror image is joined
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if gap @ gap > eps * eps:
            continue
        if b - a <= leaf and d - c <= leaf:
            done += (b - a) * (d - c)
            hit = (x[a:b] @ y[c:d].T) / (nx[a:b, None] * ny[None, c:d]) >= cosine
            i, j = np.nonzero(hit)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    if compared is not None:
        compared.append(done)


def near_duplicates(rows: DataFrame, cosine: float = COSINE, vector: str = "embedding", block: int = BLOCK, leaf: int = LEAF, group: int = GROUP) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    ship(rows.sparkSession)
    spark = rows.sparkSession
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    src = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    # -0.0 and 0.0 are one value
    src = src.withColumn("v", F.when(F.col("good"), F.transform("v", lambda x: x + F.lit(0.0))))
    src = src.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), F.col("v")))
    same = ["label", "h1", "h2"]
    classes = cut(src.filter("good").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "classes")
    lengths = [r.d for r in classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(FITTED).collect()]
    turn = spark.sparkContext.broadcast({d: directions(classes, d) for d in lengths})
    eps = float(np.sqrt(2 - 2 * cosine))

    def project(batches):
        for b in batches:
            k = b.schema.get_field_index("v")
            cells, coords, vectors = [], [], []
            for z in b.column(k).to_pylist():
                z = scaled(np.array([z]))[0]
                vectors.append(z)
                p = z / np.linalg.norm(z)
                p = p @ turn.value[len(z)] if len(z) in turn.value else p[:DIRECTIONS]
                coords.append(p.tolist())
                cells.append(np.floor(p / eps).astype(int).tolist())
            columns = list(b.columns)
            columns[k] = pa.array(vectors, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(coords, pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.int32()))], [*b.schema.names, "p", "cell"])

    placed = classes.mapInArrow(project, extended(classes, p="array<double>", cell="array<int>")).withColumn("dims", F.size("v"))
    ordered = placed.repartitionByRange("label", "dims", "cell", "rep").sortWithinPartitions("label", "dims", "cell", "rep")

    def pack(batches):
        """Blocks of neighbours in the order."""
        from pyspark import TaskContext

        task, count, held, of = TaskContext.get().partitionId(), 0, [], None

        def full(held, of):
            nonlocal count
            p = np.array([r["p"] for r in held])
            count += 1
            return pa.RecordBatch.from_pylist(
                [{
                    "block": (task << 32) + count, "label": of[0], "dims": of[1], "low": p.min(0).tolist(), "high": p.max(0).tolist(),
                    "reps": [r["rep"] for r in held], "counts": [r["n"] for r in held],
                    "x": np.array([r["v"] for r in held]).tobytes(), "p": p.tobytes(),
                }],
                schema=pa.schema([("block", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("reps", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("x", pa.binary()), ("p", pa.binary())]),
            )

        for b in batches:
            for r in b.to_pylist():
                if held and (of != (r["label"], r["dims"]) or len(held) >= block):
                    yield full(held, of)
                    held = []
                of = (r["label"], r["dims"])
                held.append(r)
        if held:
            yield full(held, of)

    blocks = cut(ordered.mapInArrow(pack, "block long, label string, dims int, low array<double>, high array<double>, reps array<long>, counts array<long>, x binary, p binary"), "blocks")
    # neighbours: blocks that share a cell of the first two coordinates, widened by one on one side
    box = blocks.select("block", "label", "dims", "low", "high")
    cell = lambda c, k, by: F.floor((F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0.0)) + by) / eps).cast("int")
    cells = lambda k, by: F.explode(F.sequence(cell("low", k, -by), cell("high", k, by)))
    wide = eps + 1e-7
    a = box.select(F.col("block").alias("a"), "label", "dims", F.col("low").alias("al"), F.col("high").alias("ah"), "low", "high").withColumn("c1", cells(1, wide)).withColumn("c2", cells(2, wide))
    b = box.select(F.col("block").alias("b"), "label", "dims", F.col("low").alias("bl"), F.col("high").alias("bh"), "low", "high").withColumn("c1", cells(1, 0.0)).withColumn("c2", cells(2, 0.0))
    a, b = a.drop("low", "high"), b.drop("low", "high")
    gap = F.aggregate(
        F.zip_with(F.zip_with("al", "bh", lambda x, y: x - y), F.zip_with("bl", "ah", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))),
        F.lit(0.0),
        lambda s, x: s + x * x,
    )
    pairs = a.join(b, ["label", "dims", "c1", "c2"]).filter((F.col("a") < F.col("b")) & (gap <= wide**2)).groupBy("a", "b").agg(F.lit(1).alias("x")).select("a", "b")
    pairs = cut(pairs, "pairs")
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / group).cast("int").alias("k"))
    body = blocks.select("block", "dims", "reps", "counts", "x", "p")
    # a row for the block itself, b = -1, before those of its neighbours; group 0 also compares it with itself
    own = body.join(groups.withColumnRenamed("a", "block"), "block", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
    own = own.select(F.col("block").alias("a"), "salt", F.lit(-1).cast("long").alias("b"), "dims", "reps", "counts", "x", "p")
    others = pairs.join(groups, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("k")).cast("int")).join(body.withColumnRenamed("block", "b"), "b").select(*own.columns)
    work = own.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")

    def compare(batches):
        held = None
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                reps, counts = np.array(r["reps"]), np.array(r["counts"])
                x = np.frombuffer(r["x"]).reshape(-1, r["dims"])
                p = np.frombuffer(r["p"]).reshape(len(x), -1)
                same = r["b"] < 0
                if same:
                    held = (reps, counts, x, p)
                    if r["salt"]:
                        continue
                ra, ca, y, py = held
                la, lb = np.zeros(len(y), np.int64), np.zeros(len(x), np.int64)
                union, forest = _Union(len(y) + len(x)), []
                for i, j in join_blocks(y, py, x, p, same, cosine, leaf):
                    la += np.bincount(i, counts[j], len(y)).astype(np.int64)
                    lb += np.bincount(j, ca[i], len(x)).astype(np.int64)
                    shift = 0 if same else len(y)
                    forest += [(int(ra[m]), int(reps[q])) for m, q in zip(i.tolist(), j.tolist(), strict=True) if union.join(m, q + shift)]
                rows = [(m, None, n) for m, n in zip(ra.tolist(), la.tolist(), strict=True) if n] + [(m, None, n) for m, n in zip(reps.tolist(), lb.tolist(), strict=True) if n]
                rows += [(m, q, 0) for m, q in forest]
                if rows:
                    u, w, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64()), pa.array(n, pa.int64())], ["u", "v", "n"])

    found = cut(work.mapInArrow(compare, "u long, v long, n long"), "joined")
    links = found.filter(F.col("v").isNull()).groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    comp = components(found.filter(F.col("v").isNotNull()).select("u", "v"))
    known = classes.join(links, "rep", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = cut(known.select(*same, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    for done in (classes, blocks, pairs, found):
        discard(done)
    linked = src.filter("good").select("vec_id", *same).join(known, same).select("vec_id", "n_links", "component_id")
    alone = src.filter(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_embedding_dedup": op5_embedding_dedup}

ORACLE = {
    "op5_embedding_dedup": """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.good AND b.good AND list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id, vec_id AS c FROM e UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c USING (vec_id) LEFT JOIN n ON n.a = e.vec_id
"""
}
