"""Approximate nearest neighbours (11): NN-descent builds a neighbour graph, queries walk it greedily.

Vectors of equal components are one node (by 128 bits of hash), so a large group of copies is one point of the graph.

Graph.  Every node starts with neighbours from three places: sorted by the signs of two sets of random projections it
meets the nodes of its block, and it is linked to the nearest of a bounded number of entry nodes, which keeps the graph
in one piece.  Then, round by round, a Spark join gives every node the vectors of its neighbours and of those that it is
a neighbour of (at most REVERSE of these a round, others in other rounds); what they have in common is that they are
neighbours of neighbours of each other.  They are compared as one small matrix product, pairs that were compared before
are left out, and only what beats a node's worst neighbour is sent on and merged with its list by another join.  It ends
when a round changes less than SETTLED of the edges, or after ROUNDS.

Search.  A query starts at its own node and the nearest entry nodes and keeps the BEAM best nodes seen.  Each hop joins
its STEP best nodes not yet expanded with the graph and sends the query, not the vectors, to the blocks of the nodes that
they lead to; it ends when all nodes of the beam are expanded.
The nearest of them are scored anew in double precision on the original vectors.

No list depends on the number of rows: edges are DEGREE a node, a task holds one node's neighbours or one query's beam at a
time, and what is broadcast is the entry nodes, at most ENTRIES of each length and ENTRY_BYTES in all.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; nearness is
between vectors of one length.  Every row stands for itself: repeated rows are candidates of each other, a repeated
query row gets its ranks once for each time that it occurs; rows without vec_id are candidates, the last among equal
scores, and are no queries.  Equal scores go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentlake.llm.common import cut, discard, ship, table

K, EVERY = 5, 50
DEGREE, REVERSE, ROUNDS, SETTLED = 20, 20, 4, 0.02
#: New neighbours that one common neighbour offers a node at most in a round; it is offered some by each.
OFFERED = 4
BLOCK = 512
ENTRIES, ENTRY_BYTES, ENTRY_EDGES = 256, 16_000_000, 4
BEAM, STEP = 512, 128
#: Nodes of a block in which queries are compared.
PLACES = 4096
#: Nodes of a beam that are scored anew beyond k: unit vectors in single precision order the beam.
SPARE = 11
#: Less than minus any squared distance of unit vectors.
FAR = -5.0
EDGES = "u long, v long, s float"


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their size; scaling by a power of two is exact."""
    top = np.frexp(np.abs(v).max(1))[1]
    v = np.ldexp(v, -top[:, None])
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = (np.ldexp(z, -np.frexp(np.abs(z).max())[1]) for z in (a, b))
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


def _vectors(column, dims: int) -> np.ndarray:
    """A matrix of the float32 vectors of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


def _closeness(x: np.ndarray) -> np.ndarray:
    """Minus the squared distances of all rows, themselves last; in double precision, so that near copies are told apart."""
    x = x.astype(np.float64)
    n = (x * x).sum(1)
    s = 2 * (x @ x.T) - n[:, None] - n[None, :]
    np.fill_diagonal(s, -np.inf)
    return s


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest entries of each row, or all."""
    return np.argpartition(-s, k - 1, 1)[:, :k] if k < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)


def _edges(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float32())], ["u", "v", "s"])


def read_rows(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """row (a number of its own), vec_id, v (array<double>) and two hashes of it, of the rows that take part; written once."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    own = own.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 and 0.0 are one value
    return cut(own.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")), "rows")


def make_nodes(rows: DataFrame) -> DataFrame:
    """A node per different vector: node (its least row), h1, h2, v, dims, x (unit vector in single precision), c0 and c1
    (signs of its random projections)."""
    classes = rows.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.first("v").alias("v")).withColumn("dims", F.size("v"))

    def run(batches):
        planes = {}
        for b in batches:
            size = b.column("dims").to_numpy()
            for d in np.unique(size).tolist():
                some = b.filter(pa.array(size == d))
                if d not in planes:
                    planes[d] = np.random.default_rng(d).standard_normal((d, 124))
                u = unit(np.asarray(some.column("v").flatten()).reshape(-1, d))
                sign = (u @ planes[d] > 0).reshape(len(u), 2, 62)
                code = sign @ (1 << np.arange(61, -1, -1))
                x = pa.array([z.tobytes() for z in u.astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns, x, pa.array(code[:, 0]), pa.array(code[:, 1])], [*some.schema.names, "x", "c0", "c1"])

    return cut(classes.mapInArrow(run, "h1 long, h2 long, node long, v array<double>, dims int, x binary, c0 long, c1 long"), "nodes")


def entry_nodes(nodes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the nodes that hold entry nodes' places, chosen by hash, and their vectors."""
    w = Window.partitionBy("dims").orderBy(F.xxhash64("node"), "node")
    some = nodes.select("node", "dims", "x").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= ENTRIES)
    # all lengths get alike many, as far as the bytes go
    for most in (ENTRIES, ENTRIES // 8, 8, 1):
        size = some.filter(F.col("k") <= most).agg(F.sum(4 * F.col("dims") + 8).alias("n")).first().n or 0
        if size <= ENTRY_BYTES:
            break
    else:
        return {}
    got = some.filter(F.col("k") <= most).orderBy("dims", "node").toArrow()
    out = {}
    for d in got["dims"].unique().to_pylist():
        own = got.filter(pa.compute.equal(got["dims"], d))
        out[d] = (own["node"].to_numpy(), _vectors(own["x"], d))
    return out


def first_edges(nodes: DataFrame, entries, degree: int = DEGREE, block: int = BLOCK) -> DataFrame:
    """Edges inside blocks of the two orders, and to the nearest entry nodes."""

    def compare(ids, x):
        s = _closeness(x)
        k = min(degree, len(ids) - 1)
        if k < 1:
            return None
        at = _best(s, k)
        return _edges(np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(s, at, 1).ravel())

    def run(batches):
        held, of = [], None  # arrays of ids and vectors of one length, the last block of the order first
        for b in batches:
            size = b.column("dims").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
            for a, z in zip(bounds, bounds[1:], strict=False):
                if a == z:
                    continue
                d = int(size[a])
                if of not in (None, d) and held:
                    yield from filter(None, [compare(*map(np.concatenate, zip(*held, strict=True)))])
                    held = []
                of = d
                held.append((b.column("node").to_numpy()[a:z], _vectors(b.column("x").slice(a, z - a), d)))
                ids, x = map(np.concatenate, zip(*held, strict=True))
                while len(ids) >= 2 * block:  # half of each block is in the next one too
                    yield compare(ids[:block], x[:block])
                    ids, x = ids[block // 2 :], x[block // 2 :]
                held = [(ids, x)]
        if held:
            yield from filter(None, [compare(*map(np.concatenate, zip(*held, strict=True)))])

    def attach(batches):
        for b in batches:
            size = b.column("dims").to_numpy()
            for d in np.unique(size).tolist():
                if d not in entries.value:
                    continue
                some = b.filter(pa.array(size == d))
                ids, (there, y) = some.column("node").to_numpy(), entries.value[d]
                x = _vectors(some.column("x"), d)
                at = _best(x @ y.T, min(ENTRY_EDGES, len(there)))
                s = -((x[:, None, :] - y[at]) ** 2).sum(2).ravel()
                u, v = np.repeat(ids, at.shape[1]), there[at].ravel()
                yield _edges(u[u != v], v[u != v], s[u != v])

    out = nodes.select("node", "dims", "x").mapInArrow(attach, EDGES)
    for code in ("c0", "c1"):
        ordered = nodes.select("node", "dims", "x", code).repartitionByRange("dims", code, "node").sortWithinPartitions("dims", code, "node")
        out = out.unionByName(ordered.mapInArrow(run, EDGES))
    return out


def nearest(edges: DataFrame, degree: int, *flags: F.Column) -> DataFrame:
    """Each edge once, the greatest `degree` of each u."""
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"), *flags)
    return once.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))).filter(F.col("k") <= degree).drop("k")


def both_ways(edges: DataFrame, most: int, turn: int) -> DataFrame:
    """m, x and the flags of edges: m's neighbours, and at most `most` of those that m is a neighbour of, others every turn."""
    back = edges.withColumns({"u": F.col("v"), "v": F.col("u")})
    back = back.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("v", F.lit(turn)), "v"))).filter(F.col("k") <= most).drop("k")
    rest = [F.max(c).alias(c) for c in edges.columns if c not in ("u", "v", "s")]
    return edges.unionByName(back).groupBy(F.col("u").alias("m"), F.col("v").alias("x")).agg(*rest or [F.lit(1).alias("one")])


def _runs(m: np.ndarray) -> list[int]:
    return [0, *(np.flatnonzero(np.diff(m)) + 1).tolist(), len(m)] if len(m) else [0]


def descend(nodes: DataFrame, edges: DataFrame, degree: int, reverse: int, turn: int) -> DataFrame:
    """Candidates: pairs of neighbours of one node, at least one of them new to it, that beat the worst neighbour of u."""
    around = both_ways(edges, reverse, turn)
    fresh = around.groupBy("m").agg(F.max("new").alias("any")).filter("any = 1").select("m")
    around = around.join(fresh, "m")
    bar = edges.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("s")).select(F.col("u").alias("x"), F.when(F.col("n") >= degree, F.col("s")).otherwise(FAR).cast("float").alias("bar"))
    body = nodes.select(F.col("node").alias("x"), F.col("x").alias("body")).join(bar, "x", "left").withColumn("bar", F.coalesce("bar", F.lit(FAR).cast("float")))
    work = around.join(body, "x").select("m", "x", "new", "bar", "body").repartition("m").sortWithinPartitions("m", "x")

    def compare(ids, new, bar, body):
        s = _closeness(np.frombuffer(b"".join(body.to_pylist()), np.float32).reshape(len(ids), -1))
        s[~(new[:, None] | new[None, :]) | (s <= bar[:, None])] = -np.inf
        at = _best(s, min(OFFERED, len(ids)))
        got = np.take_along_axis(s, at, 1).ravel()
        u, v, on = np.repeat(ids, at.shape[1]), ids[at].ravel(), got > FAR
        return u[on], v[on], got[on]

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            m = t["m"].to_numpy()
            ends = _runs(m)
            found = []
            ids, new, bar, body = t["x"].to_numpy(), t["new"].to_numpy() == 1, t["bar"].to_numpy(), t["body"].combine_chunks()
            body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
            for a, z in zip(ends[:-2], ends[1:-1], strict=True):  # the last node may go on in the next batch
                found.append(compare(ids[a:z], new[a:z], bar[a:z], body.slice(a, z - a)))
            if found:
                yield _edges(*map(np.concatenate, zip(*found, strict=True)))
            held = t.slice(ends[-2]) if len(ends) > 1 else None
        if held is not None:
            yield _edges(*compare(held["x"].to_numpy(), held["new"].to_numpy() == 1, held["bar"].to_numpy(), held["body"]))

    return work.mapInArrow(run, EDGES)


def neighbour_graph(nodes: DataFrame, entries, degree: int = DEGREE, reverse: int = REVERSE, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """u, v, s: about the `degree` nearest nodes v of every node u; s is minus their squared distance as unit vectors."""
    new = F.lit(1).cast("int")
    edges = cut(nearest(first_edges(nodes, entries, degree), degree).withColumn("new", new), "edges")
    for turn in range(rounds):
        found = descend(nodes, edges, degree, reverse, turn)
        both = edges.withColumn("new", F.lit(0)).unionByName(found.withColumn("new", new))
        after = cut(nearest(both, degree, F.min("new").alias("new")), "edges")
        discard(edges)
        edges = after
        n = edges.agg(F.count("*").alias("all"), F.count_if(F.col("new") == 1).alias("new")).first()
        if n.new <= settled * n.all:
            break
    return edges


STATE = "q long, dims int, body binary, ids array<long>, sims array<float>, done array<boolean>"


def search(nodes: DataFrame, edges: DataFrame, start: DataFrame, entries, most: int, beam: int = BEAM, step: int = STEP) -> DataFrame:
    """q, node: the `most` best nodes of the beam that each q of start (q: its own node) ends with."""
    ways = both_ways(edges.select("u", "v", "s"), REVERSE, -1).groupBy(F.col("m").alias("node")).agg(F.collect_list("x").alias("led"))
    ways = cut(ways, "ways")
    n = max(1, -(-nodes.count() // PLACES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    places = nodes.select(block("node").alias("block"), "node", "dims", "x")

    def begin(batches):
        for b in batches:
            out = []
            for q, d, body in zip(*(b.column(c).to_pylist() for c in ("q", "dims", "body")), strict=True):
                ids, sims = np.array([q]), np.zeros(1, np.float32)
                if d in entries.value:
                    there, y = entries.value[d]
                    s = -((y - np.frombuffer(body, np.float32)) ** 2).sum(1)
                    at = _best(s[None, :], min(step // 2, len(s)))[0]
                    at = at[there[at] != q]
                    ids, sims = np.append(ids, there[at]), np.append(sims, s[at])
                out.append((q, d, body, ids.tolist(), sims.tolist(), [False] * len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    schema = pa.schema([("q", pa.int64()), ("dims", pa.int32()), ("body", pa.binary()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32())), ("done", pa.list_(pa.bool_()))])
    asked = start.select("q").distinct().join(nodes.select(F.col("node").alias("q"), "dims", F.col("x").alias("body")), "q")
    state = cut(asked.mapInArrow(begin, STATE), "beams")
    ended: list[DataFrame] = []

    def compare(key, left, right):
        """How close a block's nodes are that queries were led to, of those that the beam can still take in."""
        u, v, out = [], [], []
        ids, size = left["node"].to_numpy(), left["dims"].to_numpy()
        for d in np.unique(right["dims"].to_numpy()).tolist():
            own = np.flatnonzero(size == d)
            own = own[np.argsort(ids[own])]
            x, mine = _vectors(left["x"].take(pa.array(own)), d), ids[own]
            some = right.filter(pa.compute.equal(right["dims"], d))
            for q, body, bar, led in zip(*(some[c].to_pylist() for c in ("q", "body", "bar", "led")), strict=True):
                at = np.searchsorted(mine, np.array(led))
                s = -((x[at] - np.frombuffer(body, np.float32)) ** 2).sum(1)
                best = _best(s[None, :], beam)[0]
                best = best[s[best] >= bar]
                u.append(np.full(len(best), q))
                v.append(mine[at[best]])
                out.append(s[best])
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.Table.from_arrays([pa.array(join(u, np.int64)), pa.array(join(v, np.int64)), pa.array(join(out, np.float32))], ["q", "v", "s"])

    def hop(key, left, right):
        """The beam with its best expanded and what they lead to taken in."""
        q, d, body, ids, sims, done = (left[c][0].as_py() for c in schema.names)
        ids, sims, done = np.array(ids), np.array(sims, np.float32), np.array(done)
        done[np.flatnonzero(~done)[:step]] = True
        more = right["v"].to_numpy()
        new = ~np.isin(more, ids)
        ids, sims, done = np.append(ids, more[new]), np.append(sims, right["s"].to_numpy()[new]), np.append(done, np.zeros(int(new.sum()), bool))
        at = np.lexsort((ids, -sims))[:beam]
        return pa.Table.from_arrays([pa.array([z], t) for z, t in zip((q, d, body, ids[at].tolist(), sims[at].tolist(), done[at].tolist()), schema.types, strict=True)], schema=schema)

    bar = F.when(F.size("sims") >= beam, F.element_at("sims", -1)).otherwise(F.lit(FAR).cast("float"))
    while True:
        live = state.filter(F.exists("done", lambda x: ~x))
        ended.append(state.filter(~F.exists("done", lambda x: ~x)).select("q", F.explode(F.slice("ids", 1, most)).alias("node")))
        if live.isEmpty():
            break
        open_ = F.filter(F.arrays_zip("ids", "done"), lambda x: ~x["done"])
        front = live.select("q", F.explode(F.slice(F.transform(open_, lambda x: x["ids"]), 1, step)).alias("node"))
        led = front.join(ways, "node").select("q", F.explode("led").alias("v")).withColumn("block", block("v"))
        led = led.groupBy("block", "q").agg(F.collect_set("v").alias("led")).join(live.select("q", "dims", "body", bar.alias("bar")), "q")
        found = places.groupBy("block").cogroup(led.groupBy("block")).applyInArrow(compare, "q long, v long, s float")
        state = cut(live.groupBy("q").cogroup(found.groupBy("q")).applyInArrow(hop, STATE), "beams")
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out


def nearest_neighbours(rows: DataFrame, is_query: F.Column, k: int = K, vector: str = "embedding", degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for every row where is_query holds."""
    spark = rows.sparkSession
    ship(spark)
    own = read_rows(rows, vector)
    nodes = make_nodes(own)
    entries = spark.sparkContext.broadcast(entry_nodes(nodes))
    edges = neighbour_graph(nodes, entries, degree)
    placed = own.select("row", "vec_id", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"])
    placed = cut(placed.select("row", "vec_id", "node"), "placed")
    asks = F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull()
    queries = placed.filter(asks).select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), F.col("node").alias("q"))
    found = search(nodes, edges, queries, entries, k + SPARE, beam)
    body = nodes.select("node", "v")
    pairs = found.join(body, "node").join(body.select(F.col("node").alias("q"), F.col("v").alias("w")), "q").select("q", "node", "v", "w")

    def score(batches):
        for b in batches:
            s = [cosine(np.asarray(b.column(2)[i].values), np.asarray(b.column(3)[i].values)) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], ["q", "node", "score"])

    scored = pairs.mapInArrow(score, "q long, node long, score double")
    # a class's least ids stand for all of it: no more than k of them, beside the query's own, can be in the result
    order = Window.partitionBy("node").orderBy(F.asc_nulls_last("vec_id"), "row")
    members = placed.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k + 1).drop("k")
    out = queries.join(scored, "q").join(members, "node").filter(F.col("row") != F.col("q_row"))
    w = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op11_neighbours": op11_neighbours}
