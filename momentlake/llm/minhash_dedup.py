"""MinHash near-dedup (7) with sequential Bayesian verification.

1. `sketch` reads every whole text once: words are maximal runs of non-space bytes, lower-cased in A-Z; the set of a
   document is its distinct shingles of `words` words (64-bit hashes; the whole sequence if there are fewer words).
   It keeps the set's size, a 128-bit fingerprint and N_HASHES MinHash values in BANDS bands.
2. Equal sets become one class, represented by its least doc_id.
3. Classes that agree in all values of a band are candidates.  Buckets are turned into families: the components of the
   links from every member of a bucket to the bucket's least member; no pairs are written.
4. A family of at most CHUNK classes is one group.  In a larger one each class is first compared with the one hub with
   which it shares most buckets, which joins near copies of one text in work linear in their number; then chunks of
   CHUNK classes are compared with each other, a group a pair of chunks, but no two of classes joined already.  In a
   group, pairs that share a band are compared by batches of BATCH values; a pair is pruned as soon as the posterior
   probability that its similarity reaches the threshold, from a uniform prior and the agreements so far, is below
   MISS.  Survivors are verified exactly on the full sets, in descending order of estimated similarity, unless they
   are already connected.  Only a spanning forest of links is written.
5. The forests' components are the result.

A pair of similarity 0.8 misses all bands with a probability of 3e-6, and is pruned wrongly with one below MISS a batch.

Defined results: a null, empty or all-space text has an empty set and links with nothing; a null doc_id takes no part
(component_id null, kept); rows that repeat a doc_id share its component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.llm.common import cut, extended, release, ship, slices, small_side, table, utf8, word_bounds
from momentlake.llm.components import components
from momentlake.llm.embedding_dedup import _Union

WORDS, PERCENT = 5, 80
BANDS, ROWS = 24, 4
N_HASHES, BATCH = BANDS * ROWS, 16
MISS = 1e-6
CHUNK = 64

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a public hash; x is changed."""
    x ^= x >> np.uint64(33)
    x *= _C[5]
    x ^= x >> np.uint64(33)
    x *= _C[6]
    x ^= x >> np.uint64(33)
    return x


_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_MULT = _rng.integers(1, 2**63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER: list[np.ndarray] = [np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n."""
    if len(_POWER[0]) < n:
        p = np.full(n, _C[0], np.uint64)
        q = np.full(n, np.uint64(pow(int(_C[0]), -1, 2**64)), np.uint64)
        p[0] = q[0] = 1
        _POWER[:] = [np.cumprod(p), np.cumprod(q)]
    return _POWER[0], _POWER[1] if len(_POWER) > 1 else _POWER[0]


def shingles(raw: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, one text after another, and their offsets."""
    n = len(off) - 1
    starts, ends, counts = word_bounds(raw, off)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    p, q = _powers(max(len(raw), 1 << 20))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * p[: len(raw)], out=sums[1:])
    w = _mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))
    first = np.concatenate([[0], np.cumsum(counts)])
    # texts of fewer words: the whole sequence, padded by nothing
    m = np.where(counts == 0, 0, np.maximum(1, counts - words + 1))
    at = np.concatenate([[0], np.cumsum(m)])
    doc = np.repeat(np.arange(n), m)
    begin = first[doc] + np.arange(at[-1]) - at[doc]
    stop = first[doc + 1]
    h = np.zeros(at[-1], np.uint64)
    for k in range(words):
        inside = begin + k < stop
        h = h * _C[1] + np.where(inside, w[np.minimum(begin + k, len(w) - 1)], _C[k % 5])
    h = _mix(h + np.minimum(counts, words)[doc].astype(np.uint64))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))])


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """N_HASHES minima (uint32) of every set that isn't empty; the others' rows are zero."""
    out = np.zeros((len(at) - 1, N_HASHES), np.uint32)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        begin = at[:-1][full]
        for k in range(N_HASHES):
            out[full, k] = np.minimum.reduceat(((h * _MULT[k]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, the band's number mixed in."""
    s = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * _C[2] + s[:, :, r])
    return key


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint) and sig of every row."""
    ship(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            raw, off = utf8(b.column(1))
            for a, z in slices(off, 300_000):
                h, at = shingles(raw[off[a] : off[z]], off[a : z + 1] - off[a], words)
                size = np.diff(at)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (_mix(h + _C[3]), _mix(h * _C[4] + _C[0]))]
                f1, f2 = ((s[at[1:]] - s[at[:-1]]).astype(np.int64) for s in sums)
                sig = signatures(h, at)
                flat = sig.tobytes()
                width = 4 * N_HASHES
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), pa.array(size), pa.array(f1), pa.array(f2), pa.array([flat[k * width : (k + 1) * width] if s else None for k, s in enumerate(size.tolist())], pa.binary())],
                    ["doc_id", "n_shingles", "f1", "f2", "sig"],
                )
            release()

    return src.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


_cutoffs: dict[tuple, list[int]] = {}


def cutoffs(threshold: float, miss: float = MISS) -> list[int]:
    """The least number of agreements after each batch at which a pair goes on.

    From a uniform prior, after m agreements in n values the similarity is Beta(m + 1, n - m + 1); the probability
    that it reaches t is that of at most m successes in n + 1 trials of chance t.
    """
    key = (threshold, miss)
    if key not in _cutoffs:
        out = []
        for n in range(BATCH, N_HASHES + 1, BATCH):
            total, m = 0.0, 0
            while m <= n:
                total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
                if total >= miss:
                    break
                m += 1
            out.append(m)
        _cutoffs[key] = out
    return _cutoffs[key]


def link_group(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of left and of right (indices into sig and sets)."""
    if not len(left) or not len(right):
        return []
    keys = band_keys(sig)
    share = np.zeros((len(left), len(right)), bool)
    for k in range(BANDS):
        share |= keys[left, k][:, None] == keys[right, k][None, :]
    i, j = np.nonzero(share)
    i, j = left[i], right[j]
    ok = i != j
    i, j = i[ok], j[ok]
    i, j = np.minimum(i, j), np.maximum(i, j)
    agreed = np.zeros(len(i), np.int64)
    for step, least in enumerate(cutoffs(percent / 100)):
        part = slice(step * BATCH, (step + 1) * BATCH)
        agreed = agreed + (sig[i, part] == sig[j, part]).sum(1)
        ok = agreed >= least
        i, j, agreed = i[ok], j[ok], agreed[ok]
    size = np.array([len(x) for x in sets])
    ok = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
    i, j, agreed = i[ok], j[ok], agreed[ok]
    order = np.argsort(-agreed, kind="stable")
    union, forest = _Union(len(sets)), []
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if union.find(a) == union.find(b):
            continue
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * both >= percent * (size[a] + size[b] - both):
            union.join(a, b)
            forest.append((a, b))
    return forest


def _bands(batches):
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, N_HASHES)
        ids = np.repeat(b.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(band_keys(sig).ravel().astype(np.int64)), pa.array(ids)], ["band", "node"])


def families(sketches: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, component of every class representative that shares a band with another; and node, hub, n: how many
    buckets the node shares with a hub, the least member of each."""
    reps = small_side(classes.select(F.col("rep").alias("doc_id")))
    own = sketches.filter(F.col("n_shingles") > 0).join(reps, "doc_id", "left_semi")
    bands = own.select("doc_id", "sig").mapInArrow(_bands, "band long, node long")
    buckets = cut(bands.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter(F.col("hub") < F.col("top")).select("band", "hub"), "buckets")
    hubs = cut(bands.join(small_side(buckets), "band").filter(F.col("node") != F.col("hub")).groupBy("node", "hub").agg(F.count("*").alias("n")), "hubs")
    return cut(components(hubs.select(F.col("node").alias("u"), F.col("hub").alias("v"))), "families"), hubs


def with_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """members (doc_id and others) with sig and set, the MinHash values and the sorted set of the document."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(small_side(cut(members, "members")), "doc_id").select("text", *members.columns)
    schema = extended(src.drop("text"), sig="binary", set="binary")

    def run(batches):
        for b in batches:
            raw, off = utf8(b.column(0))
            for a, z in slices(off, 300_000):
                h, at = shingles(raw[off[a] : off[z]], off[a : z + 1] - off[a], words)
                part = [b.column(k).slice(a, z - a) for k in range(1, b.num_columns)]
                sig = pa.array([x.tobytes() for x in signatures(h, at)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part, sig, pa.array([h[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], [f.name for f in schema])
            release()

    return src.mapInArrow(run, schema)


def linked(rows: DataFrame, by: list[str], percent: int) -> DataFrame:
    """u, v: a spanning forest of the verified links between the rows with l and those with r of each group.

    rows: doc_id, l, r, sig, set and the columns in by."""

    def run(t):
        node, l, r = (t[c].to_numpy() for c in ("doc_id", "l", "r"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, N_HASHES)
        own = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
        found = link_group(sig, own, np.flatnonzero(l), np.flatnonzero(r), percent)
        u, v = (node[[p[k] for p in found]] if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.Table.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.groupBy(*by).applyInArrow(run, "u long, v long")


def star_links(docs: DataFrame, hubs: DataFrame, words: int, percent: int, chunk: int) -> DataFrame:
    """Links of nodes to the hub with which they share the most buckets: each set goes to one group, a hub's to one a chunk."""
    best = cut(hubs.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "hub"))["hub"].alias("hub")), "best")
    chunks = cut(best.groupBy("hub").agg(F.ceil(F.count("*") / chunk).cast("int").alias("k")), "chunks")
    salt = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    nodes = best.join(small_side(chunks), "hub").select(F.col("node").alias("doc_id"), "hub", salt.alias("first"), salt.alias("last"))
    centres = chunks.select(F.col("hub").alias("doc_id"), "hub", F.lit(0).alias("first"), (F.col("k") - 1).alias("last"))
    rows = with_sets(docs, nodes.unionByName(centres), words).withColumn("salt", F.explode(F.sequence("first", "last")))
    hub = F.col("doc_id") == F.col("hub")
    return linked(rows.select("hub", "salt", "doc_id", hub.alias("l"), (~hub).alias("r"), "sig", "set"), ["hub", "salt"], percent)


def links(docs: DataFrame, family: DataFrame, hubs: DataFrame, words: int, percent: int, chunk: int) -> DataFrame:
    """u, v: verified links that connect all that any link of a family connects.

    A family of at most chunk classes is one group.  In a larger one, stars come first; then only members of different
    stars are compared: a star of at least chunk members is cut into chunks of its own, the others' members share
    chunks, and every two chunks are a group unless they are of one star.
    """
    family = family.select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    large = cut(family.groupBy("family").agg(F.count("*").alias("m")).filter(F.col("m") > chunk).select("family"), "large")
    pooled = [F.lit(1).alias("pool"), F.col("family").alias("unit")]
    if large.isEmpty():
        rows = with_sets(docs, family, words)
        return linked(rows.select("family", "doc_id", F.lit(True).alias("l"), F.lit(True).alias("r"), "sig", "set"), ["family"], percent)
    big = cut(family.join(small_side(large), "family", "left_semi").select("doc_id", "family"), "big")
    in_big = hubs.join(small_side(big.select(F.col("doc_id").alias("node"))), "node", "left_semi")
    stars = cut(star_links(docs, in_big, words, percent, chunk), "stars")
    found = cut(components(stars), "found")
    big = cut(big.join(small_side(found), F.col("doc_id") == F.col("node"), "left").select("doc_id", "family", F.coalesce("component", "doc_id").alias("star")), "star-members")
    sizes = cut(big.groupBy("family", "star").agg(F.count("*").alias("m")), "star-sizes")
    chunks = F.ceil(F.col("m") / chunk).cast("int").alias("k")
    units = sizes.filter(F.col("m") >= chunk).select("family", F.lit(0).alias("pool"), F.col("star").alias("unit"), chunks)
    rest = sizes.filter(F.col("m") < chunk).groupBy("family").agg(F.sum("m").alias("m")).select("family", *pooled, chunks)
    units = cut(units.unionByName(rest), "units")
    own = small_side(units.filter("pool = 0").select("family", F.col("unit").alias("star"), F.col("k").alias("k0")))
    pool = small_side(units.filter("pool = 1").select("family", F.col("k").alias("k1")))
    big = big.join(own, ["family", "star"], "left").join(pool, "family", "left")
    big = big.select(
        "doc_id",
        "family",
        F.lit(1).alias("large"),
        F.when(F.col("k0").isNull(), 1).otherwise(0).alias("pool"),
        F.when(F.col("k0").isNull(), F.col("family")).otherwise(F.col("star")).alias("unit"),
        F.pmod(F.xxhash64("doc_id"), F.coalesce("k0", "k1")).cast("int").alias("salt"),
    )
    few = family.join(small_side(large), "family", "left_anti").select("doc_id", "family", F.lit(0).alias("large"), *pooled, F.lit(0).alias("salt"))
    others = units.select(F.col("family").alias("f"), F.col("pool").alias("p"), F.col("unit").alias("u"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("s"))
    one_star = (F.col("pool") == 0) & (F.col("p") == 0) & (F.col("unit") == F.col("u"))
    rows = with_sets(docs, few.unionByName(big), words).join(small_side(cut(others, "others")), (F.col("family") == F.col("f")) & ~one_star, "left")
    rows = rows.filter((F.col("large") == 0) | F.col("f").isNotNull())
    mine = F.struct("pool", "unit", "salt")
    other = F.when(F.col("f").isNull(), mine).otherwise(F.struct(F.col("p").alias("pool"), F.col("u").alias("unit"), F.col("s").alias("salt")))
    rows = rows.select("family", F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"), mine.alias("mine"), "doc_id", "sig", "set")
    rows = rows.select("family", "i", "j", "doc_id", (F.col("mine") == F.col("i")).alias("l"), (F.col("mine") == F.col("j")).alias("r"), "sig", "set")
    flat = [F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ij" for c in ("pool", "unit", "salt")]
    names = [f"{x}_{c}" for x in "ij" for c in ("pool", "unit", "salt")]
    return stars.unionByName(linked(rows.select("family", *flat, "doc_id", "l", "r", "sig", "set"), ["family", *names], percent))


def duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text)."""
    sketches = cut(sketch(docs, words), "sketches")
    full = sketches.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = cut(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(links(docs, *families(sketches, classes), words, percent, chunk))
    known = classes.join(found, F.col("rep") == F.col("node"), "left").select("f1", "f2", F.coalesce("component", "rep").alias("c"))
    out = sketches.join(small_side(cut(known, "known")), ["f1", "f2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4)


def stage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least doc_id, once if its row is repeated.

    Null, empty and all-space texts are duplicates of nothing, nor are rows without a doc_id; an empty table stays empty."""
    found = cut(duplicates(docs.select("doc_id", "text")), "duplicates")
    gone = small_side(cut(found.filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct(), "gone"))
    out = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    again = found.filter("kept").groupBy("doc_id").count().filter((F.col("count") > 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("again"))
    again = cut(again, "again")
    if again.isEmpty():
        return out
    twice = small_side(again)
    once = out.join(twice, out["doc_id"] == twice["again"], "left_anti")
    return once.unionByName(out.join(twice, out["doc_id"] == twice["again"], "left_semi").dropDuplicates(["doc_id"]))


QUERIES = {"op7_minhash_dedup": op7_minhash_dedup}

ORACLE = {
    "op7_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i+3], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, hash(unnest(sh)) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s q ON q.doc_id = a JOIN s r ON r.doc_id = b WHERE 100 * n >= 80 * (len(q.sh) + len(r.sh) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
}
