"""Embedding whitening (13) with exact moments by a digit-slice product.

A component c becomes the integer x = floor(256 c).  The model is fitted on the different vectors x, each once:

1. a task splits the integers of a slice of rows into limbs of 16 bits.  The products of two limbs are below 2^32, so a
   float64 matrix product over up to 2^20 rows is exact; products of limbs are shifted and added as big integers.  A
   column of ones beside the vectors brings the count and the sums along.
2. Tasks hand their matrices on in digits of 32 bits, entry by entry, which Spark adds up as longs on both sides of the
   shuffle; the sums are recombined as big integers, so n, S and M = sum of x x' are exact.
3. V = (n M - S S') / n^2 is centred before it is rounded.  Its leading eigenvectors come from a double precision solver
   (from Jacobi rotations, which keep small eigenvalues accurate, if the leading ones differ by more than 10^8), and
   each eigenvalue is the exact quadratic form of its vector.

Rows are projected as n x - S, exactly where longs hold it, and the whitened fit list's covariance is measured against
the identity with centred moments, merged slice by slice.

Defined results: vectors that are null or hold null or non-finite components are dropped; empty vectors have no
components and give no rows; vectors of each length are a fit of their own; repeated rows are rows of their own and
count once in the fit; null ids go along.  A direction of no variance has whitened null and explained 0 and isn't part
of identity_error (null if there is none other).  256 c beyond the range of a long is the nearest long; a deviation
beyond it is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.llm.common import BROADCAST_BYTES, cut, discard, ship, table

K = 4
LIMB, DIGIT, DIGITS = 16, 32, 6
#: Entries of the vectors of a slice; and rows, so that sums of products of two limbs stay exact.
ENTRIES, ROWS = 1 << 20, 1 << 20


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Signed integers as float64 limbs, low ones first; only the last is signed."""
    n = 1
    while x.size and not (-(1 << (LIMB * n - 1)) <= int(x.min()) and int(x.max()) < 1 << (LIMB * n - 1)):
        n += 1
    low = [((x >> (LIMB * i)) & ((1 << LIMB) - 1)).astype(np.float64) for i in range(n - 1)]
    return [*low, (x >> (LIMB * (n - 1))).astype(np.float64)]


def gram(x: np.ndarray) -> np.ndarray:
    """x' x of a matrix of longs, exactly, as an array of Python integers."""
    parts = limbs(x)
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts[i:], i):
            p = (a.T @ b).astype(np.int64).astype(object)
            out = out + ((p if i == j else p + p.T) << (LIMB * (i + j)))
    return out


def digits(values: np.ndarray) -> list[np.ndarray]:
    """Python integers in DIGITS digits of 32 bits, the last signed."""
    low = [((values >> (DIGIT * i)) & ((1 << DIGIT) - 1)).astype(np.int64) for i in range(DIGITS - 1)]
    return [*low, (values >> (DIGIT * (DIGITS - 1))).astype(np.int64)]


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and the matrix of the vectors of one length, in slices."""
    k = batch.schema.get_field_index(column)
    lists = batch.column(k)
    size = np.asarray(lists.value_lengths())
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        step = max(1, min(ROWS, ENTRIES // max(d, 1)))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            yield d, some, np.asarray(lists.take(pa.array(some)).flatten()).reshape(len(some), d)


def moments(fit: DataFrame) -> DataFrame:
    """dims, i, j (i <= j; the last of each is the column of ones) and the digits of the sums of products of a column x."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, some, x in _matrices(b, "x"):
                g = gram(np.concatenate([x, np.ones((len(some), 1), np.int64)], 1))
                total[d] = total[d] + g if d in total else g
        for d, g in total.items():
            i, j = np.triu_indices(d + 1)
            own = [pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), *map(pa.array, digits(g[i, j]))]
            yield pa.RecordBatch.from_arrays(own, ["dims", "i", "j", *(f"d{k}" for k in range(DIGITS))])

    schema = "dims long, i long, j long, " + ", ".join(f"d{k} long" for k in range(DIGITS))
    return fit.select("x").mapInArrow(run, schema).groupBy("dims", "i", "j").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)])


def jacobi(v: np.ndarray, sweeps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of a positive semidefinite matrix by cyclic rotations."""
    a, q = v.copy(), np.eye(len(v))
    for _ in range(sweeps):
        turned = False
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if a[i, j] == 0 or abs(a[i, j]) <= 1e-17 * np.sqrt(abs(a[i, i] * a[j, j])):
                    continue
                turned = True
                t = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(1.0, t))
                c = 1 / np.hypot(1.0, t)
                turn = np.array([[c, c * t], [-c * t, c]])
                a[:, [i, j]] = a[:, [i, j]] @ turn
                a[[i, j]] = turn.T @ a[[i, j]]
                q[:, [i, j]] = q[:, [i, j]] @ turn
        if not turned:
            break
    return np.diag(a), q


def solve(n: int, s: np.ndarray, m: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, float]:
    """The k leading eigenvalues (0 where there is no variance), their unit vectors as rows, and the trace of V."""
    centred = n * m - np.outer(s, s)
    square = n * n
    v = np.array([[x / square for x in row] for row in centred.tolist()])
    values, vectors = np.linalg.eigh(v)
    if values[-k:][0] < 1e-8 * values[-1] and values[-1] > 0:
        values, vectors = jacobi(v)
    best = np.argsort(-values, kind="stable")[:k]
    out, exact = vectors[:, best].T, []
    for u in out:
        whole = np.array([int(z) for z in np.rint(u * 2.0**60)], object)
        exact.append(int(whole @ (centred @ whole)) / (int(whole @ whole) * square))
    exact = np.array(exact)
    exact[exact <= 1e-24 * exact.max(initial=0)] = 0
    again = np.argsort(-exact, kind="stable")
    return exact[again], out[again], int(np.trace(centred)) / square


class Model:
    """n, S and the components of the vectors of one length."""

    def __init__(self, n: int, s: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.s, self.values, self.vectors, self.trace, self.error = n, np.array(s, object), values, vectors, trace, None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S: longs if they hold it, Python integers if not."""
        most = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.s), default=0)
        return self.n * x - self.s.astype(np.int64) if most < 1 << 62 else self.n * x.astype(object) - self.s

    def deviation(self, d: np.ndarray) -> pa.Array:
        most = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0))))
        if most * most * d.shape[1] < 1 << 63 and d.dtype != object:
            return pa.array((d * d).sum(1))
        total = (d.astype(object) ** 2).sum(1)
        return pa.array([z if z < 1 << 63 else None for z in total.tolist()], pa.int64())

    def whitened(self, d: np.ndarray) -> np.ndarray:
        """One column a component; not a number where there is no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = d.astype(np.float64) / self.n @ self.vectors.T / np.sqrt(self.values)
        out[:, self.values == 0] = np.nan
        return out


def fitted(fit: DataFrame, k: int = K) -> Iterator[dict[int, Model]]:
    """Models by length, in parts of at most BROADCAST_BYTES; lengths are no more than the longest vector's entries."""

    def run(key, t):
        d = key[0].as_py()
        value = np.zeros(len(t), object)
        for z in range(DIGITS):
            value = value + (t[f"d{z}"].to_numpy().astype(object) << (DIGIT * z))
        i, j, m = t["i"].to_numpy(), t["j"].to_numpy(), np.zeros((d + 1, d + 1), object)
        m[i, j] = m[j, i] = value
        values, vectors, trace = solve(m[d, d], m[d, :d], m[:d, :d], k)
        return pa.Table.from_pydict({
            "dims": [d], "n": [str(m[d, d])], "s": [[str(z) for z in m[d, :d]]], "e": [values.tolist()], "u": [vectors.ravel().tolist()], "trace": [trace],
        }, schema=pa.schema([("dims", pa.int64()), ("n", pa.string()), ("s", pa.list_(pa.string())), ("e", pa.list_(pa.float64())), ("u", pa.list_(pa.float64())), ("trace", pa.float64())]))

    models = cut(moments(fit).groupBy("dims").applyInArrow(run, "dims long, n string, s array<string>, e array<double>, u array<double>, trace double"), "models")
    part, held = {}, 0
    for r in models.orderBy("dims").toLocalIterator():
        size = r.dims * (8 * len(r.e) + 48)
        if part and held + size > BROADCAST_BYTES:
            yield part
            part, held = {}, 0
        part[r.dims] = Model(int(r.n), [int(z) for z in r.s], np.array(r.e), np.array(r.u).reshape(-1, r.dims), r.trace)
        held += size
    if part:
        yield part
    discard(models)


def identity_errors(fit: DataFrame, models: dict[int, Model], k: int = K) -> dict[int, float | None]:
    """By length, the largest entry of the fit list's whitened covariance minus the identity."""
    known = fit.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for b in batches:
            for d, some, x in _matrices(b, "x"):
                model = known.value[d]
                w = np.zeros((len(some), k))
                w[:, : len(model.values)] = np.nan_to_num(model.whitened(model.centred(x)))
                mean = w.mean(0)
                own = (w - mean).T @ (w - mean)
                yield pa.RecordBatch.from_pydict({"dims": [d], "n": [len(some)], "m": [mean.tolist()], "q": [own.ravel().tolist()]}, schema=schema)

    schema = pa.schema([("dims", pa.int64()), ("n", pa.int64()), ("m", pa.list_(pa.float64())), ("q", pa.list_(pa.float64()))])
    parts = cut(fit.filter(F.size("x").isin(list(models))).select("x").mapInArrow(run, "dims long, n long, m array<double>, q array<double>"), "slices")
    total = parts.groupBy("dims").agg(F.sum("n").alias("all"), *[(F.sum(F.col("n") * F.col("m")[i]) / F.sum("n")).alias(f"m{i}") for i in range(k)])
    off = lambda i: F.col("m")[i] - F.col(f"m{i}")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = [(F.sum(F.col("q")[i * k + j] + F.col("n") * off(i) * off(j)) / F.first("all")).alias(f"c{i}_{j}") for i, j in pairs]
    out = dict.fromkeys(models)
    for r in parts.join(F.broadcast(total), "dims").groupBy("dims").agg(*cov).collect():  # a row a length
        there = np.flatnonzero(models[r.dims].values > 0)
        errors = [abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if i in there and j in there]
        out[r.dims] = max(errors, default=None)
    discard(parts)
    return out


def whiten(rows: DataFrame, k: int = K, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row that isn't dropped."""
    spark = rows.sparkSession
    ship(spark)
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(c * 256).cast("long"))
    good = rows.filter(v.isNotNull() & ~bad & (F.size(v) > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fit = cut(good.select("x").distinct(), "fit")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], schema)

    for models in fitted(fit, k):
        for d, error in identity_errors(fit, models, k).items():
            models[d].error = error
        known = spark.sparkContext.broadcast(models)

        def run(batches, known=known):
            for b in batches:
                for d, some, x in _matrices(b, "x"):
                    model = known.value[d]
                    c = model.centred(x)
                    w, p, n = model.whitened(c), len(model.values), len(some)
                    share = model.values / model.trace if model.trace > 0 else np.zeros(p)
                    rep, numbers = np.repeat(np.arange(n), p), np.tile(np.arange(1, p + 1, dtype=np.int32), n)
                    flat = w.ravel()
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(pa.array(some[rep])), pa.array(numbers), pa.array(np.full(n * p, model.n)), model.deviation(c).take(pa.array(rep)),
                        pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(share, n)), pa.array([model.error] * (n * p), pa.float64()),
                    ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        out = out.unionByName(good.filter(F.size("x").isin(list(models))).mapInArrow(run, schema))
    discard(fit)
    return out


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
