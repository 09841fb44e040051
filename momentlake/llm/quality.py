"""Quality classifier (2): hierarchical empirical Bayes over documents, hosts and paths.

1. Document evidence: a logistic model on a few measures of the whole text (shares of kinds of bytes, repetition,
   word lengths), fitted on at most MAX_FIT labelled documents, gives each document a log-likelihood ratio of good
   to bad (the model's log-odds less those of its training sample).
2. Site evidence: the ratio with the global rate gives each document an expected good count; these are summed per
   host and per path.  The spread of the hosts' rates around the global rate (method of moments) sets the strength
   of the global prior for hosts, and that of paths around their hosts the strength of the host's prior for paths.
   Sparse sites so shrink towards their host, and sparse hosts towards the global rate.
3. The posterior of a document combines its ratio with the rate of its path, from which its own count is left out.

Documents have no url: in the query and the pipeline `source` stands for the host and `lang` for the path, the one
column that divides a source further, so the path level is the rate of a language within a source.

Defined results: a null or empty text has the measures of an empty text; a null host or path is a site of its own;
labels that are null or of unknown documents are ignored, and a document labelled more than once counts once, as bad
if one label is bad; repeated rows are scored alike; without both kinds of labels the ratio is 0 and the rate 1/2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.llm.common import SPACE, cut, extended, release, ship, slices, small_side, table, utf8, word_bounds

#: At most about so many labelled documents fit the document classifier; chosen by a hash of their id.
MAX_FIT = 20_000
#: The least and most pseudo-counts of a prior.
LEAST, MOST = 2.0, 1000.0
#: A document is kept if its posterior probability of being good is at least this.
KEEP = 0.5

_KIND = np.zeros(256, np.int64)  # 0 other punctuation
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[128:] = 4
_KIND[SPACE] = 5
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 6
_KIND[10] = 7
_NAMES = 8
N_FEATURES = 15
#: The measure log(1 + words) / 10; doubles give the count back exactly.
WORDS_AT = 13


def measures(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES for each text."""
    n = len(off) - 1
    kind = _KIND[raw]
    size = np.diff(off).astype(float)
    doc = np.repeat(np.arange(n), np.diff(off))
    share = np.bincount(doc * _NAMES + kind, minlength=n * _NAMES).reshape(n, _NAMES) / np.maximum(size, 1)[:, None]
    starts, ends, counts = word_bounds(raw, off)
    length = (ends - starts).astype(float)
    wdoc = np.repeat(np.arange(n), counts)
    words = np.maximum(counts, 1)
    mean = np.bincount(wdoc, length, n) / words
    # words as 64-bit sums of their bytes times powers: equal words are equal, others hardly ever
    mixed = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(255, 0xD6E8FEB86659FD93, np.uint64))])
    w = np.zeros(len(starts), np.uint64)
    if len(starts):
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else np.arange(len(raw)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(raw))))])
        term = mixed * power[np.clip(place, 0, 255)]
        term[SPACE[raw]] = 0
        w = np.add.reduceat(term, starts)
    key = w ^ (wdoc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.lexsort((key, wdoc))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (wdoc[order][1:] != wdoc[order][:-1])
    distinct = np.bincount(wdoc[order][new], minlength=n) / words
    same = np.zeros(len(w), bool)
    same[1:] = (w[1:] == w[:-1]) & (wdoc[1:] == wdoc[:-1])
    repeated = np.bincount(wdoc[same], minlength=n) / words
    odd = np.zeros(len(starts), bool)
    if len(starts):
        odd = (_KIND[raw[ends - 1]] == 0) & (length > 0)
    tail = np.bincount(wdoc[odd], minlength=n) / words
    return np.column_stack([share, np.log1p(size) / 10, mean / 10, distinct, repeated, tail, np.log1p(counts) / 10, np.minimum(1, 50 * share[:, 0])])


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression with a small ridge by Newton's method: (mean, scale, weights with bias last, prior log-odds)."""
    if len(y) == 0 or y.all() or not y.any():
        return np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.0
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    rate = y.mean()
    return mean, scale, w, float(np.log(rate / (1 - rate)))


def _features(raw, off):
    for a, z in slices(off, 300_000):
        yield measures(raw[off[a] : off[z]], off[a : z + 1] - off[a])


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT):
    """The document model."""
    ship(docs.sparkSession)
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = marks.count()
    if n > max_fit:  # a stated bound on the sample; by hash, so that reruns agree
        marks = marks.filter(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_000)) < F.lit(max(1, max_fit * 1_000_000 // n)))
    rows = docs.select("doc_id", "text").join(small_side(marks), "doc_id").select("text", F.col("quality").cast("int").alias("y"))

    def run(batches):
        for b in batches:
            x = list(_features(*utf8(b.column(0))))
            if x:
                flat = np.concatenate(x).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), N_FEATURES).cast(pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = rows.mapInArrow(run, "x array<double>, y int").toArrow()  # about max_fit rows of N_FEATURES numbers
    if got.num_rows == 0:
        return _fit(np.zeros((0, N_FEATURES)), np.zeros(0))
    return _fit(np.array(got["x"].to_pylist()), (got["y"].to_numpy() > 0).astype(float))


def evidence(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """docs with the columns __llr, the log-likelihood ratio of good to bad, and __words, the words of the whole text."""
    ship(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    src = docs.toDF(*names)
    at = docs.columns.index(text)
    schema = extended(src, __llr="double", __words="long")
    mean, scale, w, prior = model

    def run(batches):
        for b in batches:
            x = list(_features(*utf8(b.column(at))))
            x = np.concatenate(x) if x else np.zeros((0, N_FEATURES))
            llr = np.clip((x - mean) / scale @ w[:-1] + w[-1] - prior, -20, 20)
            words = np.rint(np.expm1(10 * x[:, WORDS_AT])).astype(np.int64)
            release()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(llr), pa.array(words)], [*names, "__llr", "__words"])

    return src.mapInArrow(run, schema).toDF(*docs.columns, "__llr", "__words")


def _strength(rate, n, around):
    """Pseudo-counts of a Beta prior by the method of moments, from the rates of groups weighted by their sizes.

    Var(rate) = v + m (1 - m) / n around the mean m; the prior's own variance v gives m (1 - m) / v - 1.
    """
    m = around * (1 - around)
    spread = F.sum(n * (rate - around) * (rate - around)) - F.sum(m)
    v = F.greatest(spread / F.sum(n), F.lit(1e-9))
    return F.least(F.greatest(F.avg(m) / v - 1, F.lit(LEAST)), F.lit(MOST))


def sites(narrow: DataFrame, rate: float) -> DataFrame:
    """host, path, good and n (its documents' expected counts), host_rate and the prior's strength per path.

    narrow: host, path, __llr of every document; partial sums are made before the shuffle.
    """
    odds = rate / (1 - rate)
    p = F.lit(1.0) - 1 / (1 + odds * F.exp("__llr"))
    paths = cut(narrow.groupBy("host", "path").agg(F.sum(p).alias("good"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("n").alias("hn"))
    # one row of global figures
    g = hosts.agg((F.sum("hg") / F.sum("hn")).alias("mu")).first()
    mu = float(g.mu) if g.mu is not None else 0.5
    mu = min(max(mu, 1e-6), 1 - 1e-6)
    a = hosts.agg(_strength(F.col("hg") / F.col("hn"), F.col("hn"), F.lit(mu)).alias("a")).first().a or LEAST
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("hg") + a * mu) / (F.col("hn") + a)).alias("host_rate"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    both = cut(both, "sites")
    b = both.agg(_strength(F.col("good") / F.col("n"), F.col("n"), F.col("host_rate")).alias("b")).first().b or LEAST
    return both.withColumn("strength", F.lit(float(b)))


def posterior(docs: DataFrame, site: DataFrame, rate: float, host: F.Column, path: F.Column) -> DataFrame:
    """docs with __llr, and __host_rate, __path_rate and __good, the posterior probability of being good."""
    s = small_side(site.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("good").alias("__g"), F.col("n").alias("__n"), F.col("host_rate").alias("__host_rate"), F.col("strength").alias("__b")))
    out = docs.join(s, host.eqNullSafe(F.col("__h")) & path.eqNullSafe(F.col("__p")), "left")
    own = F.lit(1.0) - 1 / (1 + rate / (1 - rate) * F.exp("__llr"))
    path_rate = (F.col("__g") - own + F.col("__b") * F.col("__host_rate")) / (F.col("__n") - 1 + F.col("__b"))
    path_rate = F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = out.withColumn("__path_rate", path_rate)
    good = F.lit(1.0) - 1 / (1 + F.col("__path_rate") / (1 - F.col("__path_rate")) * F.exp("__llr"))
    return out.withColumn("__good", good).drop("__h", "__p", "__g", "__n", "__b")


def base_rate(model) -> float:
    return float(1 / (1 + np.exp(-model[3])))


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep, as a written table, with __llr, __words, __host_rate, __path_rate and __good, the posterior.

    Texts are measured once: what comes of them is written and then read for the sites and for the posteriors.  The
    table may be discarded once nothing reads the result any more.
    """
    model = fit(docs, labels)
    rate = base_rate(model)
    more = [c for c in ("source", "lang", text) if c not in keep]
    seen = evidence(docs.select(*[F.col(f"`{c}`") for c in [*keep, *more]]), model, text)
    seen = cut(seen.drop(*([text] if text in more else [])), "evidence")
    site = sites(seen.select(F.col("source").alias("host"), F.col("lang").alias("path"), "__llr"), rate)
    out = posterior(seen, site, rate, F.col("source"), F.col("lang"))
    out._momentlake_path = seen._momentlake_path
    return out


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", F.col("__llr").alias("llr"), F.col("__host_rate").alias("host_rate"), F.col("__path_rate").alias("path_rate"), F.col("__good").alias("score"), (F.col("__good") >= KEEP).alias("kept"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely good than bad.

    Null and empty texts are judged like others; repeated rows stay or go together; an empty table stays empty; without
    labels of both kinds all stay, at a posterior of 1/2.
    """
    out = judged(docs, table(spark, sf_dir, "labels"), docs.columns)
    return out.filter(F.col("__good") >= KEEP).select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op2_quality": op2_quality}
