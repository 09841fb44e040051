"""Language ID (6): multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every character that isn't a letter or mark counts as one space, runs of them as one; all 1-, 2-
and 3-grams of what is left are hashed into BUCKETS.  `fit` sums n-gram counts of a bounded sample of labelled
documents in Spark; the log-probability matrix (BUCKETS x languages) is broadcast, and `predict` adds up its columns
for the n-grams that a text has, a batch of whole texts at a time in numpy.

The posterior says which of the learned languages a text is in if it is in one of them: over a sentence it is near 1
whatever the text.  Whether it is in one at all, the stage of the pipeline tells by the mean log-probability of its
n-grams beside that of the training texts (see `Clear`).

Defined results: a text that is null or has no letter gets `und` and score 0; equal scores go to the language that
comes first by code point; repeated rows are each predicted alike; without any labelled row all is `und`.  Only the
columns named are read, whatever else the table holds.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.llm.common import cut, extended, release, ship, slices, table

BUCKETS = 1 << 15
#: At most about so many labelled documents are counted for the model; they are chosen by a hash of their id.
MAX_FIT = 20_000
SMOOTHING = 0.1
#: The matrix is sent to every worker, 128 kB a language; more languages than this are an error.
MAX_LANGS = 1000
#: A text is clearly of its language if no more than about this share of its n-grams is as unlike it as any, and more
#: by so many standard errors for short texts.
UNLIKE, ERRORS = 0.2, 3.0

_known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, whether a letter or mark, and its lower case (if that is one character)."""
    global _known
    if _known is None:
        kind = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
        letter = kind == "L"
        lower = np.arange(len(kind), dtype=np.uint32)
        for c in np.flatnonzero(letter).tolist():
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
        _known = letter, letter | (kind == "M"), lower
    return _known


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, the text each one is from, and which texts have a letter."""
    letter, part, lower = _tables()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    has = np.zeros(len(texts), bool)
    has[doc[letter[cps]]] = True
    c = np.where(part[cps], lower[cps], 32).astype(np.uint32)
    first = np.ones(len(c), bool)
    first[1:] = doc[1:] != doc[:-1]
    again = np.zeros(len(c), bool)
    again[1:] = (c[1:] == 32) & (c[:-1] == 32) & ~first[1:]
    c, doc = c[~again], doc[~again]
    a = c * np.uint32(0x9E3779B1)
    grams, of = [a], [doc]
    if len(c) > 1:
        two = a[:-1] * np.uint32(31) + c[1:] * np.uint32(0x85EBCA77) + np.uint32(1)
        same = doc[:-1] == doc[1:]
        grams.append(two[same])
        of.append(doc[:-1][same])
        if len(c) > 2:
            three = two[:-1] * np.uint32(31) + c[2:] * np.uint32(0xC2B2AE3D) + np.uint32(2)
            same = doc[:-2] == doc[2:]
            grams.append(three[same])
            of.append(doc[:-2][same])
    g = np.concatenate(grams)
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x2C1B3C6D)
    return (g >> np.uint32(17)).astype(np.int32), np.concatenate(of), has


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, where: F.Column, max_fit: int = MAX_FIT) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of BUCKETS x languages) of the rows where `where` holds and lang isn't null."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").filter(where & F.col("lang").isNotNull())
    n = rows.count()
    if n > max_fit:  # a stated bound on the sample; by hash, so that reruns agree
        rows = rows.filter(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_000)) < F.lit(max(1, max_fit * 1_000_000 // n)))

    def count(batches):
        for b in batches:
            langs = np.array([x or "" for x in b.column("lang").to_pylist()], object)
            texts = [x or "" for x in b.column("text").to_pylist()]
            names, which = np.unique(langs.astype(str), return_inverse=True) if len(langs) else ([], None)
            sums = np.zeros((len(names), BUCKETS), np.int64)
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            for a, z in slices(off, 300_000):
                g, of, _ = ngrams(texts[a:z])
                sums += np.bincount(which[a:z][of].astype(np.int64) * BUCKETS + g, minlength=sums.size).reshape(sums.shape)
            release()
            for k, name in enumerate(names):
                at = np.flatnonzero(sums[k])
                yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(at)), pa.array(at.astype(np.int32)), pa.array(sums[k][at])], ["lang", "bucket", "n"])

    counts = cut(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    names = counts.select("lang").distinct().limit(MAX_LANGS + 1).count()
    if names > MAX_LANGS:
        raise ValueError(f"lang has more than {MAX_LANGS} different values")
    got = counts.toArrow()  # at most BUCKETS rows a language
    langs = sorted(set(got["lang"].to_pylist()))
    m = np.zeros((BUCKETS, len(langs)))
    if langs:
        index = {x: k for k, x in enumerate(langs)}
        m[got["bucket"].to_numpy(), [index[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
        m = np.log((m + SMOOTHING) / (m.sum(0) + SMOOTHING * BUCKETS))
    return langs, m


class Clear:
    """Whether a text's mean log-probability per n-gram is near enough to that of its language's training texts.

    The model gives the mean and spread over the n-grams of the training texts themselves, and the mean over all
    buckets, which is that of n-grams which have nothing to do with the language.
    """

    def __init__(self, m: np.ndarray):
        p = np.exp(m)
        self.own = (p * m).sum(0)
        self.spread = np.sqrt(np.maximum((p * m * m).sum(0) - self.own**2, 0))
        self.any = m.mean(0)

    def __call__(self, best: np.ndarray, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not len(self.own):
            return np.zeros(len(best), bool)
        least = self.own - UNLIKE * (self.own - self.any)
        return (best >= 0) & (mean >= least[best] - ERRORS * self.spread[best] / np.sqrt(np.maximum(n, 1)))


def evidence(texts: list[str], langs: list[str], m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the best language's number (-1: none), its posterior, its mean log-probability an n-gram, and n-grams."""
    best = np.full(len(texts), -1)
    p, mean = np.zeros(len(texts)), np.zeros(len(texts))
    n = np.zeros(len(texts), np.int64)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for a, z in slices(off, 300_000):
        g, of, has = ngrams(texts[a:z])
        if not langs or not has.any():
            continue
        sums = np.stack([np.bincount(of, m[:, k][g], z - a) for k in range(len(langs))], 1)
        top = sums.argmax(1)
        share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        best[a:z] = np.where(has, top, -1)
        p[a:z] = np.where(has, share, 0.0)
        n[a:z] = np.bincount(of, minlength=z - a)
        mean[a:z] = sums.max(1) / np.maximum(n[a:z], 1)
    return best, p, mean, n


def score(texts: list[str], langs: list[str], m: np.ndarray) -> tuple[list[str], np.ndarray]:
    best, p, _, _ = evidence(texts, langs, m)
    return [langs[k] if k >= 0 else "und" for k in best.tolist()], p


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text: str = "text", clear: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in keep, then the language and its posterior, by names; with clear also __clear."""
    ship(docs.sparkSession)
    langs, m = model
    # float32 columns: BUCKETS x languages x 4 bytes, whatever the corpus
    sent = docs.sparkSession.sparkContext.broadcast((langs, np.asfortranarray(m, np.float32), Clear(m)))
    held = [f"k{i}" for i in range(len(keep))]
    own = [] if text in keep else [F.col(f"`{text}`").alias("__text")]
    src = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, held, strict=True)], *own)
    at = len(keep) if own else keep.index(text)
    schema = extended(src.drop("__text"), __lang="string", __p="double", **({"__clear": "boolean"} if clear else {}))

    def run(batches):
        langs, m, is_clear = sent.value
        for b in batches:
            best, p, mean, n = evidence([x or "" for x in b.column(at).to_pylist()], langs, m)
            cols = [*b.columns[: len(keep)], pa.array([langs[k] if k >= 0 else "und" for k in best.tolist()], pa.string()), pa.array(p)]
            if clear:
                cols.append(pa.array(is_clear(best, mean, n)))
            release()
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

    return src.mapInArrow(run, schema).select(*[F.col(k).alias(c) for c, k in zip(keep, held, strict=True)], F.col("__lang").alias(names[0]), F.col("__p").alias(names[1]), *(["__clear"] if clear else []))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out())
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter, of no learned language, or of no clear one, go.

    Null and empty texts go; repeated rows stay or go together; an empty table stays empty; without a labelled document
    none is recognised."""
    model = fit(docs, ~held_out())
    found = predict(docs, model, docs.columns, clear=True, names=("__lang", "__p"))
    return found.filter((F.col("__lang") != "und") & (F.col("__p") >= 0.5) & F.col("__clear")).select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op6_language_id": op6_language_id}
