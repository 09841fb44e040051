"""Models as pluggable batch functions, and stand-ins that need no weights."""

from __future__ import annotations

import asyncio
import hashlib
import inspect
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from momentlake.errors import ModelUnavailable, Refused


@dataclass(frozen=True)
class Models:
    """Which function plays which role; each takes and returns lists."""

    vlm: Callable | None = None
    llm: Callable | None = None
    embedder: Callable | None = None
    visual_embedder: Callable | None = None


def stub_complete(texts: list[str], fields: tuple[str, ...] = ("summary",)) -> list[dict[str, str]]:
    """A deterministic completion: every field says what it is and a hash of what was read."""
    return [{f: f"{f} {hashlib.sha256(t.encode()).hexdigest()[:8]}" for f in fields} for t in texts]


def stub_sentiment(text):
    """A deterministic signed score in [-1, 1] from the length of a text."""
    n = F.length(text)
    return ((n % 7) - 3) / 3.0


#: Characters that a reducer's model is asked with at a time.
ASKED = 1_000_000


def reduce_with(complete: Callable[[list[str]], list[str]]):
    """A reducer for `aggregates.fold`: (by, position, texts) -> (by, position, text).

    Texts reach Python one a row, as a batch of rows that hold many each may be of any size; they are put together there, and
    `complete` is asked with at most `ASKED` characters at a time, or one batch of texts that is longer."""

    def reduce(rows: DataFrame) -> DataFrame:
        keep = [c for c in rows.columns if c != "texts"]
        # the rows of one list stay neighbours: nothing is shuffled on the way to Python
        flat = rows.select(*keep, F.size("texts").alias("__n"), F.posexplode_outer("texts").alias("__at", "text"))
        schema = StructType(rows.select(*keep).schema.fields).add("text", "string")

        def run(batches):
            held, ready, heads, size = [], [], [], 0

            def answered(types):
                columns = zip(*heads, strict=True) if keep else ()
                return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(complete(ready), pa.string())], schema.names)

            types = []
            for b in batches:
                types = [c.type for c in b.columns[: len(keep)]]
                many, at = b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist()
                for k, (n, i) in enumerate(zip(many, at, strict=True)):
                    t = b.column(len(keep) + 2)[k].as_py()
                    if t is not None:
                        held.append(t)
                        size += len(t)
                    if i is None or i == n - 1:
                        ready.append("\n".join(held))
                        heads.append([c[k].as_py() for c in b.columns[: len(keep)]])
                        held = []
                        if size >= ASKED:
                            yield answered(types)
                            ready, heads, size = [], [], 0
            if ready:
                yield answered(types)

        return flat.mapInArrow(run, schema)

    return reduce


def stub_reduce(texts: list[str]) -> list[str]:
    return [f"{t.count(chr(10)) + 1} parts {hashlib.sha256(t.encode()).hexdigest()[:8]}" for t in texts]


#: By a part of a model's name, what goes before a query and before a document.
_BGE = "Represent this sentence for searching relevant passages: "
PREFIXES = (
    ("multilingual-e5", "query: ", "passage: "), ("e5-", "query: ", "passage: "), ("nomic-embed-text", "search_query: ", "search_document: "),
    ("bge-small-en", _BGE, ""), ("bge-base-en", _BGE, ""), ("bge-large-en", _BGE, ""), ("mxbai-embed-large", _BGE, ""),
)


def prefixes_for(model: str) -> tuple[str, str]:
    """What a model expects before a query and before a document; the first match counts."""
    return next(((q, d) for part, q, d in PREFIXES if part in model.lower()), ("", ""))


@dataclass(frozen=True)
class Embedder:
    """Texts -> vectors.  key names the space: name, model and dims, and a suffix for prefixes that aren't the model's own."""

    encode: Callable[[list[str]], list[list[float]]]
    name: str
    model: str
    dims: int
    query_prefix: str | None = None
    document_prefix: str | None = None
    batch: int = 64

    @property
    def prefixes(self) -> tuple[str, str]:
        q, d = prefixes_for(self.model)
        return (q if self.query_prefix is None else self.query_prefix, d if self.document_prefix is None else self.document_prefix)

    @property
    def key(self) -> str:
        own = "" if self.prefixes == prefixes_for(self.model) else ":p" + hashlib.sha1("\0".join(self.prefixes).encode()).hexdigest()[:6]
        return f"{self.name}:{self.model}:{self.dims}{own}"

    def query(self, text: str) -> list[float]:
        """The vector of a search."""
        return self._checked(self.encode([self.prefixes[0] + text]), 1)[0]

    def _checked(self, vectors: list, n: int) -> list:
        if len(vectors) != n or any(len(v) != self.dims for v in vectors):
            raise ModelUnavailable(f"{self.key} gave vectors of another number or width")
        return vectors

    def embed(self, rows: DataFrame, text: str = "content", vector: str = "vector") -> DataFrame:
        """rows with the vector of each document, by batches; a null text counts as empty."""
        me, before = self, self.prefixes[1]

        @F.pandas_udf("array<double>")
        def run(texts: pd.Series) -> pd.Series:
            said = [before + (t or "") for t in texts]
            out = [v for k in range(0, len(said), me.batch) for v in me._checked(me.encode(said[k : k + me.batch]), len(said[k : k + me.batch]))]
            return pd.Series([[float(x) for x in v] for v in out], index=texts.index, dtype=object)

        return rows.withColumn(vector, run(F.col(text)))


def hash_embedder(dims: int = 64) -> Embedder:
    """Deterministic vectors from the words of a text, the same as `functions.vectors.hash_embed` gives."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") % dims] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    return Embedder(encode, "hash", "words", dims)


@dataclass(frozen=True)
class VisualEmbedder:
    """Groups of images -> vectors, and texts -> vectors of the same space.  A group has at most max_images."""

    encode_images: Callable[[list[list[bytes]]], list[list[float]]]
    encode_query: Callable[[str], list[float]]
    name: str
    dims: int
    max_images: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}:{self.dims}:images"

    def embed(self, rows: DataFrame, images: str = "images", vector: str = "vector") -> DataFrame:
        """rows with the vector of their images (array<binary>); more of them than the model takes are refused."""
        me = self

        @F.pandas_udf("array<double>")
        def run(groups: pd.Series) -> pd.Series:
            held = [[bytes(x) for x in g] for g in groups]
            if any(len(g) > me.max_images for g in held):
                raise Refused(f"{me.key} takes {me.max_images} images at a time")
            return pd.Series([[float(x) for x in v] for v in me.encode_images(held)], index=groups.index, dtype=object)

        return rows.withColumn(vector, run(F.col(images)))


def stub_visual(dims: int = 16, max_images: int = 4) -> VisualEmbedder:
    unit = lambda raw: (lambda v: (v / np.linalg.norm(v)).tolist())(np.frombuffer((hashlib.sha256(raw).digest() * (dims // 32 + 1))[:dims], np.uint8) + 1.0)
    return VisualEmbedder(lambda groups: [unit(b"".join(g)) for g in groups], lambda t: unit(t.encode()), "stub", dims, max_images)


def asked(rows: DataFrame, complete: Callable, prompt: str = "prompt", images: str | None = None, schema: dict | None = None, concurrency: int = 8, name: str = "reply") -> DataFrame:
    """rows with `reply` (JSON text), and `error` in its place where the model failed.

    complete(prompt, images, schema) gives a dict (or a text), or a coroutine of one; `concurrency` calls of a task are
    under way at a time.  A reply that lacks a required field of the schema counts as failed."""
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    required = list((schema or {}).get("required", []))

    def one(text: str, pictures) -> tuple[str | None, str | None]:
        try:
            got = complete(text, [bytes(p) for p in pictures] if pictures is not None else [], schema)
            if inspect.isawaitable(got):
                async def wait():
                    return await got

                got = asyncio.run(wait())
            lacking = [f for f in required if not isinstance(got, dict) or f not in got]
            if lacking:
                return None, f"the reply lacks {', '.join(lacking)}"
            return got if isinstance(got, str) else json.dumps(got, ensure_ascii=False), None
        except Exception as e:  # noqa: BLE001  one call's failure mustn't lose the others
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for b in batches:
                said = list(pool.map(one, b[prompt], b[images] if images else [None] * len(b)))
                yield b.assign(**{name: [x for x, _ in said], "error": [e for _, e in said]})

    return rows.mapInPandas(run, f"{kinds}, `{name}` string, error string")


def ask(images: DataFrame, question: str, complete: Callable, by: list[str], schema: dict | None = None) -> DataFrame:
    """An ad-hoc question about images: by, reply and error, a call for each group of by, its images in frame order."""
    held = images.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "image"))), lambda i: i["image"]).alias("images"))
    return asked(held.withColumn("prompt", F.lit(question)), complete, images="images", schema=schema).select(*by, "reply", "error")


def detected(frames: DataFrame, detect: Callable[[bytes], list[tuple]]) -> DataFrame:
    """frames with `boxes`: (x1, y1, x2, y2, confidence, label) of what a detector finds in each image."""
    kind = "array<struct<x1:double,y1:double,x2:double,y2:double,confidence:double,label:string>>"
    names = ("x1", "y1", "x2", "y2", "confidence", "label")

    @F.pandas_udf(kind)
    def run(images: pd.Series) -> pd.Series:
        return images.map(lambda i: [dict(zip(names, d, strict=True)) for d in detect(bytes(i))])

    return frames.withColumn("boxes", run("image"))
