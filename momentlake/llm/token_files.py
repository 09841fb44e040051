"""Token-ID / binary output (8): shards of independent zstandard frames with a trailing seek table.

A shard holds a run of documents in ascending doc_id order (null first; ties by a hash of the text, so that the rows of
one id are many shards too, then by the text).  File layout:

    frame 0 .. frame n-1   one zstandard frame a document: its ids as little-endian unsigned integers, 2 or 4 bytes
    index frame            a skippable frame (magic 0x184D2A50): width u8, n u64, then n doc_ids i64, n null flags u8
    seek table             a skippable frame (magic 0x184D2A5E): per frame compressed size u32, plain size u32 and
                           checksum u32 (crc32 of the plain bytes); footer: n u32, descriptor 0x80, magic 0x8F92EAB1

The seek table is that of the public zstandard seekable format, with crc32 for its checksum; any zstandard decoder
reads the frames in sequence.  A reader takes the footer, the table and the index from the end and then decompresses
the frames of the requested documents only.

Shards are written under another name and renamed, so a task that is tried again after a lost executor replaces its
file.  Defined results: null texts count as empty and get the end id alone; repeated rows are each written; an empty
table makes no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentlake.llm import encoder as E
from momentlake.llm.common import cut, shared_dir, ship, table

INDEX, SEEK, FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
LEVEL = 3


#: Schemes that Hadoop calls otherwise than pyarrow's file systems.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasb": "abfs", "wasbs": "abfs"}


def _filesystem(uri: str):
    """The file system of a folder by Hadoop's name, and the path there."""
    from pyarrow import fs

    scheme, found, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if found else uri)


class ShardWriter:
    """One shard: write() a document after another, then close()."""

    def __init__(self, sink, width: int):
        import zstandard

        self.sink, self.dtype = sink, f"<u{width}"
        self.width = width
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.entries: list[bytes] = []
        self.ids: list[int | None] = []

    def write(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (8 * self.width):
            raise ValueError("an id doesn't fit the width of this file")
        plain = ids.astype(self.dtype).tobytes()
        frame = self.zstd.compress(plain)
        self.sink.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(plain), zlib.crc32(plain)))
        self.ids.append(doc_id)

    def close(self) -> None:
        n = len(self.ids)
        body = struct.pack("<BQ", self.width, n)
        body += np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array([x is None for x in self.ids], "u1").tobytes()
        self.sink.write(struct.pack("<II", INDEX, len(body)) + body)
        table = b"".join(self.entries) + struct.pack("<IBI", n, 0x80, FOOTER)
        self.sink.write(struct.pack("<II", SEEK, len(table)) + table)
        self.sink.close()


class ShardReader:
    """Documents of one shard by position; only the frames asked for are read and decompressed."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER or descriptor != 0x80:
            raise ValueError("no seek table at the end of this file")
        start = size - 9 - 12 * n - 8
        head = struct.unpack("<II", self._at(start, 8))
        if head != (SEEK, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        entries = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.plain, self.sums = entries[:, 0], entries[:, 1].astype(np.int64), entries[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        body = self._at(int(self.starts[-1]), start - int(self.starts[-1]))
        magic, length, self.width, m = struct.unpack("<IIBQ", body[:17])
        if magic != INDEX or length != len(body) - 8 or m != n:
            raise ValueError("the index is damaged")
        null = np.frombuffer(body[17 + 8 * n :], "u1")
        self.doc_ids = [None if z else int(x) for x, z in zip(np.frombuffer(body[17 : 17 + 8 * n], "<i8"), null, strict=True)]
        self.n_tokens = self.plain // self.width

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def read(self, k: int) -> np.ndarray:
        """The ids of document k, checked against its checksum."""
        plain = self.zstd.decompress(self._at(int(self.starts[k]), int(self.sizes[k])), max_output_size=int(self.plain[k]))
        if len(plain) != self.plain[k] or zlib.crc32(plain) != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(plain, f"<u{self.width}").astype("<u4")


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, width: int = 2, text: str = "text") -> DataFrame:
    """Encode whole texts, write the shards, return one row per shard: shard, path, n_docs, n_tokens.

    Texts, not ids, go through the one shuffle, by ranges of doc_id; a range is a shard.  width: bytes an id takes.
    """
    ship(docs.sparkSession)
    path = path or E.default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def run(batches):
        from pyspark import TaskContext

        writer = None
        shard, n_docs, n_tokens = TaskContext.get().partitionId(), 0, 0
        name = f"{folder}/shard-{shard:06d}.tok"
        enc = E.encoder(path)
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                store, at = _filesystem(folder)
                store.create_dir(at, recursive=True)
                own = f"{at}/.{uuid.uuid4().hex}.tmp"
                writer = ShardWriter(store.open_output_stream(own), width)
            for a, z, count, ids in enc.encode(b.column(1)):
                for doc_id, x in zip(b.column(0).slice(a, z - a).to_pylist(), np.split(ids, np.cumsum(count)[:-1]), strict=True):
                    writer.write(doc_id, np.append(x, np.uint32(end_id)))
                n_docs, n_tokens = n_docs + z - a, n_tokens + int(count.sum()) + z - a
        if writer is not None:
            writer.close()
            store.move(own, f"{at}/shard-{shard:06d}.tok")
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": name, "n_docs": n_docs, "n_tokens": n_tokens}])

    return cut(rows.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    ship(shards.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    n = max(1, shards.count())
    todo = shards.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start")).repartitionByRange(n, "shard")

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                store, at = _filesystem(row["path"])
                with store.open_input_file(at) as source:
                    reader = ShardReader(source)
                    n = len(reader.doc_ids)
                    crc = np.fromiter((zlib.crc32(reader.read(k).tobytes()) for k in range(n)), np.int64, n)
                start = row["start"] + np.concatenate([[0], np.cumsum(reader.n_tokens)[:-1]]) if n else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.doc_ids, pa.int64()), pa.array(start.astype(np.int64)), pa.array(reader.n_tokens.astype(np.int64)), pa.array(crc)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read_shards(write_shards(docs, folder))


QUERIES = {"op8_token_files": op8_token_files}
