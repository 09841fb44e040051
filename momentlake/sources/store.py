"""Where results go: a protocol of hooks, and a store of Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.errors import MissingArtifact, Moved, Unsupported
from momentlake.operators.units import insert_absent, upsert

#: Table -> key.  Rows of a table are replaced by key.
TABLES = {
    "videos": ["video_id"],
    "timelines": ["video_id"],
    "chunks": ["video_id", "chunk_id"],
    "transcripts": ["video_id"],
    "transcript_chunks": ["video_id", "chunk_id"],
    "manifests": ["video_id"],
    "chunk_samplers": ["video_id", "chunk_id", "sampler_id"],
    "descriptions": ["video_id", "chunk_id", "sampler_id"],
    "embeddings": ["video_id", "chunk_id", "sampler_id", "embedder"],
    "observations": ["video_id", "sampler_id", "frame_index", "embedder"],
    "prompts": ["name", "version"],
    "sources": ["source_id"],
    "answers": ["source_id", "aggregate_id"],
    "items": ["source_id", "aggregate_id", "item_id"],
    "mentions": ["source_id", "aggregate_id", "mention_key"],
    "aggregate_units": ["source_id", "aggregate_id", "level", "item_id", "embedder"],
    "definitions": ["name", "version"],
}
APPEND_ONLY = {"prompts", "definitions"}


class Store:
    """Hooks of a store.  A write that a store doesn't have is skipped; a read raises Unsupported."""

    def write(self, table: str, rows: DataFrame) -> None:
        return None

    def read(self, table: str) -> DataFrame:
        raise Unsupported(f"this store has no {table}")

    def implements(self, hook: str) -> bool:
        return getattr(type(self), hook) is not getattr(Store, hook)

    def __enter__(self):
        return self

    def __exit__(self, *error) -> None:
        return None


class ParquetStore(Store):
    """A folder of tables.  A write merges by key into a new version of the table, and the pointer to the current
    version moves last, by a rename, so that readers see the old or the new one whole.

    Tables by recording or source are kept in partitions of BUCKETS buckets of that id: a merge reads and writes the
    buckets that the new rows touch, and the new version refers to the others where they are; so do `replace` and
    `delete_stale`, which look for the rows that go by their keys alone.  A bucket is as many files as its size asks for
    (the session's advisory size of a partition).

    A writer publishes the state after the one that it read.  If another was there first, it merges its staged rows
    again, with the new state, up to RETRIES times."""

    BUCKETS, RETRIES = 64, 20

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- the pointer: a file of one line a bucket (bucket, path); -1 marks a table that isn't bucketed

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointers(self, table: str) -> list[str]:
        fs, p = self._fs(f"{self.folder}/{table}/pointer-*")
        found = fs.globStatus(p)
        return sorted(s.getPath().getName() for s in found or [])

    def _current(self, table: str) -> dict[int, str] | None:
        return self._state(table)[1]

    def _state(self, table: str) -> tuple[int, dict[int, str] | None]:
        """The number of the current state, -1 without one, and where its buckets are."""
        names = self._pointers(table)
        if not names:
            return -1, None
        # the newest pointer counts; older ones are deleted after it is in place
        lines = self.spark.read.text(f"{self.folder}/{table}/{names[-1]}").collect()  # at most BUCKETS lines
        return int(names[-1].rpartition("-")[2]), {int(k): at for k, _, at in (r[0].partition(" ") for r in lines if r[0])}

    def _move(self, table: str, buckets: dict[int, str], after: int) -> None:
        """Publish a state as the one after `after`."""
        old = [x for x in self._pointers(table) if int(x.rpartition("-")[2]) <= after]
        number = after + 1
        fs, tmp = self._fs(f"{self.folder}/{table}/.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp)
        out.write(bytearray("\n".join(f"{k} {at}" for k, at in sorted(buckets.items())).encode()))
        out.close()
        if not fs.rename(tmp, self._fs(f"{self.folder}/{table}/pointer-{number:012d}")[1]):
            fs.delete(tmp, False)
            raise Moved(f"another writer moved {table} meanwhile")
        for name in old[:-1]:  # the one before stays for readers that have just looked
            fs.delete(self._fs(f"{self.folder}/{table}/{name}")[1], False)

    def vacuum(self, table: str) -> int:
        """Delete what neither the current nor the previous state of a table refers to; how many folders went."""
        used = set()
        for name in self._pointers(table):
            used |= {r[0].partition(" ")[2].partition("/")[0] for r in self.spark.read.text(f"{self.folder}/{table}/{name}").collect()}
        fs, p = self._fs(f"{self.folder}/{table}/v-*")
        gone = [s.getPath() for s in fs.globStatus(p) or [] if s.getPath().getName() not in used]
        for at in gone:
            fs.delete(at, True)
        return len(gone)

    @staticmethod
    def _owner(table: str) -> str | None:
        return TABLES[table][0] if TABLES[table][0] in ("video_id", "source_id") else None

    def _bucketed(self, table: str, rows: DataFrame) -> DataFrame:
        owner = self._owner(table)
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(F.col(owner).cast("string")), F.lit(self.BUCKETS)).cast("int") if owner else F.lit(0))

    def _read(self, table: str, buckets: dict[int, str]) -> DataFrame:
        paths = [f"{self.folder}/{table}/{at}" for at in dict.fromkeys(buckets.values())]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def read(self, table: str) -> DataFrame:
        now = self._current(table)
        if now is None:
            raise MissingArtifact(f"no rows of {table} in {self.folder}")
        return self._read(table, now)

    def _publish(self, table: str, rows: DataFrame, touched: list[int], now: dict[int, str], after: int) -> None:
        """rows, all of the touched buckets, as their new content in the state after `after`."""
        at = f"v-{uuid.uuid4().hex}"
        self._bucketed(table, rows).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{table}/{at}")
        fs, p = self._fs(f"{self.folder}/{table}/{at}/__bucket=*")
        made = {int(s.getPath().getName().partition("=")[2]) for s in fs.globStatus(p) or []}
        left = {k: x for k, x in now.items() if k not in touched}
        if not made and not left:  # an empty table keeps its columns
            rows.limit(0).write.parquet(f"{self.folder}/{table}/{at}/__bucket=0")
            made = {0}
        try:
            self._move(table, left | {k: f"{at}/__bucket={k}" for k in made}, after)
        except Moved:
            fs, p = self._fs(f"{self.folder}/{table}/{at}")
            fs.delete(p, True)
            raise

    def _again(self, step: Callable[[], None]) -> None:
        """step, from the state that is current by then, as often as another writer is first."""
        for k in range(self.RETRIES):
            try:
                return step()
            except Moved:
                if k == self.RETRIES - 1:
                    raise

    def _holding(self, table: str, now: dict[int, str], rows: DataFrame, keys: list[str], how: str) -> list[int]:
        """The buckets that hold a stored row with (left_semi) or without (left_anti) the keys of a row of rows."""
        if not now:
            return []
        owner = self._owner(table)
        stored = self._bucketed(table, self._read(table, now)).select("__bucket", *dict.fromkeys([*keys, *([owner] if owner else [])]))
        return [r[0] for r in stored.join(rows.select(*keys).distinct(), keys, how).select("__bucket").distinct().collect()]  # at most BUCKETS

    def _staged(self, table: str, rows: DataFrame) -> tuple[DataFrame, list[int], str]:
        """rows written once, so that a model behind them is asked once and a choice among repeated keys is one choice."""
        at = f"{self.folder}/{table}/.staged-{uuid.uuid4().hex}"
        self._bucketed(table, rows).write.parquet(at)
        held = self.spark.read.parquet(at)
        touched = [r[0] for r in held.select("__bucket").distinct().collect()]  # at most BUCKETS
        return held.drop("__bucket"), touched, at

    def write(self, table: str, rows: DataFrame) -> None:
        keys = TABLES[table]
        staged, touched, at = self._staged(table, rows.dropDuplicates(keys))

        def step() -> None:
            after, now = self._state(table)
            old = {k: x for k, x in (now or {}).items() if k in touched}
            held = staged
            if old:
                stored = self._read(table, old)
                held = insert_absent(stored, held, keys) if table in APPEND_ONLY else upsert(stored, held, keys)
            if touched or now is None:
                self._publish(table, held, touched, now or {}, after)

        self._again(step)
        fs, p = self._fs(at)
        fs.delete(p, True)

    def replace(self, table: str, rows: DataFrame, scope: DataFrame, keys: list[str]) -> None:
        """rows in place of all stored rows that have the keys of a row of scope (an answer, say), and of those of their own key."""
        own = TABLES[table]
        staged, new, at = self._staged(table, rows.dropDuplicates(own))

        def step() -> None:
            after, now = self._state(table)
            touched = sorted({*new, *self._holding(table, now or {}, scope, keys, "left_semi")})
            old = {k: x for k, x in (now or {}).items() if k in touched}
            held = upsert(self._read(table, old).join(scope.select(*keys).distinct(), keys, "left_anti"), staged, own) if old else staged
            if touched or now is None:
                self._publish(table, held, touched, now or {}, after)

        self._again(step)
        fs, p = self._fs(at)
        fs.delete(p, True)

    def delete_stale(self, table: str, keep: DataFrame, keys: list[str]) -> None:
        """Delete stored rows that don't have the keys of a row of keep."""
        def step() -> None:
            after, now = self._state(table)
            if now is None:
                raise MissingArtifact(f"no rows of {table} in {self.folder}")
            touched = self._holding(table, now, keep, keys, "left_anti")
            if touched:
                old = {k: now[k] for k in touched}
                self._publish(table, self._read(table, old).join(keep.select(*keys).distinct(), keys, "left_semi"), touched, now, after)

        self._again(step)

    def spans(self, video_id: str) -> DataFrame:
        """The grid of a recording, in order."""
        return self.read("chunks").filter(F.col("video_id") == video_id).select("chunk_id", "start_ts", "end_ts").orderBy("chunk_id")

    def video_ids(self) -> DataFrame:
        """Recordings that have something to search."""
        return self.read("embeddings").select("video_id").distinct().orderBy("video_id")

    def live_ids(self) -> DataFrame:
        """Runs that have left observations."""
        return self.read("observations").select("video_id").distinct().orderBy("video_id")

    def declare(self, database: str | None = None) -> list[str]:
        """The stored tables as views of the session, so that SQL finds them by name; the names."""
        names = []
        for table in TABLES:
            if self._current(table) is not None:
                name = f"{database}_{table}" if database else table
                self.read(table).createOrReplaceTempView(name)
                names.append(name)
        return names

    def wipe(self) -> None:
        """Drop all tables, children first."""
        for table in reversed(TABLES):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def sink(self, table: str):
        """A foreachBatch function that merges micro-batches; a batch that is tried again changes nothing."""
        return lambda batch, _: self.write(table, batch)


def export(store: Store, tables: dict[str, DataFrame]) -> list[str]:
    """Write tables one by one; failures are returned, not raised."""
    problems = []
    for name, rows in tables.items():
        try:
            store.write(name, rows)
        except Exception as e:  # noqa: BLE001  a table that fails mustn't keep the others from being written
            problems.append(f"{name}: {e}")
    return problems
