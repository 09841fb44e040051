"""Steps that grew faster than their input, or differed from their SQL on larger tables."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from momentlake import models
from momentlake.functions import text as T
from momentlake.functions.numbers import rounded
from momentlake.operators import answers, grid, sampling, search, text_index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sampler_reads_many_chunks_in_one_pass(spark):
    """a chunk was a pandas group of its own.  Rows as by plain loops, chunks without a number too."""
    r = random.Random(1)
    data = [(f"v{i % 7}", r.choice([None, *range(40)]), i, float(i), r.uniform(0, 10)) for i in range(1500)]
    df = spark.createDataFrame(data, "video_id string, chunk_id long, frame_index long, media_ts double, score double").repartition(6)
    got = sampling.sample(df, lambda: [sampling.ScalarSampler(4.0, max_per_chunk=3, min_interval_s=20.0), sampling.ScalarSampler(1.0)], "score")
    assert "FlatMapGroupsInPandas" not in plan(got)
    want = []
    for most, gap, least in ((3, 20.0, 4.0), (10**9, 0.0, 1.0)):
        state = {}
        for v, c, i, ts, score in data:
            kept, last, reference = state.get((v, c), (0, None, None))
            if kept == 0 or (kept < most and ts - last >= gap and abs(score - reference) >= least):
                want.append((v, str(c), i))
                state[v, c] = kept + 1, ts, score
    assert sorted((x.video_id, str(x.chunk_id), x.frame_index) for x in got.collect()) == sorted(want)


def test_grids_are_not_broadcast(spark):
    """the optimizer takes a grid for as small as the durations that it is made of."""
    durations = spark.createDataFrame([("a", 1e6), ("b", 5.0)], "video_id string, duration_s double").coalesce(1)
    frames = spark.createDataFrame([("a", 3.0), ("a", 1e6), ("b", 5.0)], "video_id string, media_ts double")
    for g in (grid.uniform(durations, 20.0), grid.from_cuts(frames.withColumnRenamed("media_ts", "at"), durations)):
        for bucket in (None, 20.0):
            placed = grid.with_chunk(frames, g, "media_ts", bucket_s=bucket)
            assert "SortMergeJoin" in plan(placed) and placed.count() == 3
            joins = [line for line in plan(placed).splitlines() if "BroadcastExchange" in line]
            assert len(joins) == plan(g).count("BroadcastExchange")  # its own, of durations
        assert "Broadcast" not in plan(frames.withColumn("chunk_id", F.lit(0)).join(grid.uniform(durations, 20.0), ["video_id", "chunk_id"]))


@pytest.mark.parametrize("digits", [1, 3, 4])
def test_rounded_is_that_of_sql(spark, digits):
    """a ratio whose product with a power of ten is just beside a half."""
    r = random.Random(digits)
    data = [(n / (d / 60),) for n in range(1, 60) for d in range(100, 900, 7)] + [(round(r.uniform(-9, 9), digits + 1),) for _ in range(3000)] + [(2.675,), (1.005,), (-1.005,), (0.0,), (None,)]
    data += [(k / 10 ** (digits + 1),) for k in range(5, 40000, 10)]
    got = spark.createDataFrame(data, "x double").select("x", rounded("x", digits).alias("y")).collect()
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t (x DOUBLE)")
    duck.executemany("INSERT INTO t VALUES (?)", data[:1] + data[-2000:])
    known = dict(duck.execute(f"SELECT x, round(x, {digits}) FROM t").fetchall())
    assert all(y == known[x] for x, y in got if x in known)
    assert any(y != float(f"{x:.17g}") for x, y in got if x is not None)


def test_postings_are_counted_where_the_text_is(spark):
    """every posting was shuffled to be counted.  Rows of equal keys, null keys too, still count as one unit."""
    r = random.Random(2)
    texts = [" ".join(r.choices(["House", "the", "nation", "x1", "日本", "houses"], k=r.choice([0, 1, 5, 60]))) for _ in range(80)]
    data = [("a" if i % 3 else None, i, t) for i, t in enumerate(texts)] + [("z", 1, None), ("z", 2, "")]
    schema = "v string, c int, content string"
    alone = search.postings(spark.createDataFrame(data, schema), ["v", "c"])
    assert not any("lexeme" in line for line in plan(alone).splitlines() if "Exchange" in line)
    for rows in (data, data + [(None, 3, "house nation nation"), (None, 3, "new"), ("a", 1, None)]):
        want = {}
        for v, c, t in rows:
            for k, w in enumerate(x for x in (t or "").lower().split() if x != "the"):
                want.setdefault((v, c, w), []).append(k)
        got = search.postings(spark.createDataFrame(rows, schema).repartition(3), ["v", "c"]).collect()
        assert sorted(repr(tuple(x)) for x in got) == sorted(repr((v, c, w, len(p), min(p))) for (v, c, w), p in want.items())


def test_index_shuffles_no_keys_and_names_units_by_their_own_hash(spark):
    """keys went along with every posting, twice.  A unit of two rows is one, (null, x) and (x, null) are two."""
    rows = [("x", None, "house nation house"), (None, "x", "house nation"), ("y", "y", "house"), ("y", "y", "nation nation nation"), ("q", "q", None)]
    df = spark.createDataFrame(rows, "v string, c string, content string")
    index = text_index.build(df, ["v", "c"], stemmed=False)
    assert not {"v", "c"} & set(index.postings(spark).columns)
    assert index.units(spark).select("u").distinct().count() == 4
    got = text_index.top(spark, index, "house nation", 5).collect()
    assert [tuple(x) for x in got] == [("y", "y", 2, 4, 1), ("x", None, 2, 3, 2), (None, "x", 2, 2, 3)]


def test_texts_reach_python_in_parts(spark):
    """F8, F10, F12: a batch of 10,000 rows, of any size, was turned into Python strings whole."""
    r = random.Random(3)
    texts = [None, "", *(" ".join(r.choices(["Anna met Bob.", "so", "Constance!", "x" * 30], k=r.choice([1, 7, 90]))) for _ in range(60))]
    asked = []
    batch = pa.array(texts)
    got = [(a + k, t) for a, own in T.parts(batch, 500) for k, t in enumerate(own) if not asked.append(len(own))]
    assert got == [(k, t or "") for k, t in enumerate(texts)] and max(asked) < 40 and len(asked) > 10
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(3)
    cut = sorted((x.k, x.piece_no, x.piece) for x in T.pieces(df, ["k"], "t", 40).collect())
    assert cut == [(k, n, p) for k, t in enumerate(texts) for n, p in enumerate(T.split_pieces(t or "", 40))]
    kinds = lambda found: [[(w, "long" if len(w) > 6 else "short") for w in re.findall(r"[A-Z][a-z]+", t)] for t in found]
    want = Counter((k % 2, e) for k, t in enumerate(texts) for e in kinds([t or ""])[0])
    named = answers.ner(df.withColumn("v", F.col("k") % 2), "v", "k", "t", kinds, 40)
    assert {(x.v, (x.text, x.label)): x.mentions for x in named.collect()} == want
    assert "MapInPandas" not in plan(named) and "ArrowEvalPython" not in plan(named)  # one worker a task

    rows = spark.createDataFrame([("a", 0, ["x", None, "y" * 9]), ("a", 1, []), ("b", 0, ["z"]), ("b", 1, [None])], "v string, position long, texts array<string>").repartition(2)
    made = models.reduce_with(lambda ts: [f"<{t}>" for t in ts])(rows)
    assert sorted(map(tuple, made.collect())) == [("a", 0, "<x\n" + "y" * 9 + ">"), ("a", 1, "<>"), ("b", 0, "<z>"), ("b", 1, "<>")]
    assert not any("array<string>" in str(f.dataType) for f in made.schema) and "ArrowEvalPython" not in plan(made)
