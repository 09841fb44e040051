"""Files, frames, sound, models, live runs and records, by hand-worked cases."""

import io
import json
import threading
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlake import models, schemas
from momentlake.errors import Refused, UnknownOption
from momentlake.functions import boxes, times
from momentlake.functions import text as T
from momentlake.operators import aggregates, combine, sampling, selection
from momentlake.plans import batch, record
from momentlake.plans.library import frame_label
from momentlake.sources import frames as FR
from momentlake.sources import media
from momentlake.sources.store import ParquetStore
from momentlake.streaming import live


def wav(samples, rate=8000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_probe_and_listen(spark, tmp_path):
    tone = 0.5 * np.sin(np.arange(8000) / 5)
    (tmp_path / "talk.wav").write_bytes(wav(tone))
    (tmp_path / "copy.wav").write_bytes(wav(tone))
    (tmp_path / "still.wav").write_bytes(wav(np.zeros(4000)))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    files = media.files(spark, str(tmp_path), "*.wav")
    got = {r.video_id: r for r in media.probe(files, recorded_at="2024-03-15T09:30:00+01:00").collect()}
    assert (got["talk"].duration_s, got["talk"].audio.rate, got["talk"].name, got["talk"].recorded_at) == (1.0, 8000, "talk.wav", "2024-03-15T08:30:00.000+00:00")
    assert got["talk"].source == got["copy"].source != got["still"].source and got["bad"].problem and got["bad"].source is None
    for wrong in ({"name": " "}, {"recorded_at": "1969-01-01T00:00:00"}, {"recorded_at": "soon"}):
        with pytest.raises(Refused):
            media.probe(files, **wrong)
    heard_by = []

    def transcribe(x):
        heard_by.append(len(x))
        return [(0.0, 0.5, "hello there"), (0.5, 1.0, "bye")], [(0, 0.0, 0.2, "hello"), (0, 0.2, 0.5, "there"), (1, 0.5, 0.9, "bye")]

    ok = files.filter("video_id IN ('talk', 'still')")
    tracks, heard = media.listen(ok, transcribe, lambda x: [(0.0, 0.45, "A"), (0.45, 1.0, "B")])
    t = {r.video_id: r for r in tracks.collect()}
    assert t["still"].silent and t["still"].samples == 8000 and not t["talk"].silent and t["talk"].peak == pytest.approx(0.5, abs=0.01) and t["talk"].rms == pytest.approx(0.3535, abs=0.01)
    words, segments, turns = media.attributed(heard, 0.3)
    assert sorted((r.text, r.speaker) for r in words.collect()) == [("bye", "B"), ("hello", "A"), ("there", "A")]
    assert sorted((r.text, r.speaker) for r in segments.collect()) == [("bye", "B"), ("hello there", "A")] and turns.count() == 2
    store = ParquetStore(spark, str(tmp_path / "store"))
    store.write("chunks", spark.createDataFrame([(v, c, c / 2, c / 2 + 0.5) for v in ("talk", "still") for c in range(2)], "video_id string, chunk_id long, start_ts double, end_ts double"))
    assert batch.media(store, files).select("video_id").collect()[0][0] == "bad" and store.read("videos").count() == 3
    batch.audio(store, ok, transcribe, bucket_s=0.5)
    assert sorted((r.video_id, r.chunk_id, r.text) for r in store.read("transcript_chunks").collect()) == [("still", 0, ""), ("still", 1, ""), ("talk", 0, "hello there"), ("talk", 1, "bye")]
    batch.embed(_with_descriptions(spark, store), models.hash_embedder(8))
    units = store.read("embeddings")
    assert units.filter("sampler_id = 'transcript'").count() == 2 and units.count() == 3 and units.select(F.size("vector")).distinct().collect()[0][0] == 8
    batch.embed(store, models.hash_embedder(8))
    assert store.read("embeddings").count() == 3


def _with_descriptions(spark, store):
    store.write("descriptions", spark.createDataFrame([("talk", 0, "yolo", "yolo", "yolo", "a man", '{"mood": "calm", "tags": ["x", ["y"]]}')], "video_id string, chunk_id long, sampler_id string, sampler string, question string, description string, structured string"))
    return store


def test_frames_and_their_store(spark, tmp_path):
    made = []

    def decode(content, wanted):
        for k in range(20):
            yield k, k * 0.5, k * 500, lambda k=k: made.append(k) or f"{content.decode()}{k}".encode()

    rows = spark.createDataFrame([("v", b"a"), ("w", b"b")], "video_id string, content binary").coalesce(1)
    got = media.frames(rows, decode, per_second=1.0, after=2.0, before=5.0)
    assert sorted((r.video_id, r.frame_index, r.media_ts, bytes(r.image)) for r in got.collect()) == [(v, k, k / 2, f"{c}{k}".encode()) for v, c in (("v", "a"), ("w", "b")) for k in (4, 6, 8)]
    every = FR.as_frames(media.frames(rows, decode))
    stored = FR.store(None, every.filter("frame_index < 5"))
    stored = FR.store(stored, every.filter("frame_index < 8"))
    assert stored.count() == 16 and FR.prune(stored, every.filter("frame_index = 3")).count() == 2
    sampled = spark.createDataFrame([("v", 0, "yolo", 3), ("v", 0, "yolo", 4)], "video_id string, chunk_id long, sampler_id string, frame_index long")
    v = FR.numbered_views(spark.createDataFrame([("v", 3, "yolo", p, p == 1, f"l{p}") for p in range(3)], "video_id string, frame_index long, sampler_id string, position int, is_frame boolean, label string"))
    assert [r["view"] for r in v.orderBy("position").collect()] == [1, 0, 2]
    crops = spark.createDataFrame([("v", 3, "yolo", n, bytes([n])) for n in (1, 2)], "video_id string, frame_index long, sampler_id string, view int, image binary")
    shown = FR.images_for(sampled, FR.store(stored, crops), v).orderBy("frame_index", "position").collect()
    assert [(r.frame_index, r.label, bytes(r.image)) for r in shown] == [(3, "l0", b"\x01"), (3, "l1", b"a3"), (3, "l2", b"\x02"), (4, None, b"a4")]
    with pytest.raises(Exception, match="not stored"):
        FR.images_for(sampled.withColumn("frame_index", F.lit(15).cast("long")), stored).collect()
    again = FR.recreated(sampled, media.frames(rows, decode))
    assert FR.verified(FR.prune(stored, again), again).count() == 0
    bad = again.withColumn("image", F.when(F.col("frame_index") == 3, F.lit(b"x")).otherwise(F.col("image"))).filter("frame_index < 4")
    assert sorted((r.frame_index, r.problem) for r in FR.verified(again, bad).collect()) == [(3, "different"), (4, "missing")]
    # glance: same images keep their vectors
    store = ParquetStore(spark, str(tmp_path / "store"))
    shown = FR.images_for(sampled, stored).withColumn("sampler", F.lit("yolo"))
    calls = []
    model = models.stub_visual(16, 2)
    batch.glance(store, shown, model)
    first = store.read("embeddings").first()
    assert first.embedder == "stub:16:images" and len(first.vector) == 16 and first.question == "image"
    batch.glance(store, shown, models.VisualEmbedder(lambda g: calls.append(g) or [[0.0] * 16 for _ in g], model.encode_query, "stub", 16, 2))
    assert store.read("embeddings").first().vector == first.vector and store.read("embeddings").count() == 1
    with pytest.raises(Refused):
        batch.glance(store, shown, models.stub_visual(16, 1))
    replies = models.ask(FR.images_for(sampled, stored), "what?", lambda p, images, schema: {"said": f"{p} {len(images)}"}, ["video_id"]).first()
    assert json.loads(replies.reply) == {"said": "what? 2"}
    assert [len(r.boxes) for r in models.detected(again, lambda i: [(0, 0, 1, 1, 0.9, "cat")] * i.count(b"a")).collect()] == [1, 1]


def test_folders(spark, tmp_path):
    for v in ("a", "b", "_live"):
        (tmp_path / v / "answers").mkdir(parents=True)
        (tmp_path / v / "embedded.json").write_text("{}")
    (tmp_path / "c").mkdir()
    (tmp_path / "a/answers/entities.people.json").write_text('{"count": 1}')
    assert sorted(r[0] for r in media.recordings(spark, str(tmp_path)).collect()) == ["a", "b"]
    r = media.answer_files(spark, f"{tmp_path}/a/answers").first()
    assert (r.video_id, r.aggregate_id, json.loads(r.document)) == ("a", "entities:people", {"count": 1})


def test_models(spark):
    e = models.hash_embedder(8)
    assert e.key == "hash:words:8" and models.prefixes_for("Intfloat/E5-base") == ("query: ", "passage: ")
    own = models.Embedder(lambda t: [[1.0, float(len(x))] for x in t], "local", "e5-base", 2, document_prefix="")
    assert own.key.startswith("local:e5-base:2:p") and own.query("ab") == [1.0, 9.0]
    rows = spark.createDataFrame([("a b",), (None,)], "content string")
    assert [r.vector for r in own.embed(rows).collect()] == [[1.0, 3.0], [1.0, 0.0]]

    async def late(prompt, images, schema):
        if prompt == "bad":
            raise ValueError("no")
        return {"a": prompt} if prompt != "short" else {}

    got = models.asked(spark.createDataFrame([("x",), ("bad",), ("short",)], "prompt string"), late, schema={"required": ["a"]})
    assert [(r.prompt, r.reply, r.error) for r in got.collect()] == [("x", '{"a": "x"}', None), ("bad", None, "ValueError: no"), ("short", None, "the reply lacks a")]
    schema = schemas.json_schema({"mood": {"type": "text", "one_of": ["calm", "loud"]}, "people": {"type": "list", "of": ["name"]}})
    assert schemas.validate({"mood": "calm", "people": [{"name": "x"}]}, schema) == []
    assert len(schemas.validate({"mood": "odd", "people": [{"nam": 1}], "more": 1}, schema)) == 4
    assert schemas.claim_id("a", {"a"}) == "a-2" and schemas.claim_id("a", {"a"}, "replace") == "a"
    for policy in ("refuse", "other"):
        with pytest.raises(Refused):
            schemas.claim_id("a", {"a"}, policy)
    assert frame_label(2, 3.25, "person 1 of 3") == "Frame 2 at 3.2s: person 1 of 3"


def test_context_of_a_stream_equals_its_loop(spark, tmp_path):
    rows = [(v, i, i, i / 2, i % 4 == 0) for v in ("a", "b") for i in range(14)]
    src = tmp_path / "in"
    df = spark.createDataFrame([*rows, *[(v, 99, None, None, False) for v in ("a", "b")]], "video_id string, arrival long, frame_index long, media_ts double, kept boolean")
    for k in range(0, 14, 5):
        df.filter((F.col("arrival") >= k) & (F.col("arrival") < (k + 5 if k < 10 else 1000))).coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = live.live_context(stream, 2, 2).writeStream.format("memory").queryName("context").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert live.until(q) == "end"
    got = sorted((r.video_id, r.frame_index, list(r.before), list(r.after), r.flushed) for r in spark.table("context").collect())
    assert got == [(v, i, [x for x in (i - 2, i - 1) if x >= 0], [x for x in (i + 1, i + 2) if x < 14], i + 2 > 13) for v in ("a", "b") for i in (0, 4, 8, 12)]


def test_a_live_run_stops_and_is_finished(spark, tmp_path):
    def stream():
        return spark.readStream.format("rate").option("rowsPerSecond", 50).load().select(F.lit("v").alias("video_id"), F.col("value").cast("double").alias("media_ts"), F.col("value").alias("frame_index"))

    ended = []
    assert live.until(live.pump(stream(), str(tmp_path / "a"), 10, lambda df: None, every="0 seconds"), stop_after_s=1.0, finish=lambda: ended.append(1)) == "time" and ended == [1]
    event = threading.Event()
    assert live.until(live.pump(stream(), str(tmp_path / "b"), 10, lambda df: event.set(), every="0 seconds"), event=event) == "event"

    def write(df):
        raise live.StopStream

    assert live.until(live.pump(stream(), str(tmp_path / "c"), 10, write, every="0 seconds")) == "callback"

    def fail(df):
        raise ValueError("broken")

    with pytest.raises(Exception, match="broken"):
        live.until(live.pump(stream(), str(tmp_path / "d"), 10, fail, every="0 seconds"), finish=lambda: ended.append(2))
    assert ended == [1, 2]

    rows = [("v", c, "yolo", "yolo", "yolo", 10 * c + k, 10.0 * c + k, [10 * c + k, 10 * c], f"d{k}", json.dumps({"tags": ["a", f"t{k}"], "mood": "calm", "n": k, "none": ""}), 0.1 * k) for c in (0, 2) for k in (1, 0)]
    log = spark.createDataFrame(rows, "video_id string, chunk_id int, sampler_id string, sampler string, question string, frame_index long, media_ts double, frames array<long>, description string, structured string, lag_s double")
    sink = live.jsonl_sink(str(tmp_path / "log"))
    sink(log, 0)
    sink(log, 0)
    assert spark.read.json(str(tmp_path / "log/batch-*")).count() == 4
    t = live.finished(log, 10.0, spark.createDataFrame([("v", 27.5)], "video_id string, duration_s double"))
    assert [(r.start_ts, r.end_ts) for r in t["chunks"].orderBy("chunk_id").collect()] == [(0.0, 10.0), (10.0, 20.0), (20.0, 27.5)]
    d = t["descriptions"].orderBy("chunk_id").first()
    assert d.description == "At 0.0s: d0 At 1.0s: d1" and json.loads(d.structured) == {"tags": ["a", "t0", "t1"], "mood": "calm", "n": [0, 1]}
    assert list(d.frame_indexes) == [0, 1] and d.frame_count == 2 and [o.frame_index for o in d.observations] == [0, 1]
    assert t["timelines"].first().chunk_count == 3 and t["lags"].first().max_lag == pytest.approx(0.1)
    c = live.counters(spark.createDataFrame([("v", 0, False), ("v", 1, True)], "video_id string, rewinds long, gap_before boolean")).first()
    assert (c.frames, c.rewinds, c.gaps) == (2, 1, 1)
    assert live.send(spark.range(5).withColumn("media_ts", F.col("id") * 1.0), str(tmp_path / "sent"), speed=1000.0, slice_s=2.0) == 3


def test_a_source_of_lines(spark, tmp_path):
    lines = [json.dumps({"video_id": "v", "arrival": k, "raw": k / 2, "value": float(k)}) for k in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join([*lines[:3], '{"torn": ', *lines[3:]]) + "\n")
    q = live.parsed(live.source(spark, str(tmp_path / "in")), "cam").writeStream.format("memory").queryName("parsed").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("parsed").collect()
    assert sum(r.corrupt for r in got) == 1 and sorted(r.raw for r in got if not r.corrupt) == [k / 2 for k in range(6)] and {r.video_id for r in got} == {"cam", None}
    live.recorded(live.source(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "r")).awaitTermination()
    assert spark.read.text(str(tmp_path / "out")).count() == 7
    q = live.frames(spark, str(tmp_path / "in"), lambda: [sampling.ScalarSampler(2.0)]).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.frame_index, r.media_ts) for r in spark.table("kept").collect()) == [(0, 0.0), (2, 1.0), (4, 2.0)]
    with pytest.raises(Refused):
        live.source(spark, "tcp://nowhere")


def test_answers_are_due_again_for_another_describer(spark):
    from momentlake.operators import answers

    planned = spark.createDataFrame([("v", c, "yolo", "m1") for c in range(3)], "video_id string, chunk_id long, sampler_id string, describer string")
    done = planned.filter("chunk_id < 2").withColumn("describer", F.when(F.col("chunk_id") == 0, "m1").otherwise("m0"))
    assert [r.chunk_id for r in answers.due(planned, done).collect()] == [2]
    assert sorted(r.chunk_id for r in answers.due(planned, done, same=("describer",)).collect()) == [1, 2]


def test_samplers_over_boxes_and_layouts(spark):
    far = [("cat", (0, 0, 10, 10))], [("cat", (100, 100, 110, 110))], [("dog", (0, 0, 10, 10))]
    blind, aware, near = sampling.DetectionSampler(0.3, class_aware=False), sampling.DetectionSampler(0.3), sampling.objects()
    for s, want in ((blind, [True, True, True]), (aware, [True, True, True]), (near, [True, True, True])):
        assert [s.offer(float(k), v) for k, v in enumerate(far)] == want
    s = sampling.DetectionSampler(0.3, class_aware=False)
    assert [s.offer(0.0, far[0]), s.offer(1.0, far[2]), s.offer(2.0, [])] == [True, False, False]
    assert s.views(far[0]) == [("frame", None), ("cat 1 of 1", (0, 0, 10, 10))] and s.views([], "crops") == [("frame", None)] and s.views(far[0], "crops") == [("cat 1 of 1", (0, 0, 10, 10))]
    for wrong in (lambda: sampling.DetectionSampler(metric="l2"), lambda: s.views(far[0], "all")):
        with pytest.raises(UnknownOption):
            wrong()
    picture = np.zeros((64, 64))
    picture[8:16, 8:40] = 200.0
    picture[40:48, 8:40] = 90.0
    one, two = sampling.text_layout(picture, [(8, 8, 40, 16)], 16), sampling.text_layout(picture, [(8, 40, 40, 48)], 16)
    assert float(one @ one) == pytest.approx(1, abs=1e-5) and float(one @ two) < 0.5 and len(sampling.text_layout(picture, [])) == 0
    t = sampling.text()
    assert [t.offer(float(k), v) for k, v in enumerate((one, one, [], two))] == [True, False, False, True]
    b = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 15.0, 10.0))], "a struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>")
    got = b.select(boxes.iou(F.col("a"), F.col("b")).alias("i"), boxes.proximity(F.col("a"), F.col("b")).alias("p"), boxes.crop(F.col("b"), F.lit(14), F.lit(20)).alias("c"), boxes.enlargement(F.col("a"), 25.0).alias("e")).first()
    assert got.i == pytest.approx(1 / 3) and got.p == pytest.approx(sampling.nearness((0, 0, 10, 10), (5, 0, 15, 10))) and tuple(got.c) == (4, 0, 14, 11) and got.e == 2.5
    frames = spark.createDataFrame([("v", i, float(i), bytes([v] * 12)) for i, v in enumerate([0, 9, 30, 0])], "video_id string, frame_index long, media_ts double, image binary")
    planes = lambda raw: np.frombuffer(raw, np.uint8).reshape(3, 2, 2)
    assert sorted((r.at, r.score) for r in sampling.picture_scores(frames, planes).collect()) == [(1.0, 9.0), (2.0, 21.0), (3.0, 30.0)]
    assert [(r.at, r.score) for r in sampling.picture_scores(frames, planes, 2).collect()] == [(2.0, 30.0)]


def test_records(spark, tmp_path):
    grid_ = [{"chunk_id": c, "start_ts": 10.0 * c, "end_ts": 10.0 * c + 10} for c in range(2)]
    write = lambda name, **doc: (tmp_path / f"{name}.json").write_text(json.dumps(doc)) and str(tmp_path / f"{name}.json")
    t = write("timeline", document="timeline", video_id="v", fingerprint="g1", duration_s=20.0, chunk_count=2, chunks=grid_)
    said = [{"chunk_id": 0, "text": "hello", "word_count": 1, "turns": [{"speaker": "A", "start": 1.0, "end": 3.0, "text": "hello"}]}, {"chunk_id": 1, "text": "", "word_count": 0, "turns": []}]
    x = write("transcript", document="transcript", video_id="v", timeline_fingerprint="g1", chunks=said)
    block = {"sampler": "yolo", "question": "scene", "frame_count": 1, "frame_indexes": [1], "description": " a man ", "structured": '{"mood": "calm", "people": [{"name": "x", "age": "9"}, {"name": " "}]}'}
    d = write("descriptions", document="descriptions", video_id="v", timeline_fingerprint="g1", chunks=[{"chunk_id": 0, "samplers": {"yolo:scene": block}}])
    r = record.open_record(spark, t, d, x)
    got = batch.aggregate(r, tier="free")
    assert set(got.tables) == {"stats", "coverage", "speakers"}
    s = got.tables["stats"].first()
    assert (s.duration_s, s.chunks, s.words, s.chunks_with_speech, s.words_per_minute, s.descriptions_by_sampler) == (20.0, 2, 1, 1, 3.0, {"yolo:scene": 1})
    c = got.tables["coverage"].first()
    assert (c["both"], c.neither, list(c.silent_chunks)) == (1, 1, [1])
    p = got.tables["speakers"].first()
    assert (p.speakers, p.monologue, p.speech_s, p.speech_ratio, p.dominant) == (1, True, 2.0, 0.1, "A")
    line = batch.lines(r, "transcript+scene[summary,mood,people.name]").collect()
    assert [x.line for x in line] == ["[0] 0-10s  transcript: hello  yolo:scene: a man. mood: calm. people: name x"]
    for wrong in ({"video_id": "w", "timeline_fingerprint": "g1"}, {"video_id": "v", "timeline_fingerprint": "g2"}):
        other = write("other", document="descriptions", chunks=[], **wrong)
        with pytest.raises(Refused):
            record.open_record(spark, t, other)
    assert selection.labels(selection.parse("scene[mood],scene[people.name],x=transcript")) == ["mood", "people-name", "x"]
    assert selection.answer_ids("summary", selection.parse("scene")) == ["summary"] and selection.answer_ids("summary", selection.parse("a=scene,transcript"))[0] == "summary~a"
    assert selection.text_map(r.answers, r.spoken).first().texts == {"transcript": "hello", "yolo:scene": " a man "}
    assert selection.sources_of(r.answers, r.spoken).first().sources == ["transcript", "yolo:scene"]
    assert {(v.field, tuple(v["keys"])) for v in selection.vocabulary(r.answers).collect()} == {("mood", ()), ("people", ("age", "name"))}
    # what is unchanged isn't made again
    f = record.fingerprint(r.answers, ["video_id"], ["chunk_id", "description"]).select(F.col("video_id").alias("source_id"), F.lit("summary").alias("aggregate_id"), "inputs_fingerprint", F.lit("v1").alias("version"), F.lit(None).cast("string").alias("model"))
    assert record.due(f, f).count() == 0 and record.due(f, f.withColumn("version", F.lit("v2"))).count() == 1 and record.due(f, None).count() == 1
    assert record.model_key(a=1) != record.model_key(a=2)
    rows, seen = record.observed(spark.range(7), "n", most=F.max("id"))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 7, "most": 6}
    with record.step("a step", video="v") as said:
        said["rows"] = 1
    # several recordings as one
    tables = {"chunks": r.grid.unionByName(r.grid.withColumn("video_id", F.lit("w"))), "timelines": spark.createDataFrame([("v", "uniform"), ("w", "scene")], "video_id string, policy string"), "spoken": r.spoken, "descriptions": r.answers}
    both = combine.combine(tables, "vw", spark.createDataFrame([("v", 2.0), ("w", 3.5)], "video_id string, stored_mb double"))
    assert both["timelines"].first().policy == "mixed" and both["stats"].first().stored_mb == 5.5
    assert [(x.chunk_id, x.text) for x in both["spoken"].orderBy("chunk_id").collect()] == [(0, "hello"), (1, ""), (2, ""), (3, "")]
    assert [(x.member, x.member_start_ts) for x in combine.origin(both["chunks"], both["members"]).orderBy("chunk_id").collect()] == [("v", 0.0), ("v", 10.0), ("w", 0.0), ("w", 10.0)]


def test_texts_and_times(spark):
    rows = [("a. ", '{"b": {"x": 1, "w": [1, ["p", ""]]}, "a": [], "c": true, "d": " z "}'), (None, '{"k": "v"}'), ("s", "nonsense"), ("s", None)]
    got = spark.createDataFrame(rows, "s string, j string").select(T.rendered(F.col("s"), F.col("j"))).collect()
    assert [r[0] for r in got] == ["a.. b: w 1 | p; x 1. c: True. d: z", "k: v", "s", "s"]
    t = spark.createDataFrame([("2024-03-15T09:30:00",), ("2024-03-15",), ("1970-01-01 00:00:01",), ("2024",), ("no",), (None,)], "t string").select(times.recording_time(F.col("t"))).collect()
    assert [r[0] is not None for r in t] == [True] + [False] * 5
    tags = spark.createDataFrame([({"DATE": "2020-01-01 10:00:00", "Creation_Time": "2021-02-03T04:05:06.7Z"},)], "m map<string,string>").select(times.iso_millis(times.tagged_time(F.col("m")))).first()[0]
    assert tags == "2021-02-03T04:05:06.700+00:00" and times.stamp("2024-01-01T00:00:00") == "2024-01-01T00:00:00.000+00:00"
    tone = aggregates.sentiment_chunks(spark.createDataFrame([("v", 0, "abcd", 0.5), ("v", 0, "ab", -1.0), ("v", 1, "x", -0.25)], "video_id string, chunk_id long, piece string, signed double"))
    assert sorted((r.label, r.score, r.pieces) for r in tone.collect()) == [("negative", 0.25, 1), ("positive", 0.0, 2)]
    assert list(aggregates.sentiment(tone).first().turning_points) == [1]
    assert T.render_json("x", "[1]") == "x"
