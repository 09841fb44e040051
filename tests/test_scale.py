"""Numbering without one task, the stored text index, and links without all pairs."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlake.functions.stems import english
from momentlake.operators import aggregates, combine, linking, numbering, search, text_index


def test_running_sums_and_places(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, 1, 2, 5])) for i in r.sample(range(1000), 400)] + [("c", None, 3)]
    df = spark.createDataFrame(rows, "g string, o int, x int").repartition(7)
    got = {(x.g, x.o): (x.s, x.n) for x in numbering.running(df, ["g"], ["o"], {"s": F.col("x").cast("long"), "n": F.lit(1).cast("long")}).collect()}
    want = {}
    for g in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0))
        for k, x in enumerate(own):
            want[g, x[1]] = (sum(y[2] or 0 for y in own[:k]), k)
    assert got == want
    every = {x.o: x.position for x in numbering.numbered(df.filter("o IS NOT NULL").select("o"), [], ["o"]).collect()}
    assert every == {o: k for k, o in enumerate(sorted(x[1] for x in rows if x[1] is not None))}
    assert numbering.numbered(df.limit(0), ["g"], ["o"]).collect() == []


def windows_without_keys(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in re.findall(r"Window \[.*?\], (?=\[)?.*", plan) if re.search(r"windowspecdefinition\(\w+#\d+L? ASC", x)]


def test_offsets_and_origin(spark):
    r = random.Random(2)
    size = {f"v{i:03d}": r.randint(1, 300) for i in range(60)}
    grid = spark.createDataFrame([(v, c, 10.0 * c, 10.0 * c + 10) for v, n in size.items() for c in range(n)], "video_id string, chunk_id long, start_ts double, end_ts double")
    members = combine.offsets(grid, "all")
    assert not windows_without_keys(members)
    got = {m.video_id: (m.first_chunk, m.offset_s) for m in members.collect()}
    before, want = 0, {}
    for v in sorted(size):
        want[v] = (before, 10.0 * before)
        before += size[v]
    assert got == want
    back = combine.origin(combine.combined_grid(grid, members), members).collect()
    assert len(back) == before and all(b.chunk_id == want[b.member][0] + b.member_chunk_id and b.member_start_ts == 10.0 * b.member_chunk_id for b in back)


def test_fold_moves_texts_to_their_batch_only(spark):
    rows = spark.createDataFrame([("v", i, f"t{i}") for i in range(60)], "video_id string, position long, text string").repartition(3)
    plans = []

    def reduce(batches):
        plans.append(batches._jdf.queryExecution().optimizedPlan().toString())
        return batches.select("video_id", "position", F.array_join("texts", "+").alias("text"))

    layers = [df.collect() for _, df in aggregates.fold(rows, "video_id", "position", "text", reduce)]
    assert [len(x) for x in layers] == [3, 1] and layers[-1][0].text == "+".join(f"t{i}" for i in range(60))
    assert not any("text" in w for p in plans for w in re.findall(r"\n[ :+-]*Window .*", p))


WORDS = ["running", "runs", "ran", "houses", "house", "the", "and", "nation", "national", "Straße", "x1", "日本"]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    rows = [(f"v{i % 3}", i, " ".join(r.choices(WORDS, k=r.choice([0, 3, 12, 200])))) for i in range(150)] + [("v9", 900, None), ("v9", 901, "house " * 40 + "nation")]
    return rows, spark.createDataFrame(rows, "video_id string, chunk_id int, content string").repartition(5)


@pytest.mark.parametrize("stemmed", [False, True])
@pytest.mark.parametrize("query", ["house", "houses running", '"running house" nation', "nation -house", "-x1", "日本 straße runs runs", "the and", "", "unknown"])
def test_index_gives_the_rows_of_the_scan(spark, corpus, query, stemmed):
    rows, df = corpus
    for limit in (3, 40):
        want = [tuple(x) for x in search.text_rank(df, query, ["video_id", "chunk_id"], limit, stemmed=stemmed).collect()]
        got = [tuple(x) for x in text_index.top(spark, index_of(spark, df, stemmed), query, limit).collect()]
        assert sorted(got, key=lambda x: x[-1]) == sorted(want, key=lambda x: x[-1])
    if query == "houses running" and stemmed:  # by plain words
        from momentlake.functions.text import STOP_WORDS

        tf = lambda t: sum(english(w) in ("hous", "run") for w in re.findall(r"[^\W_]+", (t or "").lower()) if w not in STOP_WORDS)
        both = lambda t: len({english(w) for w in re.findall(r"[^\W_]+", (t or "").lower())} & {"hous", "run"}) == 2
        plain = sorted(((-tf(t), v, c) for v, c, t in rows if both(t)))[:40]
        assert [(v, c) for _, v, c in plain] == [x[:2] for x in sorted(want, key=lambda x: x[-1])]


_built = {}


def index_of(spark, df, stemmed):
    if stemmed not in _built:
        _built[stemmed] = text_index.build(df, ["video_id", "chunk_id"], stemmed=stemmed)
    return _built[stemmed]


def test_index_reads_the_querys_buckets_and_best_levels_only(spark, corpus):
    index = index_of(spark, corpus[1], False)
    own = index.postings(spark).filter(F.col("bucket").isin(text_index.bucket_of("nation", index.buckets)) & (F.col("lexeme") == "nation"))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [" in plan and "lexeme" in plan
    assert {"bucket", "level"} <= set(index.postings(spark).columns)
    seen = []
    found = text_index.top(spark, index, "house", 1, seen).collect()
    assert (found[0].video_id, found[0].chunk_id) == ("v9", 901) and found[0].tf == 40 and min(seen) > 0  # the lower levels were only looked up
    assert seen == sorted(seen, reverse=True)


def plain_mutual(rows, quantile):
    """Mutual best pairs over the bar, by plain loops: (i, j)."""
    v = {m: np.array(x, float) for _, _, m, x in rows}
    answer = {m: (b, c) for b, c, m, _ in rows}

    def cos(a, b):
        x, y = v[a], v[b]
        dot = lambda p, q: float(np.cumsum(p * q)[-1])
        return dot(x, y) / ((math.sqrt(dot(x, x)) or 1.0) * (math.sqrt(dot(y, y)) or 1.0))

    out = set()
    for block in {b for b, *_ in rows}:
        own = [m for b, _, m, _ in rows if b == block]
        known = [cos(a, b) for a in own for b in own if a < b and answer[a] == answer[b]]
        if not known:
            continue
        bar = float(np.quantile(known, quantile)) if quantile else max(known)
        best = {}
        for a in own:
            for b in own:
                if answer[a] != answer[b]:
                    k = (a, answer[b])
                    best[k] = min(best.get(k, (9, 0)), (-cos(a, b), b))
        out |= {(min(a, b), max(a, b)) for a in own for (s, b) in [best[k] for k in best if k[0] == a] if -s > bar and best[b, answer[a]][1] == a}
    return out


@pytest.mark.parametrize("part", [1024, 16])
@pytest.mark.parametrize("quantile", [None, 0.5])
def test_mutual_links_without_all_pairs(spark, part, quantile):
    g = np.random.default_rng(7)
    rows = [(f"r{i % 2}", int(g.integers(0, 25)), i, g.normal(size=5).tolist()) for i in range(160)]
    rows += [("r0", 90 + k, 500 + k, rows[3][3]) for k in range(6)]  # equal vectors: ties
    rows += [("alone", 1, 900, [1.0] * 5)]
    df = spark.createDataFrame(rows + [("r0", 7, 901, None)], "video_id string, chunk_id int, mention long, vector array<double>")
    found = linking.mutual_links(df, ["video_id"], ["chunk_id"], quantile, part=part)
    assert {(x.i, x.j) for x in found.collect()} == plain_mutual(rows, quantile) and found.count() > 10


def test_a_long_recording_makes_no_row_for_each_pair(spark):
    """20,000 mentions of one recording: as many rows as links, not as pairs."""
    g = np.random.default_rng(8)
    x = g.normal(size=(10_000, 16)).astype(np.float32)
    rows = spark.createDataFrame([("r", i // 2, i, x[i % 10_000].tolist()) for i in range(20_000)], "video_id string, chunk_id int, mention long, vector array<float>")
    found = linking.mutual_links(rows, ["video_id"], ["chunk_id"], fixed=0.9999)
    pairs = {(p.i, p.j) for p in found.collect()}
    assert pairs == {(i, i + 10_000) for i in range(10_000)}


def test_filters_on_keys_of_any_name(spark):
    df = spark.createDataFrame([(1, '{"a.b": "x", "it\'s": ["p", "q"], "n": 7}'), (2, '{"a": {"b": "x"}}'), (3, None), (4, "no json")], "id int, s string")
    ids = lambda wanted: [x.id for x in df.filter(search.structured_matches(F.col("s"), wanted)).collect()]
    assert ids({"a.b": "x"}) == [1] and ids({"it's": "q"}) == [1] and ids({"n": "7"}) == [1] and ids({"a.b": "x", "n": "8"}) == []


def state(store, table):
    return store._current(table)


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    from momentlake.sources.store import ParquetStore

    store = ParquetStore(spark, f"file://{tmp_path}/s")
    rows = lambda ids, x: spark.createDataFrame([(f"v{i}", c, f"{x}{i}") for i in ids for c in range(3)], "video_id string, chunk_id int, label string")
    store.write("chunks", rows(range(200), "a"))
    first = state(store, "chunks")
    assert len(first) > 40
    store.write("chunks", rows([7], "b"))
    second = state(store, "chunks")
    moved = {k for k in second if second[k] != first.get(k)}
    assert len(moved) == 1
    # replace in a scope that isn't the owner's: the rows that go are found by their keys
    store.replace("chunks", rows([7], "c").limit(1), spark.createDataFrame([("b7",)], "label string"), ["label"])
    third = state(store, "chunks")
    assert {k for k in third if third[k] != second.get(k)} == moved
    assert sorted((r.chunk_id, r.label) for r in store.read("chunks").filter("video_id = 'v7'").collect()) == [(0, "c7")]
    store.delete_stale("chunks", store.read("chunks").filter("video_id <> 'v9'").select("video_id"), ["video_id"])
    fourth = state(store, "chunks")
    assert len({k for k in {*third, *fourth} if fourth.get(k) != third.get(k)}) == 1 and store.read("chunks").count() == 199 * 3 + 1 - 3
    store.delete_stale("chunks", store.read("chunks").select("video_id"), ["video_id"])
    assert state(store, "chunks") == fourth  # nothing was stale
    assert {r.video_id for r in store.live_ids().collect()} == set() if state(store, "observations") else True


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from momentlake.errors import Moved
    from momentlake.sources.store import ParquetStore

    folder = f"file://{tmp_path}/s"
    rows = lambda k: spark.createDataFrame([(f"v{i}", k, f"w{k}") for i in range(5)], "video_id string, chunk_id int, label string")
    ParquetStore(spark, folder).write("chunks", rows(0))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: ParquetStore(spark, folder).write("chunks", rows(k)), range(1, 5)))
    store = ParquetStore(spark, folder)
    assert sorted((r.video_id, r.chunk_id) for r in store.read("chunks").collect()) == sorted((f"v{i}", k) for i in range(5) for k in range(5))
    # a state that isn't the current one any more can't be built upon
    after, now = store._state("chunks")
    with pytest.raises(Moved):
        store._publish("chunks", rows(9), list(now), now, after - 1)
    assert store._state("chunks") == (after, now)


def test_large_buckets_are_several_files(spark, tmp_path):
    from momentlake.sources.store import ParquetStore

    store = ParquetStore(spark, f"file://{tmp_path}/s")
    df = spark.range(60_000).selectExpr("'one' AS video_id", "cast(id AS int) AS chunk_id", "repeat(md5(cast(id AS string)), 4) AS label")
    try:
        for k, v in (("advisoryPartitionSizeInBytes", "1m"), ("coalescePartitions.minPartitionSize", "64k")):
            spark.conf.set(f"spark.sql.adaptive.{k}", v)
        store.write("chunks", df)
    finally:
        for k in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize"):
            spark.conf.unset(f"spark.sql.adaptive.{k}")
    at = next(iter(state(store, "chunks").values()))
    assert len(list((tmp_path / "s/chunks" / at).glob("*.parquet"))) > 2 and store.read("chunks").count() == 60_000


def test_moments_with_their_hits(spark):
    units = spark.createDataFrame([("v", c, s, "frames", q, f"{s} of {c}", v, None) for c, s, q, v in [(0, "a", "who", [1.0, 0.0]), (0, "b", "what", [0.9, 0.1]), (1, "a", "who", [0.5, 0.5]), (2, "a", "who", [0.0, 1.0])]], "video_id string, chunk_id int, sampler_id string, sampler string, question string, content string, vector array<double>, structured string")
    got = search.search(units, [1.0, 0.0], search.SearchRequest(limit=2), details=True).orderBy(F.desc("score")).collect()
    assert [(r.chunk_id, [(h.sampler_id, h.vector_rank, h.text_rank, h.question, h.content) for h in r.found]) for r in got] == [(0, [("a", 1, None, "who", "a of 0"), ("b", 2, None, "what", "b of 0")]), (1, [("a", 3, None, "who", "a of 1")])]
    assert search.search_notes(search.SearchRequest(sampler="x"), 0)[0].startswith("nothing matched") and search.search_notes(search.SearchRequest(), 0)[0] == "nothing is indexed for this embedder"
    assert "only the other space" in search.search_notes(search.SearchRequest(video_ids="v"), 3, ["frames:512"])[0]


def test_entities_are_told_of_by_number(spark):
    """e1000 comes after e101."""
    from momentlake.operators import entities as E

    turn = 2 * math.pi / 1100
    rows = [("v", c, "s", "f", 0, f"thing {g}", {"k": f"{g}"}, f"c{c}", 2 * g + k, [math.cos(g * turn), math.sin(g * turn)]) for g in range(1100) for k, c in enumerate((g, 2000 + g))]
    found = spark.createDataFrame(rows, "video_id string, chunk_id int, sampler_id string, field string, index int, signature string, entry map<string,string>, key string, mention long, vector array<double>")
    grid = spark.createDataFrame([("v", c, float(c), c + 1.0) for c in range(3200)], "video_id string, chunk_id int, start_ts double, end_ts double")
    out = E.linked(E.Profile("things", "f", ("k",), fixed=0.99999, max_narratives=105), found, grid)
    told = [r.entity_id for r in out.entities.filter("narrated").collect()]
    assert sorted(told) == [f"e{k:03d}" for k in range(105)] and out.entities.count() == 1100


def test_people_are_compared_one_by_one():
    """One of two who is replaced is seen although the mean stays; nobody in shot leaves the reference."""
    from momentlake.operators import sampling

    a, b, c, d = np.eye(4)
    frames = [[a, b], [b, a], [], [a, c], [a], [c, a, b], [], [0.9 * a + 0.1 * b, c], [d]]
    sampler, kept, scores = sampling.people(0.83), [], []
    for k, value in enumerate(frames):
        if sampler.offer(float(k), value):
            kept.append(k)
        scores.append(sampler.last_score)
    reference, want = frames[0], [0]  # the plain rule
    for k, value in enumerate(frames[1:], 1):
        if value and min(max(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))) for y in reference) for x in value) < 0.83:
            want.append(k)
            reference = value
    assert kept == want == [0, 3, 5, 8] and scores[2] == 1.0
    # the mean of these two frames is the same, the people are not
    one, two = [a + b, c + d], [a + c, b + d]
    other = sampling.people(0.83)
    assert other.offer(0.0, one) and np.allclose(sum(one), sum(two)) and other.offer(1.0, two)
    got = sampling.crops(np.arange(100).reshape(10, 10), [(0, 0, 4, 4), (8, 8, 30, 30), (3, 3, 3, 3)], lambda ps: [p.shape for p in ps], pad=0.5, batch=2)
    assert got == [(6, 6), (10, 10), (1, 1)]


@pytest.mark.parametrize("stride", [1, 3])
def test_picture_scores_of_a_cut_recording(spark, stride):
    from momentlake.operators import sampling

    r = random.Random(9)
    rows = [(v, i, float(i), bytes([r.randint(0, 255)])) for v in ("a", "b") for i in range(60) if r.random() < 0.8 or i % 20 == 7]
    frames = spark.createDataFrame(rows, "video_id string, frame_index long, media_ts double, image binary").repartition(4)
    planes = lambda b: np.full((3, 2, 2), b[0], float)
    want = []
    for v in ("a", "b"):
        own = [x for x in rows if x[0] == v and x[1] % stride == 0]
        want += [(v, y[2], sampling.plane_change(planes(y[3]), planes(x[3]))) for x, y in zip(own, own[1:], strict=False)]
    for span in (4, 7, 1000):
        assert sorted(tuple(x) for x in sampling.picture_scores(frames, planes, stride, span).collect()) == sorted(want)


def test_weights_of_keys_change_the_groups(spark):
    """A profile with weights compares its keys one by one, standardised by the pairs of one answer; a lone mention is no entity."""
    from momentlake.errors import Refused
    from momentlake.operators import entities as E

    axis = {"red": [1.0, 0.0, 0.0], "blue": [0.0, 1.0, 0.0], "tall": [0.6, 0.8, 0.0], "short": [0.0, 0.6, 0.8], None: [0.1, 0.1, 0.9]}
    people = {0: [("red", "tall"), ("blue", "short")], 1: [("red", "short"), ("blue", None)], 2: [("blue", "tall")]}
    rows, keyed = [], []
    for c, own in people.items():
        for k, (coat, build) in enumerate(own):
            m = len(rows)
            entry = {"coat": coat} | ({"build": build} if build else {})
            rows.append(("v", c, "s/q", "people", k, "; ".join(entry.values()), entry, f"c{c}/{k}", m, [float(m), 1.0, 1.0]))
            keyed += [("v", m, name, axis[value]) for name, value in entry.items()]
    rows.append(("w", 0, "s/q", "people", 0, "red", {"coat": "red"}, "c0/0", 0, [1.0, 0.0, 0.0]))
    found = spark.createDataFrame(rows, "video_id string, chunk_id int, sampler_id string, field string, index int, signature string, entry map<string,string>, key string, mention long, vector array<double>")
    vectors = spark.createDataFrame(keyed, "video_id string, mention long, name string, vector array<double>")
    grid = spark.createDataFrame([(v, c, float(c), c + 1.0) for v in "vw" for c in range(3)], "video_id string, chunk_id int, start_ts double, end_ts double")

    def groups(weights):
        out = E.linked(E.Profile("people", "people", ("coat", "build"), weights=weights), found, grid, keyed=vectors, unknown=axis[None])
        by = {}
        for r in out.mentions.collect():
            by.setdefault((r.video_id, r.entity_id), set()).add(r.mention)
        assert not any(v == "w" for v, _ in by)
        assert {(r.video_id, r.mentions, r["count"]) for r in out.figures.collect()} == {("v", 5, len(by)), ("w", 1, 0)}
        return sorted(sorted(x) for x in by.values())

    def plain(weights):
        v = [[np.array(axis[e.get(k)]) for k in weights] for *_, e in [(r[6],) for r in rows[:5]]]
        cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
        sim = {(i, j): sum(w * cos(a, b) for w, a, b in zip(weights.values(), v[i], v[j], strict=True)) / sum(weights.values()) for i in range(5) for j in range(5) if i < j}
        known = [s for (i, j), s in sim.items() if rows[i][1] == rows[j][1]]
        z = {p: (s - np.mean(known)) / (np.std(known) or 1.0) for p, s in sim.items()}
        bar = max(z[p] for p in z if rows[p[0]][1] == rows[p[1]][1])
        of = lambda i, j: z[min(i, j), max(i, j)]
        best = lambda i, c: max((j for j in range(5) if rows[j][1] == c), key=lambda j: (of(i, j), -j))
        links = sorted(((-z[i, j], i, j) for i, j in z if rows[i][1] != rows[j][1] and z[i, j] > bar and best(i, rows[j][1]) == j and best(j, rows[i][1]) == i))
        return sorted(map(sorted, _grouped(linking.merge_greedily(list(range(5)), [r[1] for r in rows[:5]], [(-s, i, j) for s, i, j in links]))))

    assert groups({"coat": 1.0}) == plain({"coat": 1.0}) and groups({"coat": 1.0, "build": 3.0}) == plain({"coat": 1.0, "build": 3.0})
    assert groups({"coat": 1.0}) != groups({"build": 1.0})
    assert {(r.mention, r.name, r.text) for r in E.keyed_texts(E.Profile("p", "people", ("coat",), weights={"build": 1.0}), found).collect()} == {(0, "build", "tall"), (1, "build", "short"), (2, "build", "short"), (4, "build", "tall")}
    with pytest.raises(Refused):
        E.linked(E.Profile("people", "people", ("coat",), weights={"coat": 1.0}), found, grid)


def _grouped(heads):
    out = {}
    for i, h in heads.items():
        out.setdefault(h, []).append(i)
    return out.values()
