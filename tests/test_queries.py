"""Every query of the catalogue against its SQL in DuckDB, at the smallest scale; and the entry's guard."""

import math
import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from momentlake.plans.catalogue import ORACLE, PLACED, QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return int(x) if hasattr(x, "__index__") and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def greedy(duck, got, columns):
    """Per chunk the first frame, then those 600 s after the last kept whose score differs by 100, at most four."""
    want, state = [], {}
    for v, c, i, ts, score in duck.execute(f"{PLACED} SELECT video_id, chunk_id, frame_index, media_ts, score FROM placed ORDER BY video_id, chunk_id, frame_index").fetchall():
        kept, last, reference = state.get((v, c), (0, None, None))
        if kept == 0 or (kept < 4 and ts - last >= 600 and abs(score - reference) >= 100):
            want.append((v, c, i))
            state[v, c] = kept + 1, ts, score
    k = [columns.index(x) for x in ("video_id", "chunk_id", "frame_index")]
    assert sorted(tuple(r[x] for x in k) for r in got) == sorted(want) and len(want) > 10


def folded(duck, got, columns):
    """Batches of 25 texts become one, layer by layer, until one is left."""
    from momentlake.models import stub_reduce

    texts = {}
    for source, text in duck.execute("SELECT source, text FROM documents ORDER BY source, doc_id").fetchall():
        texts.setdefault(source, []).append(text)
    most = max(map(len, texts.values()))
    while True:
        last = most <= 25
        step = most if last else 25
        texts = {k: [stub_reduce(["\n".join(t for t in x[a : a + step] if t is not None)])[0] for a in range(0, len(x), step)] for k, x in texts.items()}
        if last:
            break
        most = max(map(len, texts.values()))
    at = [columns.index(x) for x in ("video_id", "text")]
    assert sorted((r[at[0]], r[at[1]]) for r in got) == sorted((k, x[0]) for k, x in texts.items())


def stemmed(duck, got, columns):
    """The 40 units with most words of the query's stems, of those that hold two of them at least."""
    from momentlake.functions.stems import english
    from momentlake.functions.text import STOP_WORDS

    wanted = {english(w) for w in ("thonors", "entions", "tion")}
    hits = []
    for source, i, lang, text in duck.execute("SELECT source, doc_id, lang, text FROM documents").fetchall():
        own = [english(w) for w in re.findall(r"[^\W_]+", (text or "").lower()) if w not in STOP_WORDS]
        tf, matched = sum(w in wanted for w in own), len(wanted.intersection(own))
        if matched >= 2:
            hits.append((-tf, source, i // 4, f"{lang}:{i}", matched))
    want = [(v, c, s, m, -n, k) for k, (n, v, c, s, m) in enumerate(sorted(hits)[:40], 1)]
    at = [columns.index(x) for x in ("video_id", "chunk_id", "sampler_id", "matched", "tf", "text_rank")]
    assert sorted(tuple(r[k] for k in at) for r in got) == sorted(want) and len(want) > 10


def linked(duck, got, columns):
    import numpy as np
    from test_answers import plain_links

    rows = duck.execute("SELECT (vec_id // 100)::VARCHAR, vec_id % 100 // 5, vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    want = []
    for v in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == v]
        u = np.array([r[3] for r in own], float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        sim = u @ u.T
        n = len(own)
        apart = [[i != j and own[i][1] == own[j][1] for j in range(n)] for i in range(n)]
        bar = float(np.quantile([sim[i, j] for i in range(n) for j in range(i + 1, n) if apart[i][j]], 0.95))
        want += [tuple(own[k][2] for k in g) for g in plain_links(own, sim, apart, [0] * n, bar, True)]
    groups = {}
    m, g = columns.index("mention"), columns.index("group")
    for r in got:
        groups.setdefault(r[g], []).append(r[m])
    assert sorted(tuple(sorted(x)) for x in groups.values()) == sorted(want) and any(len(x) > 1 for x in want)


def merged(duck, got, columns):
    from test_engine import plain_segments

    rows = duck.execute("SELECT (vec_id % 4)::VARCHAR, vec_id // 4, embedding FROM embeddings ORDER BY vec_id").fetchall()
    want = []
    for v in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == v]
        want += [(v, r[1], k) for r, k in zip(own, plain_segments([r[2] for r in own], [10.0] * len(own), 60.0, 12), strict=True)]
    at = [columns.index(x) for x in ("video_id", "position", "segment")]
    assert sorted(tuple(r[x] for x in at) for r in got) == sorted(want)


def pieced(duck, got, columns):
    """No piece is over the limit, none could take its next sentence, and together they are the text."""
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    i, n, p = (columns.index(x) for x in ("doc_id", "piece_no", "piece"))
    by = {}
    for r in sorted(got, key=lambda r: (r[i], r[n])):
        by.setdefault(r[i], []).append(r[p])
    limit = max(len(x) for ps in by.values() for x in ps)
    for k, text in texts.items():
        own = by.get(k, [])
        assert "".join("".join(own).split()) == "".join((text or "").split()) and all(0 < len(x) <= limit for x in own)
        for a, b in zip(own, own[1:], strict=False):
            first = re.split(r"(?<=[.!?])\s+", b)[0]
            assert len(a) + 1 + len(first) > limit or re.search(r"[^.!?]$", a) or len(first) == limit or len(a) + len(b) > limit


PLAIN = {"index_search_stems": stemmed, "greedy_sampler": greedy, "stub_summary": folded, "linker_groups": linked, "segments_merged": merged, "sentence_pieces": pieced}


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    if name not in ORACLE:
        PLAIN[name](duck, [tuple(r) for r in got.collect()], got.columns)
        return
    cursor = duck.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in got.collect()) == want


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_filters_reach_the_scan_and_texts_stay_where_they_are(spark):
    plan = lambda name: QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    filtered = plan("moments_filtered")
    assert "EqualTo(lang,en)" in filtered and "NestedLoop" not in filtered and "CartesianProduct" not in filtered
    for name in ("moments_filtered", "moments_dense", "vector_topk"):
        assert "ReadSchema: struct<doc_id:bigint,text" not in plan(name), name  # a search by vector reads no text
    for name in ("chunk_assign", "word_speaker", "chunk_nearest"):
        assert "NestedLoop" not in plan(name) and "CartesianProduct" not in plan(name), name


def test_entry_works_without_the_optional_parts(tmp_path):
    """As if momentlake/llm and corpus_pipeline.py were deleted."""
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "momentlake").mkdir()
    for p in (root / "momentlake").iterdir():
        if p.name != "llm":
            (tmp_path / "momentlake" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
