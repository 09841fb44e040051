"""Neighbours by graph against brute force, and whitening against plain integers."""

import numpy as np
import pytest

from momentlake.llm import graph_search, whitening

NAN = float("nan")


def brute(rows, every, k):
    """(query_id, rank, vec_id, score) over every row; ids may repeat or be null."""
    good = [(i, v, np.array(v, float)) for i, v, *_ in rows if v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = []
    for n, (q, _, a) in enumerate(good):
        if q is None or q % every:
            continue
        found = [(-graph_search.cosine(a, b), i is None, i or 0, m, i) for m, (i, _, b) in enumerate(good) if m != n and len(b) == len(a)]
        out += [(q, r, f[4], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return out


def test_neighbours_of_odd_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).tolist(), 1, "x") for i in range(40)]
    rows += [(100 + i, rows[0][1], 2, "x") for i in range(30)]  # copies of one vector: ties to the smaller id
    rows += [(10, rows[10][1], 2, "x"), (10, rows[10][1], 2, "x"), (None, rows[20][1], 2, "x"), (None, None, 2, "x")]
    rows += [(200, None, 1, "x"), (210, [], 1, "x"), (220, [0.0] * 6, 1, "x"), (230, [NAN] * 6, 1, "x"), (240, [None] * 6, 1, "x"), (250, [1e-170] * 6, 1, "x"), (260, [1e200] * 6, 1, "x")]
    rows += [(300, [1.0, 2.0], 1, "x"), (310, [2.0, 1.0], 1, "x"), (320, [3.0], 1, "x"), (330, [-0.0, 1.0], 1, "x"), (340, [0.0, 1.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int, q string").repartition(3)
    got = [tuple(x) for x in graph_search.nearest_neighbours(df, graph_search.F.col("vec_id") % 10 == 0).collect()]
    want = brute(rows, 10, 5)
    order = lambda x: (x[0], x[1], x[2] is None, x[2] or 0)
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-12, rtol=0)


def test_recall_on_clusters_and_noise(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 24))
    x = np.concatenate([r.normal(size=(600, 24)), centres[r.integers(0, 12, 900)] + 0.2 * r.normal(size=(900, 24)), np.repeat(r.normal(size=(1, 24)), 700, 0) + 1e-4 * r.normal(size=(700, 24))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = graph_search.nearest_neighbours(df, graph_search.F.col("vec_id") % 25 == 0).collect()
    want = {(q, v) for q, _, v, _ in brute(rows, 25, 5)}
    assert len(got) == len(want) and len(want & {(g.query_id, g.vec_id) for g in got}) >= 0.95 * len(want)


def test_no_neighbours(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert graph_search.nearest_neighbours(none, graph_search.F.col("vec_id") % 50 == 0).collect() == []
    one = spark.createDataFrame([(50, [1.0]), (51, None)], "vec_id long, embedding array<float>")
    assert graph_search.nearest_neighbours(one, graph_search.F.col("vec_id") % 50 == 0).collect() == []


def test_gram_is_exact():
    r = np.random.default_rng(3)
    for top in (100, 40_000, 2**40, 2**62):
        x = r.integers(-top, top, (50, 4))
        x[0, 0] = -(2**63) if top == 2**62 else -top
        want = x.astype(object).T @ x.astype(object)
        assert (whitening.gram(x) == want).all()
        back = sum(d.astype(object) << (32 * k) for k, d in enumerate(whitening.digits(want)))
        assert (back == want).all()


def check_whitening(got, rows, close):
    """got: rows of the operator; rows: (vec_id, vector) of one length that remain."""
    x = np.array([[int(np.floor(256.0 * c)) for c in v] for _, v in rows], object)
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, s = len(fit), fit.sum(0)
    c = n * fit - s
    v = np.array([[int(z) / (n**3) for z in row] for row in c.T @ c])
    values, vectors = (whitening.jacobi if close else np.linalg.eigh)(v)
    order = np.argsort(-values)
    for k in range(min(4, x.shape[1])):
        e, u = values[order[k]], vectors[:, order[k]]
        w = ((n * x - s).astype(float) / n) @ u / np.sqrt(e)
        own = sorted((g for g in got if g.component == k + 1), key=lambda g: (g.vec_id, g.deviation))
        w = w[sorted(range(len(rows)), key=lambda i: (rows[i][0], int(((n * x[i] - s) ** 2).sum())))]
        mine = np.array([g.whitened for g in own])
        assert min(abs(mine - w).max(), abs(mine + w).max()) < 1e-6
        assert all(abs(g.explained / (e / np.trace(v)) - 1) < 1e-6 and g.identity_error < 1e-8 and g.n == n for g in own)
        assert sorted(g.deviation for g in own) == sorted(int(((n * z - s) ** 2).sum()) for z in x)


@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e4, 1e-1), (-3e3, 30.0)])
def test_whitening(spark, shift, scale):
    r = np.random.default_rng(4)
    x = shift + scale * r.normal(size=(400, 6)) * np.array([5, 3, 2, 1.5, 1, 0.5])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[7].tolist()) for i in (7, 7, 500, 501)] * 20  # copies count once in the fit
    odd = [(600, None), (601, [None] * 6), (602, [NAN] * 6), (603, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    got = whitening.whiten(df).collect()
    assert len(got) == 4 * len(rows)
    check_whitening(got, rows, False)


def test_whitening_of_unlike_scales(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 4)) * np.array([1e4, 0.5, 10.0, 200.0])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    check_whitening(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows, True)


def test_whitening_without_variance(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (None, [1.0, 2.0]), (3, [5.0]), (4, [5.0]), (5, [1e300, 0.0, 1.0]), (6, [0.0, 1.0, 1.0])]
    got = {(g.vec_id, g.component): g for g in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 2 * 3 + 2 + 2 * 3
    assert got[1, 1].n == 2 and abs(got[1, 1].whitened) == pytest.approx(1) and got[1, 1].explained == pytest.approx(1) and got[1, 1].whitened == got[None, 1].whitened
    assert got[1, 2].whitened is None and got[1, 2].explained == 0 and got[1, 2].identity_error == got[1, 1].identity_error < 1e-9
    assert got[3, 1].whitened is None and got[3, 1].deviation == 0 and got[3, 1].identity_error is None
    assert got[5, 1].deviation is None and abs(got[5, 1].whitened) == pytest.approx(1)
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<double>, x string")).collect() == []
