"""Whitening against numpy's dense eigenvectors and exact whole-number moments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foundling.llm import whitening as w


def _brute(vectors):
    """n, S, unit eigenvectors and eigenvalues (falling) of the distinct whole vectors."""
    x = np.unique(np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + w.SHIFT, axis=0)
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    values, turn = np.linalg.eigh(y.T @ y / n)
    return n, sums, values[::-1], turn[:, ::-1], np.einsum("ij,ij->", y, y) / n


def _compare(rows, vectors, k):
    n, sums, values, turn, trace = _brute([v for _, v in vectors])
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert len(rows) == k * len(vectors)
    for c in range(k):
        p = turn[:, c] / np.sqrt(values[c])
        mine, theirs = [], []
        for i, v in vectors:
            x = np.floor(64 * np.float32(v).astype(float)).astype(np.int64) + w.SHIFT
            for r in got[i, c + 1]:
                mine.append(r.whitened)
                theirs.append((n * x - sums) / n @ p)
                assert (r.n, r.deviation) == (n, int(((n * x - sums) ** 2).sum()))
                assert r.explained == pytest.approx(values[c] / trace, rel=1e-9) and r.identity_error < 1e-9
        sign = np.sign(np.dot(mine, theirs))
        assert np.abs(np.array(mine) * sign - theirs).max() < 1e-7


@pytest.fixture
def table(spark):
    def make(vectors):
        data = [(i, None if v is None else [None if e is None else float(e) for e in v], 1, "x", [1]) for i, v in vectors]
        return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, x string, v array<int>")

    return make


@pytest.mark.parametrize("d, k", [(6, 6), (40, 16), (90, 16)])
def test_whitening(table, d, k):
    rng = np.random.default_rng(d)
    steep = rng.normal(size=(d, d)) * (1.5 ** -np.arange(d))[:, None] * 4
    good = [(i, (rng.normal(size=d) @ steep + 3).tolist()) for i in range(400)]
    good += [(1000 + i, good[5][1]) for i in range(300)]  # copies are fitted once
    bad = [(5000, None), (5001, [float("nan")] * d), (5002, [None] + [0.5] * (d - 1)), (5003, [float("-inf")] * d), (5004, []), (5005, [1.0] * (d + 1))]
    df = table(good + bad)
    _compare(w.whiten(df, w.fit(df)).collect(), good, k)


def test_steep_and_equal_eigenvalues():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(100, 100)))[0]
    for values in (10.0 ** -np.linspace(0, 9, 100), np.r_[[5.0] * 4, [1.0] * 12, np.linspace(0.99, 0.2, 84)], np.r_[1e6, 1e3, np.linspace(1, 0.9, 98)]):
        v = q * values @ q.T
        found, x, worst = w.subspace(lambda y, v=v: v @ y, 100, 16)
        assert np.allclose(found, np.sort(values)[::-1][:16], rtol=0, atol=1e-12 * values.max())
        assert np.abs(x.T @ x - np.eye(16)).max() < 1e-12 and np.linalg.norm(v @ x - x * found, axis=0).max() <= 2e-11 * values.max()
        assert worst <= w.ROUNDED


@pytest.mark.parametrize("wide", [(106.0, 104.0), (150.0,), ()])
def test_nearly_equal_eigenvalues(wide):
    """What many vectors without a direction of their own give: a bulk a thousandth wide, and few values far off."""
    rng = np.random.default_rng(5)
    g = rng.normal(size=(64, 64))
    v = 62.5 * (np.eye(64) + (g + g.T) / np.sqrt(2 * 1.5e7))
    for top in wide:
        u = rng.normal(size=64)
        v += (top - 62.5) * np.outer(u, u) / (u @ u)
    found, x, worst = w.subspace(lambda y: v @ y, 64, 16)
    assert np.allclose(found, np.linalg.eigvalsh(v)[::-1][:16], rtol=0, atol=1e-11)
    assert np.abs(x.T @ x - np.eye(16)).max() < 1e-12 and np.linalg.norm(v @ x - x * found, axis=0).max() <= 1e-12 * found[0]
    assert worst <= w.ROUNDED


def test_blocks_take_the_bytes_their_entries_need(table):
    rows = [(i, [float(i % 5), 1.0]) for i in range(40)]
    x = table(rows).select(w.whole(F.col("embedding")).alias("v")).mapInArrow(w._pack, "v binary")
    block = x.coalesce(1).mapInArrow(w._blocks, "rows long, sums array<long>, x binary").first()
    assert len(block.x) == 1 + 40 * 2 * 2 and w._unpacked(block.x).reshape(-1, 2).sum(axis=0).tolist() == block.sums


def test_filter_damps_only_the_unwanted():
    values = np.array([3.0, 2.0, 1.0, 0.5, 0.1])
    out = w.chebyshev(lambda y: values[:, None] * y, np.ones((5, 1)), 8, 0.1, 1.0, 3.0)[:, 0]
    assert out[0] == pytest.approx(1) and out[1] > 1e-3 and np.abs(out[2:]).max() < 1e-5


def test_rank_and_repeats(table, spark):
    rng = np.random.default_rng(9)
    flat = rng.normal(size=(50, 3)) @ np.round(rng.normal(size=(3, 30)) * 4)
    rows = [(i, (np.round(r * 4) / 4).tolist()) for i, r in enumerate(np.round(flat))] + [(None, (np.round(flat[0])).tolist()), (3, np.round(flat[3]).tolist())]
    df = table(rows)
    model = w.fit(df)
    n, sums, values, _, _ = _brute([v for _, v in rows])
    assert model.n == n and model.sums == sums.tolist() and len(model.values) == min(16, int((values > 1e-12 * values[0]).sum()))
    out = w.whiten(df, model)
    assert out.filter("vec_id IS NULL AND component = 1").count() == 1 and out.filter("vec_id = 3 AND component = 1").count() == 2


def test_nothing_to_fit(table):
    for rows in ([], [(1, None)], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        df = table(rows)
        assert w.whiten(df, w.fit(df)).count() == 0


def test_many_tasks_and_large_entries(table, spark, monkeypatch):
    monkeypatch.setattr(w, "ADDERS", 1)
    monkeypatch.setattr(w, "BLOCK", 32)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * 1e4).round(1).tolist()) for i in range(300)]
    df = table(rows).repartition(6, F.col("vec_id"))
    _compare(w.whiten(df, w.fit(df)).collect(), rows, 4)
    huge = table([(i, [3e38 * (-1) ** i, float(i)]) for i in range(8)])
    found = w.whiten(huge, w.fit(huge)).filter("component = 1").collect()
    assert len(found) == 8 and {r.deviation for r in found} == {None}


def test_tasks_follow_the_rows(table, spark, monkeypatch):
    """A pass has no more tasks than blocks, however many partitions the shuffle of the vectors had."""
    asked = []
    monkeypatch.setattr(w, "Passes", lambda blocks, n, sums, made=w.Passes: asked.append(blocks.rdd.getNumPartitions()) or made(blocks, n, sums))
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).round(2).tolist()) for i in range(200)]
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = table(rows)
        _compare(w.whiten(df, w.fit(df)).collect(), rows, 5)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert asked == [1]
