"""Whitening against numpy's own eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from comarca.llm import whitening
from comarca.llm.frames import load
from comarca.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute(rows, components=32):
    """Rows of the report by Python integers and ``eigh``; signs of components are free."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), [int(s) for s in x.sum(0)]
    mean = np.array([s / n for s in sums], float)
    z = x.astype(float) - mean
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [i for i, _ in rows], n, deviation, z @ u / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "pairs", "rank", "zero", "one"])
def test_components(kind):
    rng, d = np.random.default_rng(3), 1 if kind == "one" else 24
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = {
        "random": rng.random(d) * 9, "graded": 10.0 ** -np.linspace(0, 11, d), "equal": np.full(d, 2.5), "zero": np.zeros(d),
        "pairs": np.repeat(np.arange(d // 2), 2).astype(float), "rank": np.r_[3.0, 2.0, np.zeros(22)], "one": np.ones(1),
    }[kind]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.components_of(a)
    top = max(np.abs(e).max(), 1e-300)
    assert np.abs(values - np.sort(e)[::-1]).max() <= 1e-14 * top
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-14 * top
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() <= 1e-14


def test_polar_factor():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(9, 9))
    a = a + a.T
    u = whitening.polar(a)
    e, v = np.linalg.eigh(a)
    assert np.allclose(u, (v * np.sign(e)) @ v.T, atol=1e-13)


def test_report_equals_brute_force(spark):
    rows = sorted((r["vec_id"], r["embedding"]) for r in load(spark, FOLDER, "embeddings").collect())
    ids, n, deviation, want, explained = brute(rows)
    got = QUERIES["op11_embedding_whitening"](spark, FOLDER).orderBy("vec_id", "component").collect()
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, c) for i in ids for c in range(1, 33)]
    assert {r["n"] for r in got} == {n} and [r["deviation"] for r in got[::32]] == deviation
    found = np.array([r["whitened"] for r in got]).reshape(-1, 32)
    sign = np.sign((found * want).sum(0))
    assert np.abs(found - want * sign).max() < 1e-8
    assert np.abs(np.array([r["explained"] for r in got[:32]]) / explained - 1).max() < 1e-8
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    assert np.abs(found.T @ found / n - np.eye(32)).max() < 1e-8


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, component int, n double")


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [3.0, 1.0]), (None, [0.0, 5.0]), (2, None), (3, []), (4, [None, 1.0]),
        (5, [float("nan"), 1.0]), (6, [float("-inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, [-2.0, 0.01]),
    ]
    used = [(i, v) for i, v in rows if v and len(v) == 2 and all(c is not None and math.isfinite(c) for c in v)]
    ids, n, deviation, want, explained = brute(used)
    got = whitening.whiten_report(table(spark, rows)).collect()
    assert len(got) == 2 * len(used)
    assert sorted(str((r["vec_id"], r["n"], r["deviation"], round(abs(r["whitened"]), 6))) for r in got) == sorted(
        str((i, n, d, round(abs(float(w)), 6))) for i, d, ws in zip(ids, deviation, want) for w in ws
    )
    assert whitening.whiten_report(table(spark, rows).limit(0)).collect() == []
    assert whitening.whiten_report(table(spark, rows[:1])).collect() == []  # nothing varies
    flat = whitening.whiten_report(table(spark, [(i, [float(i), 2.0]) for i in range(4)])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 4  # the second component has no scale


def test_deviation_of_any_size():
    far = whitening.Whitener(3, [3 << 40, 6], np.eye(2), 2)
    x = np.array([[(1 << 40) + 5, 7], [1 << 42, 2]], np.int64)
    assert far.deviations(x) == [(3 * 5) ** 2 + (21 - 6) ** 2, None]
    many = whitening.Whitener(10**9, [10**15] * 2, np.eye(2), 2)
    assert many.deviations(np.array([[10**6 + 2, 10**6 - 2], [10**6 + 3, 10**6 + 3]])) == [8 * 10**18, None]
