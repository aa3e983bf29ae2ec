"""Embedding whitening (op11) against eigenvectors of numpy and exact sums of plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cartlane.llm import whitening as W
from cartlane.llm.common import ship_package

SCHEMA = "vec_id long, embedding array<float>, deviation long, whitened string, label int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", None) for i, v in vectors], SCHEMA).repartition(3)


def vectors(n=300, width=12, seed=1):
    r = np.random.default_rng(seed)
    basis = r.standard_normal((width, width)) * (0.7 ** np.arange(width))
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(r.standard_normal((n, width)) @ basis + 3)]


def brute(rows, components=8):
    """{(id, component): (n, deviation, |whitened|, explained)} of the rows that remain."""
    left = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, width = len(left), max(len(v) for _, v in left)
    left = [(i, v + [100000] * (width - len(v))) for i, v in left]
    sums = [sum(v[k] for _, v in left) for k in range(width)]
    x = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for _, v in left], float) / n
    cov = x.T @ x / n
    values, basis = np.linalg.eigh(cov)
    out = {}
    for k in range(min(components, width)):
        e, u = values[-1 - k], basis[:, -1 - k]
        for (i, v), row in zip(left, x, strict=True):
            out[i, k + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), abs(row @ u) / math.sqrt(e), e / np.trace(cov))
    return out


def check(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(whitened, rel=1e-8, abs=1e-8)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9


def test_rows_match_numpy(spark):
    ship_package(spark)
    rows = vectors()
    rows += [(1000, None), (1001, [1.0] * 11 + [None]), (1002, [float("nan")] * 12), (1003, [float("-inf")] + [0.0] * 11),
             (1004, rows[3][1]), (1005, rows[3][1]), (1006, [0.5, -0.25]), (1007, [])]
    got = W.component_rows(frame(spark, rows)).collect()
    check(got, brute(rows))
    # Whitened values have unit covariance, with one sign for all rows.
    z = np.array(sorted((r["vec_id"], r["component"], r["whitened"]) for r in got))[:, 2].reshape(-1, 8)
    assert np.abs(z.T @ z / len(z) - np.eye(8)).max() < 1e-9
    assert abs(np.abs(z.T @ z / len(z) - np.eye(8)).max() - got[0]["identity_error"]) < 1e-9
    again = {(r["vec_id"], r["component"]): r for r in W.component_rows(frame(spark, rows).repartition(7)).collect()}
    # The components do not depend on the partitioning; a product's last digit may.
    assert all(again[r["vec_id"], r["component"]]["whitened"] == pytest.approx(r["whitened"], abs=1e-12) for r in got)


def test_defined_cases(spark):
    ship_package(spark)
    assert W.component_rows(frame(spark, [])).count() == 0
    assert W.component_rows(frame(spark, [(1, None), (2, [None])])).count() == 0
    one = W.component_rows(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one)] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    # One direction only; a null id stays a row.
    line = W.component_rows(frame(spark, [(None, [0.0, 0.0, 1.0]), (7, [1.0, 1.0, 1.0]), (8, [2.0, 2.0, 1.0])])).collect()
    assert len(line) == 9 and sum(r["vec_id"] is None for r in line) == 3
    assert sorted(abs(r["whitened"]) for r in line if r["component"] == 1) == pytest.approx([0, 1.5 ** 0.5, 1.5 ** 0.5], abs=1e-12)
    assert all(r["whitened"] is None and r["explained"] == 0 for r in line if r["component"] > 1)
    assert all(r["identity_error"] < 1e-12 for r in line)
    with pytest.raises(Exception, match="beyond"):
        W.component_rows(frame(spark, [(1, [1e30]), (2, [0.0])])).collect()


def test_exact_where_numbers_are_wide(spark):
    ship_package(spark)
    r = random.Random(5)
    rows = [(i, [float(np.float32(r.uniform(-9e8, 9e8))), float(i % 7)]) for i in range(40)]
    want = brute(rows)
    got = W.component_rows(frame(spark, rows)).collect()
    assert {(r["vec_id"], r["component"]): r["deviation"] for r in got} == {k: v[1] if v[1] < 1 << 63 else None for k, v in want.items()}


@pytest.mark.parametrize("case", ["random", "twins", "zeros", "indefinite pivots", "close"])
def test_spectrum(case):
    r = np.random.default_rng(3)
    q, _ = np.linalg.qr(r.standard_normal((20, 20)))
    values = {"random": np.sort(r.random(20))[::-1], "twins": np.array([5, 5, 5, 2, 2, *[1] * 15], float),
              "zeros": np.array([3, 2, 1, *[0] * 17], float), "indefinite pivots": np.array([9, 8, 7, 6, 5, *[1e-9] * 15]),
              "close": 1 + 1e-11 * np.arange(20)[::-1]}[case]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    s, vectors = W.Spectrum(a), []
    for k in range(8):
        pair = s.next()
        if values[k] == 0:
            assert pair is None
            break
        assert pair[0] == pytest.approx(values[k], abs=1e-13 * values[0])
        assert np.linalg.norm(a @ pair[1] - pair[0] * pair[1]) < 1e-13 * values[0] * 20
        vectors.append(pair[1])
    u = np.array(vectors)
    assert np.abs(u @ u.T - np.eye(len(u))).max() < 1e-12


def test_inertia_and_solve():
    r = np.random.default_rng(9)
    for n in (1, 2, 3, 7, 30):
        for _ in range(20):
            a = r.standard_normal((n, n))
            a = a + a.T
            np.fill_diagonal(a, 0)  # blocks of two
            f = W.Factors(a + 1e-3 * np.eye(n))
            values = np.linalg.eigvalsh(a + 1e-3 * np.eye(n))
            assert f.positive() == (values > 0).sum()
            b = r.standard_normal(n)
            assert np.allclose((a + 1e-3 * np.eye(n)) @ f.solve(b, 1e-300), b, atol=1e-6)
    assert W.Factors(np.zeros((4, 4))).positive() == 0
