"""Whitening against exact integers and a plain covariance of all rows."""

import numpy as np
import pytest

from routelens.llm import whitening


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, copies string").repartition(3)


def brute(rows, weights):
    d = max(len(v) for _, v in rows)
    x = [[int(np.floor(64.0 * c)) + 1_000_000 for c in np.array(v, np.float32).astype(float)] + [1_000_000] * (d - len(v)) for _, v in rows]
    fit = x if weights == "count" else [list(t) for t in dict.fromkeys(map(tuple, x))]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    cov = np.cov(np.array(fit, float).T, bias=True).reshape(d, d)
    return n, deviation, cov, np.array(x, float) - np.array(sums) / n


@pytest.mark.parametrize("weights", ["one", "count"])
def test_against_brute_force(spark, weights):
    rng = np.random.default_rng(1)
    basis = rng.normal(size=(6, 6))
    rows = [(k, (rng.normal(size=6) @ basis * np.array([9, 5, 3, 2, 1, 0.5])).tolist()) for k in range(80)]
    rows += [(1000 + k, rows[0][1]) for k in range(60)] + [(None, rows[1][1]), (5, rows[1][1]), (6, [1.0, -2.5])]
    bad = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6)]
    n, deviation, cov, centred = brute(rows, weights)
    got = whitening.components(whitening.whiten(frame(spark, rows + bad), weights, 4)).collect()
    assert len(got) == 4 * len(rows) and {r.component for r in got} == {1, 2, 3, 4} and {r.n for r in got} == {n}
    assert all(r.identity_error < 1e-9 for r in got)
    assert sorted(str((r.vec_id, r.deviation)) for r in got if r.component == 1) == sorted(str((i, v)) for (i, _), v in zip(rows, deviation, strict=True))
    value = np.sort(np.linalg.eigvalsh(cov))[::-1]
    for k in range(4):
        assert {round(r.explained, 12) for r in got if r.component == k + 1} == {round(value[k] / np.trace(cov), 12)}
    vector = np.linalg.eigh(cov)[1][:, ::-1][:, :4]
    white = centred @ vector / np.sqrt(value[:4])
    by = {(r.vec_id, r.component): r.whitened for r in got}
    for k in range(4):
        mine = np.array([by[i, k + 1] for i in range(80) if i != 5])
        plain = white[[i for i in range(80) if i != 5], k]
        assert min(np.abs(mine - plain).max(), np.abs(mine + plain).max()) < 1e-9


def test_large_components_are_exact(spark):
    rows = [(1, [3e30, 1.0]), (2, [-3e30, 5.0]), (3, [1e9, -7.25])]
    fit = [[max(-(1 << 61), min(1 << 61, int(64 * float(np.float32(c))))) + 1_000_000 if abs(c) > 100 else int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*fit, strict=True)]
    want = {i: sum((3 * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for (i, _), x in zip(rows, fit, strict=True)}
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, rows)).collect()}
    assert {i: int(v) if v is not None else None for i, v in got.items()} == {i: v if v < 10**38 else None for i, v in want.items()}


def test_constant_dimensions_and_empty_tables(spark):
    one = whitening.components(whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)
    flat = whitening.components(whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 4.0]), (3, [1.0, 9.0])]))).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and flat[0].identity_error < 1e-9
    assert whitening.whiten(frame(spark, [])).collect() == [] and whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
