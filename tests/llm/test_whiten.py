from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagewise.llm.whiten import Bidiagonal, Centre, _packed, components, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], 0, "x", 1, 2)
                                  for i, v in rows], SCHEMA)


def exact(rows):
    """Whole numbers, counts, sums, variances and components by a dense solver."""
    x = {k: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for k, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - b) / n for a, b in zip(row, s)] for row in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, e[::-1], v[:, ::-1]


def check(spark, rows, want=16):
    got = defaultdict(dict)
    for r in whiten(table(spark, rows), want).collect():
        got[r.vec_id][r.component] = r
    x, n, s, e, v = exact(rows)
    assert set(got) == set(x)
    many = len(next(iter(got.values())))
    for key, row in x.items():
        assert sorted(got[key]) == list(range(1, many + 1))
        offsets = [n * a - b for a, b in zip(row, s)]
        assert {r.deviation for r in got[key].values()} == {sum(o * o for o in offsets)}
        assert {r.n for r in got[key].values()} == {n}
    errors = {r.identity_error for rs in got.values() for r in rs.values()}
    assert len(errors) == 1 and errors.pop() < 1e-9
    mine = np.array([[got[k][c].whitened for c in range(1, many + 1)] for k in x])
    for c in range(many):
        assert got[next(iter(x))][c + 1].explained == pytest.approx(e[c] / e.sum(), rel=1e-9)
    return mine, np.array([[(n * a - b) / n for a, b in zip(row, s)] for row in x.values()]), e, v


def test_components_are_those_of_a_dense_solver(shipped):
    r = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(400, 24)) * np.geomspace(1, 0.05, 24))]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a third of all rows is one vector
    mine, centred, e, v = check(shipped, rows)
    want = centred @ v[:, :16] / np.sqrt(e[:16])
    sign = np.sign((mine * want).sum(axis=0))
    np.testing.assert_allclose(mine * sign, want, atol=1e-8)


def test_equal_variances_are_all_found(shipped):
    """The corners of two boxes: eight directions of one variance, of which one start vector sees one."""
    rows = [(i, [s * 2.0 if j == i // 2 else 0.0 for j in range(10)]) for i in range(16) for s in [1 if i % 2 else -1]]
    mine, centred, e, _ = check(shipped, rows, 8)
    assert mine.shape[1] == 8 and np.allclose(e[:8], e[0])
    np.testing.assert_allclose((mine * e[0] ** 0.5) @ (mine * e[0] ** 0.5).T, centred @ centred.T, atol=1e-6)


def test_locked_runs_find_what_an_early_stop_misses(shipped):
    r = np.random.default_rng(3)
    a = np.round(r.normal(size=(300, 40)) * np.concatenate([[40, 30, 20], np.ones(37)]) * 4)
    frame = shipped.createDataFrame([([int(c) + 5000 for c in row],) for row in a], "x array<long>")
    fit = frame.mapInArrow(_packed, "x binary").cache()
    centre = Centre(300, tuple(int(s) for s in (a + 5000).sum(axis=0)))
    variance, vectors = components(fit, centre, 3)
    centred = a - a.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / 300)
    np.testing.assert_allclose(variance, e[::-1][:3], rtol=1e-12)
    np.testing.assert_allclose(np.abs((vectors * v[:, ::-1][:, :3]).sum(axis=0)), 1, atol=1e-12)
    run = Bidiagonal(fit, centre, np.zeros((40, 0)))
    for _ in range(12):
        run.step()
    left = centred @ run.weights
    np.testing.assert_allclose(left.T @ left, np.eye(12), atol=1e-10)
    np.testing.assert_allclose(run.right.T @ run.right, np.eye(12), atol=1e-12)
    np.testing.assert_allclose(centred @ run.right, left @ run.matrix(), atol=1e-8)
    fit.unpersist()


def test_rows_that_can_not_be_used_and_flat_directions(shipped):
    good = [(i, [i % 5, i % 3, 1.0, 2.0 * (i % 5)]) for i in range(30)]  # rank two of four
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0]), (103, [float("nan"), 1, 1, 1]), (104, [float("inf"), 1, 1, 1]),
           (105, [1.0, 2.0]), (106, [1e30, 0, 0, 0])]
    frame = table(shipped, good + bad + [(None, [0.5, 0, 1.0, 0.0]), (3, [3, 0, 1.0, 6.0])])
    got = whiten(frame).collect()
    assert {r.vec_id for r in got} == {*range(30), None} and {r.component for r in got} == {1, 2, 3}
    assert sum(r.vec_id == 3 for r in got) == 6
    assert whiten(table(shipped, [])).collect() == [] and whiten(table(shipped, bad[:2])).collect() == []
    assert whiten(table(shipped, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert [t for _, t in whiten(frame).dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]


def test_sums_and_deviations_are_exact_beyond_64_bits(shipped):
    rows = [(1, [2.0**45, 1.0]), (2, [-(2.0**45), 2.0]), (3, [0.0, 5.0])]
    got = {(r.vec_id, r.component): r for r in whiten(table(shipped, rows)).collect()}
    assert got[1, 1].deviation is None and got[1, 1].n == 3
    x, n, s, _, _ = exact(rows)
    assert got[3, 1].deviation == sum((n * a - b) ** 2 for a, b in zip(x[3], s))


def test_half_numbers_go_down(shipped):
    from stagewise.llm.whiten import whole_numbers

    frame = shipped.createDataFrame([(1, [-0.001, 0.999, 1 / 64])], "vec_id long, embedding array<double>")
    assert whole_numbers(frame).select(F.col("x")).first().x == [999_999, 1_000_063, 1_000_001]
