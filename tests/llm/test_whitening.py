"""Whitening against the dense eigensolver and exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tracelens.llm.whitening import fit_axes, polar, spectrum, whiten

SF = "/root/testdata/sf0.001"


def matrices():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64):
        a = rng.standard_normal((n, n))
        yield a @ a.T
        yield a + a.T
        q, _ = np.linalg.qr(a)
        yield q @ np.diag(10.0 ** -np.arange(n)) @ q.T  # falling fast
        yield q @ np.diag([5.0] * (n // 2) + [1.0] * (n - n // 2)) @ q.T  # repeated
        yield np.eye(n) * 3
        yield np.zeros((n, n))
        yield q @ np.diag(1 + 1e-13 * np.arange(n)) @ q.T  # equal to rounding
    yield np.ones((20, 20))


@pytest.mark.parametrize("a", list(matrices()))
def test_spectrum(a):
    a = (a + a.T) / 2
    e, v = spectrum(a)
    scale = max(np.linalg.norm(a), 1e-300)
    assert np.abs(v.T @ v - np.eye(len(a))).max() < 1e-13
    assert np.linalg.norm(a @ v - v * e) < 2e-13 * scale * len(a)
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * scale and (np.diff(e) <= 1e-15 * scale).all()


def test_polar():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    e, v = np.linalg.eigh(a)
    assert np.abs(polar(a) - v * np.sign(e) @ v.T).max() < 1e-12


def expected(rows, most=32):
    size = max(sorted({len(v) for v in (r[1] for r in rows) if v}), key=lambda s: sum(v is not None and len(v) == s for _, v in rows))
    used = [(i, v) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in used]
    n, s = len(x), [sum(c) for c in zip(*x)]
    d = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s)] for r in x])
    v = d.T @ d / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    return used, n, [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x], d, v, e, axes


def place(row):
    return -1 if row.vec_id is None else row.vec_id, row.deviation


def check(rows, df):
    used, n, deviation, d, v, e, axes = expected(rows)
    got = {}
    for r in whiten(df).collect():
        got.setdefault(r.component, []).append(r)
    assert len(got) == min(32, len(e))
    z = np.array([[r.whitened for r in sorted(got[c], key=place)] for c in sorted(got)]).T
    order = sorted(range(len(used)), key=lambda i: (-1 if used[i][0] is None else used[i][0], deviation[i]))
    for c, mine in got.items():
        mine = sorted(mine, key=place)
        assert [(r.vec_id, r.n, r.deviation) for r in mine] == [(used[i][0], n, deviation[i]) for i in order]
        want = d @ axes[:, c - 1] / np.sqrt(e[c - 1])
        want = want[order] * np.sign(want[order] @ z[:, c - 1])
        assert np.abs(z[:, c - 1] - want).max() < 1e-8
        assert abs(mine[0].explained - e[c - 1] / np.trace(v)) < 1e-10
    error = np.abs(z.T @ z / n - np.outer(z.mean(0), z.mean(0)) - np.eye(len(got))).max()
    assert all(r.identity_error < 1e-9 for m in got.values() for r in m) and error < 1e-9


def test_query_rows(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in df.collect()], df)


def test_defined_cases(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(5) * [1, 30, 0.2, 4000, 1] + [0, 1e6, 0, 0, 9]).tolist()) for i in range(60)]
    rows += [rows[3], (None, rows[4][1]), (4, [1.0, 1e6, 3.0, 4.0, 5.0]), (70, None), (71, [1.0, None, 2.0, 3.0, 4.0]), (72, [math.nan] * 5), (73, [math.inf, 1.0, 1.0, 1.0, 1.0]), (74, []), (75, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as component").repartition(7)
    check(rows, df)


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5):
        assert whiten(spark.createDataFrame(rows, schema)).count() == 0
    flat = [(i, [float(i), 7.0, float(i) * 2]) for i in range(10)]  # one direction only
    assert {r.component for r in whiten(spark.createDataFrame(flat, schema)).collect()} == {1}
    huge = [(i, [float(i % 3) * 1e30, float(i % 2)]) for i in range(8)]
    assert {r.deviation for r in whiten(spark.createDataFrame(huge, schema)).collect()} == {None}


def test_sums_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = (fit_axes(df.repartition(k)) for k in (1, 9))
    assert a["sums"] == b["sums"] and (a["covariance"] == b["covariance"]).all()
