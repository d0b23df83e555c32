"""Tail probabilities against known values and independent sums."""

import math

from tracelens.functions import special
from tracelens.plans import association as A


def t_tail(t, df):
    """Finite series for whole degrees of freedom."""
    th = math.atan(abs(t) / math.sqrt(df))
    c, s = math.cos(th), math.sin(th)
    if df % 2 == 0:
        term, total = 1.0, 0.0
        for k in range(df // 2):
            total += term
            term *= c * c * (2 * k + 1) / (2 * k + 2)
        return 1 - s * total
    term, total = c, 0.0
    for k in range((df - 1) // 2):
        total += term
        term *= c * c * (2 * k + 2) / (2 * k + 3)
    return 1 - 2 / math.pi * (th + s * total)


def test_t_tail(spark):
    grid = [(t, df) for t in (0.0, 0.1, 0.5, 1.0, 1.2, 2.0, 3.5, 8.0) for df in (1, 2, 3, 10, 37, 180, 397, 3000, 4999, 6001)]
    df = spark.createDataFrame([(t, float(d)) for t, d in grid], "t double, d double")
    got = df.select("t", "d", special.t_pvalue("t", "d").alias("p")).collect()
    for r in got:
        assert abs(r.p - t_tail(r.t, int(r.d))) < 1e-8, r
    one = spark.createDataFrame([(0.2, 5), (None, 5), (1.0, 9), (0.5, 2)], "rho double, n long")
    p = [r.p for r in A.with_pvalue(one).collect()]
    assert round(p[0], 2) == 0.75 and p[1] is None and p[2] < 1e-100 and p[3] is None


def test_normal_and_chi2(spark):
    df = spark.createDataFrame([(z,) for z in (0.0, 0.3, 1.0, 1.96, 2.5, 3.4, 3.6, 6.0, 12.0)], "z double")
    for r in df.select("z", special.normal_pvalue("z").alias("p"), special.chi2_1df_pvalue("z * z").alias("c")).collect():
        want = math.erfc(r.z / math.sqrt(2))
        assert abs(r.p - want) <= 1e-12 + 1e-9 * want and abs(r.c - want) <= 1e-12 + 1e-9 * want, r
    c = spark.createDataFrame([(9.488, 2), (18.307, 5), (0.0, 3)], "x double, k long")
    got = [r[0] for r in c.select(special.chi2_even_pvalue("x", "k")).collect()]
    assert abs(got[0] - 0.05) < 1e-4 and abs(got[1] - 0.05) < 1e-4 and got[2] == 1.0


def test_tails_in_logs(spark):
    """No jump where the two forms meet, no underflow, and null data of many strata stay null."""
    import numpy as np

    grid = [(t, d) for t in (0.01, 0.5, 2.0, 3.0, 10.0, 30.0, 60.0) for d in (4999.0, 5000.0, 5001.0, 5002.0)]
    df = spark.createDataFrame(grid, "t double, d double")
    got = {(r.t, r.d): r.lp for r in df.select("t", "d", special.t_log_pvalue("t", "d").alias("lp")).collect()}
    for t in {g[0] for g in grid}:
        a, b, c, e = (got[t, d] for d in (4999.0, 5000.0, 5001.0, 5002.0))
        assert abs((c - b) - ((b - a) + (e - c)) / 2) < 1e-9 * max(1, abs(b) * 1e-2), (t, a, b, c, e)
    assert got[60.0, 5000.0] < -1200
    rng = np.random.default_rng(1)
    rows = [("f", float(p), 0.1, 20) for p in rng.uniform(0, 1, 2000)]
    null = spark.createDataFrame(rows, "feature string, p double, rho double, n long")
    assert 0.01 < A.fisher_combine(null, ["feature"]).first().p_combined < 0.99
    strong = spark.createDataFrame([("f", 0.9, 20_000), ("f", 0.95, 20_000), ("f", 1.0, 20_000)], "feature string, rho double, n long")
    ln = [r.ln_p for r in A.with_log_pvalue(strong).collect()]
    assert ln[0] < -16_000 and ln[1] < ln[0] and ln[2] == math.log(1e-300)


def test_published_fixed_points(spark):
    ci = spark.createDataFrame([(0.494, 183), (-0.253, 183)], "rho double, n long")
    got = [(round(r.ci_low, 4), round(r.ci_high, 4)) for r in A.fisher_interval(ci).collect()]
    assert got == [(0.3759, 0.5963), (-0.3840, -0.1121)]
    ps = [0.0006, 0.0058, 0.0081, 0.0106, 0.0179, 0.0463, 0.028, 0.05, 0.10, 0.10, 0.10, 0.15, 0.15, 0.20, 0.20, 0.30, 0.30, 0.30, 0.40, 0.50, 0.60, 0.60, 0.70]
    df = spark.createDataFrame([(f"f{i:02d}", p) for i, p in enumerate(ps)], "feature string, p double")
    assert [r.feature for r in A.benjamini_hochberg(df, "feature").where("survives").collect()] == ["f00"]
    five = spark.createDataFrame([(f"f{i}", p) for i, p in enumerate([0.003, 0.001, 0.005, 0.025, 0.026])], "feature string, p double")
    assert A.benjamini_hochberg(five, "feature").where("survives").count() == 5
    holm = {r.feature: r.p_holm for r in A.holm(five, "feature").collect()}
    assert holm == {"f1": 0.005, "f0": 0.012, "f2": 0.015, "f3": 0.05, "f4": 0.05}


def test_kappa_and_interaction(spark):
    from tracelens.operators.gates import kappa
    from tracelens.plans.evidence import interaction_bonus
    rows = [(1, 1)] * 27 + [(1, 0)] * 7 + [(0, 1)] * 2 + [(0, 0)] * 34
    r = kappa(spark.createDataFrame(rows, "a int, b int"), [], "a", "b").collect()[0]
    assert r.n == 70 and abs(r.agreement - 61 / 70) < 1e-12 and round(r.kappa, 3) == 0.742
    cells = spark.createDataFrame([("HH", 0.73), ("HL", 0.23), ("LH", 0.32), ("LL", 0.38)], "cell string, rate double")
    assert round(interaction_bonus(cells).collect()[0].bonus, 2) == 0.56


def test_spearman_matches_numpy_and_cuts(spark):
    import random

    import numpy as np
    rng = random.Random(11)
    rows = [(g, float(rng.randint(0, 9)) if g == "a" else rng.gauss(0, 1), rng.randint(0, 1), rng.gauss(0, 2)) for g in "ab" for _ in range(60)]
    df = spark.createDataFrame(rows + [("c", 1.0, 0, 0.5), ("c", 1.0, 1, 0.1)], "g string, x double, y int, z double").cache()

    def ranks(v):
        v = np.asarray(v, float)
        return np.array([np.mean(np.flatnonzero(np.sort(v) == x) + 1) for x in v])

    def want(g):
        part = [r for r in rows if r[0] == g]
        return np.corrcoef(ranks([r[1] for r in part]), ranks([r[2] for r in part]))[0, 1]

    def want_partial(g):
        part = [r for r in rows if r[0] == g]
        rx, ry, rz = (ranks([r[i] for r in part]) for i in (1, 2, 3))
        fit = np.column_stack([np.ones(len(rz)), rz])
        ex, ey = (np.round(v - fit @ np.linalg.lstsq(fit, v, rcond=None)[0], 9) for v in (rx, ry))
        return np.corrcoef(ranks(ex), ranks(ey))[0, 1]

    for limit in (1_000_000, 10):
        got = {r.g: r.rho for r in A.spearman(df, ["g"], limit=limit).collect()}
        assert got["c"] is None
        part = {r.g: r.rho for r in A.partial_spearman(df, ["g"], "x", "y", "z", limit=limit).collect()}
        for g in "ab":
            assert abs(got[g] - want(g)) < 1e-12 and abs(part[g] - want_partial(g)) < 1e-9
