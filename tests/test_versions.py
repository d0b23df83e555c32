"""Counter-based draws, version-parallel cross-validation, rank sums without folds and fits that say whether they converged."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_models import data, frame, logit

from tracelens.functions import draws as D
from tracelens.plans import logit as M
from tracelens.plans import resample as R
from tracelens.plans import versions as V


def test_draws_are_the_same_in_numpy_columns_and_whole_numbers(spark):
    def five(x):
        return pow(x, 5, D.P)

    units = spark.range(40).select("id", *[c.alias(n) for c, n in zip(D.unit_numbers("id"), ("u1", "u2"))])
    rows = D.with_draw(units.crossJoin(spark.range(7).withColumnRenamed("id", "rep")), 42, "rep", "u1", "u2", "h").collect()
    t = units.orderBy("id").toPandas()
    all_ = D.draws(42, range(7), t["u1"].to_numpy(), t["u2"].to_numpy())
    for r in rows:
        k = [five(42 * 1_000_003 + r.rep * 8_191 + j * 131_071 + 17) for j in (1, 2, 3)]
        want = five(five(five(r.u1 + k[0]) * (k[1] % (D.P - 1) + 1) + r.u2) + k[2])
        assert r.h == want == all_[r.rep, r.id]


def test_draws_spread_evenly():
    n, reps = 30, 6000
    first, second = np.random.default_rng(0).integers(0, 1 << 28, (2, n))
    hits = D.chosen(1, np.arange(reps), first, second, 10)
    assert (hits.sum(axis=1) == 10).all()
    assert np.abs(hits.mean(axis=0) - 1 / 3).max() < 4.5 * np.sqrt(2 / 9 / reps)
    both = (hits.T.astype(float) @ hits / reps)[np.triu_indices(n, 1)]
    assert np.abs(both - 10 * 9 / (30 * 29)).max() < 5 * np.sqrt(0.1 * 0.9 / reps)
    assert not D.chosen(1, [0], first, second, 0).any() and D.chosen(1, [0], first, second, n).all()


def test_one_draw_serves_all_features(spark):
    df = frame(spark, data(11)).withColumn("x3", F.when(F.col("id") % 9 > 0, F.col("x1") * F.col("x2")))
    together = {r.feature: r for r in R.permutation_tests(df, "s", ["x1", "x2", "x3"], "y", "id", 40).collect()}
    for f in ("x1", "x2", "x3"):
        alone = R.permutation_test(df, "s", f, "y", "id", 40).first()
        assert (alone.observed, alone.permutations, alone.p) == pytest.approx((together[f].observed, 40, together[f].p))
    small = sorted(R.permutation_null(df, "s", ["x1"], "y", "id", 6).collect())
    cut = sorted(R.permutation_null(df, "s", ["x1"], "y", "id", 6, limit=7).collect())
    assert [(r.rep, round(r.statistic, 9)) for r in small] == [(r.rep, round(r.statistic, 9)) for r in cut]


def test_versions_and_rows_give_the_same(spark):
    df = frame(spark, data(12, 120))
    for select in (None, ("s", ["a", "b"])):
        args = (df, ["x1", "x2"], "y", "task", "s", "id", 7)
        a = {r.rep: r.auc for r in M.permuted_auc(*args, select_in=select).collect()}
        b = {r.rep: r.auc for r in M.permuted_auc(*args, select_in=select, at_once=4, table_rows=10).collect()}
        assert len(a) == 8 and a == pytest.approx(b, abs=1e-9)


def test_folds_from_one_pass_over_the_rows():
    """Near fits, with the bound of their error, against a fit of every fold over its rows; most folds need no pass of their own."""
    rng = np.random.default_rng(3)
    n, folds = 20_000, 100
    x = np.column_stack((rng.lognormal(1, 0.3, n), rng.random(n), np.full(n, 4.0)))
    y = (rng.random(n) < 1 / (1 + np.exp(1 - x[:, 1]))).astype(int)
    task = rng.integers(0, folds, n)
    t = V.Table(x, y, task, task % 4, *rng.integers(0, 1 << 28, (2, n)), rng.integers(-1, 2, n))
    labels = t.labels(1, np.arange(6))
    keep = t.selected(labels, 0.02, 0.9, 5)
    gamma, error, curve = t.near_fits(labels, keep, 1.0)
    c = t.prepared()
    assert (error < 1e-5).all() and (error < V.TOL).mean() > 0.5 and 0 < keep.mean() < 1  # the others take a pass
    for f in range(0, folds, 7):
        train = task != f
        mean, sd = t.scaled(train)
        z = np.column_stack((np.ones(train.sum()), (x[train] - mean) / sd))
        columns = np.column_stack((np.ones(6), keep[:, f]))
        beta = V.fit_many(z, labels[:, train].astype(float), columns, 1.0)[0]
        want = np.column_stack((beta[:, 0] - beta[:, 1:] @ ((mean - c["mean"]) / sd), beta[:, 1:] * c["sd"] / sd))
        assert (np.abs(gamma[:, f] - want).max(axis=1) < error[:, f] + 2 * V.TOL).all()
        again, rest = t.rested(labels, gamma[:, f], curve[:, f], f, 1.0)
        assert rest.all() and np.allclose(again, want, atol=2 * V.TOL)
        for s in (0, 1):
            rows = np.flatnonzero(train & (t.select == s))
            r = V.mean_ranks(x[rows, 1])
            for v in range(6):
                assert keep[v, f, 1] or abs(np.corrcoef(r, labels[v, rows])[0, 1]) <= max(0.02, V.critical_rho(len(rows), 0.9))


def test_one_class_training_sets_give_no_score(spark):
    one = spark.createDataFrame([(1, "a", "s", 0.1, 0), (2, "a", "s", 0.2, 0), (3, "b", "s", 0.3, 1), (4, "b", "s", 0.4, 0)], "id long, task string, s string, x1 double, y int")
    got = {r.rep: r.auc for r in M.permuted_auc(one, ["x1"], "y", "task", "s", "id", 4).collect()}
    assert got[0] is None and len(got) == 5
    with_null = one.unionByName(spark.createDataFrame([(5, "b", "s", None, 1)], one.schema))
    assert {r.rep: r.auc for r in M.permuted_auc(with_null, ["x1"], "y", "task", "s", "id", 4).collect()} == got


def test_tail_and_critical_value():
    for df, t, p in ((1, 1.0, 0.5), (10, 2.228138852, 0.05), (30, 1.697260887, 0.10), (5000, 1.960, 0.0500509)):
        assert abs(V.t_tail(t, df) - p) < 1e-6
    r = V.critical_rho(32, 0.10)
    assert abs(r * np.sqrt(30 / (1 - r * r)) - 1.697260887) < 1e-6 and V.critical_rho(2, 0.1) == np.inf


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_ranks_without_a_fold(spark, limit):
    """n, sums of ranks, of squares and of products by the running sums against ranks taken anew."""
    rows = [(i, t, s, float(round(x1)), x2 if i % 7 else None, y) for i, t, s, x1, x2, y in data(13)]
    df = M.fold_of(frame(spark, rows), "task").withColumn("y2", 1 - F.col("y")).drop("id")
    seen = []

    def keep(found, *args, **kw):
        seen.extend(found.collect())
        return found.withColumn("p", F.lit(1.0))

    old = M.with_pvalue
    M.with_pvalue = keep
    try:
        M._select(df, ["x1", "x2"], ["y", "y2"], list(range(9)), "s", ["a", "b"], -1.0, 0.1, 5, limit)
    finally:
        M.with_pvalue = old
    fold = {r.task: r.fold for r in df.collect()}
    got = {(r.fold, r.feature, r.rep, r.n, round(r.rho, 9)) for r in seen}
    want = set()
    for f in range(9):
        for s in "ab":
            for j, name in ((3, "x1"), (4, "x2")):
                part = [(r[j], r[5]) for r in rows if fold[r[1]] != f and r[2] == s and r[j] is not None]
                x, y = V.mean_ranks(np.array([a for a, _ in part])), np.array([b for _, b in part])
                for rep, v in ((0, y), (1, 1 - y)):
                    want.add((f, name, rep, float(len(part)), round(np.corrcoef(x, v)[0, 1], 9)))
    assert got == want


def test_separable_classes_are_reported(spark):
    rows = [(i, "t", "a" if i % 2 else "b", float(i), float((i * 7) % 10), int(i >= 20)) for i in range(40)]
    df = frame(spark, rows)
    assert not M.fit(df, ["x1"], "y", penalty=0.0)["converged"] and M.fit(df, ["x1"], "y")["converged"]
    table = {r.feature: r for r in M.stratum_logit_table(df, ["x1", "x2"], "s", "y").collect()}
    assert not table["x1"].converged and table["x1"].coef is None and table["x1"].p is None
    assert table["x2"].converged and table["x2"].p is not None
    z = np.column_stack((np.ones(40), [r[3] for r in rows]))
    *_, rest = V.fit_many(z, np.array([[r[5] for r in rows], [int(r[4] > 4) for r in rows]], float), np.ones((2, 2)), 0.0)
    assert rest.tolist() == [False, True]


def test_steps_that_go_too_far_are_halved():
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.standard_cauchy(200) * 30, [900.0]))
    y = (rng.random(201) < 1 / (1 + np.exp(-np.clip(x, -3, 3)))).astype(float)
    z = np.column_stack((np.ones(201), x / x.std()))
    start = np.array([[40.0, -40.0]])
    beta, ll, hess, rest = V.fit_many(z, y[None, :], np.ones((1, 2)), 0.0, start)
    plain = V.fit_many(z, y[None, :], np.ones((1, 2)), 0.0)
    assert rest.all() and np.allclose(beta, plain[0], atol=1e-6) and np.allclose(hess, plain[2], rtol=1e-6)


def test_large_means_keep_their_spread(spark):
    rows = [(i, f"t{i % 5}", "a", 1e9 + i % 10, 0.0, int((i * 13) % 7 > 3)) for i in range(100)]
    df = M.fold_of(frame(spark, rows), "task")
    _, _, mean, sd = M.training_scale(df, ["x1"])
    for f in range(5):
        own = np.array([r[3] for r in rows if int(r[1][1]) != f])
        assert abs(mean[f, 0] - own.mean()) < 1e-6 and abs(sd[f, 0] - own.std()) < 1e-9
    z = (np.array([r[3] for r in rows]) - 1e9 - 4.5)[:, None]
    assert np.allclose(M.fit(df, ["x1"], "y")["beta"], logit((z - z.mean(0)) / z.std(0), np.array([r[5] for r in rows]), 1.0)[0], atol=1e-6)


@pytest.mark.parametrize("n", [1, 2, 50, 2047, 2048, 9000])
def test_least_draws_whatever_the_size(n):
    """The marked units are those with the least (draw, place), also where only draws near the cut are put in order."""
    first, second = np.random.default_rng(n).integers(0, 1 << 28, (2, n))
    second[: n // 2], first[: n // 2] = 5, first[:1]  # half of the units draw the same
    h = D.draws(9, np.arange(12), first, second)
    assert h[0, 0] < D.P and (h[:, : n // 2] == h[:, :1]).all()
    for positives in {0, 1, n // 7, n // 2, n - 1, n}:
        order = np.argsort(h, axis=1, kind="stable")[:, :positives]
        want = np.zeros((12, n), bool)
        np.put_along_axis(want, order, True, axis=1)
        assert (D.chosen(9, np.arange(12), first, second, positives) == want).all()


def test_tables_of_a_gigabyte_are_packed_without_a_python_object_a_row(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("not for a table of this size")

    df = spark.range(200_500).selectExpr("id", "concat('t', id % 6) as task", "concat('s', id % 2) as s", "cast(pmod(hash(id), 1000) as double) as x1", "pmod(hash(id, 1), 3) div 2 as y")
    monkeypatch.setattr(M, "cross_validate", never)
    monkeypatch.setattr(type(df), "toPandas", never)
    got = M.permuted_auc(df, ["x1"], "y", "task", "s", "id", 2).collect()
    assert sorted(r.rep for r in got) == [0, 1, 2] and all(abs(r.auc - 0.5) < 0.02 for r in got)


def test_rounds_over_a_table_too_large_for_a_task_leave_no_plans(spark):
    df = frame(spark, data(12, 120))
    got = M.permuted_auc(df, ["x1", "x2"], "y", "task", "s", "id", 3, at_once=1, table_rows=10)
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString() and got.dtypes == [("rep", "int"), ("auc", "double")] and got.count() == 4


def test_fits_do_not_depend_on_the_rows_worked_on_at_once(monkeypatch):
    rng = np.random.default_rng(1)
    z, y, keep = np.column_stack((np.ones(500), rng.normal(size=(500, 2)))), rng.integers(0, 2, (4, 500)).astype(float), np.ones((4, 3))
    whole = V.fit_many(z, y, keep, 1.0)
    monkeypatch.setattr(V, "AT_ONCE", 100)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(whole, V.fit_many(z, y, keep, 1.0)))


def test_names_are_numbered_in_order():
    names = pa.chunked_array([["b", "é", "a"], ["b", "B"]])
    assert M._codes(names).tolist() == [2, 3, 1, 2, 0] and not len(M._codes(pa.chunked_array([], pa.string())))
