"""Models and resampling against plain numpy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tracelens.plans import evaluate as V
from tracelens.plans import logit as M
from tracelens.plans import resample as R


def data(seed=1, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice("abcd")
        x1, x2 = rng.gauss(0, 2) + (s == "a"), rng.random()
        y = int(rng.random() < 1 / (1 + np.exp(-(x1 - 0.5 + 0.8 * (s == "b")))))
        rows.append((i, f"t{i % 9}", s, float(x1), float(x2), y))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, task string, s string, x1 double, x2 double, y int").cache()


def logit(x, y, penalty):
    z = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(z.shape[1])
    ridge = np.r_[0, np.full(x.shape[1], penalty)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (y - p) - ridge * b)
    p = 1 / (1 + np.exp(-z @ b))
    return b, float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), z.T @ (z * (p * (1 - p))[:, None])


def test_fit_and_leave_task_out(spark):
    rows = data()
    df = frame(spark, rows)
    x, y = np.array([r[3:5] for r in rows]), np.array([r[5] for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(M.fit(df, ["x1", "x2"], "y")["beta"], logit(z, y, 1.0)[0], atol=1e-6)
    preds, _ = M.cross_validate(df.drop("s"), ["x1", "x2"], ["y"], "task")
    got = {r.id: r.score for r in preds.collect()}
    assert len(got) == len(rows)
    for task in {r[1] for r in rows}:
        tr = np.array([r[1] != task for r in rows])
        mu, sd = x[tr].mean(0), x[tr].std(0)
        b = logit((x[tr] - mu) / sd, y[tr], 1.0)[0]
        for r in rows:
            if r[1] == task:
                want = 1 / (1 + np.exp(-(b[0] + (np.array(r[3:5]) - mu) / sd @ b[1:])))
                assert abs(got[r[0]] - want) < 1e-6


def test_nested_selection_and_folds(spark):
    df = frame(spark, data())
    preds, share = M.cross_validate(df, ["x1", "x2"], ["y"], "task", select_in=("s", ["a", "b"]))
    assert share["x1"] == 1.0 and 0 <= share["x2"] <= 1 and preds.count() == 160
    hashed = M.fold_of(df, "task", 4)
    assert hashed.select("task", "fold").distinct().count() == 9 and hashed.agg(F.max("fold")).first()[0] <= 3


def test_every_task_is_a_fold(spark):
    for tasks in (50, 51, 300):
        df = spark.range(tasks * 2).selectExpr("id", f"id % {tasks} AS task", "rand(1) AS x1", "CAST(id % 2 AS INT) AS y")
        assert M.fold_of(df, "task").groupBy("fold").agg(F.count_distinct("task").alias("t")).where("t = 1").count() == tasks
    preds, _ = M.cross_validate(df, ["x1"], ["y"], "task")  # 300 folds are more than one block
    assert preds.count() == 600
    one = spark.createDataFrame([(1, "a", 0.1, 0), (2, "a", 0.2, 0), (3, "b", 0.3, 1), (4, "b", 0.4, 0)], "id long, task string, x1 double, y int")
    assert {r.id for r in M.cross_validate(one, ["x1"], ["y"], "task")[0].collect()} == {1, 2}
    assert M.cross_validate(one, ["x1"], ["y"], "task", one_class="rate")[0].count() == 4


def test_stratum_logit(spark):
    rows = data(3)
    df = frame(spark, rows)
    got = {r.feature: r for r in M.stratum_logit_table(df, ["x1", "x2"], "s", "y").collect()}
    by = sorted({r[2] for r in rows}, key=lambda s: (-sum(r[2] == s for r in rows), s))[:3]
    part = [r for r in rows if r[2] in by]
    y = np.array([r[5] for r in part])
    d = np.array([[float(r[2] == s) for s in by[1:]] for r in part])
    _, ll0, _ = logit(d, y, 0.0)
    for f, i in (("x1", 3), ("x2", 4)):
        v = np.array([r[i] for r in part])
        b, ll, h = logit(np.column_stack([(v - v.mean()) / v.std(ddof=1), d]), y, 0.0)
        assert abs(got[f].coef - b[1]) < 1e-5 and abs(got[f].lr - 2 * (ll - ll0)) < 1e-5
        assert abs(got[f].wald - b[1] / np.sqrt(np.linalg.inv(h)[1, 1])) < 1e-4


def test_random_intercept(spark):
    rows = data(4)
    df = frame(spark, rows)
    got = {r.feature: r for r in M.random_intercept(df, ["x1"], "s", "y").collect()}["x1"]
    s, x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[5] for r in rows], float)

    def loglik(g, cols):
        v = np.eye(len(y)) + g * (s[:, None] == s[None, :])
        vi = np.linalg.inv(v)
        b = np.linalg.solve(cols.T @ vi @ cols, cols.T @ vi @ y)
        r = y - cols @ b
        sig = r @ vi @ r / len(y)
        return -len(y) / 2 * (np.log(2 * np.pi * sig) + 1) - np.linalg.slogdet(v)[1] / 2, b

    grid = np.r_[0, 10 ** np.linspace(-5, 1, 400)]
    one = np.column_stack([np.ones(len(y)), x])
    best = max(((*loglik(g, one), g) for g in grid), key=lambda t: t[0])
    null = max(loglik(g, one[:, :1])[0] for g in grid)
    assert abs(got.coef - best[1][1]) < 1e-3 and abs(got.lr - 2 * (best[0] - null)) < 1e-2


def auc(scores, labels):
    pos = [s for s, l in zip(scores, labels) if l]
    neg = [s for s, l in zip(scores, labels) if not l]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_auc_and_average_precision(spark):
    rng = random.Random(9)
    rows = [("g", rng.randint(0, 20) / 20, rng.randint(0, 1)) for _ in range(200)] + [("h", 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    want = auc([r[1] for r in rows[:-1]], [r[2] for r in rows[:-1]])
    for limit in (1_000_000, 5):
        got = {r.g: r.auc for r in V.auc(df, ["g"], "s", "y", limit=limit).collect()}
        assert abs(got["g"] - want) < 1e-12 and got["h"] is None
    flipped = V.auc(df.withColumn("s", 1 - F.col("s")), ["g"], "s", "y").where("g = 'g'").first().auc
    assert abs(flipped - (1 - want)) < 1e-12
    order = sorted({r[1] for r in rows[:-1]}, reverse=True)
    total = sum(r[2] for r in rows[:-1])
    ap = sum(sum(r[2] for r in rows[:-1] if r[1] == s) / total * sum(r[2] for r in rows[:-1] if r[1] >= s) / sum(r[1] >= s for r in rows[:-1]) for s in order)
    assert abs(V.average_precision(df.where("g = 'g'"), [], "s", "y").first()[0] - ap) < 1e-12


def test_shuffle_keeps_counts_and_ignores_cuts(spark):
    df = frame(spark, data(5))
    plain = {(r.rep, r.id): r.shuffled for r in R.shuffle_labels(df, "s", "y", "id", 6).collect()}
    cut = {(r.rep, r.id): r.shuffled for r in R.shuffle_labels(df, "s", "y", "id", 6, limit=7).collect()}
    other = {(r.rep, r.id): r.shuffled for r in R.shuffle_labels(df.repartition(7), "s", "y", "id", 6).collect()}
    assert plain == cut == other
    rows = data(5)
    for rep in range(6):
        for s in "abcd":
            assert sum(plain[(rep, r[0])] for r in rows if r[2] == s) == sum(r[5] for r in rows if r[2] == s)
    p = R.permutation_test(df, "s", "x1", "y", "id", 30).first()
    assert p.permutations == 30 and 1 / 31 <= p.p <= 1


def test_bootstrap_interval(spark):
    df = frame(spark, data(6))
    reps = R.bootstrap_auc(df, "x1", "y", "id", 30)
    out = R.bootstrap_interval(reps).first()
    seen = auc([r[3] for r in data(6)], [r[5] for r in data(6)])
    assert out.replicates == 30 and out.low < seen < out.high


def test_variance_inflation(spark):
    from tracelens.operators.extra import vif
    rows = [(r[3], r[4], r[3] * 2 + r[4] + (i % 5)) for i, r in enumerate(data(7))]
    got = {r.feature: r.vif for r in vif(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(np.array(rows).T)))
    assert np.allclose([got[f] for f in "abc"], want, rtol=1e-6)


def test_permuted_versions_share_one_fit(spark):
    df = frame(spark, data(8))
    wide, names = M.shuffled_versions(df.select("id", "task", "s", "x1", "y"), "s", "y", "id", 2)
    together, _ = M.cross_validate(wide.drop("y"), ["x1"], names, "task")
    scores = {(r.rep, r.id): r.score for r in together.collect()}
    alone, _ = M.cross_validate(df.select("id", "task", "x1", "y"), ["x1"], ["y"], "task")
    assert all(abs(scores[(0, r.id)] - r.score) < 1e-8 for r in alone.collect())
    labels = [(r.y0, r.y1, r.y2) for r in wide.collect()]
    assert sum(l[0] for l in labels) == sum(l[1] for l in labels) == sum(l[2] for l in labels)


def spearman_p(x, y):
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    if np.std(x) == 0 or np.std(y) == 0:
        return 0.0, 1.0
    rho, df = np.corrcoef(rank(x), rank(y))[0, 1], len(x) - 2
    t = np.linspace(0, abs(rho) * np.sqrt(df / (1 - rho * rho)), 20001)
    gamma = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return rho, 1 - 2 * gamma * np.trapezoid((1 + t * t / df) ** (-(df + 1) / 2), t)


def test_permuted_auc_selects_in_every_fold(spark):
    rows = data(9, 90)
    df = frame(spark, rows)
    got = {r.rep: r.auc for r in M.permuted_auc(df, ["x1", "x2"], "y", "task", "s", "id", 5, select_in=("s", ["a", "b"]), at_once=2).collect()}
    wide, names = M.shuffled_versions(df, "s", "y", "id", 5)
    labels = {r.id: [r[c] for c in names] for r in wide.collect()}
    x, task, s = np.array([r[3:5] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    partly = 0
    for rep in range(6):
        y = np.array([labels[r[0]][rep] for r in rows])
        score = np.zeros(len(rows))
        for held in set(task):
            tr = task != held
            pick = [j for j in range(2) if any(abs(c[0]) > 0.15 and c[1] < 0.10 for c in (spearman_p(x[tr & (s == f), j], y[tr & (s == f)]) for f in "ab"))]
            partly += len(pick) == 1
            z = x[:, pick or [0, 1]]
            z = (z - z[tr].mean(0)) / z[tr].std(0)
            b = logit(z[tr], y[tr], 1.0)[0]
            score[~tr] = (1 / (1 + np.exp(-(b[0] + z @ b[1:]))))[~tr]
        assert abs(got[rep] - auc(list(score), list(y))) < 1e-9
    assert partly and len(got) == 6


def test_b3_draws_all_permutations_with_nested_selection(spark, monkeypatch):
    asked = []

    def short(df, features, label, task, strata, unit, reps, select_in=None, **other):
        asked.append((reps, select_in))
        return spark.createDataFrame([(0, 0.7), (1, 0.5), (2, 0.8)], "rep int, auc double")

    monkeypatch.setattr(M, "permuted_auc", short)
    from tracelens import catalog
    row = catalog.queries()["b3_permuted_cv_auc"](spark, "/root/testdata/sf0.001").first()
    assert asked == [(10_000, ("model", ["en", "fr"]))] and (row.permutations, row.p) == (2, 0.5)
