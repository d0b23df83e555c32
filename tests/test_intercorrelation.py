"""Rank correlations of all pairs from one ranking a feature against numpy, pair by pair."""

import random

import numpy as np
import pytest

from tracelens.plans import evidence as E
from tracelens.plans.versions import mean_ranks


@pytest.mark.parametrize("limit", [1_000_000, 25])
def test_pairs(spark, limit):
    rnd = random.Random(4)
    rows = [(float(i % 9), rnd.random(), 7.0, None if i % 5 == 0 else float(i % 4), float(i % 9) + rnd.random() / 3) for i in range(150)]
    names = list("abcde")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    got = {(r.f1, r.f2): r for r in E.intercorrelation(df, names, limit=limit).collect()}
    assert len(got) == 10
    for (f, g), r in got.items():
        part = [(x[names.index(f)], x[names.index(g)]) for x in rows if None not in (x[names.index(f)], x[names.index(g)])]
        x, y = (np.array(c) for c in zip(*part))
        assert r.n == len(part)
        if "c" in (f, g):
            assert r.rho is None and not r.collinear
        else:
            want = np.corrcoef(mean_ranks(x), mean_ranks(y))[0, 1]
            assert abs(r.rho - want) < 1e-9 and r.collinear == (abs(want) > 0.5)


def test_few_features(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert E.intercorrelation(df, ["a"]).count() == 0 and E.intercorrelation(df, ["a", "b"]).first().rho is None
    tests = spark.createDataFrame([("a", 0.2), ("b", 0.05), ("a", None), ("b", 0.5)], "feature string, p double")
    assert E.reaching(tests, ["a", "b"]) == ["b"]


def test_query_has_every_pair(spark):
    from tracelens import catalog
    from tracelens.catalog.sequences import LONG_FEATURES

    rows = catalog.queries()["t14_intercorrelation"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.f1, r.f2) for r in rows} == {(a, b) for i, a in enumerate(LONG_FEATURES) for b in LONG_FEATURES[i + 1:]}
