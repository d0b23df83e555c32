"""Ordering inside groups where one value of the leading column holds most rows."""

import random

from pyspark.sql import functions as F

from tracelens.operators import skew


def rows(n=20_000, equal=15_000):
    rnd = random.Random(2)
    ties = list(range(n))
    rnd.shuffle(ties)
    return [("hot", 5 if i < equal else i, t, f"x{t}") for i, t in enumerate(ties)] + [("cold", i % 3, i, "c") for i in range(40)] + [(None, 1, i, None) for i in range(30)]


def test_equal_leading_values_are_cut(spark):
    df = spark.createDataFrame(rows(), "run string, k int, tie int, v string")
    parts = skew.ranged(df, ["run"], ["k", "tie"], 1000).groupBy("_part").count().agg(F.max("count").alias("most"), F.count("*").alias("parts")).first()
    assert parts.most <= 1000 and parts.parts > 30
    cut = skew.positions(df, "run", F.col("k"), ["k", "tie"], 1000)
    assert cut.columns == ["run", "k", "tie", "v", "seq", "n"]
    got = {(r.run, r.tie): (r.seq, r.n) for r in cut.collect()}
    whole = {(r.run, r.tie): (r.seq, r.n) for r in skew.positions(df, "run", F.col("k"), ["k", "tie"], 10**6).collect()}
    assert got == whole and len(got) == 20_070


def test_running_sums_of_several_columns(spark):
    rnd = random.Random(3)
    data = [(g, float(x), rnd.randint(0, 9), rnd.randint(0, 9)) for g in "ab" for x in range(300 if g == "a" else 20)]
    df = spark.createDataFrame(data, "g string, x double, p int, q int")
    for limit in (10**6, 25):
        got = {(r.g, r.x): (r.cum_p, r.cum_q) for r in skew.running(df, ["g"], "x", ["p", "q"], limit).collect()}
        want = {(g, x): tuple(sum(d[i] for d in data if d[0] == g and d[1] <= x) for i in (2, 3)) for g, x, _, _ in data}
        assert got == want
