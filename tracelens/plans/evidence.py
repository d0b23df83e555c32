"""Reading many association results together: directions, tiers, polarity, interaction, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators.skew import HOT_ROWS, average_ranks, quantile
from ..session import materialize
from . import association as A


def noise(key: str, seed: str = "42") -> Column:
    """A reproducible uniform number per key, as a control feature."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def direction_check(result: DataFrame, directions: dict[str, str] | None = None) -> DataFrame:
    """Does the sign of rho match the sign that was expected beforehand?"""
    listed = list((directions or P.DIRECTIONS).items())
    wanted = result.sparkSession.createDataFrame(listed, "feature string, expected string")
    sign = F.when(F.col("rho").isNull(), "no var").when(F.col("expected") == "null", "control").when(
        F.col("expected") == "positive", F.when(F.col("rho") > 0, "YES").otherwise("NO")).otherwise(
        F.when(F.col("rho") < 0, "YES").otherwise("NO"))
    return result.join(F.broadcast(wanted), "feature").withColumn("matches", sign)


def rank_evidence(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per feature: methods with p < alpha, least p, and whether any test survives Bonferroni.

    ``tests`` has one row per (method, feature); the correction counts features.
    """
    m = tests.select("feature").distinct().agg(F.count(F.lit(1)).alias("_m"))
    both = tests.crossJoin(F.broadcast(m))  # one row
    return both.groupBy("feature").agg(
        F.count_if(F.col("p") < alpha).alias("methods"), F.min("p").alias("min_p"),
        F.coalesce(F.bool_or(F.col("p") < alpha / F.col("_m")), F.lit(False)).alias("survives"))


def tier(within_p: Column, combined_p: Column, permutation_p: Column, same_sign: Column) -> Column:
    """gold: all three agree; silver: two; moderate: one; retracted: only with mixed signs; null: none."""
    hits = sum(F.coalesce((p < 0.05).cast("int"), F.lit(0)) for p in (within_p, combined_p, permutation_p))
    return (
        F.when((hits > 0) & ~same_sign & (hits < 3), "retracted")
        .when(hits == 3, "gold").when(hits == 2, "silver").when(hits == 1, "moderate").otherwise("null"))


def polarity(result: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Compare every two models' results for the same test, as ``<side>_a`` and ``<side>_b``."""
    pick = lambda n: result.select(*keys, F.col(side).alias(f"{side}_{n}"), F.col("rho").alias(f"rho_{n}"), F.col("p").alias(f"p_{n}"))
    both = pick("a").join(pick("b"), keys).where(F.col(f"{side}_a") < F.col(f"{side}_b"))
    sa, sb = F.col("p_a") < 0.05, F.col("p_b") < 0.05
    agree = F.signum("rho_a") == F.signum("rho_b")
    kind = (
        F.when(sa & sb & agree, "same direction").when(sa & sb, "flipped").when(sa | sb, "model specific")
        .when(~agree, "suggestive").otherwise("none"))
    return both.withColumn("kind", F.when(F.col("rho_a").isNotNull() & F.col("rho_b").isNotNull(), kind))


def layer_winner(result: DataFrame, a: str, b: str) -> DataFrame:
    """Which of two text layers correlates more strongly, per feature."""
    pick = lambda v, n: result.where(F.col("layer") == v).select("feature", F.coalesce("rho", F.lit(0.0)).alias(f"rho_{n}"))
    both = pick(a, "a").join(pick(b, "b"), "feature")
    return both.withColumn("winner", F.when(F.abs("rho_a") > F.abs("rho_b"), a).when(F.abs("rho_b") > F.abs("rho_a"), b).otherwise("tie"))


def quadrants(df: DataFrame, strata: str, f1: str, f2: str, success: str) -> DataFrame:
    """Pass rates for high/low halves of two features, split at each stratum's medians."""
    m1 = quantile(df, [strata], f1, [0.5]).withColumnRenamed("q0", "_m1")
    m2 = quantile(df, [strata], f2, [0.5]).withColumnRenamed("q0", "_m2")
    cut = df.join(m1, strata).join(m2, strata)
    level = lambda f, m: F.when(F.col(f) > F.col(m), "H").otherwise("L")
    return cut.groupBy(F.concat(level(f1, "_m1"), level(f2, "_m2")).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(success).cast("double")).alias("rate"))


def interaction_bonus(cells: DataFrame) -> DataFrame:
    """HH - (HL + LH - LL)."""
    w = cells.groupBy().pivot("cell", ["HH", "HL", "LH", "LL"]).agg(F.first("rate"))
    return w.withColumn("bonus", F.col("HH") - (F.col("HL") + F.col("LH") - F.col("LL")))


def replication(result: DataFrame, keys: list[str], wave: str, a, b) -> DataFrame:
    pick = lambda v, n: result.where(F.col(wave) == v).select(*keys, F.col("rho").alias(f"rho_{n}"), F.col("p").alias(f"p_{n}"))
    both = pick(a, "a").join(pick(b, "b"), keys)
    ok = (F.signum("rho_a") == F.signum("rho_b")) & (F.col("p_a") < 0.05) & (F.col("p_b") < 0.05)
    return both.withColumn("replicates", F.coalesce(ok, F.lit(False)))


def within_between(df: DataFrame, strata: str, x: str) -> DataFrame:
    """The stratum mean of x and the deviation from it (window-free: means are joined back)."""
    means = df.groupBy(strata).agg(F.avg(x).alias("between"))
    return df.join(means, strata).withColumn("within", F.col(x) - F.col("between"))


def intraclass(df: DataFrame, strata: str, x: str) -> DataFrame:
    """One-way ANOVA intraclass correlation from per-stratum sums."""
    per = df.where(F.col(x).isNotNull()).groupBy(strata).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.avg(x).alias("_m"), F.var_samp(x).alias("_v"))
    s = per.agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_n")).alias("nn"),
        F.sum(F.col("_n") * F.col("_m")).alias("s1"), F.sum(F.col("_n") * F.col("_m") * F.col("_m")).alias("s2"),
        F.sum(F.coalesce("_v", F.lit(0.0)) * (F.col("_n") - 1)).alias("ssw"))
    msb = (F.col("s2") - F.col("s1") ** 2 / F.col("n")) / (F.col("k") - 1)
    msw = F.col("ssw") / (F.col("n") - F.col("k"))
    n0 = (F.col("n") - F.col("nn") / F.col("n")) / (F.col("k") - 1)
    return s.select(F.col("k").cast("long").alias("strata"), F.col("n").cast("long").alias("n"),
                    F.try_divide(msb - msw, msb + (n0 - 1) * msw).alias("icc"))


def pair_values(df: DataFrame, ids: list[str], features: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(f1, f2, x, y) for each feature pair; the factor is the number of pairs, not of rows."""
    pairs = pairs or [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    cells = F.array(*[
        F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for a, b in pairs])
    return df.select(*ids, F.explode(cells).alias("_p")).select(*ids, "_p.*")


def reaching(tests: DataFrame, features: list[str], p: float = 0.10) -> list[str]:
    """The features that reach ``p`` in any of the tests (feature, p), in the given order."""
    found = {r["feature"] for r in tests.where(F.col("p") < p).select("feature").distinct().collect()}  # at most one a feature
    return [f for f in features if f in found]


def intercorrelation(df: DataFrame, features: list[str], flag: float = 0.5, min_n: int = 5, limit: int = HOT_ROWS) -> DataFrame:
    """(f1, f2, n, rho, collinear) for each pair of features.

    A feature without nulls is ranked once; one aggregation of all products of ranks then gives every pair. Only pairs
    with a feature that has nulls are ranked pair by pair, as other rows count for each.
    """
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "f1 string, f2 string, n long, rho double, collinear boolean")
    rows = materialize(df.select(*[F.col(f).cast("double").alias(f) for f in features]))
    gaps = rows.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    whole = [f for f in features if not gaps[f]]
    parts = []
    if len(whole) > 1:
        numbered = rows.select(F.monotonically_increasing_id().alias("_row"), *whole)  # a written table: the numbers stay
        long = A.to_long(numbered, ["_row"], whole)
        ranks = average_ranks(long.select("feature", "x", F.lit(1).alias("_c")), ["feature"], "x", "_c", limit)
        each = [F.max(F.when(F.col("feature") == f, F.col("rnk"))).alias(f) for f in whole]
        wide = long.join(ranks.select("feature", "x", "rnk"), ["feature", "x"]).groupBy("_row").agg(*each)
        at = {f: i for i, f in enumerate(whole)}
        inner = [(a, b) for a, b in pairs if a in at and b in at]
        mid = rows.count() / 2 + 0.5  # ranks of n rows add up to n times this
        centred = wide.select(*[(F.col(f) - mid).alias(f) for f in whole])
        sums = centred.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f) * F.col(f)).alias(f"_s{at[f]}") for f in whole],
                           *[F.sum(F.col(a) * F.col(b)).alias(f"_p{at[a]}_{at[b]}") for a, b in inner])
        cells = F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"_p{at[a]}_{at[b]}").alias("p"), F.col(f"_s{at[a]}").alias("a"), F.col(f"_s{at[b]}").alias("b"))
                          for a, b in inner])
        one = sums.select("n", F.explode(cells).alias("c"))
        value = F.try_divide("c.p", F.sqrt(F.col("c.a") * F.col("c.b")))
        rho = F.when(value.isNotNull() & (F.col("n") >= min_n), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))
        parts.append(one.select("c.f1", "c.f2", F.col("n").cast("long").alias("n"), rho.alias("rho")))
    rest = [(a, b) for a, b in pairs if gaps[a] or gaps[b]]
    if rest:
        parts.append(A.spearman(pair_values(rows, [], features, rest), ["f1", "f2"], min_n=min_n, limit=limit).select("f1", "f2", "n", "rho"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("collinear", F.coalesce(F.abs("rho") > flag, F.lit(False)))


def length_strata(n: Column) -> Column:
    return F.when(n < 15, "short").when(n <= 25, "medium").otherwise("long")


def with_family_count(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("m", F.count("p").over(Window.partitionBy(*keys)))
