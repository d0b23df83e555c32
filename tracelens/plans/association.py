"""Rank association, combination and multiplicity control on long result frames.

Input frames are long: one row per (group…, feature, unit) with a value and an outcome.
Every statistic is computed from (group, value, outcome) cells, so equal pairs are
counted before any shuffle and no group is gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..operators.skew import HOT_ROWS, average_ranks, has_large
from ..session import materialize


def to_long(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Unpivot feature columns into (feature, x)."""
    cast = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return cast.unpivot(ids, features, "feature", "x")


def _pair_ranks(cells: DataFrame, keys: list[str], x: str, y: str, limit: int, large: bool) -> DataFrame:
    axes = cells.select(
        *keys, "_c",
        F.explode(F.array(
            F.struct(F.lit(0).alias("axis"), F.col(x).cast("double").alias("v")),
            F.struct(F.lit(1).alias("axis"), F.col(y).cast("double").alias("v")),
        )).alias("_a"),
    ).select(*keys, "_c", "_a.axis", "_a.v")
    ranks = average_ranks(axes, [*keys, "axis"], "v", "_c", limit, large)
    rx = ranks.where("axis = 0").select(*keys, F.col("v").alias(x), F.col("rnk").alias("rx"))
    ry = ranks.where("axis = 1").select(*keys, F.col("v").alias(y), F.col("rnk").alias("ry"))
    typed = cells.withColumn(x, F.col(x).cast("double")).withColumn(y, F.col(y).cast("double"))
    return typed.join(rx, [*keys, x]).join(ry, [*keys, y])


def weighted_corr(df: DataFrame, keys: list[str], a: str, b: str, w: str, out: str) -> DataFrame:
    """Pearson correlation from weighted sums; null when either side does not vary."""
    c, u, v = F.col(w), F.col(a), F.col(b)
    sums = df.groupBy(*keys).agg(
        F.sum(c).alias("n"), F.sum(c * u).alias("_su"), F.sum(c * v).alias("_sv"),
        F.sum(c * u * u).alias("_suu"), F.sum(c * v * v).alias("_svv"), F.sum(c * u * v).alias("_suv"),
    )
    n = F.col("n").cast("double")
    vu = n * F.col("_suu") - F.col("_su") ** 2
    vv = n * F.col("_svv") - F.col("_sv") ** 2
    cov = n * F.col("_suv") - F.col("_su") * F.col("_sv")
    flat = 1e-12
    varies = (vu > flat * n * F.col("_suu")) & (vv > flat * n * F.col("_svv"))
    rho = F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vu * vv))))
    return sums.select(*keys, F.col("n").cast("long").alias("n"), rho.alias(out))


def rank_over(keys: list[str], x: str) -> Column:
    """Average rank inside groups that fit a task; all such windows share one exchange by ``keys``."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return (F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (ties - 1) / 2).cast("double")


def cells_of(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    paired = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return paired.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_c"))


def spearman(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", min_n: int = 0,
             limit: int = HOT_ROWS, large: bool | None = None) -> DataFrame:
    """Spearman's rho per group over complete pairs: columns ``n`` and ``rho``.

    ``rho`` is null below ``min_n`` pairs or when a side is constant.
    """
    large = has_large(df, keys, limit) if large is None else large
    if large:
        ranked = _pair_ranks(cells_of(df, keys, x, y), keys, x, y, limit, large)
    else:
        paired = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
        ranked = paired.select(*keys, rank_over(keys, x).alias("rx"), rank_over(keys, y).alias("ry"), F.lit(1).alias("_c"))
    out = weighted_corr(ranked, keys, "rx", "ry", "_c", "rho")
    if min_n:
        out = out.withColumn("rho", F.when(F.col("n") >= min_n, F.col("rho")))
    return out


PERFECT = 0.9999999999  # beyond it a correlation counts as exact, and its p as 1e-300


def with_log_pvalue(df: DataFrame, rho: str = "rho", n: str = "n", out: str = "ln_p") -> DataFrame:
    """ln of the two-sided p of a rank correlation by the t approximation with n - 2 degrees of freedom."""
    t = f"{rho} * sqrt(({n} - 2) / (1 - {rho} * {rho}))"
    exact = (F.abs(rho) > PERFECT) & (F.col(n) > 2)
    return df.withColumn(out, F.when(exact, math.log(1e-300)).otherwise(special.t_log_pvalue(f"CASE WHEN abs({rho}) <= {PERFECT} THEN {t} END", f"{n} - 2")))


def with_pvalue(df: DataFrame, rho: str = "rho", n: str = "n", out: str = "p") -> DataFrame:
    """The same as a p."""
    return with_log_pvalue(df, rho, n, "_ln_p").withColumn(out, F.exp("_ln_p")).drop("_ln_p")


def partial_spearman(df: DataFrame, keys: list[str], x: str, y: str, z: str, limit: int = HOT_ROWS,
                     strata: str | None = None) -> DataFrame:
    """Rank x, y and z; remove the linear effect of rank(z); Spearman of the residuals.

    With ``strata`` the ranks are also centred within strata before the regression, which
    is the same as adding one dummy per stratum to the regression.
    """
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    extra = [strata] if strata else []
    if has_large(df, keys, limit):
        return _partial_cut(whole, keys, extra, x, y, z, limit)
    rows = whole.select(*keys, *extra, x, y, z)
    for i, c in enumerate((x, y, z)):
        rows = rows.withColumn(f"_r{i}", rank_over(keys, c))
    group, level = Window.partitionBy(*keys), Window.partitionBy(*keys, *extra)
    d = [F.col(f"_r{i}") - F.avg(f"_r{i}").over(level) for i in range(3)]
    rows = rows.select(*keys, *[d[i].alias(f"_d{i}") for i in range(3)])
    zz = F.sum(F.col("_d2") * F.col("_d2")).over(group)
    slope = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("_d2")).over(group), zz), F.lit(0.0))
    resid = rows.select(
        *keys, F.round(F.col("_d0") - slope("_d0") * F.col("_d2"), 9).alias("_ex"),
        F.round(F.col("_d1") - slope("_d1") * F.col("_d2"), 9).alias("_ey"))
    ranked = resid.select(*keys, rank_over(keys, "_ex").alias("rx"), rank_over(keys, "_ey").alias("ry"), F.lit(1).alias("_c"))
    return weighted_corr(ranked, keys, "rx", "ry", "_c", "rho")


def _partial_cut(whole: DataFrame, keys: list[str], extra: list[str], x: str, y: str, z: str, limit: int) -> DataFrame:
    """The same for groups larger than a task, from counted cells and stored stages."""
    large = True
    cells = whole.groupBy(*keys, *extra, x, y, z).agg(F.count(F.lit(1)).alias("_c"))
    parts = [F.struct(F.lit(i).alias("axis"), F.col(c).cast("double").alias("v")) for i, c in enumerate((x, y, z))]
    axes = cells.select(*keys, "_c", F.explode(F.array(*parts)).alias("_a")).select(*keys, "_c", "_a.axis", "_a.v")
    ranks = average_ranks(axes, [*keys, "axis"], "v", "_c", limit, large)
    ranked = cells
    for i, c in enumerate((x, y, z)):
        one = ranks.where(F.col("axis") == i).select(*keys, F.col("v").alias(c), F.col("rnk").alias(f"_r{i}"))
        ranked = ranked.withColumn(c, F.col(c).cast("double")).join(one, [*keys, c])
    ranked = materialize(ranked.select(*keys, *extra, "_c", "_r0", "_r1", "_r2"))  # read three times below
    level = [*keys, *extra]
    w = F.col("_c")
    means = ranked.groupBy(*level).agg(*[(F.sum(w * F.col(f"_r{i}")) / F.sum(w)).alias(f"_m{i}") for i in range(3)])
    centred = ranked.join(means, level) if level else ranked.crossJoin(F.broadcast(means))  # one row
    for i in range(3):
        centred = centred.withColumn(f"_d{i}", F.col(f"_r{i}") - F.col(f"_m{i}"))
    d0, d1, d2 = F.col("_d0"), F.col("_d1"), F.col("_d2")
    fit = centred.groupBy(*keys).agg(
        F.sum(w * d2 * d2).alias("_zz"), F.sum(w * d0 * d2).alias("_xz"), F.sum(w * d1 * d2).alias("_yz"),
    )
    both = centred.join(fit, keys) if keys else centred.crossJoin(F.broadcast(fit))  # one row
    bx = F.coalesce(F.try_divide("_xz", "_zz"), F.lit(0.0))
    by = F.coalesce(F.try_divide("_yz", "_zz"), F.lit(0.0))
    resid = both.select(
        *keys, "_c",
        F.round(F.col("_d0") - bx * F.col("_d2"), 9).alias("_ex"),
        F.round(F.col("_d1") - by * F.col("_d2"), 9).alias("_ey"),
    )
    counted = materialize(resid.groupBy(*keys, "_ex", "_ey").agg(F.sum("_c").alias("_c")))
    return weighted_corr(_pair_ranks(counted, keys, "_ex", "_ey", limit, large), keys, "rx", "ry", "_c", "rho")


# -- combination and multiplicity: inputs are result rows, one per test -----------------


def bonferroni(df: DataFrame, p: str = "p", family: list[str] | None = None, out: str = "p_bonf") -> DataFrame:
    tests = _tests(df, p, family)
    return tests.withColumn(out, F.least(F.col(p) * F.col("_m"), F.lit(1.0))).drop("_m")


def _tests(df: DataFrame, p: str, family: list[str] | None) -> DataFrame:
    """Add ``_m``, the number of tests of the family (of the table when none is given)."""
    if family:
        return df.withColumn("_m", F.count(p).over(Window.partitionBy(*family)))
    return df.crossJoin(F.broadcast(df.agg(F.count(p).alias("_m"))))  # one row


def holm(df: DataFrame, tie: str, p: str = "p", family: list[str] | None = None, out: str = "p_holm") -> DataFrame:
    whole = Window.partitionBy(*(family or []))
    order = whole.orderBy(p, tie)
    step = F.least(F.lit(1.0), F.col(p) * (F.count(p).over(whole) - F.row_number().over(order) + 1))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_step", step).withColumn(out, F.max("_step").over(run)).drop("_step")


def benjamini_hochberg(df: DataFrame, tie: str, p: str = "p", q: float = 0.05,
                       family: list[str] | None = None) -> DataFrame:
    """Step-up FDR: ``bh_rank``, ``bh_threshold`` (6 decimals) and ``survives``."""
    whole = Window.partitionBy(*(family or []))
    tested = df.where(F.col(p).isNotNull())
    ranked = tested.withColumn("bh_rank", F.row_number().over(whole.orderBy(p, tie)))
    m = F.count(F.lit(1)).over(whole)
    ranked = ranked.withColumn("bh_threshold", F.round(F.col("bh_rank") / m * F.lit(float(q)), 6))
    last = F.max(F.when(F.col(p) <= F.col("bh_threshold"), F.col("bh_rank"))).over(whole)
    return ranked.withColumn("survives", F.coalesce(F.col("bh_rank") <= last, F.lit(False)))


def fisher_combine(df: DataFrame, keys: list[str], p: str = "p", rho: str = "rho", n: str = "n", log_p: str | None = None) -> DataFrame:
    """Fisher's chi-square over strata, the n-weighted mean rho and whether all signs agree.

    ``log_p`` names a column of ln p, which keeps p below the least double apart.
    """
    tested = df.where(F.col(p).isNotNull())
    ln_p = F.col(log_p) if log_p else F.log(F.col(p))
    sums = tested.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"),
        (-2 * F.sum(ln_p)).alias("chi2"),
        (F.sum(F.col(rho) * F.col(n)) / F.sum(n)).alias("mean_rho"),
        (F.abs(F.sum(F.signum(rho))) == F.count(F.lit(1))).alias("same_sign"),
    )
    return sums.withColumn("p_combined", special.chi2_even_pvalue("chi2", "k"))


def fisher_interval(df: DataFrame, rho: str = "rho", n: str = "n", z: float = 1.959963984540054) -> DataFrame:
    se = F.when(F.col(n) > 3, 1 / F.sqrt(F.col(n) - 3))
    mid = F.when(F.abs(rho) < 1, F.atanh(rho))
    return df.withColumn("ci_low", F.tanh(mid - z * se)).withColumn("ci_high", F.tanh(mid + z * se))


def fixed_effects(df: DataFrame, keys: list[str], rho: str = "rho", n: str = "n") -> DataFrame:
    """Inverse-variance mean of Fisher z over waves or strata."""
    usable = df.where((F.abs(rho) < 1) & (F.col(n) > 3))
    w = (F.col(n) - 3).cast("double")
    sums = usable.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum(w).alias("_w"), (F.sum(w * F.atanh(rho)) / F.sum(w)).alias("z_mean"),
    )
    se = 1 / F.sqrt("_w")
    return sums.select(*keys, "k", "z_mean", se.alias("z_se"), F.tanh("z_mean").alias("rho_pooled"))
