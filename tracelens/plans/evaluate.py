"""Scores of predictions and of conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..operators.skew import HOT_ROWS, cumulative


def auc(df: DataFrame, keys: list[str], score: str, label: str, weight: str | None = None,
        limit: int = HOT_ROWS) -> DataFrame:
    """Mann-Whitney AUC with ties per group; null when a class is missing.

    Scores are counted per class before ranking, so only distinct scores are sorted.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    pos = F.sum(F.when(F.col(label) == 1, w).otherwise(0))
    cells = df.groupBy(*keys, score).agg(F.sum(w).alias("_w"), pos.alias("_p"))
    run = cumulative(cells, keys, score, "_w", limit)
    both = run.join(cells.select(*keys, score, "_p"), [*keys, score])
    rank = F.col("cum") - F.col("w") + (F.col("w") + 1) / 2
    sums = both.groupBy(*keys).agg(
        F.sum("_p").cast("double").alias("_np"), F.sum("w").cast("double").alias("_n"),
        F.sum(F.col("_p") * rank).alias("_r"))
    np_, nn = F.col("_np"), F.col("_n") - F.col("_np")
    value = F.try_divide(F.col("_r") - np_ * (np_ + 1) / 2, np_ * nn)
    return sums.select(*keys, F.col("_n").cast("long").alias("n"), value.alias("auc"))


def average_precision(df: DataFrame, keys: list[str], score: str, label: str, limit: int = HOT_ROWS, weight: str | None = None) -> DataFrame:
    """Area under precision-recall by steps at distinct scores, highest first; rows count ``weight`` times."""
    w = F.lit(1) if weight is None else F.col(weight)
    cells = df.groupBy(*keys, (-F.col(score)).alias("_s")).agg(
        F.sum(w).alias("_w"), F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("_p"))
    seen = cumulative(cells, keys, "_s", "_w", limit).select(*keys, "_s", F.col("cum").alias("_seen"))
    hits = cumulative(cells, keys, "_s", "_p", limit).select(*keys, "_s", F.col("w").alias("_here"), F.col("cum").alias("_hits"))
    both = seen.join(hits, [*keys, "_s"])
    agg = both.groupBy(*keys).agg((F.sum(F.col("_here") * F.col("_hits") / F.col("_seen"))).alias("_a"), F.sum("_here").alias("_np"))
    return agg.select(*keys, F.try_divide("_a", F.col("_np").cast("double")).alias("average_precision"))


def binary_metrics(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    y, s = F.col(label).cast("double"), F.col(score)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(((s >= 0.5).cast("double") == y).cast("double")).alias("accuracy"),
        F.avg((s - y) * (s - y)).alias("brier"), F.avg(y).alias("base_rate"))


def reliability(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")
    return df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))


def expected_calibration_error(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    r = reliability(df, score, label, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_score"))) / F.sum("n")).alias("ece"))


def risk_coverage(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Coverage and error rate of the rows at or above each threshold, in one pass over the rows."""
    total = F.count(F.lit(1)).cast("double")
    one = df.agg(*[c for i, th in enumerate(thresholds) for c in (
        (F.count_if(F.col(score) >= th) / total).alias(f"c{i}"),
        F.avg(F.when(F.col(score) >= th, 1.0 - F.col(label))).alias(f"r{i}"))])
    rows = F.array(*[F.struct(F.lit(th).alias("threshold"), F.col(f"c{i}").alias("coverage"), F.col(f"r{i}").alias("risk")) for i, th in enumerate(thresholds)])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def vuong(df: DataFrame, keys: list[str], cluster: str, p_a: str, p_b: str, label: str) -> DataFrame:
    """Clustered Vuong statistic of two predictors from cluster means of log-likelihood differences."""
    ll = lambda p: F.log(F.when(F.col(label) == 1, F.col(p)).otherwise(1 - F.col(p)))
    means = df.groupBy(*keys, cluster).agg(F.avg(ll(p_a) - ll(p_b)).alias("_d"))
    out = means.groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"), F.avg("_d").alias("_m"), F.stddev_samp("_d").alias("_s"))
    out = out.select(*keys, "clusters", F.try_divide(F.col("_m"), F.col("_s") / F.sqrt("clusters")).alias("vuong"))
    return out.withColumn("p", special.normal_pvalue("vuong"))


def agreement_signal(df: DataFrame, level: str, label: str) -> DataFrame:
    """P(correct | agreement level), attached to the rows."""
    rates = df.groupBy(level).agg(F.avg(F.col(label).cast("double")).alias("p_level"))
    return df.join(rates, level)


def critic_quality(df: DataFrame, keys: list[str], level: str, label: str) -> DataFrame:
    bad = F.col(label) == 0
    dis, full = F.col(level) == "disagree", F.col(level) != "disagree"
    part = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return df.groupBy(*keys).agg(
        part(F.count_if(dis & bad), F.count_if(dis)).alias("critic_precision"),
        part(F.count_if(full), F.count(F.lit(1))).alias("coverage"),
        part(F.count_if(full & bad), F.count_if(full)).alias("selective_risk"))


def directional_consistency(runs: DataFrame, base: str, gated: str, success: str = "success") -> DataFrame:
    """Share of tasks where the gated condition does at least as well."""
    rate = lambda c: F.avg(F.when(F.col("condition") == c, F.col(success).cast("double")))
    per = runs.groupBy("task_id").agg(rate(base).alias("u"), rate(gated).alias("g")).where("u is not null and g is not null")
    return per.agg(F.count(F.lit(1)).alias("tasks"), F.avg((F.col("g") >= F.col("u")).cast("double")).alias("consistency"))


def pass_k(runs: DataFrame, keys: list[str], k: int, success: str = "success") -> DataFrame:
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.pow(F.avg(F.col(success).cast("double")), F.lit(k)).alias("pass_k"))


def paired_difference(runs: DataFrame, kind: str, base: str, gated: str, success: str = "success") -> DataFrame:
    """Success-rate difference per task kind with its 95 % interval."""
    y = F.col(success).cast("double")
    at = lambda c, f: f(F.when(F.col("condition") == c, y))
    s = runs.groupBy(kind).agg(at(base, F.avg).alias("_pu"), at(gated, F.avg).alias("_pg"), at(base, F.count).alias("_nu"), at(gated, F.count).alias("_ng"))
    d = F.col("_pg") - F.col("_pu")
    se = F.sqrt(F.try_divide(F.col("_pg") * (1 - F.col("_pg")), F.col("_ng")) + F.try_divide(F.col("_pu") * (1 - F.col("_pu")), F.col("_nu")))
    return s.select(kind, d.alias("difference"), (d - 1.959963984540054 * se).alias("low"), (d + 1.959963984540054 * se).alias("high"))


