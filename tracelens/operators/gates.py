"""Replaying block/approve rules over recorded calls and scoring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .skew import quantile


def median_thresholds(calls: DataFrame, tokens: str, chars: str) -> DataFrame:
    """Whole-number medians of positive token and character counts, with defaults for no data."""
    def median(c: str, out: str, default: int) -> DataFrame:
        q = quantile(calls.where(F.col(c) > 0), [], c, [0.5])
        return q.agg(F.coalesce(F.max(F.floor("q0")), F.lit(default)).cast("long").alias(out))
    a = median(tokens, "token_threshold", P.DEFAULT_TOKEN_THRESHOLD)
    b = median(chars, "char_threshold", P.DEFAULT_CHAR_THRESHOLD)
    return a.crossJoin(F.broadcast(b))  # one row each


def conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(P.CONDITIONS, "condition string, gate_timing string, gate_type string")


def aligned(text, path) -> Column:
    """Blank text fails; no path passes; else the text must hold the file name or a path suffix."""
    t, p = T._text(text), F.coalesce(T._col(path), F.lit(""))
    parts = F.split(p, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    named = F.exists(suffixes, lambda s: (s != "") & F.contains(t, s))
    return F.when(~T.has_text(text), False).when((p == "") | (T.basename(p) == ""), True).otherwise(named)


def deliberated(text, threshold) -> Column:
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return T.has_text(text) & (T.stripped_length(text) >= limit)


def past_early_cutoff(seq, n) -> Column:
    return (T._col(n) > 0) & (T._col(seq) > F.greatest(F.lit(1), F.floor(T._col(n) / 3)))


def introspective(ok_align: Column, ok_delib: Column) -> tuple[Column, Column]:
    """(verdict, reason)."""
    verdict = F.when(ok_align & ok_delib, "approve").otherwise("block")
    reason = (
        F.when(~ok_align & ~ok_delib, "both").when(~ok_align, "alignment").when(~ok_delib, "deliberation").otherwise("passed"))
    return verdict, reason


def critic_key(path, old, new) -> Column:
    """Key of an external verdict: path, old text and new text."""
    return F.substring(F.sha2(F.concat(*[F.coalesce(T._col(c), F.lit("")) for c in (path, old, new)]), 256), 1, 16)


def external(verdict) -> Column:
    """A logged verdict as a gate verdict: reject blocks, missing or failed approves."""
    v = F.lower(T._col(verdict))
    return F.when(v.isin("reject", "block"), "block").when(v == "concern", "concern").otherwise("approve")


def combined(a: Column, b: Column) -> Column:
    return F.when((a == "block") | (b == "block"), "block").when((a == "concern") | (b == "concern"), "concern").otherwise("approve")


def replay(calls: DataFrame, verdicts: DataFrame | None = None, threshold=P.DEFAULT_CHAR_THRESHOLD) -> DataFrame:
    """Every gated condition over every edit of the history, in one pass.

    ``calls`` needs run_id, seq, n, tool_name, file_path, reasoning_text and, with
    ``verdicts`` (key, verdict), a ``key`` column. One row per (condition, run, call):
    the key is the content, so a rerun gives the same rows.
    """
    edits = calls.where(F.col("tool_name").isin(P.WRITE_TOOLS))
    if verdicts is None:
        edits = edits.withColumn("_ext", F.lit(None).cast("string"))
    else:
        one = verdicts.groupBy("key").agg(F.max("verdict").alias("_ext"))
        edits = edits.join(one, "key", "left")
    judged = (
        edits.withColumn("_align", aligned("reasoning_text", "file_path"))
        .withColumn("_delib", deliberated("reasoning_text", threshold))
        .withColumn("_early", past_early_cutoff("seq", "n"))
    )
    v, reason = introspective(F.col("_align"), F.col("_delib"))
    judged = judged.withColumn("_intro", v).withColumn("_why", reason).withColumn("_extro", external("_ext"))
    gated = [c for c in P.CONDITIONS if c[2] != "none"]
    tagged = F.array(*[F.struct(F.lit(a).alias("condition"), F.lit(b).alias("gate_timing"), F.lit(c).alias("gate_type")) for a, b, c in gated])
    rows = judged.withColumn("_c", F.explode(tagged)).select("*", "_c.*")
    late = (F.col("gate_timing") == "early") & F.col("_early")
    chosen = (
        F.when(late, "approve").when(F.col("gate_type") == "introspective", F.col("_intro"))
        .when(F.col("gate_type") == "extrospective", F.col("_extro")).otherwise(combined(F.col("_intro"), F.col("_extro"))))
    why = (
        F.when(late, "past cutoff").when(F.col("gate_type") == "extrospective", F.concat(F.lit("critic "), F.col("_extro")))
        .when((F.col("gate_type") == "both") & (F.col("_extro") == "block"), F.concat_ws("+", "_why", F.lit("critic")))
        .otherwise(F.col("_why")))
    checked = ~late & (F.col("gate_type") != "extrospective")
    return rows.select(
        "condition", "gate_type", "gate_timing", "run_id", "seq", chosen.alias("verdict"),
        F.when(checked, F.col("_align").cast("int")).alias("aligned"),
        T.stripped_length("reasoning_text").alias("deliberation_length"), why.alias("reason"))


def confusion(df: DataFrame, keys: list[str], blocked: Column, failed: Column) -> DataFrame:
    """tp, fp, fn, tn with precision, recall, F1 and block rate; 0 where nothing is counted."""
    b, f = blocked, failed
    cells = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(b & f).alias("tp"), F.count_if(b & ~f).alias("fp"),
        F.count_if(~b & f).alias("fn"), F.count_if(~b & ~f).alias("tn"))
    part = lambda a, c: F.coalesce(F.try_divide(a.cast("double"), c.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = cells.withColumn("precision", part(tp, tp + fp)).withColumn("recall", part(tp, tp + fn))
    out = out.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("block_rate", part(tp + fp, F.col("total")))


def gate_metrics(decisions: DataFrame, runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    joined = decisions.join(runs, "run_id").where(F.col("success").isNotNull())
    return confusion(joined, keys or ["condition"], F.col("verdict") == "block", F.col("success") != 1)


def run_gate_metrics(decisions: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """As ``gate_metrics`` with a run blocked as soon as one of its calls is."""
    per = decisions.groupBy("condition", "run_id").agg(F.bool_or(F.col("verdict") == "block").alias("blocked"))
    joined = per.join(runs, "run_id").where(F.col("success").isNotNull())
    return confusion(joined, keys, F.col("blocked"), F.col("success") != 1)


def compare_conditions(metrics: DataFrame, base_fail_rate: DataFrame) -> DataFrame:
    """Precision above the base failure rate for each condition, and F1 contrasts: early against always, both
    gates against either, critic against self."""
    m = metrics.select("condition", "precision", "recall", "f1")
    wide = m.groupBy().pivot("condition", ["A1", "A2", "A3", "B1", "B2", "B3"]).agg(
        F.first("precision").alias("p"), F.first("f1").alias("f"))
    c = F.col
    pairs = F.array(*[
        F.struct(F.lit(name).alias("contrast"), value.alias("difference"))
        for name, value in [
            *[(f"{x}{i} over base", c(f"{x}{i}_p") - c("base")) for x in "AB" for i in (1, 2, 3)],
            *[(f"A{i} minus B{i}", c(f"A{i}_f") - c(f"B{i}_f")) for i in (1, 2, 3)],
            *[(f"{x}{i} minus {x}{j}", c(f"{x}{i}_f") - c(f"{x}{j}_f")) for x in "AB" for i, j in ((3, 1), (3, 2), (2, 1))],
        ]])
    one = wide.crossJoin(F.broadcast(base_fail_rate))  # one row each
    return one.select(F.explode(pairs).alias("_p")).select("_p.*")


# -- labels -------------------------------------------------------------------------------


def reconcile(machine: Column, pass1: Column, pass2: Column) -> Column:
    """A decisive machine label wins; two passes must agree; a single pass counts."""
    return (
        F.when(machine.isin("machine_correct", "machine_incorrect"), F.replace(machine, F.lit("machine_"), F.lit("")))
        .when(pass1.isNotNull() & pass2.isNotNull(), F.when(pass1 == pass2, pass2).otherwise("uncertain"))
        .otherwise(F.coalesce(pass2, pass1)))


def label_view(labels: DataFrame, key: str) -> DataFrame:
    """Passes side by side by one aggregation; a lone first pass gives no final label."""
    one = labels.groupBy(key).agg(
        F.max(F.when(F.col("pass") == 1, F.col("label"))).alias("pass1"),
        F.max(F.when(F.col("pass") == 2, F.col("label"))).alias("pass2"))
    both = F.col("pass1").isNotNull() & F.col("pass2").isNotNull()
    return one.withColumn("final", F.when(both & (F.col("pass1") != F.col("pass2")), "uncertain").otherwise(F.col("pass2")))


def kappa(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Agreement and Cohen's kappa of two labels, from their contingency table."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    total = cells.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.sum(F.when(F.col(a) == F.col(b), F.col("_c")).otherwise(0)).alias("_same"))
    left = cells.groupBy(*keys, F.col(a).alias("_v")).agg(F.sum("_c").alias("_l"))
    right = cells.groupBy(*keys, F.col(b).alias("_v")).agg(F.sum("_c").alias("_r"))
    chance = left.join(right, [*keys, "_v"]).groupBy(*keys).agg(F.sum(F.col("_l") * F.col("_r")).alias("_e"))
    out = total.join(chance, keys, "left") if keys else total.crossJoin(F.broadcast(chance))  # one row each
    po = F.col("_same") / F.col("_n")
    pe = F.coalesce("_e", F.lit(0.0)) / (F.col("_n") * F.col("_n"))
    return out.select(*keys, F.col("_n").cast("long").alias("n"), po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def agreement_table(calls: DataFrame, critic: DataFrame, labels: DataFrame) -> DataFrame:
    joined = calls.join(critic, "event_id").join(labels, "run_id").where(F.col("label").isin("correct", "incorrect"))
    return joined.groupBy(T.trajectory_bin("seq").alias("bin"), "agreement").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "incorrect").alias("n_incorrect"))


def go_no_go(df: DataFrame, checks: list[tuple[str, str, float, float]]) -> DataFrame:
    """(name, column, go at or above, kill below): one row per check of a one-row frame."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(c).cast("double").alias("value"),
                 F.when(F.col(c) >= go, "go").when(F.col(c) < kill, "kill").otherwise("revise").alias("decision"))
        for name, c, go, kill in checks])
    return df.select(F.explode(rows).alias("_r")).select("_r.*")
