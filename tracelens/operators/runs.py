"""From calls to runs and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from . import sequence as S


def zero(c) -> Column:
    return F.coalesce(c, F.lit(0.0))


def sum_max_rollup(calls: DataFrame, summed: list[str], peaked: list[str], text_flag: str) -> DataFrame:
    aggs = [zero(F.sum(c)).cast("double").alias(f"{c}_sum") for c in summed]
    aggs += [F.greatest(zero(F.max(c)), F.lit(0.0)).cast("double").alias(f"{c}_max") for c in peaked]
    return calls.groupBy("run_id").agg(*aggs, F.count_if(F.col(text_flag) > 0).alias("calls_with_reasoning"))


def mean_rollup(calls: DataFrame, cols: list[str], key: str = "run_id") -> DataFrame:
    """Means over non-null values; 0 when all are null."""
    return calls.groupBy(key).agg(*[zero(F.avg(c)).alias(c) for c in cols])


def structural(annotated: DataFrame) -> DataFrame:
    """Run-level structure from ``sequence.annotate`` output, in one aggregation.

    Test calls are looked for in the whole parameter text where the calls carry it (``params_json``).
    """
    test = T.is_test_command("tool_name", "params_json" if "params_json" in annotated.columns else "tool_target", "substring")
    return annotated.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_calls"), S.fail_streak_max().alias("fail_streak_max"),
        S.early_error_rate().alias("early_error_rate"), S.first_edit().alias("first_edit_position"),
        S.unique_files().alias("unique_files_touched"), S.edit_churn(all_edits=True).alias("edit_churn_rate"),
        S.recovery_rate(empty_is_null=True).alias("recovery_rate"),
        S.fail_then_switch_rate(all_failures=True).alias("fail_then_switch_rate"),
        F.count_if(test).alias("test_run_count"),
    )


LEXICAL = ["hedging_score", "deliberation_length", "backtrack_count", "verification_score", "planning_score"]
DENSITIES = ["metacognitive_density", "tentative_density", "insight_density", "instead_contrast_density",
             "self_directive_density", "wrong_stuck_density", "causal_density", "precision_naming_score"]
FEATURES = ["fail_streak_max", "early_error_rate", "first_edit_position", "unique_files_touched", "edit_churn_rate",
            "recovery_rate", "fail_then_switch_rate", "test_run_count", "n_calls", *LEXICAL, *DENSITIES,
            "reasoning_to_action_alignment"]


def run_features(runs: DataFrame, calls: DataFrame, text: str = "reasoning_text",
                 parts: dict[str, list[str]] | None = None, lexicon: list[str] | None = None) -> DataFrame:
    """The 23-column frame: structure, lexical means, densities of non-blank texts, alignment.

    ``lexicon`` replaces the short list of hedging words; ``text.read_lexicon`` reads a longer one.
    """
    t1 = T.tier1(text, lexicon)
    dens = {k: F.when(F.length(text) > 0, T.substring_density(text, v)) for k, v in (parts or P.SUBSTRINGS).items()}
    dens["precision_naming_score"] = F.when(F.length(text) > 0, T.precision_naming(text, loose=True))
    scored = calls.select(
        "run_id", *[t1[c].alias(c) for c in LEXICAL], *[dens[c].alias(c) for c in DENSITIES],
        T.alignment(text, "tool_name", "tool_target", "zero").alias("reasoning_to_action_alignment"))
    means = scored.groupBy("run_id").agg(
        *[zero(F.avg(c)).alias(c) for c in LEXICAL], *[F.avg(c).alias(c) for c in DENSITIES],
        F.avg("reasoning_to_action_alignment").alias("reasoning_to_action_alignment"))
    shape = structural(S.annotate(calls))
    out = runs.join(shape, "run_id", "left").join(means, "run_id", "left")
    return out.withColumn("n_calls", F.coalesce("n_calls", F.lit(0)))


def layer_features(calls: DataFrame, layers: dict[str, str], alternations: dict[str, str]) -> DataFrame:
    """The same densities for each text layer: means over non-empty layer texts, block and character totals."""
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), F.col(c).alias("t")) for k, c in layers.items()]))
    long = calls.select("run_id", stack.alias("_l")).select("run_id", "_l.layer", "_l.t").where(F.coalesce("t", F.lit("")) != "")
    feats = [F.avg(T.alternation_density("t", p)).alias(k) for k, p in alternations.items()]
    per = long.groupBy("run_id", "layer").agg(
        *feats, F.avg(T.token_count("t")).alias("token_count"), F.count(F.lit(1)).alias("blocks"),
        F.sum(F.length("t")).alias("chars"))
    names = [*alternations, "token_count", "blocks", "chars"]
    wide = calls.select("run_id").distinct().join(
        per.groupBy("run_id").pivot("layer", list(layers)).agg(*[F.first(n).alias(n) for n in names]), "run_id", "left")
    return wide.na.fill(0)


def outcome_summary(runs: DataFrame, keys: list[str], success: str = "success") -> DataFrame:
    """Counts and pass rate over a rollup of ``keys``; null keys are totals."""
    s = F.col(success)
    return runs.rollup(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(s == 1).alias("passes"), F.count_if(s == 0).alias("fails"),
        F.count_distinct("task_id").alias("tasks"), F.avg(s.cast("double")).alias("pass_rate"))


def describe(long: DataFrame) -> DataFrame:
    """n, mean, sample sd, min and max per feature of a long frame."""
    return long.where(F.col("x").isNotNull()).groupBy("feature").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"))


def cluster_mean(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """Mean of cluster means with its standard error."""
    per = df.groupBy(cluster).agg(F.avg(value).alias("m"))
    return per.agg(F.count(F.lit(1)).alias("clusters"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"),
                   (F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def majority(runs: DataFrame, keys: list[str], tie: int | None = None, success: str = "success") -> DataFrame:
    """Majority outcome per group; ``tie`` is the label of an even split."""
    rate = F.avg(F.col(success).cast("double"))
    return runs.groupBy(*keys).agg(rate.alias("rate")).withColumn(
        "vote", F.when(F.col("rate") > 0.5, 1).when(F.col("rate") < 0.5, 0).otherwise(F.lit(tie)))


def mixed_tasks(runs: DataFrame, success: str = "success") -> DataFrame:
    both = runs.groupBy("task_id").agg(F.min(success).alias("_lo"), F.max(success).alias("_hi"))
    return both.where(F.col("_lo") < F.col("_hi")).select("task_id")


def next_batch(tasks: DataFrame, runs: DataFrame, k: int, success: str = "success") -> DataFrame:
    """The k tasks to run next: never run, then mixed outcomes, then the rest; fewest runs first."""
    s = F.col(success)
    stats = runs.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(s == 1).alias("passes"), F.count_if(s == 0).alias("fails"))
    tier = F.when(F.col("n").isNull(), 0).when((F.col("passes") > 0) & (F.col("fails") > 0), 1).otherwise(2)
    scored = tasks.join(stats, "task_id", "left").select("task_id", tier.alias("tier"), F.coalesce("n", F.lit(0)).alias("n"))
    return scored.orderBy("tier", "n", "task_id").limit(k)
