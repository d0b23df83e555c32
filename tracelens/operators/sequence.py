"""Features of a call's place in its run.

Input: (run_id, seq from 1, n = run length, tool_name, tool_target, is_error …).
All windows share one partitioning; see ``skew`` for runs that outgrow a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .skew import HOT_ROWS, carried, chunked, has_large

RUN = "run_id"


def step_index(seq, n) -> Column:
    """(seq - 1) / (n - 1) within [0, 1]; 0 for single-step runs."""
    s, m = (F.col(c) if isinstance(c, str) else c for c in (seq, n))
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(s - 1, m - 1)))
    return F.when(m > 1, F.coalesce(at, F.lit(0.0))).otherwise(0.0)


def annotate(calls: DataFrame, failed: Column | None = None, limit: int = HOT_ROWS,
             large: bool | None = None) -> DataFrame:
    """Add the neighbour and running columns that the sequence features are made of.

    ``failed`` is the flag for failure streaks (default: a null error flag is a failure).
    """
    err = F.coalesce(F.col("is_error"), F.lit(False))
    fail = F.coalesce(F.col("is_error"), F.lit(True)) if failed is None else failed
    large = has_large(calls, [RUN], limit) if large is None else large
    cut = chunked(calls.withColumn("err", err).withColumn("fail", fail), RUN, 4, 1, limit, large=large)
    w = Window.partitionBy(RUN, "_chunk").orderBy("seq") if large else Window.partitionBy(RUN).orderBy("seq")
    until = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changed = F.when(F.lag("tool_name").over(w).isNotNull(), (F.col("tool_name") != F.lag("tool_name").over(w)).cast("double"))
    wide = (
        cut.withColumn("prev_tool", F.lag("tool_name").over(w))
        .withColumn("prev_target", F.lag("tool_target").over(w))
        .withColumn("next_tool", F.lead("tool_name").over(w))
        .withColumn("next_target", F.lead("tool_target").over(w))
        .withColumn("next_err", F.lead("err").over(w))
        .withColumn("_last_pass", F.max(F.when(~F.col("fail"), F.col("seq"))).over(until))
        .withColumn("_last_ok", F.max(F.when(~F.col("err"), F.col("seq"))).over(upto))
        .withColumn("_last_err", F.max(F.when(F.col("err"), F.col("seq"))).over(upto))
        .withColumn("_changed", changed)
    )
    wide = wide.withColumn("tool_switch_rate", F.coalesce(F.avg("_changed").over(w.rowsBetween(-3, 0)), F.lit(0.0)))
    for name, flag in (("_last_pass", ~F.col("fail")), ("_last_ok", ~F.col("err")), ("_last_err", F.col("err"))):
        wide = carried(wide, [RUN], F.when(flag, F.col("seq")), F.max, name + "_c", large=large)
        wide = wide.withColumn(name, F.coalesce(F.greatest(name, name + "_c"), F.lit(0))).drop(name + "_c")
    own = wide.where(~F.col("_halo"))
    return (
        own.withColumn("step_index_normalized", step_index("seq", "n"))
        .withColumn("prior_failure_streak", F.col("seq") - 1 - F.col("_last_pass"))
        .withColumn("error_run", F.when(F.col("err"), F.col("seq") - F.col("_last_ok")).otherwise(0))
        .withColumn("success_run", F.when(~F.col("err"), F.col("seq") - F.col("_last_err")).otherwise(0))
        .drop("_halo", "_last_pass", "_last_err", "_changed", "_chunk")
    )


def retry_count(calls: DataFrame, limit: int = HOT_ROWS, large: bool | None = None) -> DataFrame:
    """How often the same (tool, target) appeared earlier in the run."""
    keys = [RUN, "tool_name", "tool_target"]
    large = has_large(calls, [RUN], limit) if large is None else large
    cut = chunked(calls, RUN, limit=limit, large=large)
    w = Window.partitionBy(*keys, "_chunk").orderBy("seq") if large else Window.partitionBy(*keys).orderBy("seq")
    counted = cut.withColumn("_in", F.row_number().over(w) - 1)
    counted = carried(counted, keys, F.lit(1), F.sum, "_earlier", large=large)
    out = counted.withColumn("retry_count", (F.col("_in") + F.coalesce("_earlier", F.lit(0))).cast("long"))
    return out.drop("_chunk", "_halo", "_in", "_earlier")


def first_edit(variant: str = "span") -> Column:
    """Position of the first edit of a run as an aggregate over its calls.

    ``span``: (seq - 1) / max(n - 1, 1), 1 without edits. ``zero_based``: (seq - 1) / n, 1.
    ``one_based``: seq / n, 0 without edits. ``edit_only``: least step index of Edit calls, 1.
    """
    edit = F.col("tool_name").isin(P.WRITE_TOOLS)
    seq, n = F.col("seq"), F.max("n")
    first = F.min(F.when(edit, seq))
    if variant == "zero_based":
        return F.coalesce((first - 1) / n, F.lit(1.0))
    if variant == "one_based":
        return F.coalesce(first / n, F.lit(0.0))
    if variant == "edit_only":
        return F.coalesce(F.min(F.when(F.col("tool_name") == "Edit", step_index("seq", "n"))), F.lit(1.0))
    return F.coalesce((first - 1) / F.greatest(n - 1, F.lit(1)), F.lit(1.0))


def fail_streak_max() -> Column:
    return F.coalesce(F.max("error_run"), F.lit(0)).cast("long")


def recovery_rate(empty_is_null: bool = False) -> Column:
    fails = F.count_if("err")
    back = F.count_if(F.col("err") & ~F.col("next_err"))
    rate = F.try_divide(back.cast("double"), fails.cast("double"))
    return rate if empty_is_null else F.coalesce(rate, F.lit(0.0))


def fail_then_switch_rate(all_failures: bool = False) -> Column:
    """Share of failures followed by another tool; over those with a next call, or over all (null when none)."""
    base = F.col("err") if all_failures else F.col("err") & F.col("next_tool").isNotNull()
    hits = F.count_if(F.col("err") & (F.col("tool_name") != F.col("next_tool")))
    rate = F.try_divide(hits.cast("double"), F.count_if(base).cast("double"))
    return rate if all_failures else F.coalesce(rate, F.lit(0.0))


def early_error_rate() -> Column:
    return F.coalesce(F.avg(F.when(T.in_first_third("seq", "n"), F.col("err").cast("double"))), F.lit(0.0))


def unique_files() -> Column:
    edit = F.col("tool_name").isin(P.WRITE_TOOLS)
    return F.count_distinct(F.when(edit, F.nullif("tool_target", F.lit(""))))


def edit_churn(all_edits: bool = False) -> Column:
    edit = F.col("tool_name").isin(P.WRITE_TOOLS)
    base = F.count_if(edit) if all_edits else F.count_if(edit & (F.col("tool_target") != ""))
    return base / F.greatest(unique_files(), F.lit(1))
