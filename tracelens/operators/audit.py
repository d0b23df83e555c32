"""Checking outcomes against the traces, replaying edits, and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .skew import quantile


def test_executions(blocks: DataFrame) -> DataFrame:
    """Test commands with their output, error flag and counts, in result order."""
    use = blocks.where("kind = 'tool_use' and tool_name = 'Bash'").select(
        "run_id", "tool_id", F.get_json_object("input_json", "$.command").alias("command"))
    use = use.where(T.is_test_command(F.lit("Bash"), "command", "runner"))
    res = blocks.where("kind = 'tool_result'").select(
        "run_id", "tool_id", "line_no", "block_pos", F.col("text").alias("output"), "is_error")
    passed, failed = T.test_counts("output")
    return use.join(res, ["run_id", "tool_id"]).withColumn("passed", passed).withColumn("failed", failed)


def cross_reference(executions: DataFrame, targets: DataFrame) -> DataFrame:
    """One verdict per run of ``targets`` from its best-matching test execution, ``no_tests`` for a run that has none.

    ``targets`` has (run_id, targets array). Most target hits win, the first of equals; without
    any hit the last execution counts. Executions of a run are reduced, never gathered.
    """
    wanted = F.coalesce("targets", F.array().cast("array<string>"))
    scored = executions.join(targets, "run_id", "left").withColumn(
        "hits", F.size(F.filter(wanted, lambda x: F.contains(F.col("command"), x) | F.contains(F.col("output"), x))))
    rest = F.struct("command", "output", "is_error", "passed", "failed", "hits")
    first = F.struct("hits", (-F.col("line_no")).alias("l"), (-F.col("block_pos")).alias("b"))
    best = scored.groupBy("run_id").agg(
        F.max_by(rest, first).alias("_b"), F.max_by(rest, F.struct("line_no", "block_pos")).alias("_l"))
    one = best.select("run_id", F.when(F.col("_b.hits") > 0, F.col("_b")).otherwise(F.col("_l")).alias("e")).select("run_id", "e.*")
    missing = F.col("output").contains("ModuleNotFoundError") | F.col("output").contains("ImportError")
    verdict = (
        F.when((F.col("passed") > 0) & (F.col("failed") == 0) & ~F.col("is_error"), "pass").when(F.col("failed") > 0, "fail")
        .when(F.col("is_error"), F.when(missing, "env_error").otherwise("fail")).otherwise("unclear"))
    out = one.withColumn("verdict", verdict)
    sure = F.col("verdict").isin("pass", "fail")
    judged = out.withColumn("confidence", F.when(sure & (F.col("hits") > 0), "high").when(sure, "medium").otherwise("low"))
    every = targets.select("run_id").distinct().join(judged, "run_id", "left")
    return every.withColumn("verdict", F.coalesce("verdict", F.lit("no_tests"))).withColumn("confidence", F.coalesce("confidence", F.lit("none")))


def relabel(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """New outcomes for runs without a validated label; validated ones stay."""
    joined = runs.join(verdicts, "run_id", "left")
    sure = F.col("validation_source").isNull() & F.col("confidence").isin("high", "medium")
    new = F.when(sure & (F.col("verdict") == "pass"), 1).when(sure & (F.col("verdict") == "fail"), 0).otherwise(F.col("success"))
    return joined.withColumn("new_success", new)


def label_changes(relabelled: DataFrame) -> DataFrame:
    return relabelled.groupBy(F.col("success").alias("old"), F.col("new_success").alias("new")).agg(F.count(F.lit(1)).alias("runs"))


def edit_log(blocks: DataFrame, markers: tuple[str, ...] = ("workspace_",)) -> DataFrame:
    """Write and Edit payloads in order, with relative paths; ``ok`` is false for paths that leave the workspace."""
    pick = lambda k: F.get_json_object("input_json", f"$.{k}")
    edits = blocks.where((F.col("role") == "assistant") & (F.col("kind") == "tool_use") & F.col("tool_name").isin(P.WRITE_TOOLS))
    rel = T.relative_path(F.coalesce(pick("file_path"), F.lit("")), markers)
    out = edits.select(
        "run_id", "line_no", "block_pos", "tool_name", rel.alias("path"), pick("content").alias("content"),
        pick("old_string").alias("old"), pick("new_string").alias("new"))
    return out.withColumn("ok", ~F.contains(F.col("path"), F.lit("..")) & ~F.col("path").startswith("/"))


def _apply(state: Column, e: Column) -> Column:
    """One edit on (text, applied, failed); text is null while the file does not exist."""
    at = F.position(e["old"], state["text"])
    hit = state["text"].isNotNull() & (at > 0)
    swapped = F.concat(F.substr(state["text"], F.lit(1), at - 1), e["new"], F.substr(state["text"], at + F.length(e["old"])))
    write = e["tool_name"] == "Write"
    text = F.when(write, e["content"]).when(hit, swapped).otherwise(state["text"])
    done = write | F.coalesce(hit, F.lit(False))
    return F.struct(text.alias("text"), (state["applied"] + done.cast("int")).alias("applied"),
                    (state["failed"] + (~done).cast("int")).alias("failed"))


def replay_edits(edits: DataFrame, files: DataFrame) -> DataFrame:
    """Replay each file's edits on its content: final text and how many edits applied or failed.

    ``files`` has (run_id, path, text). Only the edits of one file of one run meet in a row;
    rejected paths count as failed. Equal to replaying in stream order, since edits of
    different files do not touch each other.
    """
    step = F.struct("line_no", "block_pos", "tool_name", "content", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))
    per = edits.groupBy("run_id", "path").agg(
        F.array_sort(F.collect_list(F.when(F.col("ok"), step))).alias("_e"), F.count_if(~F.col("ok")).alias("rejected"))
    start = F.struct(F.col("text"), F.lit(0).alias("applied"), F.lit(0).alias("failed"))
    out = per.join(files, ["run_id", "path"], "left").withColumn("_s", F.aggregate("_e", start, _apply))
    return out.select("run_id", "path", F.col("_s.text").alias("text"), F.col("_s.applied").alias("applied"),
                      (F.col("_s.failed") + F.col("rejected")).cast("int").alias("failed"))


def quality(runs: DataFrame, calls: DataFrame, feature: str, step: str) -> DataFrame:
    """(issue, severity, n): one aggregation per table."""
    def long(df: DataFrame, checks: list) -> DataFrame:
        agg = df.agg(*[F.count_if(cond).alias(name) for name, _, cond in checks])
        rows = F.array(*[F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"), F.col(n).alias("n")) for n, s, _ in checks])
        return agg.select(F.explode(rows).alias("_r")).select("_r.*")
    seen = calls.select("run_id").distinct().withColumn("_seen", F.lit(True))
    flagged = runs.join(seen, "run_id", "left")
    a = long(flagged, [
        ("runs_without_calls", "WARN", F.col("_seen").isNull()), ("null_outcomes", "INFO", F.col("success").isNull()),
        ("inverted_counts", "ERROR", F.col("total_tool_calls") < F.col("total_state_modifying_calls"))])
    b = long(calls, [
        ("null_features", "WARN", F.col(feature).isNull() | F.col(step).isNull()),
        ("biased_first_step", "WARN", (F.col("seq") == 1) & (F.col(step) > 0.01))])
    return a.unionByName(b)


def anomalies(runs: DataFrame, short_seconds: float, many_calls: int, order: str, prob: float = 0.95) -> DataFrame:
    """Counts of fast-but-busy runs, repeated run ids and call outliers, and the drift of the pass rate."""
    p = quantile(runs, [], "n_calls", [prob]).withColumnRenamed("q0", "_cut")
    mid = quantile(runs, [], order, [0.5]).withColumnRenamed("q0", "_mid")
    dup = runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("_k")).agg(F.count_if(F.col("_k") > 1).alias("repeated_runs"))
    one = runs.crossJoin(F.broadcast(p)).crossJoin(F.broadcast(mid))  # one row each
    s = F.col("success").cast("double")
    out = one.agg(
        F.count_if((F.col("wall_seconds") < short_seconds) & (F.col("n_calls") > many_calls)).alias("fast_busy_runs"),
        F.count_if(F.col("n_calls") > F.col("_cut")).alias("call_outliers"),
        F.avg(F.when(F.col(order) <= F.col("_mid"), s)).alias("early_pass_rate"),
        F.avg(F.when(F.col(order) > F.col("_mid"), s)).alias("late_pass_rate"))
    return out.crossJoin(F.broadcast(dup))  # one row
