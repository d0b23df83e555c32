"""Further run features: streaks, phases, pacing, corrections, word mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .skew import HOT_ROWS, chunked, has_large

EDIT = list(P.WRITE_TOOLS)


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def streaks(annotated: DataFrame) -> DataFrame:
    """Longest success streak, and mean calls from a streak's first error to the next success."""
    ends = F.col("err") & (F.col("next_err") == F.lit(False))
    return annotated.groupBy("run_id").agg(
        F.max("success_run").cast("long").alias("longest_success_streak"),
        F.avg(F.when(ends, F.col("error_run"))).alias("recovery_latency_mean"))


def _near(calls: DataFrame, before: int, after: int, limit: int):
    large = has_large(calls, ["run_id"], limit)
    cut = chunked(calls, "run_id", before, after, limit, large=large)
    keys = ["run_id", "_chunk"] if large else ["run_id"]
    return cut, Window.partitionBy(*keys).orderBy("seq")


def phase_count(calls: DataFrame, size: int = 5, share: float = 0.6, limit: int = HOT_ROWS) -> DataFrame:
    """Changes between stretches in which one tool holds more than ``share`` of the last ``size`` calls."""
    cut, w = _near(calls, size, 1, limit)
    last = w.rowsBetween(-(size - 1), 0)
    recent = F.collect_list("tool_name").over(last)
    count = lambda t: F.size(F.filter(recent, lambda x: x == t))
    top = F.array_max(F.transform(F.array_distinct(recent), lambda t: F.struct(count(t).alias("c"), t.alias("t"))))
    dom = cut.withColumn("_top", top).withColumn("_n", F.size(recent))
    phase = F.when(F.col("_top.c") > share * F.col("_n"), F.col("_top.t")).otherwise("mixed")
    dom = dom.withColumn("phase", phase)
    moved = dom.withColumn("_moved", F.coalesce(F.col("phase") != F.lag("phase").over(w), F.lit(False)))
    return moved.where(~F.col("_halo")).groupBy("run_id").agg((F.count_if("_moved") + 1).alias("phase_count"))


def exploration(calls: DataFrame, modifies: Column) -> DataFrame:
    """Read-only calls before the first edit over all calls, and all calls over modifying calls."""
    first = calls.groupBy("run_id").agg(F.min(F.when(F.col("tool_name").isin(EDIT), F.col("seq"))).alias("_first"))
    rows = calls.withColumn("_m", modifies).join(first, "run_id")
    early = ~F.col("_m") & (F.col("_first").isNull() | (F.col("seq") < F.col("_first")))
    return rows.groupBy("run_id").agg(
        _ratio(F.count_if(early), F.count(F.lit(1))).alias("explore_before_act_ratio"),
        _ratio(F.count(F.lit(1)), F.count_if("_m")).alias("read_to_write_ratio"))


def edit_shape(calls: DataFrame, growth: str) -> DataFrame:
    """Edit/Bash ratio, variation and mean of edit growth, share of edits in the last third."""
    edit = F.col("tool_name").isin(EDIT)
    late = (F.col("seq") - 1) / F.greatest(F.col("n") - 1, F.lit(1)) > 0.67
    g = F.when(edit, F.col(growth))
    return calls.groupBy("run_id").agg(
        _ratio(F.count_if(edit), F.count_if(F.col("tool_name") == "Bash")).alias("edit_to_bash_ratio"),
        F.try_divide(F.stddev_samp(g), F.avg(g)).alias("edit_size_cv"),
        _ratio(F.count_if(edit & late), F.count_if(edit)).alias("late_edit_fraction"), F.avg(g).alias("mean_edit_expansion"))


def test_pass_rate(calls: DataFrame) -> DataFrame:
    """Share of a run's test calls without error, its last test call excluded."""
    tests = calls.where(T.is_test_command("tool_name", "tool_target"))
    last = tests.groupBy("run_id").agg(F.max("seq").alias("_last"))
    rest = tests.join(last, "run_id").where(F.col("seq") < F.col("_last"))
    ok = ~F.coalesce("is_error", F.lit(False))
    return rest.groupBy("run_id").agg(F.count(F.lit(1)).alias("tests"), F.avg(ok.cast("double")).alias("test_pass_rate"))


def read_before_edit(calls: DataFrame, back: int = 3, limit: int = HOT_ROWS) -> DataFrame:
    cut, w = _near(calls, back, 0, limit)
    look = F.col("tool_name").isin("Read", "Grep", "Glob").cast("int")
    seen = cut.withColumn("_seen", F.max(look).over(w.rowsBetween(-back, -1))).where(~F.col("_halo"))
    edit = F.col("tool_name").isin(EDIT)
    return seen.groupBy("run_id").agg(_ratio(F.count_if(edit & (F.col("_seen") == 1)), F.count_if(edit)).alias("grep_before_edit_rate"))


def command_complexity(calls: DataFrame, command: str = "tool_target") -> DataFrame:
    ops = F.regexp_count(F.col(command), F.lit(r"\|\||\||&&|;"))
    return calls.where("tool_name = 'Bash'").groupBy("run_id").agg(F.avg(ops).alias("command_complexity"))


def slope(x: Column, y: Column) -> Column:
    """OLS slope as an aggregate; null when x does not vary."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(xs).cast("double")
    return F.try_divide(n * F.sum(xs * ys) - F.sum(xs) * F.sum(ys), n * F.sum(xs * xs) - F.sum(xs) * F.sum(xs))


def slopes(calls: DataFrame, size: str, bins: int = 5) -> DataFrame:
    """Slope of the error rate over equal bins of the run, and of a size over the step."""
    b = F.floor((F.col("seq") - 1) * bins / F.col("n"))
    err = F.coalesce("is_error", F.lit(False)).cast("double")
    per = calls.groupBy("run_id", b.alias("_b")).agg(F.avg(err).alias("_e"))
    step = (F.col("seq") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    return per.groupBy("run_id").agg(slope(F.col("_b"), F.col("_e")).alias("error_rate_slope")).join(
        calls.groupBy("run_id").agg(slope(step, F.col(size)).alias("size_trend_slope")), "run_id")


def density_slope(calls: DataFrame, at: Column, bins: int = 5) -> DataFrame:
    """Slope of calls per equal time interval of the run, empty intervals counted."""
    span = calls.groupBy("run_id").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    share = F.coalesce(F.try_divide((at - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0))
    b = F.least(F.floor(share * bins), F.lit(bins - 1))
    wide = calls.join(span, "run_id").withColumn("_b", b).groupBy("run_id").agg(
        *[F.count_if(F.col("_b") == i).alias(f"_c{i}") for i in range(bins)])
    mid = (bins - 1) / 2
    den = sum((i - mid) ** 2 for i in range(bins))
    return wide.select("run_id", (sum(F.col(f"_c{i}") * (i - mid) for i in range(bins)) / den).alias("action_density_slope"))


def entropy_shift(calls: DataFrame) -> DataFrame:
    """Shannon entropy of tool names, late half minus early half."""
    half = F.when(F.col("seq") > F.floor(F.col("n") / 2), "late").otherwise("early")
    c = calls.groupBy("run_id", half.alias("half"), "tool_name").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    total = F.sum("_c")
    h = c.groupBy("run_id", "half").agg((F.log(total) - F.sum(F.col("_c") * F.log("_c")) / total).alias("h"))
    pick = lambda v: F.coalesce(F.max(F.when(F.col("half") == v, F.col("h"))), F.lit(0.0))
    return h.groupBy("run_id").agg((pick("late") - pick("early")).alias("tool_diversity_trajectory"))


def corrections(annotated: DataFrame, text: str, patterns: list[str] | None = None) -> DataFrame:
    """Correction markers followed, or not followed, by another tool or target than before."""
    hits = T.pattern_hits(text, patterns or P.CORRECTIONS)
    changed = F.coalesce((F.col("tool_name") != F.col("prev_tool")) | (F.col("tool_target") != F.col("prev_target")), F.lit(True))
    return annotated.groupBy("run_id").agg(
        F.sum(F.when(changed, hits).otherwise(0)).alias("productive_corrections"),
        F.sum(F.when(~changed, hits).otherwise(0)).alias("unproductive_corrections"))


def plan_match_rate(calls: DataFrame, text: str, verbs: dict[str, str]) -> DataFrame:
    """Share of calls whose text has a verb of the tool used."""
    named = F.lit(False)
    for tool, verb in verbs.items():
        named = named | ((F.col("tool_name") == tool) & F.coalesce(F.col(text), F.lit("")).rlike("(?iU)" + verb))
    return calls.groupBy("run_id").agg(F.avg(named.cast("double")).alias("stated_plan_match_rate"))


VERBS = {"Edit": r"\bedit\b", "Bash": r"\b(?:run|test|execute)\b", "Write": r"\b(?:write|create)\b"}


def length_ratio(calls: DataFrame, size: str, committed: list[str]) -> DataFrame:
    """Mean text size before committed actions over that before exploratory ones."""
    yes = F.col("tool_name").isin(committed)
    return calls.groupBy("run_id").agg(
        F.try_divide(F.avg(F.when(yes, F.col(size))), F.avg(F.when(~yes, F.col(size)))).alias("reasoning_action_type_match"))


def diagnose_implement_verify(calls: DataFrame) -> DataFrame:
    """One third of the score for each third of the run whose commonest tool fits: read or shell, edit, shell."""
    kind = F.when(F.col("tool_name").isin(EDIT), "edit").when(F.col("tool_name") == "Bash", "bash").otherwise("read")
    c = calls.groupBy("run_id", T.trajectory_third("seq", "n").alias("third"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("_c"))
    top = c.groupBy("run_id", "third").agg(F.max_by("kind", F.struct("_c", "kind")).alias("top"))
    fits = (
        F.when(F.col("third") == "early", F.col("top").isin("read", "bash")).when(F.col("third") == "mid", F.col("top") == "edit")
        .otherwise(F.col("top") == "bash"))
    return top.groupBy("run_id").agg((F.sum(fits.cast("int")) / 3).alias("div_score"))


def third_error_rates(calls: DataFrame) -> DataFrame:
    err = F.coalesce("is_error", F.lit(False)).cast("double")
    third = T.trajectory_third("seq", "n")
    rate = lambda v: F.avg(F.when(third == v, err))
    upto = lambda k: F.avg(F.when(F.col("seq") <= F.greatest(F.lit(1), F.floor(F.col("n") / k)), err))
    out = calls.groupBy("run_id").agg(
        rate("early").alias("early"), rate("mid").alias("mid"), rate("late").alias("late"),
        upto(4).alias("first_quarter"), upto(3).alias("first_third"), upto(2).alias("first_half"))
    return out.withColumn("mid_error_spike", F.col("mid") - (F.col("early") + F.col("late")) / 2)


def transitions(annotated: DataFrame) -> DataFrame:
    """Shares of tool pairs a → b among all of a run's steps."""
    steps = annotated.where(F.col("next_tool").isNotNull())
    c = steps.groupBy("run_id", F.col("tool_name").alias("a"), F.col("next_tool").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    total = c.groupBy("run_id").agg(F.sum("c").alias("_t"))
    return c.join(total, "run_id").select("run_id", "a", "b", (F.col("c") / F.col("_t")).alias("share"))


INFRASTRUCTURE = r"(?i)ModuleNotFoundError|ImportError|command not found|No such file|Permission denied|timed? ?out"


def substantive_error_rate(calls: DataFrame, output: str, pattern: str = INFRASTRUCTURE) -> DataFrame:
    bad = F.coalesce("is_error", F.lit(False))
    infra = F.coalesce(F.col(output).rlike(pattern), F.lit(False))
    return calls.groupBy("run_id").agg(
        F.count_if(bad & infra).alias("infrastructure_errors"), F.count_if(bad & ~infra).alias("substantive_errors"),
        F.avg((bad & ~infra).cast("double")).alias("substantive_error_rate"))


def discriminative_words(runs: DataFrame, text: str, success: str, min_docs: int) -> DataFrame:
    """Per word: passing and failing texts that hold it, the ratio of their shares, and the rank correlation of holding
    it with the outcome (``rho`` over ``n`` texts; of two yes/no columns it follows from the counts).

    Words are made distinct inside a text before anything is shuffled.
    """
    word = F.explode(F.array_distinct(T.tokens(text))).alias("word")
    c = runs.select(success, word).groupBy("word").agg(
        F.count_if(F.col(success) == 1).alias("pass_docs"), F.count_if(F.col(success) == 0).alias("fail_docs"))
    totals = runs.agg(F.count_if(F.col(success) == 1).alias("_p"), F.count_if(F.col(success) == 0).alias("_f"))
    both = c.where(F.col("pass_docs") + F.col("fail_docs") >= min_docs).crossJoin(F.broadcast(totals))  # one row
    ratio = F.try_divide(F.col("pass_docs") / F.col("_p"), F.col("fail_docs") / F.col("_f"))
    have, n = F.col("pass_docs") + F.col("fail_docs"), F.col("_p") + F.col("_f")
    spread = F.sqrt((have * (n - have)).cast("double")) * F.sqrt((F.col("_p") * F.col("_f")).cast("double"))
    rho = F.try_divide((F.col("pass_docs") * (F.col("_f") - F.col("fail_docs")) - F.col("fail_docs") * (F.col("_p") - F.col("pass_docs"))).cast("double"), spread)
    return both.select("word", "pass_docs", "fail_docs", ratio.alias("ratio"), n.alias("n"), rho.alias("rho"))


def vif(df: DataFrame, features: list[str]) -> DataFrame:
    """Variance inflation from one aggregation of second moments; the k x k inverse is on the driver."""
    import numpy as np
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    rows = df.dropna(subset=features)
    r = rows.agg(*[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs], *[F.var_pop(a).alias(f"v_{a}") for a in features]).first()
    c = np.eye(len(features))
    for a, b in pairs:
        i, j = features.index(a), features.index(b)
        s = (r[f"v_{a}"] * r[f"v_{b}"]) ** 0.5
        c[i, j] = c[j, i] = r[f"c_{a}_{b}"] / s if s else 0.0
    inv = np.linalg.pinv(c)
    out = [(f, float(inv[i, i]), bool(inv[i, i] > 5)) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(out, "feature string, vif double, flagged boolean")


def condition_costs(runs: DataFrame, base: str, seconds: str, tokens: str, calls: str, success: str = "success") -> DataFrame:
    """Median seconds against the base condition, tokens and calls per solved task."""
    from .skew import quantile
    med = quantile(runs, ["condition"], seconds, [0.5]).withColumnRenamed("q0", "median_seconds")
    agg = runs.groupBy("condition").agg(
        _ratio(F.sum(tokens), F.sum(success)).alias("tokens_per_solved"), _ratio(F.sum(calls), F.sum(success)).alias("calls_per_solved"))
    ref = med.where(F.col("condition") == base).select(F.col("median_seconds").alias("_base"))
    both = med.join(agg, "condition").crossJoin(F.broadcast(ref))  # one row
    return both.withColumn("overhead", F.try_divide("median_seconds", "_base") - 1).drop("_base")
