"""Sequence, rollup, run selection and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import runs as R
from ..operators import sequence as S
from ..operators.skew import quantile
from ..plans import association as C
from ..sources import tables
from . import bind as B
from .attributed import attributed
from .registry import query


def annotated(t):
    if "_annotated" not in t.__dict__:
        t.__dict__["_annotated"] = S.annotate(t.calls)
    return t.__dict__["_annotated"]


B.CTES["marked"] = """SELECT *, coalesce(is_error, false) AS err, coalesce(is_error, true) AS bad,
    lead(coalesce(is_error, false)) OVER w AS next_err, lead(tool_name) OVER w AS next_tool, lag(tool_name) OVER w AS prev_tool,
    lead(tool_target) OVER w AS next_target, lag(tool_target) OVER w AS prev_target,
    seq - 1 - coalesce(max(CASE WHEN NOT coalesce(is_error, true) THEN seq END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS streak,
    CASE WHEN coalesce(is_error, false) THEN seq - coalesce(max(CASE WHEN NOT coalesce(is_error, false) THEN seq END) OVER (w ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END AS error_run,
    CASE WHEN NOT coalesce(is_error, false) THEN seq - coalesce(max(CASE WHEN coalesce(is_error, false) THEN seq END) OVER (w ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END AS success_run
    FROM calls WINDOW w AS (PARTITION BY run_id ORDER BY seq)"""


@query("w6_step_index", "SELECT run_id, seq, CASE WHEN n > 1 THEN (seq - 1) / (n - 1) ELSE 0.0::DOUBLE END AS step FROM calls", dbl="step", lng="seq")
def _w6(t):
    return t.calls.select("run_id", "seq", S.step_index("seq", "n").alias("step"))


@query("w7_failure_streak", "SELECT run_id, seq, streak FROM marked", lng="seq streak")
def _w7(t):
    return annotated(t).select("run_id", "seq", F.col("prior_failure_streak").alias("streak"))


@query("w8_retry_count", "SELECT run_id, seq, row_number() OVER (PARTITION BY run_id, tool_name, tool_target ORDER BY seq) - 1 AS retries FROM calls", lng="seq retries")
def _w8(t):
    return S.retry_count(t.calls).select("run_id", "seq", F.col("retry_count").alias("retries"))


@query("w9_tool_switch_rate", """SELECT run_id, seq, coalesce(avg(CASE WHEN prev_tool IS NULL THEN NULL WHEN prev_tool <> tool_name THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0) AS rate FROM marked""", dbl="rate", lng="seq")
def _w9(t):
    return annotated(t).select("run_id", "seq", F.col("tool_switch_rate").alias("rate"))


@query("w10_fail_streak_max", "SELECT run_id, max(error_run) AS fail_streak_max FROM marked GROUP BY run_id", lng="fail_streak_max")
def _w10(t):
    return annotated(t).groupBy("run_id").agg(S.fail_streak_max().alias("fail_streak_max"))


@query("w11_recovery_rate", """SELECT run_id, coalesce(count(*) FILTER (WHERE err AND NOT next_err) / nullif(count_if(err), 0), 0) AS rate,
    count(*) FILTER (WHERE err AND NOT next_err) / nullif(count_if(err), 0) AS rate_or_null FROM marked GROUP BY run_id""", dbl="rate rate_or_null")
def _w11(t):
    return annotated(t).groupBy("run_id").agg(S.recovery_rate().alias("rate"), S.recovery_rate(True).alias("rate_or_null"))


@query("w12_fail_then_switch", """SELECT run_id, coalesce(count(*) FILTER (WHERE err AND next_tool <> tool_name) / nullif(count(*) FILTER (WHERE err AND next_tool IS NOT NULL), 0), 0) AS rate,
    count(*) FILTER (WHERE err AND next_tool <> tool_name) / nullif(count_if(err), 0) AS rate_all FROM marked GROUP BY run_id""", dbl="rate rate_all")
def _w12(t):
    return annotated(t).groupBy("run_id").agg(S.fail_then_switch_rate().alias("rate"), S.fail_then_switch_rate(True).alias("rate_all"))


@query("w13_first_edit_position", """SELECT run_id, coalesce((min(CASE WHEN tool_name IN ('Edit', 'Write') THEN seq END) - 1) / greatest(max(n) - 1, 1), 1.0) AS span,
    coalesce((min(CASE WHEN tool_name IN ('Edit', 'Write') THEN seq END) - 1) / max(n), 1.0) AS zero_based,
    coalesce(min(CASE WHEN tool_name IN ('Edit', 'Write') THEN seq END) / max(n), 0.0) AS one_based,
    coalesce(min(CASE WHEN tool_name = 'Edit' THEN (seq - 1) / greatest(n - 1, 1) END), 1.0) AS edit_only FROM calls GROUP BY run_id""",
       dbl="span zero_based one_based edit_only")
def _w13(t):
    return t.calls.groupBy("run_id").agg(*[S.first_edit(v).alias(v) for v in ("span", "zero_based", "one_based", "edit_only")])


@query("w14_thirds_contrast", """SELECT r.stratum, r.success, CASE WHEN (seq - 1) / n < 1 / 3.0::DOUBLE THEN 'early' WHEN (seq - 1) / n < 2 / 3.0::DOUBLE THEN 'mid' ELSE 'late' END AS third,
    count(*) AS calls, avg(CASE WHEN coalesce(is_error, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS error_rate, avg(length(tool_target)) AS mean_chars
    FROM calls c JOIN call_runs r USING (run_id) GROUP BY ALL""", dbl="error_rate mean_chars", lng="calls success")
def _w14(t):
    rows = t.calls.join(t.call_runs, "run_id")
    err = F.coalesce("is_error", F.lit(False)).cast("double")
    return rows.groupBy("stratum", "success", T.trajectory_third("seq", "n").alias("third")).agg(
        F.count(F.lit(1)).alias("calls"), F.avg(err).alias("error_rate"), F.avg(F.length("tool_target")).alias("mean_chars"))


@query("w15_half_split_gain", f"""WITH b AS (SELECT run_id, text, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS i, count(*) OVER (PARTITION BY run_id) AS m
        FROM turns WHERE role <> 'system'),
    d AS (SELECT run_id, coalesce(sum(CASE WHEN i > m // 2 THEN {B.hits(B.ascii_of('text'), '\\bthe\\b')} END)::DOUBLE / nullif(sum(CASE WHEN i > m // 2 THEN length(text) END), 0) * 1000, 0)
        - coalesce(sum(CASE WHEN i <= m // 2 THEN {B.hits(B.ascii_of('text'), '\\bthe\\b')} END)::DOUBLE / nullif(sum(CASE WHEN i <= m // 2 THEN length(text) END), 0) * 1000, 0) AS gain,
        coalesce(sum(CASE WHEN i > m // 2 THEN {B.hits('text', ',')} END)::DOUBLE / nullif(sum(CASE WHEN i > m // 2 THEN length(text) END), 0) * 1000, 0)
        - coalesce(sum(CASE WHEN i <= m // 2 THEN {B.hits('text', ',')} END)::DOUBLE / nullif(sum(CASE WHEN i <= m // 2 THEN length(text) END), 0) * 1000, 0) AS correction_gain FROM b GROUP BY run_id)
    SELECT run_id, gain, gain - correction_gain AS progressive FROM d""", dbl="gain progressive")
def _w15(t):
    from ..operators.skew import positions
    from ..operators.thinking import half_gain
    turns = t.conversations.where("role <> 'system'").select(F.col("conv_id").alias("run_id"), "turn", "text")
    blocks = positions(turns, "run_id", F.col("turn"), ["turn"])
    out = blocks.groupBy("run_id").agg(half_gain([r"\bthe\b"]).alias("gain"), half_gain([","]).alias("c"))
    return out.select("run_id", "gain", (F.col("gain") - F.col("c")).alias("progressive"))


# -- rollups ------------------------------------------------------------------------------


def text_calls(t):
    """Conversation calls with the lexical columns of a call."""
    return attributed(t).select(
        "run_id", "seq", "tool_name", "tool_target",
        T.token_count("reasoning_text").alias("delib"), T.substring_density("reasoning_text", B.COMMON_PARTS).alias("hedging"),
        T.pattern_hits("reasoning_text", B.COMMON_PATTERNS).alias("alts"), "reasoning_text")


_CALLTXT = f"""SELECT run_id, seq, {B.ntok("coalesce(reasoning_text, '')")} AS delib, {B.per_tok(B.sub_hits("coalesce(reasoning_text, '')", B.COMMON_PARTS), "coalesce(reasoning_text, '')")} AS hedging,
    {B.hits_all(B.ascii_of("coalesce(reasoning_text, '')"), B.COMMON_PATTERNS)} AS alts, reasoning_text, tool_name, file_path FROM attributed"""
B.CTES["calltxt"] = _CALLTXT


@query("a1_sum_max_rollup", """SELECT run_id, sum(hedging) AS hedging_sum, sum(delib) AS delib_sum, sum(alts) AS alts_sum, max(hedging) AS hedging_max, max(delib) AS delib_max,
    count_if(delib > 0) AS calls_with_reasoning FROM calltxt GROUP BY run_id""", dbl="hedging_sum delib_sum alts_sum hedging_max delib_max", lng="calls_with_reasoning")
def _a1(t):
    return R.sum_max_rollup(text_calls(t), ["hedging", "delib", "alts"], ["hedging", "delib"], "delib")


@query("a2_mean_rollup", """SELECT run_id, coalesce(avg(CASE WHEN reasoning_text IS NOT NULL THEN hedging END), 0) AS hedging,
    coalesce(avg(CASE WHEN delib > 100 THEN delib END), 0) AS delib FROM calltxt GROUP BY run_id""", dbl="hedging delib")
def _a2(t):
    c = text_calls(t).select("run_id", F.when(F.col("reasoning_text").isNotNull(), F.col("hedging")).alias("hedging"),
                             F.when(F.col("delib") > 100, F.col("delib")).alias("delib"))
    return R.mean_rollup(c, ["hedging", "delib"])


_EDIT = "tool_name IN ('Edit', 'Write')"


@query("a3_structural_features", f"""SELECT run_id, count(DISTINCT CASE WHEN {_EDIT} THEN tool_target END) AS files,
    count_if({_EDIT}) / greatest(count(DISTINCT CASE WHEN {_EDIT} THEN tool_target END), 1) AS churn,
    count_if({_EDIT}) / greatest(count(DISTINCT CASE WHEN {_EDIT} THEN tool_target END), 1) AS churn_all,
    count_if(tool_name = 'Bash' AND contains(tool_target, 'test')) AS test_runs, count(*) AS n_calls FROM calls GROUP BY run_id""",
       dbl="churn churn_all", lng="files test_runs n_calls")
def _a3(t):
    return t.calls.groupBy("run_id").agg(
        S.unique_files().alias("files"), S.edit_churn().alias("churn"), S.edit_churn(True).alias("churn_all"),
        F.count_if(T.is_test_command("tool_name", "tool_target", "substring")).alias("test_runs"), F.count(F.lit(1)).alias("n_calls"))


def _mean(expr, blank="NULL"):
    return f"avg(CASE WHEN length(tx) > 0 THEN {expr} ELSE {blank} END)"


_PARTS = {**{k: P.SUBSTRINGS[k] for k in P.SUBSTRINGS}, "causal_density": ["the", "la"], "tentative_density": ["on", "er"]}


_LEXICON = [*P.HEDGE_WORDS, "the", "and", "der", "que"]


def _edge(tx: str, words: list[str], phrases: list[str]) -> str:
    bare = f"list_transform({B.toks(f'lower({tx})')}, lambda x: trim(x, '.,;:!?()'))"
    return B.per_tok(f"(len(list_filter({bare}, lambda x: x IN {B.in_list(words)})) + {B.sub_hits(tx, phrases)})", tx)


@query("a4_run_feature_frame", f"""WITH c AS (SELECT *, coalesce(reasoning_text, '') AS tx, tool_target AS tg FROM attributed),
    res AS (SELECT t.run_id, t.seq, coalesce(u.len % 5 = 0, false) AS err FROM takers t LEFT JOIN good u ON u.run_id = t.run_id AND u.role = 'user' AND u.line_no = t.line_no + 1),
    m AS (SELECT c.run_id, c.seq, c.n, c.tool_name, c.tg, r.err, lead(r.err) OVER w AS next_err, lead(c.tool_name) OVER w AS next_tool,
        CASE WHEN r.err THEN c.seq - coalesce(max(CASE WHEN NOT r.err THEN c.seq END) OVER (w ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END AS error_run
        FROM c JOIN res r USING (run_id, seq) WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
    shape AS (SELECT run_id, count(*) AS n_calls, max(error_run) AS fail_streak_max,
        avg(CASE WHEN seq <= greatest(1, n // 3) THEN CASE WHEN err THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS early_error_rate,
        coalesce((min(CASE WHEN {_EDIT} THEN seq END) - 1) / greatest(max(n) - 1, 1), 1.0) AS first_edit_position,
        count(DISTINCT CASE WHEN {_EDIT} THEN tg END) AS unique_files_touched,
        count_if({_EDIT}) / greatest(count(DISTINCT CASE WHEN {_EDIT} THEN tg END), 1) AS edit_churn_rate,
        count(*) FILTER (WHERE err AND NOT next_err) / nullif(count_if(err), 0) AS recovery_rate,
        count(*) FILTER (WHERE err AND next_tool <> tool_name) / nullif(count_if(err), 0) AS fail_then_switch_rate,
        count_if(tool_name = 'Bash' AND contains(tg, 'test')) AS test_run_count FROM m GROUP BY run_id),
    lex AS (SELECT run_id, avg({B.per_tok(f"len(list_filter({B.toks('lower(tx)')}, lambda x: x IN {B.in_list(_LEXICON)}))", 'tx')}) AS hedging_score,
        avg({B.ntok('tx')}) AS deliberation_length, avg({B.hits_all(B.ascii_of('tx'), P.BACKTRACKS)}) AS backtrack_count,
        avg({_edge('tx', P.VERIFICATION_WORDS, P.VERIFICATION_PHRASES)}) AS verification_score, avg({_edge('tx', P.PLANNING_WORDS, P.PLANNING_PHRASES)}) AS planning_score,
        {", ".join(f"{_mean(B.per_tok(B.sub_hits('tx', v), 'tx'))} AS {k}" for k, v in _PARTS.items())},
        {_mean(B.per_tok(B.hits_all(B.ascii_of('tx'), P.NAMING_LOOSE, ''), 'tx'))} AS precision_naming_score,
        avg(CASE WHEN {_EDIT} THEN CASE WHEN contains(tx, split_part(tg, '/', -1)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS reasoning_to_action_alignment FROM c GROUP BY run_id)
    SELECT d.run_id, d.success, coalesce(n_calls, 0) AS n_calls, fail_streak_max, early_error_rate, first_edit_position, unique_files_touched, edit_churn_rate,
        recovery_rate, fail_then_switch_rate, test_run_count, hedging_score, deliberation_length, backtrack_count, verification_score, planning_score, {", ".join(_PARTS)}, precision_naming_score, reasoning_to_action_alignment
    FROM call_runs d LEFT JOIN shape USING (run_id) LEFT JOIN lex USING (run_id)""",
       dbl="early_error_rate first_edit_position edit_churn_rate recovery_rate fail_then_switch_rate hedging_score deliberation_length backtrack_count verification_score planning_score precision_naming_score reasoning_to_action_alignment " + " ".join(_PARTS),
       lng="success n_calls fail_streak_max unique_files_touched test_run_count")
def _a4(t):
    from ..operators import attribution as A
    calls = A.attach_results(attributed(t), t.blocks)
    return R.run_features(t.call_runs, calls, parts=_PARTS, lexicon=_LEXICON).drop("task_id", "stratum")


_ALT = r"\b(?:the|and|la|die)\b"


@query("a5_layer_features", f"""WITH x AS (SELECT conv_id AS run_id, role AS layer, text FROM conversations WHERE role <> 'system' AND text <> ''),
    f AS (SELECT run_id, layer, avg(CASE WHEN length(text) >= 10 THEN {B.hits('lower(' + B.ascii_of('text') + ')', _ALT, '')} / greatest({B.ntok('text')}, 1) ELSE 0.0::DOUBLE END) AS d,
        avg({B.ntok('text')}) AS tk, count(*) AS bl, sum(length(text)) AS ch FROM x GROUP BY ALL)
    SELECT c.run_id, coalesce(u.d, 0) AS message_common, coalesce(u.tk, 0) AS message_token_count, coalesce(u.bl, 0) AS message_blocks, coalesce(u.ch, 0) AS message_chars,
        coalesce(a.d, 0) AS thinking_common, coalesce(a.tk, 0) AS thinking_token_count, coalesce(a.bl, 0) AS thinking_blocks, coalesce(a.ch, 0) AS thinking_chars
    FROM (SELECT DISTINCT conv_id AS run_id FROM conversations) c LEFT JOIN f u ON u.run_id = c.run_id AND u.layer = 'user' LEFT JOIN f a ON a.run_id = c.run_id AND a.layer = 'assistant'""",
       dbl="message_common message_token_count thinking_common thinking_token_count", lng="message_blocks message_chars thinking_blocks thinking_chars")
def _a5(t):
    c = t.conversations.select(
        F.col("conv_id").alias("run_id"), F.when(F.col("role") == "assistant", F.col("text")).alias("th"),
        F.when(F.col("role") == "user", F.col("text")).alias("ms"))
    return R.layer_features(c, {"thinking": "th", "message": "ms"}, {"common": _ALT})


@query("a6_outcome_summary", """SELECT stratum, model, count(*) AS runs, count_if(success = 1) AS passes, count_if(success = 0) AS fails, count(DISTINCT task_id) AS tasks,
    avg(success) AS pass_rate FROM runs GROUP BY ROLLUP (stratum, model)""", dbl="pass_rate", lng="runs passes fails tasks")
def _a6(t):
    return R.outcome_summary(t.runs, ["stratum", "model"])


@query("a7_coverage", """SELECT count(*) AS calls, count_if(delib > 0) AS with_reasoning, count_if(hedging > 0) AS with_hedging FROM calltxt""", lng="calls with_reasoning with_hedging")
def _a7(t):
    return text_calls(t).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("delib") > 0).alias("with_reasoning"),
                             F.count_if(F.col("hedging") > 0).alias("with_hedging"))


LONG_IDS = ["run_id", "task_id", "stratum", "model", "success", "toxic", "wave"]
LONG_FEATURES = ["f_chars", "f_tokens", "f_common", "f_commas", "f_parts"]


def long(t):
    return C.to_long(t.features, LONG_IDS, LONG_FEATURES)


@query("a8_describe", "SELECT feature, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS min_x, max(x) AS max_x FROM long GROUP BY feature", dbl="mean sd min_x max_x", lng="n")
def _a8(t):
    return R.describe(long(t))


@query("a9_bin_distribution", """SELECT CASE WHEN seq <= 3 THEN 'early' WHEN seq <= 7 THEN 'mid' ELSE 'late' END AS bin, count(*) AS calls, count_if(success = 1) AS correct, count_if(success = 0) AS incorrect,
    avg(value) AS mean_value, avg(CASE WHEN n > 1 THEN (seq - 1) / (n - 1) ELSE 0 END) AS mean_step FROM calls JOIN call_runs USING (run_id) GROUP BY 1""",
       dbl="mean_value mean_step", lng="calls correct incorrect")
def _a9(t):
    return t.calls.join(t.call_runs, "run_id").groupBy(T.trajectory_bin("seq").alias("bin")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("success") == 1).alias("correct"), F.count_if(F.col("success") == 0).alias("incorrect"),
        F.avg("value").alias("mean_value"), F.avg(S.step_index("seq", "n")).alias("mean_step"))


@query("a11_condition_outcomes", "SELECT condition, count(DISTINCT task_id) AS tasks, sum(success) AS successes, avg(success) AS rate, avg(n_chars) AS mean_seconds FROM runs GROUP BY condition",
       dbl="rate mean_seconds", lng="tasks successes")
def _a11(t):
    return t.runs.groupBy("condition").agg(F.count_distinct("task_id").alias("tasks"), F.sum("success").alias("successes"),
                                           F.avg("success").alias("rate"), F.avg("n_chars").alias("mean_seconds"))


@query("a12_median_thresholds", f"""SELECT coalesce(CAST(floor(quantile_cont(CASE WHEN {B.ntok('text')} > 0 THEN {B.ntok('text')} END, 0.5)) AS BIGINT), 29) AS token_threshold,
    coalesce(CAST(floor(quantile_cont(CASE WHEN length(text) > 0 THEN length(text) END, 0.5)) AS BIGINT), 117) AS char_threshold FROM runs WHERE success = 1""")
def _a12(t):
    from ..operators.gates import median_thresholds
    rows = t.runs.where("success = 1").select(T.token_count("text").alias("tokens"), F.length("text").alias("chars"))
    return median_thresholds(rows, "tokens", "chars")


@query("a13_cluster_mean", "WITH c AS (SELECT task_id, avg(f_common) AS m FROM features GROUP BY task_id) SELECT count(*) AS clusters, avg(m) AS mean, stddev_samp(m) AS sd, stddev_samp(m) / sqrt(count(*)) AS se FROM c",
       dbl="mean sd se", lng="clusters")
def _a13(t):
    return R.cluster_mean(t.features, "task_id", "f_common")


# -- run selection ------------------------------------------------------------------------


@query("r1_latest_run", "SELECT task_id, max(run_id) AS run_id, arg_max(success, run_id) AS success FROM runs GROUP BY task_id", lng="success")
def _r1(t):
    return tables.latest(t.runs.select("task_id", "run_id", "success"), "task_id", ["run_id"])


@query("r2_latest_by_column", "SELECT task_id, arg_max(success, run_id) FILTER (success IS NOT NULL) AS success, arg_max(n_chars, run_id) FILTER (toxic = 1) AS last_toxic_chars FROM runs GROUP BY task_id",
       lng="success last_toxic_chars")
def _r2(t):
    newest = lambda c, ok: F.max_by(c, F.when(ok, F.col("run_id")))
    out = t.runs.groupBy("task_id").agg(newest("success", F.col("success").isNotNull()).alias("success"),
                                        F.max_by(F.when(F.col("toxic") == 1, F.col("n_chars")), F.when(F.col("toxic") == 1, F.col("run_id"))).alias("last_toxic_chars"))
    return out


@query("r3_majority_vote", "SELECT task_id, model, avg(success) AS rate, CASE WHEN avg(success) > 0.5 THEN 1 WHEN avg(success) < 0.5 THEN 0 ELSE 1 END AS vote FROM runs GROUP BY task_id, model",
       dbl="rate", lng="vote")
def _r3(t):
    return R.majority(t.runs, ["task_id", "model"], tie=1)


_TASKS = "SELECT DISTINCT source || '__' || lang AS task_id FROM documents"


@query("r4_next_batch", f"""SELECT d.task_id, CASE WHEN s.n IS NULL THEN 0 WHEN passes > 0 AND fails > 0 THEN 1 ELSE 2 END AS tier, coalesce(s.n, 0) AS n
    FROM ({_TASKS}) d LEFT JOIN (SELECT task_id, count(*) AS n, count_if(success = 1) AS passes, count_if(success = 0) AS fails FROM runs GROUP BY task_id) s USING (task_id)
    ORDER BY tier, n, task_id LIMIT 25""", lng="tier n")
def _r4(t):
    tasks = t.documents.select(F.concat_ws("__", "source", "lang").alias("task_id")).distinct()
    return R.next_batch(tasks, t.runs, 25)


@query("r5_unrun_tasks", f"SELECT task_id FROM ({_TASKS}) d WHERE task_id NOT IN (SELECT task_id FROM runs WHERE wave = 0)")
def _r5(t):
    tasks = t.documents.select(F.concat_ws("__", "source", "lang").alias("task_id")).distinct()
    return tasks.join(t.runs.where("wave = 0"), "task_id", "left_anti")


@query("r6_mixed_tasks", "SELECT task_id FROM runs GROUP BY task_id HAVING min(success) <> max(success)")
def _r6(t):
    return R.mixed_tasks(t.runs)


# -- joins --------------------------------------------------------------------------------


@query("j1_calls_runs", "SELECT c.run_id, c.seq, c.tool_name, r.stratum, r.success FROM calls c JOIN call_runs r USING (run_id)", lng="seq success")
def _j1(t):
    return t.calls.join(t.call_runs, "run_id").select("run_id", "seq", "tool_name", "stratum", "success")


@query("j2_runs_left_features", "SELECT r.run_id, r.success, count(c.event_id) AS n_calls FROM call_runs r LEFT JOIN calls c USING (run_id) GROUP BY ALL", lng="success n_calls")
def _j2(t):
    counts = t.raw_calls.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_calls"))
    return t.call_runs.select("run_id", "success").join(counts, "run_id", "left").na.fill(0, ["n_calls"])


@query("j3_runs_without_calls", "SELECT run_id, task_id FROM call_runs WHERE run_id NOT IN (SELECT user_id FROM events)")
def _j3(t):
    return t.call_runs.join(t.raw_calls, "run_id", "left_anti").select("run_id", "task_id")


@query("j6_label_passes", """SELECT run_id, max(CASE WHEN pass = 1 THEN label END) AS pass1, max(CASE WHEN pass = 2 THEN label END) AS pass2,
    CASE WHEN max(CASE WHEN pass = 1 THEN label END) = max(CASE WHEN pass = 2 THEN label END) THEN max(label) WHEN max(CASE WHEN pass = 1 THEN label END) IS NOT NULL AND max(CASE WHEN pass = 2 THEN label END) IS NOT NULL THEN 'uncertain'
        ELSE max(CASE WHEN pass = 2 THEN label END) END AS final
    FROM (SELECT run_id, 1 AS pass, CASE success WHEN 1 THEN 'correct' ELSE 'incorrect' END AS label FROM runs WHERE n_chars % 3 <> 0
          UNION ALL SELECT run_id, 2, CASE toxic WHEN 0 THEN 'correct' ELSE 'incorrect' END FROM runs WHERE n_chars % 5 <> 0) GROUP BY run_id""")
def _j6(t):
    from ..operators.gates import label_view
    word = lambda c: F.when(c, "correct").otherwise("incorrect")
    one = t.runs.where("n_chars % 3 <> 0").select("run_id", F.lit(1).alias("pass"), word(F.col("success") == 1).alias("label"))
    two = t.runs.where("n_chars % 5 <> 0").select("run_id", F.lit(2).alias("pass"), word(F.col("toxic") == 0).alias("label"))
    return label_view(one.unionByName(two), "run_id")


@query("j7_calls_critic_labels", """SELECT CASE WHEN c.seq <= 3 THEN 'early' WHEN c.seq <= 7 THEN 'mid' ELSE 'late' END AS bin, CASE c.k % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'disagree' END AS agreement,
    count(*) AS n, count_if(r.success = 0) AS n_incorrect FROM calls c JOIN call_runs r USING (run_id) GROUP BY ALL""", lng="n n_incorrect")
def _j7(t):
    from ..operators.gates import agreement_table
    critic = t.raw_calls.select("event_id", F.element_at(F.array(F.lit("full"), F.lit("partial"), F.lit("disagree")), (F.pmod("k", F.lit(3)) + 1).cast("int")).alias("agreement"))
    labels = t.call_runs.select("run_id", F.when(F.col("success") == 1, "correct").otherwise("incorrect").alias("label"))
    return agreement_table(t.calls.select("run_id", "event_id", "seq"), critic, labels)


@query("j8_matched_tasks", """SELECT run_id, stratum, model FROM runs WHERE model IN ('en', 'fr') AND stratum IN (
    SELECT stratum FROM runs WHERE model = 'en' INTERSECT SELECT stratum FROM runs WHERE model = 'fr' AND toxic = 1)""")
def _j8(t):
    both = t.runs.where("model = 'en'").select("stratum").intersect(t.runs.where("model = 'fr' AND toxic = 1").select("stratum"))
    return t.runs.where("model in ('en', 'fr')").join(both, "stratum", "left_semi").select("run_id", "stratum", "model")


@query("j10_task_list", "SELECT run_id, task_id FROM runs WHERE task_id IN (SELECT task_id FROM runs WHERE toxic = 1)")
def _j10(t):
    wanted = t.runs.where("toxic = 1").select("task_id").distinct()
    return t.runs.join(wanted, "task_id", "left_semi").select("run_id", "task_id")


@query("j11_evaluated_union", "SELECT task_id FROM runs WHERE success = 1 UNION SELECT task_id FROM runs WHERE success = 0 AND toxic = 1")
def _j11(t):
    return t.runs.where("success = 1").select("task_id").union(t.runs.where("success = 0 AND toxic = 1").select("task_id")).distinct()
