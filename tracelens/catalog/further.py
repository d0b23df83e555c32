"""Thinking-text and further run feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import shell
from ..functions import text as T
from ..operators import extra as X
from ..operators import thinking as K
from ..plans import association as A
from ..plans import evaluate as V
from . import bind as B
from .registry import query
from .sequences import LONG_FEATURES, annotated
from .statistics import rho_sql, t_p, within

AT = B.ascii_of("text")
# Sentences, function-like words and clause starts that occur in the given texts.
COMPAT = r"[^.]*(?:compat|version|install|deprecated|removed|Python 3\.\d+)[^.]*\."
SENTENCE = r"[^.]*(?:tion|ung)[^.]*\."
WORDS = r"\b(?:the|und|de)\b"
START = r"(?:^|\n|(?<=\.\s))(?:The|La|Is)\b"


def _rate(pattern, flags="(?i)", t=AT):
    return f"coalesce({B.hits(t, pattern, flags)}::DOUBLE / nullif(length(text) / 1000.0::DOUBLE, 0), 0)"


def _share(pattern, t=AT):
    return f"coalesce(list_sum(list_transform(regexp_extract_all({t}, {B.q('(?i)' + pattern)}), lambda s: length(s)))::DOUBLE / nullif(length(text), 0), 0)"


@query("l20_thinking_first", f"""SELECT doc_id, {_share(SENTENCE)} AS sentence_share, {_share(WORDS)} AS word_share, {_share(COMPAT)} AS compat_fraction, {_rate(P.PIVOT)} AS pivots_per_kchar,
    {B.hits(AT, P.DEAD_END)} AS dead_end_count, {_rate(P.FUNC_REF, '')} AS func_refs_per_kchar, {_rate(P.CODE_STRUCTURE)} - {_share(P.ENVIRONMENT)} * 10 - {_rate(P.PIVOT)} * 2 AS focus_score,
    CASE WHEN strpos(lower(text), 'tion') > 0 THEN (strpos(lower(text), 'tion') - 1) / length(text) ELSE 1.0 END AS first_mention FROM documents""",
       dbl="sentence_share word_share compat_fraction pivots_per_kchar func_refs_per_kchar focus_score first_mention", lng="dead_end_count")
def _l20(t):
    f = K.first_round("text")
    return t.documents.select(
        "doc_id", K.sentence_share("text", "tion|ung").alias("sentence_share"), K.matched_share("text", WORDS).alias("word_share"),
        *[f[c].alias(c) for c in ("compat_fraction", "pivots_per_kchar", "dead_end_count", "func_refs_per_kchar", "focus_score")],
        K.first_mention("text", "tion").alias("first_mention"))


_STARTS = f"len(regexp_extract_all({AT}, '(^|\\n|\\.\\s)(The|La|Is)\\b'))"
_DASH = r"\w\s+[-–—|]\s+\w"


@query("l21_thinking_second", f"""SELECT doc_id, coalesce({_STARTS}::DOUBLE / nullif(length(text) / 1000.0::DOUBLE, 0), 0) AS starts_per_kchar, {_rate(_DASH, '', B.ascii_of("replace(replace(text, '–', '-'), '—', '-')"))} AS dash_density,
    {_rate(WORDS)} + CASE WHEN {B.hits(AT, '[a-z]+ing')} >= 3 THEN 1 ELSE 0 END AS confusion, {_rate(P.CODE_PATH)} AS code_path_density, {_rate(P.ERROR_QUOTE, '')} AS error_quote_density FROM documents""",
       dbl="starts_per_kchar dash_density confusion code_path_density error_quote_density")
def _l21(t):
    f = K.second_round("text")
    zero = F.lit(0.0)
    return t.documents.select(
        "doc_id", K.rate("text", START, "(?U)").alias("starts_per_kchar"), K.rate("text", _DASH, "(?U)").alias("dash_density"),
        K.confusion(K.rate("text", WORDS), zero, zero, K.count("text", "[a-z]+ing")).alias("confusion"),
        f["code_path_density"].alias("code_path_density"), f["error_quote_density"].alias("error_quote_density"))


# Reasoning that the phrases of the two rounds occur in, put behind the given texts.
_SAID = ["\nActually the issue is in `core.py` line 12. Wait, the problem is that run() calls start. Hmm no. Actually the issue is worse.",
         " This approach won't work. The fix is in lines 3. I need to fix pip and docker first.\nOh well, let me try another method of the class.",
         " From `a` to `b` the flow is clear; `ValueError raised` by `load` - not by `save`. I cannot find it in `x/y.py`. Instead, let me try a simpler way.",
         " That doesn't work. ImportError, not available. the issue is old. Ah. the problem is new. the issue is here - lines 4 and line 5.", " Nothing of it."]
B.CTES["said"] = "SELECT doc_id, text || ([" + ", ".join(B.q(s) for s in _SAID) + f"])[doc_id % {len(_SAID)} + 1] AS text FROM documents"
_BEGIN = "(?:^|\\n|\\.\\s)"
_ACT, _INT = (f"coalesce(len(regexp_extract_all({AT}, {B.q(_BEGIN + w)}))::DOUBLE / nullif(length(text) / 1000.0::DOUBLE, 0), 0)" for w in (r"Actually\b", r"(?:Actually|Wait|Hmm|Oh|Ah)\b"))


def said(t):
    return t.documents.select("doc_id", F.concat("text", F.element_at(F.array(*[F.lit(s) for s in _SAID]), (F.pmod("doc_id", F.lit(len(_SAID))) + 1).cast("int"))).alias("text"))


@query("l20_thinking_composites", f"""SELECT doc_id, {_share(P.ENVIRONMENT)} AS env_distraction_fraction, {B.hits(AT, P.PIVOT)} AS approach_pivots, {_rate(P.PIVOT)} AS pivots_per_kchar, {B.hits(AT, P.DEAD_END)} AS dead_end_count,
    {_rate(P.FUNC_REF, '')} AS func_refs_per_kchar, {_rate(P.CODE_STRUCTURE)} - {_share(P.ENVIRONMENT)} * 10 - {_rate(P.PIVOT)} * 2 AS focus_score,
    coalesce((least(nullif(strpos(lower(text), 'the fix'), 0), nullif(strpos(lower(text), 'i need to fix'), 0)) - 1) / length(text), 1.0) AS fix_mention_position FROM said""",
       dbl="env_distraction_fraction pivots_per_kchar func_refs_per_kchar focus_score fix_mention_position", lng="approach_pivots dead_end_count")
def _l20c(t):
    f = K.first_round("text")
    names = ("env_distraction_fraction", "approach_pivots", "pivots_per_kchar", "dead_end_count", "func_refs_per_kchar", "focus_score", "fix_mention_position")
    return said(t).select("doc_id", *[f[c].alias(c) for c in names])


@query("l21_thinking_composites", f"""SELECT *, precise AS diagnostic_precision, precise - confusion_score AS reasoning_clarity FROM (SELECT doc_id, {_ACT} AS actually_density, {_INT} AS interruption_rate,
    {_ACT} + {_INT} + {_rate(P.PIVOT)} + CASE WHEN {B.hits(AT, P.REDIAGNOSIS)} >= 3 THEN 1 ELSE 0 END AS confusion_score, {_rate(P.ERROR_QUOTE, '')} AS error_quote_density, {_rate(P.CODE_PATH)} AS code_path_density,
    ({_rate(P.FUNC_REF, '')} + {_rate(P.FILE_REF, '')} + {_rate(P.CODE_PATH)} + {_rate(P.LINE_REF)} + {_rate(P.BACKTICK_ID, '')}) / 5 AS precise FROM said)""",
       dbl="actually_density interruption_rate confusion_score error_quote_density code_path_density precise diagnostic_precision reasoning_clarity")
def _l21c(t):
    f = K.second_round("text")
    names = ("actually_density", "interruption_rate", "confusion_score", "error_quote_density", "code_path_density", "diagnostic_precision", "reasoning_clarity")
    return said(t).select("doc_id", *[f[c].alias(c) for c in names], f["diagnostic_precision"].alias("precise"))


@query("l21_narrative_fraction", "SELECT conv_id AS run_id, avg(CASE WHEN length(text) > 500 AND NOT contains(text, '```') THEN 1.0::DOUBLE ELSE 0 END) AS narrative_fraction FROM conversations GROUP BY conv_id", dbl="narrative_fraction")
def _l21b(t):
    return t.conversations.groupBy(F.col("conv_id").alias("run_id")).agg(K.narrative_fraction("text").alias("narrative_fraction"))


@query("e1_streaks", "SELECT run_id, max(success_run) AS longest_success_streak, avg(error_run) FILTER (WHERE err AND next_err = false) AS recovery_latency_mean FROM marked GROUP BY run_id", dbl="recovery_latency_mean", lng="longest_success_streak")
def _e1(t):
    return X.streaks(annotated(t))


@query("e2_phase_count", """WITH w AS (SELECT run_id, seq, list(tool_name) OVER (PARTITION BY run_id ORDER BY seq ROWS 4 PRECEDING) AS l FROM calls),
    d AS (SELECT run_id, seq, CASE WHEN len(list_filter(l, lambda x: x = 'Bash')) > 0.6 * len(l) THEN 'Bash' WHEN len(list_filter(l, lambda x: x = 'Read')) > 0.6 * len(l) THEN 'Read'
        WHEN len(list_filter(l, lambda x: x = 'Edit')) > 0.6 * len(l) THEN 'Edit' WHEN len(list_filter(l, lambda x: x = 'Write')) > 0.6 * len(l) THEN 'Write' ELSE 'mixed' END AS phase FROM w)
    SELECT run_id, count(*) FILTER (WHERE phase <> prev) + 1 AS phase_count FROM (SELECT *, lag(phase) OVER (PARTITION BY run_id ORDER BY seq) AS prev FROM d) GROUP BY run_id""", lng="phase_count")
def _e2(t):
    return X.phase_count(t.calls)


_MOD = f"(tool_name IN ('Edit', 'Write') OR (tool_name = 'Bash' AND {B._chg_list}[k % {len(B.COMMANDS)} + 1]))"


@query("e3_exploration", f"""WITH f AS (SELECT run_id, min(seq) FILTER (WHERE tool_name IN ('Edit', 'Write')) AS first FROM calls GROUP BY run_id)
    SELECT run_id, count(*) FILTER (WHERE NOT {_MOD} AND (first IS NULL OR seq < first)) / count(*) AS explore_before_act_ratio, count(*) / nullif(count(*) FILTER (WHERE {_MOD}), 0) AS read_to_write_ratio FROM calls JOIN f USING (run_id) GROUP BY run_id""",
       dbl="explore_before_act_ratio read_to_write_ratio")
def _e3(t):
    return X.exploration(t.calls, shell.modifies_state(F.col("tool_name"), F.col("tool_target")))


@query("e4_edit_shape", """SELECT run_id, count(*) FILTER (WHERE e) / nullif(count(*) FILTER (WHERE tool_name = 'Bash'), 0) AS edit_to_bash_ratio, stddev_samp(CASE WHEN e THEN value END) / nullif(avg(CASE WHEN e THEN value END), 0) AS edit_size_cv,
    count(*) FILTER (WHERE e AND (seq - 1) / greatest(n - 1, 1) > 0.67::DOUBLE) / nullif(count(*) FILTER (WHERE e), 0) AS late_edit_fraction, avg(CASE WHEN e THEN value END) AS mean_edit_expansion FROM (SELECT *, tool_name IN ('Edit', 'Write') AS e FROM calls) GROUP BY run_id""",
       dbl="edit_to_bash_ratio edit_size_cv late_edit_fraction mean_edit_expansion")
def _e4(t):
    return X.edit_shape(t.calls, "value")


@query("e5_test_pass_rate", """WITH x AS (SELECT *, max(seq) OVER (PARTITION BY run_id) AS last FROM calls WHERE tool_name = 'Bash' AND (contains(tool_target, 'pytest') OR contains(tool_target, 'test_')))
    SELECT run_id, count(*) AS tests, avg(CASE WHEN coalesce(is_error, false) THEN 0.0::DOUBLE ELSE 1 END) AS test_pass_rate FROM x WHERE seq < last GROUP BY run_id""", dbl="test_pass_rate", lng="tests")
def _e5(t):
    return X.test_pass_rate(t.calls)


@query("e6_read_before_edit", """WITH x AS (SELECT *, max(CASE WHEN tool_name = 'Read' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS seen FROM calls)
    SELECT run_id, count(*) FILTER (WHERE tool_name IN ('Edit', 'Write') AND seen = 1) / nullif(count(*) FILTER (WHERE tool_name IN ('Edit', 'Write')), 0) AS grep_before_edit_rate FROM x GROUP BY run_id""", dbl="grep_before_edit_rate")
def _e6(t):
    return X.read_before_edit(t.calls)


@query("e7_command_complexity", f"SELECT run_id, avg({B.hits('tool_target', '&&|[|]|;', '')}) AS command_complexity FROM calls WHERE tool_name = 'Bash' GROUP BY run_id", dbl="command_complexity")
def _e7(t):
    return X.command_complexity(t.calls)


@query("e8_slopes", """WITH b AS (SELECT run_id, floor((seq - 1) * 5 / n) AS b, avg(CASE WHEN coalesce(is_error, false) THEN 1.0::DOUBLE ELSE 0 END) AS e FROM calls GROUP BY ALL),
    s AS (SELECT run_id, regr_slope(value, (seq - 1) / greatest(n - 1, 1)) AS v FROM calls GROUP BY run_id)
    SELECT run_id, CASE WHEN isfinite(regr_slope(e, b)) THEN regr_slope(e, b) END AS error_rate_slope, max(CASE WHEN isfinite(v) THEN v END) AS size_trend_slope FROM b JOIN s USING (run_id) GROUP BY run_id""",
       dbl="error_rate_slope size_trend_slope")
def _e8(t):
    return X.slopes(t.calls, "value")


@query("e8_density_slope", """WITH m AS (SELECT run_id, least(floor(coalesce((epoch_us(ts) - lo)::DOUBLE / nullif(hi - lo, 0), 0) * 5), 4) AS b FROM calls JOIN (SELECT run_id, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM calls GROUP BY run_id) USING (run_id))
    SELECT run_id, sum(b - 2) / 10.0::DOUBLE AS action_density_slope FROM m GROUP BY run_id""", dbl="action_density_slope")
def _e8b(t):
    return X.density_slope(t.calls, F.unix_micros(F.col("ts").cast("timestamp")))


@query("e9_entropy_shift", """WITH c AS (SELECT run_id, seq > n // 2 AS late, tool_name, count(*)::DOUBLE AS c FROM calls GROUP BY ALL), h AS (SELECT run_id, late, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM c GROUP BY ALL)
    SELECT run_id, coalesce(max(CASE WHEN late THEN h END), 0) - coalesce(max(CASE WHEN NOT late THEN h END), 0) AS tool_diversity_trajectory FROM h GROUP BY run_id""", dbl="tool_diversity_trajectory")
def _e9(t):
    return X.entropy_shift(t.calls)


_EXT = {**P.EXTENDED, "common": [r"\bthe (?:[a-z]+) is\b", r"\bit was\b", r"\bla\s+\w+"]}


@query("e10_extended_densities", "SELECT doc_id, " + ", ".join(f"{B.per_tok(B.hits_all(AT, v), 'text')} AS {k}" for k, v in _EXT.items()) + " FROM documents", dbl=" ".join(_EXT))
def _e10(t):
    return t.documents.select("doc_id", *[T.pattern_density("text", v).alias(k) for k, v in _EXT.items()])


@query("e11_corrections", f"""SELECT run_id, sum(CASE WHEN coalesce(tool_name <> prev_tool OR tool_target <> prev_target, true) THEN h ELSE 0 END) AS productive_corrections,
    sum(CASE WHEN coalesce(tool_name <> prev_tool OR tool_target <> prev_target, true) THEN 0 ELSE h END) AS unproductive_corrections FROM (SELECT *, {B.hits('tool_target', 'a|test')} AS h FROM marked) GROUP BY run_id""",
       lng="productive_corrections unproductive_corrections")
def _e11(t):
    return X.corrections(annotated(t), "tool_target", ["a|test"])


@query("e12_plan_match", f"""SELECT run_id, avg(CASE WHEN (tool_name = 'Bash' AND {B.hits('tool_target', '\\b(run|test|execute)\\b')} > 0) OR (tool_name = 'Edit' AND contains(tool_target, 'm')) THEN 1.0::DOUBLE ELSE 0 END) AS stated_plan_match_rate FROM calls GROUP BY run_id""", dbl="stated_plan_match_rate")
def _e12(t):
    return X.plan_match_rate(t.calls, "tool_target", {"Bash": X.VERBS["Bash"], "Edit": "m"})


B.CTES["nextok"] = "SELECT run_id, value AS x, CASE WHEN next_err THEN 0 ELSE 1 END AS y FROM marked WHERE next_err IS NOT NULL"


@query("e12_predicts_next_success", rho_sql("nextok", "run_id", y="y", floor=5), dbl="rho", lng="n")
def _e12b(t):
    rows = annotated(t).where("next_err is not null").select("run_id", F.col("value").alias("x"), (~F.col("next_err")).cast("int").alias("y"))
    return A.spearman(rows, ["run_id"], min_n=5)


@query("e12_length_ratio", "SELECT run_id, avg(value) FILTER (WHERE tool_name IN ('Edit', 'Write')) / nullif(avg(value) FILTER (WHERE tool_name NOT IN ('Edit', 'Write')), 0) AS reasoning_action_type_match FROM calls GROUP BY run_id", dbl="reasoning_action_type_match")
def _e12c(t):
    return X.length_ratio(t.calls, "value", P.WRITE_TOOLS)


_THIRD = "CASE WHEN (seq - 1) / n < 1 / 3.0::DOUBLE THEN 'early' WHEN (seq - 1) / n < 2 / 3.0::DOUBLE THEN 'mid' ELSE 'late' END"


@query("e13_diagnose_implement_verify", f"""WITH c AS (SELECT run_id, {_THIRD} AS third, CASE WHEN tool_name IN ('Edit', 'Write') THEN 'edit' WHEN tool_name = 'Bash' THEN 'bash' ELSE 'read' END AS kind, count(*) AS c FROM calls GROUP BY ALL),
    p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY run_id, third ORDER BY c DESC, kind DESC) = 1)
    SELECT run_id, sum(CASE WHEN (third = 'early' AND kind <> 'edit') OR (third = 'mid' AND kind = 'edit') OR (third = 'late' AND kind = 'bash') THEN 1 ELSE 0 END) / 3 AS div_score FROM p GROUP BY run_id""", dbl="div_score")
def _e13(t):
    return X.diagnose_implement_verify(t.calls)


_ERR = "CASE WHEN coalesce(is_error, false) THEN 1.0::DOUBLE ELSE 0 END"


@query("e14_third_error_rates", f"""WITH r AS (SELECT run_id, avg({_ERR}) FILTER (WHERE {_THIRD} = 'early') AS early, avg({_ERR}) FILTER (WHERE {_THIRD} = 'mid') AS mid, avg({_ERR}) FILTER (WHERE {_THIRD} = 'late') AS late,
    avg({_ERR}) FILTER (WHERE seq <= greatest(1, n // 4)) AS first_quarter, avg({_ERR}) FILTER (WHERE seq <= greatest(1, n // 3)) AS first_third, avg({_ERR}) FILTER (WHERE seq <= greatest(1, n // 2)) AS first_half FROM calls GROUP BY run_id)
    SELECT *, mid - (early + late) / 2 AS mid_error_spike FROM r""", dbl="early mid late first_quarter first_third first_half mid_error_spike")
def _e14(t):
    return X.third_error_rates(t.calls)


@query("e15_transitions", "SELECT run_id, a, b, c / sum(c) OVER (PARTITION BY run_id) AS share FROM (SELECT run_id, tool_name AS a, next_tool AS b, count(*) AS c FROM marked WHERE next_tool IS NOT NULL GROUP BY run_id, tool_name, next_tool)", dbl="share")
def _e15(t):
    return X.transitions(annotated(t))


@query("e15_pacing", "SELECT run_id, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::DOUBLE / count(*) AS seconds_per_call FROM calls GROUP BY run_id", dbl="seconds_per_call")
def _e15b(t):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.raw_calls.groupBy("run_id").agg(((F.max(at) - F.min(at)) / F.lit(1e6) / F.count(F.lit(1))).alias("seconds_per_call"))


@query("e16_error_categories", f"""SELECT run_id, count(*) FILTER (WHERE e AND i) AS infrastructure_errors, count(*) FILTER (WHERE e AND NOT i) AS substantive_errors, avg(CASE WHEN e AND NOT i THEN 1.0::DOUBLE ELSE 0 END) AS substantive_error_rate
    FROM (SELECT run_id, coalesce(is_error, false) AS e, contains(tool_target, 'pytest') AS i FROM calls) GROUP BY run_id""", dbl="substantive_error_rate", lng="infrastructure_errors substantive_errors")
def _e16(t):
    return X.substantive_error_rate(t.calls, "tool_target", "pytest")


@query("e17_discriminative_words", f"""WITH w AS (SELECT success, unnest(list_distinct({B.toks('lower(text)')})) AS word FROM runs), n AS (SELECT count(*) FILTER (WHERE success = 1) AS p, count(*) FILTER (WHERE success = 0) AS f FROM runs)
    SELECT *, {t_p('rho', 'n')} AS p FROM (SELECT word, a AS pass_docs, b AS fail_docs, (a / p) / nullif(b / f, 0) AS ratio, p + f AS n,
        (a * (f - b) - b * (p - a)) / nullif(sqrt(((a + b) * (p + f - a - b))::DOUBLE) * sqrt((p * f)::DOUBLE), 0) AS rho
        FROM (SELECT word, count(*) FILTER (WHERE success = 1) AS a, count(*) FILTER (WHERE success = 0) AS b FROM w GROUP BY word HAVING count(*) FILTER (WHERE success IN (0, 1)) >= 1), n)""", dbl="ratio rho p", lng="pass_docs fail_docs n")
def _e17(t):
    """Every word, with its association; words of equal counts share one tail."""
    words = X.discriminative_words(t.runs, "text", "success", 1)
    tails = A.with_pvalue(words.select("pass_docs", "fail_docs", "n", "rho").distinct()).select("pass_docs", "fail_docs", "p")
    return words.join(tails, ["pass_docs", "fail_docs"])


@query("e18_holm_blocks", """SELECT stratum, feature, p, max(step) OVER (PARTITION BY stratum ORDER BY p, feature ROWS UNBOUNDED PRECEDING) AS p_holm, least(p * count(*) OVER (PARTITION BY feature), 1) AS p_block FROM (
    SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY stratum) - row_number() OVER (PARTITION BY stratum ORDER BY p, feature) + 1)) AS step FROM (SELECT * REPLACE (round(p, 9) AS p) FROM within WHERE p IS NOT NULL))""", dbl="p p_holm p_block")
def _e18(t):
    rows = within(t).where("p is not null").withColumn("p", F.round("p", 9))
    out = A.bonferroni(A.holm(rows, "feature", family=["stratum"]), family=["feature"], out="p_block")
    return out.select("stratum", "feature", "p", "p_holm", "p_block")


def _vif_sql() -> str:
    """1 / (1 - R^2) of each feature on the others, taking the others out one after the other by partial correlation."""
    name = lambda a, b: "r_" + "_".join(sorted((a, b)))
    pairs = [(a, b) for i, a in enumerate(LONG_FEATURES) for b in LONG_FEATURES[i + 1:]]
    whole = " AND ".join(f"{f} IS NOT NULL" for f in LONG_FEATURES)
    base = f"SELECT {', '.join(f'CASE WHEN isnan(corr({a}, {b})) THEN 0 ELSE coalesce(corr({a}, {b}), 0) END AS {name(a, b)}' for a, b in pairs)} FROM features WHERE {whole}"
    out = []
    for f in LONG_FEATURES:
        rest, table = [x for x in LONG_FEATURES if x != f], f"(SELECT *, 1.0::DOUBLE AS left_over FROM ({base}))"
        while rest:
            z, rest = rest[0], rest[1:]
            own = [(a, b) for i, a in enumerate([f, *rest]) for b in [f, *rest][i + 1:]]
            step = [f"({name(a, b)} - {name(a, z)} * {name(b, z)}) / sqrt((1 - pow({name(a, z)}, 2)) * (1 - pow({name(b, z)}, 2))) AS {name(a, b)}" for a, b in own]
            table = f"(SELECT {', '.join([*step, f'left_over * (1 - pow({name(f, z)}, 2)) AS left_over'])} FROM {table})"
        out.append(f"SELECT '{f}' AS feature, 1 / left_over AS vif, 1 / left_over > 5 AS flagged FROM {table}")
    return " UNION ALL ".join(out)


@query("e19_variance_inflation", _vif_sql(), dbl="vif")
def _e19(t):
    return X.vif(t.features, LONG_FEATURES)


B.CTES["sized"] = "SELECT CASE WHEN f_tokens < 100 THEN 'short' WHEN f_tokens <= 400 THEN 'medium' ELSE 'long' END AS size, feature, x, success FROM long JOIN (SELECT run_id, f_tokens FROM features) USING (run_id)"


@query("e20_length_strata", f"""WITH r AS ({rho_sql('sized', 'size, feature', floor=5)}) SELECT *, coalesce(max(sign(rho)) OVER (PARTITION BY feature) <> min(sign(rho)) OVER (PARTITION BY feature), false) AS flips FROM r""", dbl="rho", lng="n")
def _e20(t):
    from .sequences import LONG_IDS
    f = t.features.withColumn("size", F.when(F.col("f_tokens") < 100, "short").when(F.col("f_tokens") <= 400, "medium").otherwise("long"))
    stats = A.spearman(A.to_long(f, [*LONG_IDS, "size"], LONG_FEATURES), ["size", "feature"], y="success", min_n=5)
    signs = A.Window.partitionBy("feature")
    return stats.withColumn("flips", F.coalesce(F.max(F.signum("rho")).over(signs) != F.min(F.signum("rho")).over(signs), F.lit(False)))


@query("e22_paired_conditions", """WITH s AS (SELECT model, avg(success) FILTER (WHERE condition = 'ungated') AS pu, avg(success) FILTER (WHERE condition = 'always') AS pg, count(*) FILTER (WHERE condition = 'ungated') AS nu, count(*) FILTER (WHERE condition = 'always') AS ng FROM runs GROUP BY model),
    e AS (SELECT *, sqrt(pg * (1 - pg) / nullif(ng, 0) + pu * (1 - pu) / nullif(nu, 0)) AS se FROM s) SELECT model, pg - pu AS difference, pg - pu - 1.959963984540054::DOUBLE * se AS low, pg - pu + 1.959963984540054::DOUBLE * se AS high FROM e""", dbl="difference low high")
def _e22(t):
    return V.paired_difference(t.runs, "model", "ungated", "always")


@query("e22_condition_costs", """WITH c AS (SELECT condition, quantile_cont(n_chars, 0.5) AS median_seconds, sum(n_chars) / nullif(sum(success), 0) AS tokens_per_solved, count(*) / nullif(sum(success), 0) AS calls_per_solved FROM runs GROUP BY condition)
    SELECT *, median_seconds / (SELECT median_seconds FROM c WHERE condition = 'ungated') - 1 AS overhead FROM c""", dbl="median_seconds tokens_per_solved calls_per_solved overhead")
def _e22b(t):
    return X.condition_costs(t.runs.withColumn("one", F.lit(1)), "ungated", "n_chars", "n_chars", "one")


