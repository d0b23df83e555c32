"""Gate replay, label and outcome audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as Q
from ..operators import gates as G
from . import bind as B
from .attributed import attributed
from .registry import query

LIMIT = 300


def history(t):
    """Attributed calls with a file path, and keys of the verdict log."""
    c = attributed(t)
    path = F.when(F.pmod("seq", F.lit(3)) == 0, F.lit("src/er")).otherwise(F.concat(F.lit("src/"), F.substring("reasoning_text", 5, 4)))
    h = c.withColumn("file_path", path).select(
        "run_id", "seq", "n", F.when(F.col("tool_name") == "Bash", "Write").otherwise("Edit").alias("tool_name"), "file_path", "reasoning_text")
    return h.withColumn("key", G.critic_key("file_path", F.col("run_id").cast("string"), F.col("seq").cast("string")))


def verdict_log(t):
    """Logged verdicts: by text length, some missing."""
    h = history(t)
    m = F.pmod(F.length("reasoning_text"), F.lit(4))
    return h.where(m < 3).select("key", F.when(m == 0, "reject").when(m == 1, "concern").otherwise("APPROVE").alias("verdict"))


def decisions(t):
    if "_decisions" not in t.__dict__:
        t.__dict__["_decisions"] = G.replay(history(t), verdict_log(t), LIMIT)
    return t.__dict__["_decisions"]


B.CTES["history"] = f"""SELECT *, length(trim(coalesce(reasoning_text, ''), ' ' || chr(10) || chr(9) || chr(13))) AS chars,
    CASE WHEN coalesce(trim(reasoning_text), '') = '' THEN false WHEN coalesce(file_path, '') = '' OR split_part(file_path, '/', -1) = '' THEN true
         ELSE contains(reasoning_text, split_part(file_path, '/', -1)) OR contains(reasoning_text, file_path) END AS ok_align
    FROM (SELECT run_id, seq, n, reasoning_text, CASE WHEN tool_name = 'Bash' THEN 'Write' ELSE 'Edit' END AS tool_name,
        CASE WHEN seq % 3 = 0 THEN 'src/er' ELSE 'src/' || substr(reasoning_text, 5, 4) END AS file_path,
        CASE WHEN length(reasoning_text) % 4 = 0 THEN 'block' WHEN length(reasoning_text) % 4 = 1 THEN 'concern' ELSE 'approve' END AS extro FROM attributed)"""
B.CTES["judged"] = f"""SELECT *, chars >= {LIMIT} AND chars > 0 AS ok_delib, CASE WHEN ok_align AND chars >= {LIMIT} AND chars > 0 THEN 'approve' ELSE 'block' END AS intro,
    n > 0 AND seq > greatest(1, n // 3) AS late FROM history"""
B.CTES["decisions"] = """SELECT c.condition, c.gate_type, c.gate_timing, run_id, seq,
    CASE WHEN c.gate_timing = 'early' AND late THEN 'approve' WHEN c.gate_type = 'introspective' THEN intro WHEN c.gate_type = 'extrospective' THEN extro
         WHEN intro = 'block' OR extro = 'block' THEN 'block' WHEN extro = 'concern' THEN 'concern' ELSE 'approve' END AS verdict,
    CASE WHEN NOT (c.gate_timing = 'early' AND late) AND c.gate_type <> 'extrospective' THEN CAST(ok_align AS INTEGER) END AS aligned, chars AS deliberation_length,
    CASE WHEN c.gate_timing = 'early' AND late THEN 'past cutoff' WHEN c.gate_type = 'extrospective' THEN 'critic ' || extro ELSE
        (CASE WHEN NOT ok_align AND NOT ok_delib THEN 'both' WHEN NOT ok_align THEN 'alignment' WHEN NOT ok_delib THEN 'deliberation' ELSE 'passed' END)
        || CASE WHEN c.gate_type = 'both' AND extro = 'block' THEN '+critic' ELSE '' END END AS reason
    FROM judged, (VALUES ('A1', 'early', 'introspective'), ('A2', 'early', 'extrospective'), ('A3', 'early', 'both'),
        ('B1', 'always', 'introspective'), ('B2', 'always', 'extrospective'), ('B3', 'always', 'both')) c(condition, gate_timing, gate_type)"""


def conf_sql(source: str, keys: str, blocked: str, failed: str) -> str:
    p, r = "coalesce(tp / nullif(tp + fp, 0), 0)", "coalesce(tp / nullif(tp + fn, 0), 0)"
    return f"""SELECT *, {p} AS precision, {r} AS recall, coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0) AS f1, coalesce((tp + fp) / nullif(total, 0), 0) AS block_rate FROM (
        SELECT {keys + ', ' if keys else ''}count(*) AS total, count(*) FILTER (WHERE {blocked} AND {failed}) AS tp, count(*) FILTER (WHERE {blocked} AND NOT {failed}) AS fp,
        count(*) FILTER (WHERE NOT {blocked} AND {failed}) AS fn, count(*) FILTER (WHERE NOT {blocked} AND NOT {failed}) AS tn FROM {source} {'GROUP BY ' + keys if keys else ''})"""


B.CTES["scored"] = "SELECT d.*, r.stratum, r.success, r.task_id FROM decisions d JOIN call_runs r USING (run_id)"
B.CTES["gate_metrics"] = conf_sql("scored", "condition", "verdict = 'block'", "success <> 1")
_CONF = dict(dbl="precision recall f1 block_rate", lng="total tp fp fn tn")


@query("g1_alignment_check", "SELECT run_id, seq, ok_align FROM history", lng="seq")
def _g1(t):
    return history(t).select("run_id", "seq", G.aligned("reasoning_text", "file_path").alias("ok_align"))


@query("g2_deliberation_check", "SELECT run_id, seq, ok_delib FROM judged", lng="seq")
def _g2(t):
    return history(t).select("run_id", "seq", G.deliberated("reasoning_text", LIMIT).alias("ok_delib"))


@query("g3_introspective_gate", "SELECT condition, run_id, seq, verdict, reason FROM decisions WHERE gate_type = 'introspective'", lng="seq")
def _g3(t):
    return decisions(t).where("gate_type = 'introspective'").select("condition", "run_id", "seq", "verdict", "reason")


@query("g4_verdict_log_gate", "SELECT run_id, seq, extro AS verdict, substr(sha256(coalesce(file_path, '') || run_id || seq), 1, 16) AS key FROM history", lng="seq")
def _g4(t):
    joined = history(t).join(verdict_log(t), "key", "left")
    return joined.select("run_id", "seq", G.external("verdict").alias("verdict"), "key")


@query("g5_combined_gate", "SELECT run_id, seq, verdict, reason FROM decisions WHERE condition = 'B3'", lng="seq")
def _g5(t):
    return decisions(t).where("condition = 'B3'").select("run_id", "seq", "verdict", "reason")


@query("g6_condition_map", """SELECT c.condition, c.gate_timing, c.gate_type, count(d.run_id) AS decisions FROM (VALUES ('C0', 'none', 'none'), ('A1', 'early', 'introspective'), ('A2', 'early', 'extrospective'), ('A3', 'early', 'both'),
    ('B1', 'always', 'introspective'), ('B2', 'always', 'extrospective'), ('B3', 'always', 'both'), ('P1', 'none', 'none'), ('P2', 'none', 'none')) c(condition, gate_timing, gate_type) LEFT JOIN decisions d USING (condition) GROUP BY ALL""", lng="decisions")
def _g6(t):
    counts = decisions(t).groupBy("condition").agg(F.count(F.lit(1)).alias("decisions"))
    return G.conditions(t.spark).join(counts, "condition", "left").na.fill(0, ["decisions"])


@query("g7_replay_history", "SELECT * FROM decisions", lng="seq aligned deliberation_length")
def _g7(t):
    return decisions(t)


@query("g8_gate_metrics", "SELECT * FROM gate_metrics", **_CONF)
def _g8(t):
    return G.gate_metrics(decisions(t), t.call_runs)


@query("g9_run_gate_metrics", conf_sql("(SELECT condition, stratum, run_id, success, bool_or(verdict = 'block') AS blocked FROM scored GROUP BY ALL)", "condition, stratum", "blocked", "success <> 1"), **_CONF)
def _g9(t):
    return G.run_gate_metrics(decisions(t), t.call_runs, ["condition", "stratum"])


@query("g9_block_reasons", "SELECT condition, reason, count(*) AS n FROM decisions WHERE verdict = 'block' GROUP BY ALL", lng="n")
def _g9b(t):
    return decisions(t).where("verdict = 'block'").groupBy("condition", "reason").agg(F.count(F.lit(1)).alias("n"))


_CONTRASTS = [*[(f"{x}{i} over base", f"{x}{i}", "") for x in "AB" for i in (1, 2, 3)], *[(f"A{i} minus B{i}", f"A{i}", f"B{i}") for i in (1, 2, 3)],
              *[(f"{x}{i} minus {x}{j}", f"{x}{i}", f"{x}{j}") for x in "AB" for i, j in ((3, 1), (3, 2), (2, 1))]]


@query("g10_condition_comparison", f"""SELECT n.contrast, CASE WHEN n.b = '' THEN x.precision - (SELECT avg(1.0::DOUBLE - success) FROM call_runs) ELSE x.f1 - y.f1 END AS difference
    FROM (VALUES {', '.join(map(str, _CONTRASTS))}) n(contrast, a, b) LEFT JOIN gate_metrics x ON x.condition = n.a LEFT JOIN gate_metrics y ON y.condition = n.b""", dbl="difference")
def _g10(t):
    base = t.call_runs.agg(F.avg(1 - F.col("success").cast("double")).alias("base"))
    return G.compare_conditions(G.gate_metrics(decisions(t), t.call_runs), base)


_VERDICTS = "CASE WHEN doc_id % 5 = 0 THEN 'reject' WHEN doc_id % 5 = 1 THEN 'concern' ELSE 'approve' END"


@query("g11_verdict_retro", conf_sql(f"(SELECT {_VERDICTS} AS v, quality FROM labels)", "", "v = 'reject'", "quality <> 1"), **_CONF)
def _g11(t):
    v = t.read("labels").withColumn("v", F.expr(_VERDICTS))
    return G.confusion(v, [], F.col("v") == "reject", F.col("quality") != 1)


@query("g12_label_reconcile", """SELECT run_id, CASE WHEN m IN ('machine_correct', 'machine_incorrect') THEN replace(m, 'machine_', '') WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN CASE WHEN p1 = p2 THEN p2 ELSE 'uncertain' END ELSE coalesce(p2, p1) END AS final
    FROM (SELECT run_id, CASE n_chars % 4 WHEN 0 THEN 'machine_correct' WHEN 1 THEN 'machine_unclear' END AS m, CASE WHEN n_chars % 3 > 0 THEN CASE success WHEN 1 THEN 'correct' ELSE 'incorrect' END END AS p1,
        CASE WHEN n_chars % 5 > 0 THEN CASE toxic WHEN 0 THEN 'correct' ELSE 'incorrect' END END AS p2 FROM runs)""")
def _g12(t):
    word = lambda c: F.when(c, "correct").otherwise("incorrect")
    m = F.when(F.pmod("n_chars", F.lit(4)) == 0, "machine_correct").when(F.pmod("n_chars", F.lit(4)) == 1, "machine_unclear")
    p1 = F.when(F.pmod("n_chars", F.lit(3)) > 0, word(F.col("success") == 1))
    p2 = F.when(F.pmod("n_chars", F.lit(5)) > 0, word(F.col("toxic") == 0))
    return t.runs.select("run_id", G.reconcile(m, p1, p2).alias("final"))


@query("g13_intra_rater_kappa", """WITH s AS (SELECT source, count(*) AS n, avg(CASE WHEN quality = 1 - toxic THEN 1.0::DOUBLE ELSE 0 END) AS po, avg(quality) * avg(1 - toxic) + (1 - avg(quality)) * avg(toxic) AS pe
    FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT source AS stratum, n, po AS agreement, CASE WHEN abs(1 - pe) < 1e-12 THEN NULL ELSE (po - pe) / (1 - pe) END AS kappa FROM s""", dbl="agreement kappa", lng="n")
def _g13(t):
    return G.kappa(t.runs.withColumn("other", 1 - F.col("toxic")), ["stratum"], "success", "other")


@query("g14_directional_consistency", """WITH w AS (SELECT task_id, avg(success) FILTER (condition = 'ungated') AS u, avg(success) FILTER (condition = 'always') AS g FROM runs GROUP BY task_id)
    SELECT count(*) AS tasks, avg(CASE WHEN g >= u THEN 1.0::DOUBLE ELSE 0 END) AS consistency FROM w WHERE u IS NOT NULL AND g IS NOT NULL""", dbl="consistency", lng="tasks")
def _g14(t):
    from ..plans.evaluate import directional_consistency
    return directional_consistency(t.runs, "ungated", "always")


@query("g15_pass_k", "SELECT task_id, condition, count(*) AS n, pow(avg(success), 3) AS pass_k FROM runs GROUP BY ALL", dbl="pass_k", lng="n")
def _g15(t):
    from ..plans.evaluate import pass_k
    return pass_k(t.runs, ["task_id", "condition"], 3)


@query("g16_go_no_go", """WITH v AS (SELECT (SELECT precision FROM gate_metrics WHERE condition = 'B1') AS precision, (SELECT count(*) FROM calls) AS calls, (SELECT avg(1.0::DOUBLE - success) FROM call_runs) AS base)
    SELECT unnest(['precision', 'calls', 'base_rate']) AS check, unnest([precision, calls::DOUBLE, base]) AS value,
    unnest([CASE WHEN precision >= 0.6 THEN 'go' WHEN precision < 0.1 THEN 'kill' ELSE 'revise' END, CASE WHEN calls >= 50 THEN 'go' WHEN calls < 10 THEN 'kill' ELSE 'revise' END, CASE WHEN base >= 0.1 THEN 'go' WHEN base < 0.05 THEN 'kill' ELSE 'revise' END]) AS decision FROM v""", dbl="value")
def _g16(t):
    m = G.gate_metrics(decisions(t), t.call_runs).where("condition = 'B1'").agg(F.max("precision").alias("precision"))
    n = t.raw_calls.agg(F.count(F.lit(1)).alias("calls"))
    b = t.call_runs.agg(F.avg(1 - F.col("success").cast("double")).alias("base"))
    one = m.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(b))  # one row each
    return G.go_no_go(one, [("precision", "precision", 0.6, 0.1), ("calls", "calls", 50, 10), ("base_rate", "base", 0.1, 0.05)])


@query("a10_verdict_distribution", "SELECT gate_type, gate_timing, verdict, success, count(*) AS n FROM scored GROUP BY ALL", lng="success n")
def _a10(t):
    return decisions(t).join(t.call_runs, "run_id").groupBy("gate_type", "gate_timing", "verdict", "success").agg(F.count(F.lit(1)).alias("n"))


@query("j4_decisions_runs", "SELECT condition, run_id, seq, verdict, success FROM scored WHERE gate_type = 'both' AND gate_timing = 'early'", lng="seq success")
def _j4(t):
    wanted = G.conditions(t.spark).where("gate_type = 'both' and gate_timing = 'early'").select("condition")
    return decisions(t).join(F.broadcast(wanted), "condition").join(t.call_runs, "run_id").select("condition", "run_id", "seq", "verdict", "success")


# -- outcome audit ------------------------------------------------------------------------

B.CTES["executions"] = """SELECT t.run_id, t.line_no, t.command, u.len % 5 = 0 AS is_error, u.text AS output FROM tools t
    JOIN good u ON u.run_id = t.run_id AND u.role = 'user' AND u.line_no = t.line_no + 1 WHERE t.tool_name = 'Bash' AND contains(t.command, 'pytest')"""


_P, _F = "length(output) % 9", "length(output) % 4"


@query("q1_test_executions", f"""SELECT run_id, command, is_error, CASE length(output) % 3 WHEN 0 THEN {_P} WHEN 1 THEN greatest({_P} - {_F}, 0) ELSE 0 END AS passed,
    CASE length(output) % 3 WHEN 0 THEN {_F} WHEN 1 THEN {_F} ELSE 0 END AS failed FROM executions""", lng="passed failed")
def _q1(t):
    """Outputs that end in the summary of one runner, of another, or in none."""
    n = F.length("text")
    p, f = (F.pmod(n, F.lit(m)).cast("string") for m in (9, 4))
    tail = F.when(F.pmod(n, F.lit(3)) == 0, F.concat(F.lit("\n== "), p, F.lit(" passed, "), f, F.lit(" failed in 0.1s =="))).when(
        F.pmod(n, F.lit(3)) == 1, F.concat(F.lit("\nRan "), p, F.lit(" tests in 0.1s\n\nFAILED (failures="), f, F.lit(")"))).otherwise("\nno summary")
    printed = t.blocks.withColumn("text", F.when(F.col("kind") == "tool_result", F.concat("text", tail)).otherwise(F.col("text")))
    return Q.test_executions(printed).select("run_id", "command", "is_error", "passed", "failed")


def _event_executions(t):
    """Bash events as test executions with printed counts."""
    from .texts import _output
    runs = t.raw_calls.where("tool_name = 'Bash'").select(
        "run_id", F.col("event_id").alias("line_no"), F.lit(0).alias("block_pos"),
        F.concat(F.lit("pytest tests/m"), F.col("k").cast("string"), F.lit(".py")).alias("command"),
        _output(F.col("k")).alias("output"), (F.pmod("k", F.lit(7)) == 0).alias("is_error"))
    passed, failed = T.test_counts("output")
    return runs.withColumn("passed", passed).withColumn("failed", failed)


B.CTES["xref"] = """SELECT *, CASE WHEN passed > 0 AND failed = 0 AND NOT is_error THEN 'pass' WHEN failed > 0 OR is_error THEN 'fail' ELSE 'unclear' END AS verdict FROM (
    SELECT run_id, event_id, k, k % 7 = 0 AS is_error, CASE k % 6 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN greatest(0, k - (k % 5) - 1) WHEN 3 THEN greatest(0, k - 1) WHEN 4 THEN k ELSE 0 END AS passed,
    CASE k % 6 WHEN 0 THEN k % 4 WHEN 2 THEN k % 5 + 1 WHEN 3 THEN 1 ELSE 0 END AS failed,
    CASE WHEN contains('pytest tests/m' || k || '.py', 'm' || (run_id % 50) || '.py') THEN 1 ELSE 0 END AS hits FROM calls WHERE tool_name = 'Bash')
    JOIN (SELECT run_id, bool_or(contains('pytest tests/m' || k || '.py', 'm' || (run_id % 50) || '.py')) AS hit FROM calls WHERE tool_name = 'Bash' GROUP BY run_id) USING (run_id)
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN hit AND hits = 0 THEN 1 ELSE 0 END, CASE WHEN hit THEN event_id ELSE -event_id END) = 1"""


def _xref(t):
    target = F.array(F.concat(F.lit("m"), F.pmod("run_id", F.lit(50)).cast("string"), F.lit(".py")))
    ex = _event_executions(t)
    every = ex.select("run_id").unionByName(t.call_runs.select("run_id")).distinct()
    return Q.cross_reference(ex, every.select("run_id", target.alias("targets")))


@query("q2_cross_reference", """SELECT run_id, passed, failed, hits, coalesce(verdict, 'no_tests') AS verdict, CASE WHEN verdict IS NULL THEN 'none' WHEN verdict = 'unclear' THEN 'low' WHEN hits > 0 THEN 'high' ELSE 'medium' END AS confidence
    FROM xref FULL JOIN (SELECT DISTINCT run_id FROM call_runs) USING (run_id)""", lng="passed failed hits")
def _q2(t):
    return _xref(t).select("run_id", "passed", "failed", "hits", "verdict", "confidence")


@query("q5_label_changes", """SELECT success AS old, CASE WHEN run_id % 3 = 0 THEN success WHEN verdict = 'pass' THEN 1 WHEN verdict = 'fail' THEN 0 ELSE success END AS new, count(*) AS runs
    FROM call_runs LEFT JOIN xref USING (run_id) GROUP BY ALL""", lng="old new runs")
def _q5(t):
    runs = t.call_runs.withColumn("validation_source", F.when(F.pmod("run_id", F.lit(3)) == 0, "checked"))
    return Q.label_changes(Q.relabel(runs, _xref(t)))


@query("q3_edit_log", "SELECT run_id, line_no, 1 AS block_pos, tool_name, regexp_replace(file_path, '^/tmp/workspace_x/', '') AS path, true AS ok FROM tools WHERE tool_name = 'Edit'", lng="block_pos")
def _q3(t):
    return Q.edit_log(t.blocks).select("run_id", "line_no", "block_pos", "tool_name", "path", "ok")


@query("q4_edit_replay", """SELECT * FROM (WITH RECURSIVE e AS (SELECT run_id, 'm' || (k % 3) || '.py' AS path, tool_name, 'start ' || k AS content, substr(k::VARCHAR, 1, 1) AS old,
        row_number() OVER (PARTITION BY run_id, k % 3 ORDER BY event_id) AS i FROM calls WHERE tool_name IN ('Edit', 'Write')),
    r AS (SELECT DISTINCT e.run_id, e.path, 0::BIGINT AS i, CASE WHEN e.path = 'm1.py' THEN d.text END AS t, 0::BIGINT AS applied, 0::BIGINT AS failed FROM e LEFT JOIN documents d ON d.doc_id = e.run_id
        UNION ALL SELECT r.run_id, r.path, e.i, CASE WHEN e.tool_name = 'Write' THEN e.content WHEN contains(r.t, e.old) THEN substr(r.t, 1, instr(r.t, e.old) - 1) || '9' || substr(r.t, instr(r.t, e.old) + 1) ELSE r.t END,
            r.applied + CASE WHEN e.tool_name = 'Write' OR coalesce(contains(r.t, e.old), false) THEN 1 ELSE 0 END, r.failed + CASE WHEN e.tool_name = 'Write' OR coalesce(contains(r.t, e.old), false) THEN 0 ELSE 1 END
        FROM r JOIN e ON e.run_id = r.run_id AND e.path = r.path AND e.i = r.i + 1)
    SELECT run_id, path, md5(t) AS text_md5, applied, failed FROM r QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY i DESC) = 1)""", lng="applied failed")
def _q4(t):
    """Edits of event runs over files made of the labelled text: final texts and what was applied."""
    path = F.concat(F.lit("m"), F.pmod("k", F.lit(3)).cast("string"), F.lit(".py"))
    edits = t.raw_calls.where("tool_name in ('Edit', 'Write')").select(
        "run_id", F.col("event_id").alias("line_no"), F.lit(0).alias("block_pos"), "tool_name", path.alias("path"),
        F.concat(F.lit("start "), F.col("k").cast("string")).alias("content"), F.substring(F.col("k").cast("string"), 1, 1).alias("old"),
        F.lit("9").alias("new"), F.lit(True).alias("ok"))
    files = t.documents.select(F.col("doc_id").alias("run_id"), F.lit("m1.py").alias("path"), "text")
    return Q.replay_edits(edits, files).select("run_id", "path", F.md5("text").alias("text_md5"), "applied", "failed")


@query("q6_quality_checks", """SELECT 'runs_without_calls' AS issue, 'WARN' AS severity, count(*) FILTER (WHERE run_id NOT IN (SELECT user_id FROM events)) AS n FROM call_runs
    UNION ALL SELECT 'null_outcomes', 'INFO', count(*) FILTER (WHERE run_id % 40 = 0) FROM call_runs UNION ALL SELECT 'inverted_counts', 'ERROR', count(*) FILTER (WHERE run_id % 10 < run_id % 9) FROM call_runs
    UNION ALL SELECT 'null_features', 'WARN', count(*) FILTER (WHERE k = 5) FROM calls UNION ALL SELECT 'biased_first_step', 'WARN', count(*) FILTER (WHERE seq = 1 AND value / 1000 > 0.01) FROM calls""", lng="n")
def _q6(t):
    runs = t.call_runs.select("run_id", F.when(F.pmod("run_id", F.lit(40)) != 0, F.col("success")).alias("success"),
                              F.pmod("run_id", F.lit(10)).alias("total_tool_calls"), F.pmod("run_id", F.lit(9)).alias("total_state_modifying_calls"))
    calls = t.calls.select("run_id", "seq", F.when(F.col("k") != 5, F.lit(0.0)).alias("feature"), (F.col("value") / 1000).alias("step"))
    return Q.quality(runs, calls, "feature", "step")


@query("q7_anomalies", """WITH r AS (SELECT run_id, success, n_chars AS n_calls, n_chars % 100 AS wall_seconds FROM runs)
    SELECT count(*) FILTER (WHERE wall_seconds < 10 AND n_calls > 2000) AS fast_busy_runs, count(*) FILTER (WHERE n_calls > (SELECT quantile_cont(n_calls, 0.95) FROM r)) AS call_outliers,
    avg(success) FILTER (WHERE run_id <= (SELECT quantile_cont(run_id, 0.5) FROM r)) AS early_pass_rate, avg(success) FILTER (WHERE run_id > (SELECT quantile_cont(run_id, 0.5) FROM r)) AS late_pass_rate, 0 AS repeated_runs FROM r""",
       dbl="early_pass_rate late_pass_rate", lng="fast_busy_runs call_outliers repeated_runs")
def _q7(t):
    runs = t.runs.select("run_id", "success", F.col("n_chars").alias("n_calls"), F.pmod("n_chars", F.lit(100)).alias("wall_seconds"))
    return Q.anomalies(runs, 10, 2000, "run_id")


