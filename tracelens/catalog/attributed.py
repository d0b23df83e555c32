"""Ingestion and attribution queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators import attribution as A
from ..operators import sequence as S
from ..session import materialize, shared_dir
from ..sources import tables, traces
from . import bind as B
from .registry import query


def attributed(t):
    """Calls of the conversation traces with reasoning, stored as the calls table that later steps read."""
    if "_attributed" not in t.__dict__:
        t.__dict__["_attributed"] = materialize(A.with_reasoning(A.attribute(t.blocks)))
    return t.__dict__["_attributed"]


@query("d1_ndjson_scan", "SELECT run_id, count(*) AS total, count_if(NOT broken) AS events, count_if(broken) AS dropped FROM turns GROUP BY run_id", lng="total events dropped")
def _d1(t):
    return traces.drop_report(t.lines)


def _folder(t) -> str:
    """A new folder in shared storage."""
    return f"{shared_dir(t.spark)}/query-{uuid.uuid4().hex}"


@query("d1_read_files", "SELECT run_id, count(*) AS total, count_if(NOT broken) AS events, count_if(broken) AS dropped FROM turns GROUP BY run_id", lng="run_id total events dropped")
def _d1b(t):
    """The same from files, one per run, in two folders."""
    path = _folder(t)
    traces.write_lines(t.lines.withColumn("half", F.pmod("run_id", F.lit(2))), path, "half")
    report = traces.drop_report(traces.read_lines(t.spark, path))
    return report.select(F.nullif(F.regexp_extract("run_id", r"run_id=(-?\d+)", 1), F.lit("")).alias("run_id"), "total", "events", "dropped")


_BLOCKS = """SELECT run_id, line_no, 0 AS block_pos, 'thinking' AS kind, text, NULL AS tool_name FROM good WHERE role = 'assistant'
    UNION ALL SELECT run_id, line_no, 1, 'tool_use', NULL, tool_name FROM tools
    UNION ALL SELECT run_id, line_no, 2, 'text', 'after ' || line_no, NULL FROM tools
    UNION ALL SELECT run_id, line_no, 0, 'tool_result', text, NULL FROM good WHERE role = 'user'"""


@query("d2_block_explode", _BLOCKS, lng="block_pos")
def _d2(t):
    return t.blocks.select("run_id", "line_no", "block_pos", "kind", "text", "tool_name")


@query("d3_conform_append", """SELECT CAST(run_id AS VARCHAR) AS run_id, task_id, stratum, CASE WHEN wave = 0 THEN model END AS model,
    CAST(wave AS INTEGER) AS wave, CAST(NULL AS VARCHAR) AS error FROM runs""")
def _d3(t):
    old = t.runs.where("wave = 0")
    new = t.runs.where("wave = 1").drop("model")
    return schemas.append(old, new, schemas.RUNS).select("run_id", "task_id", "stratum", "model", "wave", "error")


@query("d4_reparse_counts", """SELECT run_id, count_if(k < 90) AS before, count(*) AS after, count_if(k < 90) <> count(*) AS changed FROM calls GROUP BY run_id""", lng="before after")
def _d4(t):
    return tables.count_changes(t.raw_calls.where("k < 90"), t.raw_calls)


@query("d5_backfill", """WITH dirty AS (SELECT DISTINCT run_id FROM calls WHERE k = 13)
    SELECT run_id, seq, CASE WHEN run_id IN (SELECT run_id FROM dirty) THEN (seq - 1) / nullif(n - 1, 0) ELSE -1 END AS step FROM calls""", dbl="step", lng="seq")
def _d5(t):
    stored = t.calls.select("run_id", "seq", "n", F.when(F.col("k") != 13, F.lit(-1.0)).alias("step"))
    redo = lambda rows: rows.withColumn("step", S.step_index("seq", "n"))
    return tables.backfill(stored, ["step"], redo).select("run_id", "seq", "step")


@query("d6_run_counters", """SELECT g.run_id, nullif(sum(CASE WHEN role = 'assistant' THEN len + line_no ELSE 0 END), 0) AS total_tokens,
    count_if(role = 'assistant' AND kind <> 0) AS total_tool_calls,
    count_if(role = 'assistant' AND (kind = 2 OR (kind = 3 AND changes))) AS total_state_modifying_calls FROM good g GROUP BY g.run_id""",
       lng="total_tokens total_tool_calls total_state_modifying_calls")
def _d6(t):
    return traces.run_counters(t.lines)


def second_dialect(t):
    """The same conversations in the second dialect, one item per turn."""
    c = t.conversations.withColumn("len", F.length("text")).withColumn("kind", F.pmod("len", F.lit(4)))
    cmd = F.element_at(F.array(*[F.lit(x) for x in B.COMMANDS]), (F.pmod("len", F.lit(len(B.COMMANDS))) + 1).cast("int"))
    said = lambda kind: F.struct(F.lit(kind).alias("type"), F.col("text").alias("text"))
    ran = F.struct(F.lit("command_execution").alias("type"), F.concat(F.lit("/bin/bash -lc '"), cmd, F.lit("'")).alias("command"),
                   F.lit("out").alias("aggregated_output"), F.pmod("len", F.lit(2)).alias("exit_code"))
    event = lambda state, item: F.to_json(F.struct(F.lit(state).alias("type"), item.alias("item")))
    used = F.to_json(F.struct(F.lit("turn.completed").alias("type"), F.struct(
        F.col("len").alias("input_tokens"), F.col("turn").alias("output_tokens")).alias("usage")))
    done, begun = "item.completed", "item.started"
    line = (
        F.when(F.col("role") == "system", event(done, said("reasoning")))
        .when(F.col("role") == "user", event(done, said("agent_message")))
        .when(F.pmod("len", F.lit(9)) == 0, used)
        .when(F.col("kind") == 0, event(done, said("reasoning")))
        .when(F.col("kind") == 1, event(begun, said("agent_message")))
        .when(F.col("kind") == 2, event(done, ran)).otherwise(event(done, ran)))
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("line_no"), line.alias("line"))


@query("d7_second_dialect", """SELECT run_id, coalesce(sum(CASE WHEN role = 'assistant' AND len % 9 = 0 THEN len + line_no END), 0) AS total_tokens,
    count_if(role = 'assistant' AND len % 9 <> 0 AND kind >= 2) AS total_tool_calls,
    count_if(role = 'assistant' AND len % 9 <> 0 AND kind >= 2 AND changes) AS total_state_modifying_calls,
    count_if(role = 'system' OR (role = 'assistant' AND len % 9 <> 0 AND kind = 0)) > 0 AS has_reasoning FROM turns GROUP BY run_id""",
       lng="total_tokens total_tool_calls total_state_modifying_calls")
def _d7(t):
    return traces.command_counters(second_dialect(t))


@query("d8_manifest_union", """WITH a AS (SELECT 't' || doc_id AS task_id, source AS origin FROM documents WHERE doc_id % 2 = 0),
    b AS (SELECT 't' || item_id AS task_id, 'benchmark' AS origin FROM benchmark)
    SELECT coalesce(a.task_id, b.task_id) AS task_id, coalesce(a.origin, b.origin) AS origin FROM a FULL JOIN b USING (task_id)""")
def _d8(t):
    first = t.documents.where("doc_id % 2 = 0").select(F.concat(F.lit("t"), F.col("doc_id")).alias("task_id"), F.col("source").alias("origin"))
    second = t.read("benchmark").select(F.concat(F.lit("t"), F.col("item_id")).alias("task_id"), F.lit("benchmark").alias("origin"))
    return tables.first_source_wins([first, second], "task_id")


@query("d8_read_manifest", """WITH a AS (SELECT 't' || doc_id AS task_id, source AS origin FROM documents WHERE doc_id % 2 = 0),
    b AS (SELECT 't' || item_id AS task_id, 'benchmark' AS origin FROM benchmark)
    SELECT coalesce(a.task_id, b.task_id) AS task_id, coalesce(a.origin, b.origin) AS origin FROM a FULL JOIN b USING (task_id)""")
def _d8b(t):
    """The same union from JSON-lines files."""
    path = _folder(t)
    t.documents.where("doc_id % 2 = 0").select(F.concat(F.lit("t"), F.col("doc_id")).alias("task_id"), F.col("source").alias("origin")).write.json(f"{path}/a")
    t.read("benchmark").select(F.concat(F.lit("t"), F.col("item_id")).alias("task_id"), F.lit("benchmark").alias("origin")).write.json(f"{path}/b")
    return tables.read_manifest(t.spark, [f"{path}/a", f"{path}/b"], "task_id string, origin string")


@query("d9_markdown", """WITH s AS (SELECT stratum, count(*) AS n, CAST(sum(success) AS BIGINT) AS passes FROM runs GROUP BY stratum)
    SELECT '| stratum | n | passes |' AS line UNION ALL SELECT '| --- | --- | --- |' UNION ALL SELECT '| ' || stratum || ' | ' || n || ' | ' || passes || ' |' FROM s""")
def _d9b(t):
    return tables.markdown(t.runs.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("success").alias("passes"))).select("line")


@query("d9_export", "SELECT stratum, count(*) AS n, sum(success) AS passes FROM runs GROUP BY stratum", lng="n passes")
def _d9(t):
    """Written as JSON lines and read back."""
    out = t.runs.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("success").alias("passes"))
    path = _folder(t)
    tables.export(out, path + "/rows", "json")
    return t.spark.read.schema("stratum string, n bigint, passes bigint").json(path + "/rows")


@query("d10_merge_outcomes", """WITH latest AS (SELECT task_id, max(run_id) AS last_run FROM runs GROUP BY task_id),
    first_run AS (SELECT task_id, min(run_id) AS mapped FROM runs WHERE model = 'en' GROUP BY task_id),
    goal AS (SELECT coalesce(f.mapped, l.last_run) AS run_id, CASE WHEN l.task_id LIKE 'src1%' THEN 1 ELSE 0 END AS v FROM latest l LEFT JOIN first_run f USING (task_id))
    SELECT r.run_id, coalesce(g.v, r.success) AS success FROM runs r LEFT JOIN goal g USING (run_id)""", lng="success")
def _d10(t):
    tasks = t.runs.select("task_id").distinct()
    good = F.col("task_id").startswith("src1")
    run_map = t.runs.where("model = 'en'").groupBy("task_id").agg(F.min("run_id").alias("run_id"))
    out = tables.merge_outcomes(t.runs.select("run_id", "task_id", "success"), tasks.where(good), tasks.where(~good), run_map, ["run_id"])
    return out.select("run_id", "success")


@query("d11_fetch_calls", """SELECT c.run_id, c.seq, r.task_id, c.tool_name FROM calls c JOIN call_runs r USING (run_id)
    WHERE r.success IS NOT NULL AND r.task_id IN (SELECT task_id FROM call_runs WHERE success = 0)""", lng="seq")
def _d11(t):
    failing = t.call_runs.where("success = 0").select("task_id").distinct()
    out = tables.fetch_calls(t.calls, t.call_runs, F.col("success").isNotNull(), failing)
    return out.select("run_id", "seq", "task_id", "tool_name")


@query("w1_reasoning_attribution", "SELECT run_id, seq, tool_id, reasoning_text FROM attributed", lng="seq")
def _w1(t):
    return attributed(t).select("run_id", "seq", "tool_id", "reasoning_text")


@query("w2_dialect2_attribution", """WITH ev AS (SELECT *, CASE WHEN role = 'system' OR (role = 'assistant' AND len % 9 <> 0 AND kind = 0) THEN 'thinking'
        WHEN role = 'user' THEN 'text' WHEN role = 'assistant' AND len % 9 <> 0 AND kind >= 2 AND changes THEN 'take' END AS what FROM turns),
    k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS seq FROM ev WHERE what = 'take'),
    w AS (SELECT e.*, (SELECT min(k.line_no) FROM k WHERE k.run_id = e.run_id AND k.line_no > e.line_no) AS goal FROM ev e WHERE what IN ('thinking', 'text') AND text <> '')
    SELECT k.run_id, k.seq, k.len % 2 <> 0 AS failed, coalesce(
        (SELECT string_agg(text, chr(10) ORDER BY line_no) FROM w WHERE w.run_id = k.run_id AND goal = k.line_no AND what = 'thinking'),
        (SELECT string_agg(text, chr(10) ORDER BY line_no) FROM w WHERE w.run_id = k.run_id AND goal = k.line_no AND what = 'text')) AS reasoning_text FROM k""", lng="seq")
def _w2(t):
    calls = A.attribute(traces.command_blocks(second_dialect(t)), rule="stream")
    return A.with_reasoning(calls, layers=True).select("run_id", "seq", F.col("own_error").alias("failed"), "reasoning_text")


@query("w3_split_layers", """WITH txt AS (SELECT run_id, line_no, 0 AS pos, text, 'thinking' AS layer FROM good WHERE role = 'assistant' AND text <> ''
        UNION ALL SELECT run_id, line_no, 2, 'after ' || line_no, 'text' FROM tools),
    w AS (SELECT x.*, (SELECT min(o.line_no) FROM tools o WHERE o.run_id = x.run_id AND (o.line_no > x.line_no OR (o.line_no = x.line_no AND x.pos = 0))) AS goal FROM txt x),
    o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS seq FROM tools)
    SELECT o.run_id, o.seq, o.tool_name,
        (SELECT string_agg(text, chr(10) ORDER BY line_no, pos) FROM w WHERE w.run_id = o.run_id AND goal = o.line_no AND layer = 'thinking') AS thinking_text,
        (SELECT string_agg(text, chr(10) ORDER BY line_no, pos) FROM w WHERE w.run_id = o.run_id AND goal = o.line_no AND layer = 'text') AS message_text FROM o""", lng="seq")
def _w3(t):
    return A.attribute(t.blocks, rule="every").select("run_id", "seq", "tool_name", "thinking_text", "message_text")


_RESULTS = """SELECT t.run_id, t.seq, u.text AS result_text, u.len % 5 = 0 AS is_error FROM takers t
    LEFT JOIN good u ON u.run_id = t.run_id AND u.role = 'user' AND u.line_no = t.line_no + 1"""


@query("w4_result_attach", _RESULTS, lng="seq")
def _w4(t):
    return A.attach_results(attributed(t), t.blocks).select("run_id", "seq", "result_text", "is_error")


@query("w5_sequence_number", "SELECT run_id, tool_id, seq, n FROM takers", lng="seq n")
def _w5(t):
    return attributed(t).select("run_id", "tool_id", "seq", "n")


@query("l19_thinking_text", """SELECT run_id, string_agg(text, chr(10) ORDER BY line_no) AS thinking_text, count(*) AS n_thinking_blocks
    FROM good WHERE role = 'assistant' AND text <> '' GROUP BY run_id""", lng="n_thinking_blocks")
def _l19(t):
    return traces.thinking_text(t.lines)


@query("j5_tool_use_result", """SELECT t.run_id, t.tool_id, t.tool_name, u.len AS result_chars FROM tools t
    JOIN good u ON u.run_id = t.run_id AND u.role = 'user' AND u.line_no = t.line_no + 1""", lng="result_chars")
def _j5(t):
    use = t.blocks.where("kind = 'tool_use'").select("run_id", "tool_id", "tool_name")
    res = t.blocks.where("kind = 'tool_result'").select("run_id", "tool_id", F.length("text").alias("result_chars"))
    return use.join(res, ["run_id", "tool_id"])
