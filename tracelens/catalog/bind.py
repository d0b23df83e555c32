"""How the operators' inputs are made from the given tables, in Spark and in SQL.

Events become calls of a run, labelled documents become runs with outcomes, and
conversations become traces: each turn is written as a trace line and read back.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.skew import positions
from ..sources import traces


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A text table; one that comes in fewer files than there are cores is spread by its key."""
        df = self.read(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores, key) if len(df.inputFiles()) < cores else df

    @cached_property
    def documents(self) -> DataFrame:
        return self.spread("documents", "doc_id")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def conversations(self) -> DataFrame:
        return self.spread("conversations", "conv_id")

    @cached_property
    def runs(self) -> DataFrame:
        """Labelled documents as runs: stratum = source, model = language, success = quality."""
        d, l = self.documents, self.read("labels")
        return d.join(l, "doc_id").select(
            F.col("doc_id").alias("run_id"), F.concat_ws("__", "source", "lang").alias("task_id"),
            F.col("source").alias("stratum"), F.col("lang").alias("model"),
            F.col("quality").alias("success"), "toxic", "text", "n_chars",
            F.expr("CASE pmod(doc_id, 3) WHEN 0 THEN 'ungated' WHEN 1 THEN 'early' ELSE 'always' END").alias("condition"),
            F.pmod("doc_id", F.lit(2)).alias("wave"),
        )

    @cached_property
    def features(self) -> DataFrame:
        """Runs with five text features of the data's own vocabulary."""
        low = F.lower("text")
        return self.runs.select(
            "run_id", "task_id", "stratum", "model", "success", "toxic", "condition", "wave",
            F.col("n_chars").cast("double").alias("f_chars"),
            T.token_count("text").cast("double").alias("f_tokens"),
            T.lexicon_density("text", COMMON_WORDS).alias("f_common"),
            T.per_kilochar("text", COMMA).alias("f_commas"),
            T.substring_density("text", COMMON_PARTS).alias("f_parts"),
        )

    @cached_property
    def raw_calls(self) -> DataFrame:
        """Events as calls, before numbering."""
        k = F.get_json_object("props", "$.k").cast("long")
        tool = (
            F.when(F.col("event_type") == "purchase", "Edit").when(F.col("event_type") == "signup", "Write")
            .when(F.col("event_type") == "view", "Read").otherwise("Bash")
        )
        command = F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (F.pmod(k, F.lit(len(COMMANDS))) + 1).cast("int"))
        params = F.when(F.col("tool_name") == "Bash", F.to_json(F.struct(F.concat_ws(" ", "command", F.col("k").cast("string")).alias("command")))).otherwise(
            F.to_json(F.struct(F.concat(F.lit("src/m"), F.col("k").cast("string"), F.lit(".py")).alias("file_path"))))
        failed = F.col("event_type") == "error"
        record = F.when(F.pmod("k", F.lit(10)) != 0, F.to_json(F.struct(failed.alias("is_error"))))
        base = self.events.select(
            F.col("user_id").alias("run_id"), "ts", "event_id", "event_type", "value", k.alias("k"),
            tool.alias("tool_name"), command.alias("command"))
        return base.select(
            "run_id", "ts", "event_id", "value", "k", "tool_name", params.alias("params_json"), record.alias("result_json"))

    @cached_property
    def calls(self) -> DataFrame:
        placed = positions(self.raw_calls, "run_id", F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"])
        flag = F.get_json_object("result_json", "$.is_error").cast("boolean")
        return placed.withColumn("tool_target", T.target("params_json")).withColumn("is_error", flag)

    @cached_property
    def call_runs(self) -> DataFrame:
        """Outcomes of event runs: labels by the same number."""
        l = self.read("labels")
        return l.select(
            F.col("doc_id").alias("run_id"), F.concat(F.lit("g"), F.pmod("doc_id", F.lit(20))).alias("task_id"),
            F.concat(F.lit("s"), F.pmod("doc_id", F.lit(4))).alias("stratum"), F.col("quality").alias("success"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.trace_lines(self.conversations)

    @staticmethod
    def trace_lines(conversations: DataFrame) -> DataFrame:
        """Conversations as trace lines of the first dialect; every 11th text length gives a broken line."""
        c = conversations.withColumn("len", F.length("text")).withColumn("kind", F.pmod("len", F.lit(4)))
        ident = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("t"), turn)
        thinking = F.struct(F.lit("thinking").alias("type"), F.col("text").alias("thinking"))
        none = F.lit(None).cast("string")
        block = lambda **kw: F.struct(*[kw.get(k, none).alias(k) for k in ("type", "thinking", "text", "id", "name")],
                                      kw.get("input", F.lit(None).cast("struct<file_path:string,command:string>")).alias("input"))
        head = block(type=F.lit("thinking"), thinking=F.col("text"))
        tail = block(type=F.lit("text"), text=F.concat(F.lit("after "), F.col("turn").cast("string")))
        name = F.when(F.col("kind") == 1, "Read").when(F.col("kind") == 2, "Edit").otherwise("Bash")
        args = F.struct(
            F.when(F.col("kind") != 3, F.concat(F.lit("/tmp/workspace_x/src/m"), F.pmod("len", F.lit(5)).cast("string"), F.lit(".py"))).alias("file_path"),
            F.when(F.col("kind") == 3, F.element_at(F.array(*[F.lit(x) for x in COMMANDS]), (F.pmod("len", F.lit(len(COMMANDS))) + 1).cast("int"))).alias("command"))
        tool = block(type=F.lit("tool_use"), id=ident(F.col("turn")), name=name, input=args)
        spoken = F.when(F.col("kind") == 0, F.array(head)).otherwise(F.array(head, tool, tail))
        usage = F.struct(F.col("len").alias("input_tokens"), F.col("turn").alias("output_tokens"))
        assistant = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(spoken.alias("content")).alias("message"), usage.alias("usage")))
        result = F.struct(F.lit("tool_result").alias("type"), ident(F.col("turn") - 1).alias("tool_use_id"),
                          F.col("text").alias("content"), (F.pmod("len", F.lit(5)) == 0).alias("is_error"))
        user = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.array(result).alias("content")).alias("message")))
        system = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("init").alias("subtype")))
        line = F.when(F.col("role") == "assistant", assistant).when(F.col("role") == "user", user).otherwise(system)
        broken = F.pmod("len", F.lit(11)) == 0
        return c.select(
            F.col("conv_id").alias("run_id"), F.col("turn").alias("line_no"),
            F.when(broken, F.concat(F.lit("{"), line)).otherwise(line).alias("line"))

    @cached_property
    def blocks(self) -> DataFrame:
        return traces.blocks(self.lines)


# Words and patterns that occur in the given texts.
COMMON_WORDS = ["the", "and", "of", "to", "in", "de", "la", "und", "que"]
COMMON_PARTS = ["the", "on", "er"]
COMMON_PATTERNS = [r"\bthe\b", r"\band\b", r"\bof the\b", r"\bthe [a-z]+ing\b"]
COMMA = [","]
# Commands that calls made from events and conversations run.
COMMANDS = [
    "pytest tests/test_a.py", "ls -la", "rm -f x", "cat a | grep b", "sed -i s/a/b/ f", "git log", "echo hi > out", "find . -name x",
    "cd a && make test", "python -c 'print(1)'",
]
# Which of them change state.
COMMAND_CHANGES = [True, False, True, False, True, False, True, False, True, False]


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def ascii_of(t: str) -> str:
    """RE2 knows only ASCII word characters; the texts' other letters become a digit, also a word character."""
    return f"regexp_replace({t}, '[^\\x00-\\x7F]', '9', 'g')"


def hits(t: str, pattern: str, flags: str = "(?i)") -> str:
    return f"len(regexp_extract_all({t}, {q(flags + pattern)}))"


def hits_all(t: str, patterns: list[str], flags: str = "(?i)") -> str:
    return "(" + " + ".join(hits(t, p, flags) for p in patterns) + ")"


def toks(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '\\s+'), lambda x: x <> '')"


def ntok(t: str) -> str:
    return f"len({toks(t)})"


def per_tok(count: str, t: str) -> str:
    return f"coalesce({count} / nullif({ntok(t)}, 0), 0.0)"


def sub_hits(t: str, parts: list[str]) -> str:
    one = lambda p: f"((length(lower({t})) - length(replace(lower({t}), {q(p)}, ''))) // {len(p)})"
    return "(" + " + ".join(one(p) for p in parts) + ")"


def in_list(items: list[str]) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


_cmd_list = "[" + ", ".join(q(c) for c in COMMANDS) + "]"
_chg_list = "[" + ", ".join("true" if c else "false" for c in COMMAND_CHANGES) + "]"

CTES: dict[str, str] = {
    "runs": """SELECT doc_id AS run_id, source || '__' || lang AS task_id, source AS stratum, lang AS model,
        quality AS success, toxic, text, n_chars,
        CASE doc_id % 3 WHEN 0 THEN 'ungated' WHEN 1 THEN 'early' ELSE 'always' END AS condition, doc_id % 2 AS wave
        FROM documents JOIN labels USING (doc_id)""",
    "features": f"""SELECT run_id, task_id, stratum, model, success, toxic, condition, wave,
        CAST(n_chars AS DOUBLE) AS f_chars, CAST({ntok('text')} AS DOUBLE) AS f_tokens,
        {per_tok(f"len(list_filter({toks('lower(text)')}, lambda x: x IN {in_list(COMMON_WORDS)}))", 'text')} AS f_common,
        {hits('text', ',')} * 1000.0::DOUBLE / nullif(length(text), 0) AS f_commas,
        {per_tok(sub_hits('text', COMMON_PARTS), 'text')} AS f_parts
        FROM runs""",
    "long": """SELECT run_id, task_id, stratum, model, success, toxic, wave, 'f_chars' AS feature, f_chars AS x FROM features
        UNION ALL SELECT run_id, task_id, stratum, model, success, toxic, wave, 'f_tokens', f_tokens FROM features
        UNION ALL SELECT run_id, task_id, stratum, model, success, toxic, wave, 'f_common', f_common FROM features
        UNION ALL SELECT run_id, task_id, stratum, model, success, toxic, wave, 'f_commas', f_commas FROM features
        UNION ALL SELECT run_id, task_id, stratum, model, success, toxic, wave, 'f_parts', f_parts FROM features""",
    "calls": f"""SELECT *, CASE WHEN tool_name = 'Bash' THEN command || ' ' || k ELSE 'src/m' || k || '.py' END AS tool_target,
        CASE WHEN k % 10 <> 0 THEN failed END AS is_error,
        row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY run_id) AS n
        FROM (SELECT user_id AS run_id, ts, event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
            CASE event_type WHEN 'purchase' THEN 'Edit' WHEN 'signup' THEN 'Write' WHEN 'view' THEN 'Read' ELSE 'Bash' END AS tool_name,
            event_type = 'error' AS failed, {_cmd_list}[k % {len(COMMANDS)} + 1] AS command FROM events)""",
    "call_runs": """SELECT doc_id AS run_id, 'g' || (doc_id % 20) AS task_id, 's' || (doc_id % 4) AS stratum, quality AS success FROM labels""",
    "turns": f"""SELECT conv_id AS run_id, turn AS line_no, role, text, length(text) AS len, length(text) % 4 AS kind,
        length(text) % 11 = 0 AS broken, {_cmd_list}[length(text) % {len(COMMANDS)} + 1] AS command,
        {_chg_list}[length(text) % {len(COMMANDS)} + 1] AS changes FROM conversations""",
    "good": "SELECT * FROM turns WHERE NOT broken",
    "tools": """SELECT run_id, line_no, 'c' || run_id || 't' || line_no AS tool_id, len,
        CASE kind WHEN 1 THEN 'Read' WHEN 2 THEN 'Edit' ELSE 'Bash' END AS tool_name,
        CASE WHEN kind <> 3 THEN '/tmp/workspace_x/src/m' || (len % 5) || '.py' END AS file_path,
        CASE WHEN kind = 3 THEN command END AS command, kind = 2 OR (kind = 3 AND changes) AS takes, text AS own_text
        FROM good WHERE role = 'assistant' AND kind <> 0""",
    "takers": "SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS seq, count(*) OVER (PARTITION BY run_id) AS n FROM tools WHERE takes",
    "waiting": """SELECT g.run_id, g.line_no, g.text, (SELECT min(t.line_no) FROM takers t WHERE t.run_id = g.run_id AND t.line_no > g.line_no) AS goal
        FROM good g WHERE g.role = 'assistant' AND g.kind = 0 AND g.text <> ''""",
    "attributed": """SELECT t.run_id, t.seq, t.n, t.line_no, t.tool_id, t.tool_name, coalesce(t.file_path, t.command) AS tool_target, t.file_path,
        (SELECT string_agg(x.text, chr(10) ORDER BY x.line_no) FROM (
            SELECT w.line_no, w.text FROM waiting w WHERE w.run_id = t.run_id AND w.goal = t.line_no
            UNION ALL SELECT t.line_no, t.own_text WHERE t.own_text <> '') x) AS reasoning_text
        FROM takers t""",
}


def with_ctes(sql: str) -> str:
    """Put the bindings that a query names in front of it, those they need first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
