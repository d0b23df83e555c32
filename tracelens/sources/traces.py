"""Reading newline-delimited JSON traces of two dialects into one block layout."""

from __future__ import annotations

import os
import re
import uuid
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shell, text


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trace files, one run per file: (run_id, line_no, line).

    A run is named by its file's path below the fixed part of ``path`` (what precedes the first wildcard), without the
    extension, so files of one name in two folders are two runs. ``line_no`` grows along the file but
    has gaps; large files are still split over tasks.
    """
    raw = _listed(spark, path)
    root = re.split(r"[*?\[{]", re.sub(r"^[a-z0-9]+:/*", "/", path))[0]
    root = root if root.endswith("/") else root.rsplit("/", 1)[0] + "/" if root != re.sub(r"^[a-z0-9]+:/*", "/", path) else root + "/"
    file = F.col("_metadata.file_path")
    below = F.when(F.contains(file, F.lit(root)), F.substring(file, F.position(F.lit(root), file) + len(root), 1 << 20)).otherwise(F.element_at(F.split(file, "/"), -1))
    return raw.select(
        F.regexp_replace(below, r"\.[^./]*$", "").alias("run_id"),
        (F.col("_metadata.file_block_start") * 16 + F.monotonically_increasing_id() % (1 << 33)).alias("line_no"),
        F.col("value").alias("line"),
    )


#: At most so many tasks list folders.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The files below ``path``, which are listed here. A task lists many folders, else there is one task per folder."""
    own = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(own), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.option("recursiveFileLookup", "true").text(path)
    finally:
        spark.conf.set(LISTING, own)


def write_lines(lines: DataFrame, path: str, folder: str) -> None:
    """Lines (run_id, line_no, line and the column ``folder``) as trace files that ``read_lines`` reads, one per run, in order.

    On a mounted file system tasks write ``<folder>=<value>/part=<task>/run_id=<run>.jsonl`` themselves, because Hadoop's
    local file system starts processes for each file that it creates; tasks share no folder, they would wait for each other.
    Elsewhere Spark's writer does it, into ``<folder>=<value>/run_id=<run>/``. Runs and folders are whole numbers or null.
    """
    spark = lines.sparkSession
    ordered = lines.repartition("run_id").sortWithinPartitions(folder, "run_id", "line_no")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        ordered.select("line", folder, "run_id").write.partitionBy(folder, "run_id").text(path)
        return
    root = at.toUri().getPath()

    def write(batches):
        """A file appears under its name when it is complete, so a task may run twice."""
        made = set()
        rows = (r for b in batches for r in zip(b["folder"].to_pylist(), b["name"].to_pylist(), b["line"].to_pylist()))
        for (below, name), group in groupby(rows, key=lambda r: r[:2]):
            if below not in made:
                os.makedirs(f"{root}/{below}", exist_ok=True)
                made.add(below)
            part = f"{root}/{below}/.{name}-{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.writelines((line or b"") + b"\n" for *_, line in group)
            os.replace(part, f"{root}/{below}/{name}.jsonl")
        yield from ()

    named = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    below = F.concat(named(folder), F.lit("/part="), F.spark_partition_id().cast("string"))
    slim = ordered.select(below.alias("folder"), named("run_id").alias("name"), F.col("line").cast("binary").alias("line"))
    slim.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def lines_of_blob(runs: DataFrame, run: str = "run_id", blob: str = "raw_stream") -> DataFrame:
    """Runs that carry their whole trace in one column."""
    return runs.select(F.col(run).alias("run_id"), F.posexplode(F.split(blob, "\n")).alias("line_no", "line")).select(
        "run_id", F.col("line_no").cast("long").alias("line_no"), "line")


def parse(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their parsed value ``v``, null where the line is not JSON."""
    filled = lines.where(F.regexp_replace("line", r"\s+", "") != "")
    return filled.withColumn("v", F.try_parse_json("line"))


def drop_report(lines: DataFrame) -> DataFrame:
    """Per run: non-blank lines, events kept and malformed lines dropped."""
    bad = F.col("v").isNull()
    return parse(lines).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("events"), F.count_if(bad).alias("dropped"))


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def _joined_text(v: str, path: str) -> Column:
    """A string, or the text blocks of an array joined by newlines."""
    parts = _get(v, path, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(parts, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.when(parts.isNotNull(), F.array_join(texts, "\n")).otherwise(F.coalesce(_get(v, path), F.lit("")))


def blocks(lines: DataFrame) -> DataFrame:
    """First dialect: message content blocks of assistant and user events, in order."""
    events = parse(lines).where(F.col("v").isNotNull()).withColumn("role", _get("v", "$.type"))
    spoken = events.where(F.col("role").isin("assistant", "user"))
    content = spoken.select("run_id", "line_no", "role", _get("v", "$.message.content", "array<variant>").alias("content"))
    is_tool = lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_use", F.lit(False))
    each = content.select(
        "run_id", "line_no", "role", F.size(F.filter("content", is_tool)).alias("line_tools"),
        F.posexplode("content").alias("block_pos", "b"),
    ).withColumn("kind", _get("b", "$.type"))
    return _shape(each)


def line_blocks(lines: DataFrame) -> DataFrame:
    """The same blocks with every line in them: a line without blocks is one row without ``kind``, a malformed one is ``bad``.

    Each row depends on its line alone, so it works on a stream.
    """
    filled = F.regexp_replace("line", r"\s+", "") != ""
    v = lines.withColumn("v", F.when(filled, F.try_parse_json("line"))).withColumn("bad", filled & F.col("v").isNull()).withColumn("role", _get("v", "$.type"))
    content = F.when(F.col("role").isin("assistant", "user"), _get("v", "$.message.content", "array<variant>"))
    is_tool = lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_use", F.lit(False))
    listed = v.select("run_id", "line_no", "role", "bad", content.alias("content"))
    each = listed.select("run_id", "line_no", "role", "bad", F.coalesce(F.size(F.filter("content", is_tool)), F.lit(0)).alias("line_tools"), F.posexplode_outer("content").alias("block_pos", "b"))
    return _shape(each.withColumn("kind", _get("b", "$.type")), "bad")


def _shape(each: DataFrame, *more: str) -> DataFrame:
    content = (
        F.when(F.col("kind") == "thinking", F.coalesce(F.nullif(_get("b", "$.thinking"), F.lit("")), _get("b", "$.text")))
        .when(F.col("kind") == "text", _get("b", "$.text"))
        .when(F.col("kind") == "tool_result", _joined_text("b", "$.content"))
    )
    return each.select(
        "run_id", "line_no", "block_pos", "line_tools", "role", "kind", content.alias("text"),
        F.coalesce(_get("b", "$.id"), _get("b", "$.tool_use_id")).alias("tool_id"),
        _get("b", "$.name").alias("tool_name"),
        F.to_json(_get("b", "$.input", "variant")).alias("input_json"),
        F.when(F.col("kind") == "tool_result", F.coalesce(_get("b", "$.is_error", "boolean"), F.lit(False))).alias("is_error"),
        F.lit(None).cast("string").alias("output"), *more,
    )


def command_blocks(lines: DataFrame) -> DataFrame:
    """Second dialect: completed reasoning, message and command items; a command carries its own result."""
    done = parse(lines).where(_get("v", "$.type") == "item.completed").withColumn("item", _get("v", "$.item.type"))
    kept = done.where(F.col("item").isin("reasoning", "agent_message", "command_execution"))
    is_cmd = F.col("item") == "command_execution"
    kind = F.when(is_cmd, "tool_use").when(F.col("item") == "reasoning", "thinking").otherwise("text")
    return kept.select(
        "run_id", "line_no", F.lit(0).alias("block_pos"), is_cmd.cast("int").alias("line_tools"), F.lit("assistant").alias("role"), kind.alias("kind"),
        F.when(~is_cmd, _get("v", "$.item.text")).alias("text"),
        F.when(is_cmd, F.concat_ws(":", "run_id", "line_no")).alias("tool_id"),
        F.when(is_cmd, "Bash").alias("tool_name"),
        F.when(is_cmd, F.to_json(F.struct(_get("v", "$.item.command").alias("command")))).alias("input_json"),
        F.when(is_cmd, F.coalesce(_get("v", "$.item.exit_code", "int") != 0, F.lit(False))).alias("is_error"),
        F.when(is_cmd, _get("v", "$.item.aggregated_output")).alias("output"),
    )


def consumes(b: str = "input_json") -> Column:
    """Tool calls that may change state, wrappers around the command removed."""
    command = shell.unwrap(F.coalesce(F.get_json_object(b, "$.command"), F.lit("")))
    return (F.col("kind") == "tool_use") & shell.modifies_state(F.col("tool_name"), command)


def run_counters(lines: DataFrame) -> DataFrame:
    """Per run: all tool calls, state-modifying calls, and tokens (null when none were reported)."""
    events = parse(lines).where(F.col("v").isNotNull()).withColumn("type", _get("v", "$.type"))
    used = F.coalesce(_get("v", "$.usage.input_tokens", "long"), F.lit(0)) + F.coalesce(_get("v", "$.usage.output_tokens", "long"), F.lit(0))
    tokens = events.groupBy("run_id").agg(F.nullif(F.sum(F.coalesce(used, F.lit(0))), F.lit(0)).alias("total_tokens"))
    tools = blocks(lines).where("role = 'assistant' and kind = 'tool_use'")
    counts = tools.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_tool_calls"), F.count_if(consumes()).alias("total_state_modifying_calls"))
    return tokens.join(counts, "run_id", "left").na.fill(0, ["total_tool_calls", "total_state_modifying_calls"])


def command_counters(lines: DataFrame) -> DataFrame:
    events = parse(lines).where(F.col("v").isNotNull()).withColumn("type", _get("v", "$.type"))
    used = F.coalesce(_get("v", "$.usage.input_tokens", "long"), F.lit(0)) + F.coalesce(_get("v", "$.usage.output_tokens", "long"), F.lit(0))
    tokens = events.groupBy("run_id").agg(F.sum(F.when(F.col("type") == "turn.completed", used).otherwise(0)).alias("total_tokens"))
    cmds = command_blocks(lines)
    counts = cmds.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "tool_use").alias("total_tool_calls"),
        F.count_if(consumes()).alias("total_state_modifying_calls"),
        F.coalesce(F.bool_or(F.col("kind") == "thinking"), F.lit(False)).alias("has_reasoning"))
    return tokens.join(counts, "run_id", "left").na.fill(0).na.fill(False)


def thinking_text(lines: DataFrame) -> DataFrame:
    """All thinking of a run in order, from the top level and the message of each event."""
    events = parse(lines).where(F.col("v").isNotNull())
    shape = "array<struct<type:string,thinking:string>>"
    parts = F.concat(F.coalesce(_get("v", "$.content", shape), F.array().cast(shape)),
                     F.coalesce(_get("v", "$.message.content", shape), F.array().cast(shape)))
    each = events.select("run_id", "line_no", F.posexplode(parts).alias("pos", "b"))
    thought = each.where((F.col("b.type") == "thinking") & (F.col("b.thinking") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "pos", F.col("b.thinking").alias("t"))))
    return thought.groupBy("run_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("thinking_text"),
        F.count(F.lit(1)).alias("n_thinking_blocks"))


__all__ = ["read_lines", "write_lines", "lines_of_blob", "parse", "drop_report", "blocks", "command_blocks", "consumes",
           "run_counters", "command_counters", "thinking_text", "text"]
