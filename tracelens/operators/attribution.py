"""Which reasoning text belongs to which call.

Every text block is given the call that takes it with two running windows over the
block stream, then the texts of a call are joined in order. No per-row state, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.traces import consumes
from .skew import HOT_ROWS, carried, chunked, has_large, positions


def _stream(blocks: DataFrame, consuming: Column, limit: int, large: bool) -> DataFrame:
    spoken = blocks.where((F.col("role") == "assistant") & F.col("kind").isin("text", "thinking", "tool_use"))
    flagged = spoken.withColumn("is_tool", F.col("kind") == "tool_use").withColumn("takes", consuming)
    placed = positions(flagged, "run_id", F.col("line_no"), ["line_no", "block_pos"], limit, large)
    cut = chunked(placed.withColumnRenamed("seq", "pos"), "run_id", limit=limit, seq="pos", large=large)
    keys = ["run_id", "_chunk"] if large else ["run_id"]
    back = Window.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    tool = F.when(F.col("is_tool"), F.struct("pos", "line_no", "takes"))
    taker = F.when(F.col("takes"), F.col("pos"))
    cut = cut.withColumn("_tool", F.last(tool, ignorenulls=True).over(back))
    cut = cut.withColumn("_taker", F.last(taker, ignorenulls=True).over(back))
    cut = carried(cut, ["run_id"], tool, F.min, "_tool_later", later=True, large=large)
    cut = carried(cut, ["run_id"], taker, F.min, "_taker_later", later=True, large=large)
    return cut.withColumn("next_tool", F.coalesce("_tool", "_tool_later")).withColumn(
        "next_taker", F.coalesce("_taker", "_taker_later"))


def attribute(blocks: DataFrame, rule: str = "message", consuming: Column | None = None,
              carry_in_message: bool = False, limit: int = HOT_ROWS) -> DataFrame:
    """Consuming calls with the text that led to them.

    ``message``: text of tool-free messages waits for the next consuming call; text in a
    message with tools goes to the next tool of that message and is dropped when that tool
    does not consume or when no tool follows (``carry_in_message`` makes it wait instead).
    ``stream``: all text waits for the next consuming call.
    ``every``: as ``stream``, but every tool consumes.
    """
    takes = F.col("is_tool") if rule == "every" else (consumes() if consuming is None else consuming)
    large = has_large(blocks, ["run_id"], limit)
    flow = _stream(blocks, takes, limit, large)
    inside = F.col("next_tool.line_no") == F.col("line_no")
    if rule == "message":
        own = F.when(F.col("next_tool.takes"), F.col("next_tool.pos"))
        if carry_in_message:
            own = F.coalesce(own, F.col("next_taker"))
        late = F.col("next_taker") if carry_in_message else F.lit(None).cast("long")
        to = F.when(F.col("line_tools") == 0, F.col("next_taker")).when(inside, own).otherwise(late)
    else:
        to = F.col("next_taker")
    given = flow.where(~F.col("is_tool") & (F.col("text") != "")).withColumn("_to", to).where(F.col("_to").isNotNull())

    def joined(keep: Column) -> Column:
        part = F.collect_list(F.when(keep, F.struct("pos", "text")))
        return F.nullif(F.array_join(F.transform(F.array_sort(part), lambda x: x["text"]), "\n"), F.lit(""))

    texts = given.groupBy("run_id", F.col("_to").alias("pos")).agg(
        joined(F.lit(True)).alias("all_text"),
        joined(F.col("kind") == "thinking").alias("thinking_text"),
        joined(F.col("kind") == "text").alias("message_text"),
    )
    calls = flow.where("takes").select(
        "run_id", "pos", "line_no", "tool_id", "tool_name", F.col("input_json").alias("params_json"),
        F.col("is_error").alias("own_error"), "output")
    out = calls.join(texts, ["run_id", "pos"], "left")
    numbered = positions(out, "run_id", F.col("pos"), ["pos"], limit, large)
    return numbered.withColumn("tool_target", T.target("params_json"))


def with_reasoning(calls: DataFrame, layers: bool = False) -> DataFrame:
    """``reasoning_text`` and its token estimate; with ``layers`` thinking wins over messages."""
    chosen = F.coalesce("thinking_text", "message_text") if layers else F.col("all_text")
    named = calls.withColumn("reasoning_text", chosen)
    return named.withColumn("reasoning_token_count", T.token_estimate("reasoning_text"))


def attach_results(calls: DataFrame, blocks: DataFrame) -> DataFrame:
    """The last result of each call: ``result_text``, ``is_error`` (null when none came) and ``result_json``."""
    results = blocks.where("role = 'user' and kind = 'tool_result'").groupBy("run_id", "tool_id").agg(
        F.max_by(F.struct(F.col("text").alias("content"), "is_error"), F.struct("line_no", "block_pos")).alias("_r"))
    out = calls.join(results, ["run_id", "tool_id"], "left")
    record = F.to_json(F.struct(F.col("tool_id").alias("tool_use_id"), F.col("_r.content").alias("content"),
                                F.col("_r.is_error").alias("is_error")))
    return (
        out.withColumn("result_text", F.col("_r.content")).withColumn("is_error", F.col("_r.is_error"))
        .withColumn("result_json", F.when(F.col("_r").isNotNull(), record)).drop("_r")
    )
