"""Trace lines as a stream into a table of calls with the text that led to them.

Lines are parsed by column expressions. What a run has said and no call has taken yet is the run's keyed state, so a
call that comes in a later file, batch or session after a restart gets the same text as from the whole trace at
rest (``attribution.attribute``, rule ``message``). Each batch is written once under its id: a batch that is run again
after a failure replaces itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..sources.traces import consumes, line_blocks

CALLS = "run_id string, seq long, line_no long, tool_id string, tool_name string, params_json string, reasoning_text string, n_lines long, n_malformed long"
STATE = "due long, seq long, pending array<string>, waiting array<string>"
SPOKEN = ("text", "thinking")


def take_line(blocks: list[list], pending: list[str]) -> tuple[list[list], list[str]]:
    """Calls (block, text) of one line of an assistant, and the text that waits after it.

    Text of a line without tools waits for the next call that takes text; in a line with tools it goes to
    the next tool, and is dropped if that doesn't take it.
    """
    said = [b[1] for b in blocks if b[0] in SPOKEN and b[1]]
    if not any(b[0] == "tool_use" for b in blocks):
        return [], pending + said
    calls, own = [], []
    for kind, text, tool_id, name, params, takes in blocks:
        if kind in SPOKEN and text:
            own.append(text)
        elif kind == "tool_use":
            if takes:
                calls.append([tool_id, name, params, "\n".join(pending + own) or None])
                pending = []
            own = []
    return calls, pending


def attribute_stream(lines: DataFrame, gapless: bool = False, first: int = 0) -> DataFrame:
    """A row per call that takes text, numbered within its run, and a row (without ``tool_name`` and ``seq``) per batch and run that counts lines.

    Lines of a batch are taken in order of ``line_no``. With ``gapless`` every number from ``first`` on stands for a line and a
    line waits in the state until all before it have come, so nothing depends on how lines fall into files
    and batches; otherwise a run's lines must come in order, batch by batch. A line that comes again, or
    after later ones were taken, is taken when it comes. The state of a run holds its waiting text and lines.
    """
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, seq, pending, waiting = state.get if state.exists else (first, 0, [], [])
        pending, held = list(pending), [json.loads(w) for w in waiting]
        new = pd.concat(list(batches)).sort_values(["line_no", "block_pos"], kind="stable", na_position="first")
        held += [[int(no), g.astype(object).where(g.notna(), None)[["kind", "text", "tool_id", "tool_name", "input_json", "takes"]].values.tolist() if g["spoken"].iloc[0] else []]
                 for no, g in new.groupby("line_no", sort=False)]
        held.sort(key=lambda h: h[0])
        out = []
        while held and (not gapless or held[0][0] <= due):
            no, blocks = held.pop(0)
            due = max(due, no + 1)
            calls, pending = take_line(blocks, pending)
            for c in calls:
                seq += 1
                out.append([key[0], seq, no, *c, None, None])
        state.update((due, seq, pending, [json.dumps(h) for h in held]))
        lines_ = new.drop_duplicates("line_no")
        out.append([key[0], None, None, None, None, None, None, len(lines_), int(lines_["bad"].sum())])
        names = [c.split()[0] for c in CALLS.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("seq", "line_no", "n_lines", "n_malformed")})

    blocks = line_blocks(lines)
    rows = blocks.select(
        F.col("run_id").cast("string").alias("run_id"), F.col("line_no").cast("long").alias("line_no"), F.col("block_pos"), "kind", "text", "tool_id", "tool_name", "input_json",
        F.coalesce(consumes(), F.lit(False)).alias("takes"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("spoken"), "bad")
    return rows.groupBy("run_id").applyInPandasWithState(fold, CALLS, STATE, "append", GroupStateTimeout.NoTimeout)


def ingest(lines: DataFrame, table: str, checkpoint: str, gapless: bool = False, **trigger) -> None:
    """Run the stream into ``table`` until what is there now is taken, or by the given trigger.

    A batch is written to a folder of its id, so running it again after a failure doesn't repeat its calls.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = attribute_stream(lines, gapless)
    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    run.awaitTermination()


def read_ingested(spark: SparkSession, table: str) -> DataFrame:
    """The calls in the table."""
    rows = spark.read.schema(CALLS + ", batch long").parquet(table)
    return rows.where("seq IS NOT NULL").drop("n_lines", "n_malformed").withColumn("reasoning_token_count", T.token_estimate("reasoning_text")).withColumn("tool_target", T.target("params_json"))


def line_counts(spark: SparkSession, table: str) -> DataFrame:
    """Per run: lines taken in and malformed ones among them."""
    rows = spark.read.schema(CALLS + ", batch long").parquet(table)
    return rows.groupBy("run_id").agg(F.sum("n_lines").alias("lines"), F.sum("n_malformed").alias("malformed"))
