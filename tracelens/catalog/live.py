"""Streaming queries, drained over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import new_stage
from ..streaming import ingest as I
from ..streaming import monitor as S
from .registry import query


def stream(t):
    return S.read_calls(t.spark, t.sf_dir, t.events.schema, "events.parquet").withColumn("failed", F.col("event_type") == "error")


_WINDOWS = """SELECT user_id % 8 AS run_group, epoch_us(time_bucket(INTERVAL 1 hour, ts)) // 1000000 AS window_start, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors,
    avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS error_rate FROM events GROUP BY ALL"""


@query("x1_error_monitor", f"""SELECT * FROM ({_WINDOWS}) WHERE window_start + 3600 <= (SELECT floor(epoch_us(max(ts)) / 1000) / 1000 - 600 FROM events)""", dbl="error_rate", lng="run_group window_start calls errors")
def _x1(t):
    """Windows that the watermark has closed: those that end ten minutes or more before the last event."""
    rows = stream(t).withColumn("run_group", F.pmod("user_id", F.lit(8)))
    return S.drain(S.error_monitor(rows, "run_group", F.col("failed"))).withColumn("window_start", F.unix_seconds("window_start"))


@query("x1_error_monitor_batch", _WINDOWS, dbl="error_rate", lng="run_group window_start calls errors")
def _x1b(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("run_group", F.pmod("user_id", F.lit(8)))
    out = S.monitor_batch(rows, "run_group", F.col("event_type") == "error")
    return out.withColumn("window_start", F.unix_seconds("window_start"))


def trace_stream(t):
    """The trace lines of the conversations, as a stream of the table's files."""
    raw = t.spark.readStream.schema(t.read("conversations").schema).option("pathGlobFilter", "*.parquet")
    return t.trace_lines(raw.option("recursiveFileLookup", "true").parquet(f"{t.sf_dir}/conversations.parquet"))


def ingested(t):
    """The table that the stream has filled."""
    if "_ingested" not in t.__dict__:
        table = new_stage(t.spark)
        I.ingest(trace_stream(t), table, new_stage(t.spark), gapless=True)
        t.__dict__["_ingested"] = table
    return t.__dict__["_ingested"]


@query("x1_trace_ingest", "SELECT run_id, seq, tool_id, reasoning_text FROM attributed", lng="run_id seq")
def _x1c(t):
    return I.read_ingested(t.spark, ingested(t)).select("run_id", "seq", "tool_id", "reasoning_text")


@query("x1_ingest_counts", "SELECT run_id, count(*) AS lines, count_if(broken) AS malformed FROM turns GROUP BY run_id", lng="run_id lines malformed")
def _x1d(t):
    return I.line_counts(t.spark, ingested(t))


@query("x2_streak_alert", """WITH past AS (SELECT * FROM events WHERE ts <= (SELECT max(ts) - INTERVAL 10 minute FROM events)),
    s AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER w - coalesce(max(CASE WHEN event_type <> 'error' THEN event_rank END) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS streak
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_rank FROM past) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id::VARCHAR AS run_id, event_id AS position, 3 AS streak FROM s WHERE bad AND streak = 3""", lng="position streak")
def _x2(t):
    """Alerts up to the watermark, ten minutes before the last event."""
    return S.drain(S.streak_alerts(stream(t), "user_id", "event_id", "failed", 3))
