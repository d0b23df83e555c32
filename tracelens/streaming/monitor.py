"""Streaming ingest of call events with an early-error monitor and a failure-streak alert."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir


def read_calls(spark: SparkSession, path: str, schema, glob: str, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream; ``ts`` becomes a timestamp so that it can carry a watermark."""
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", glob)
           .option("maxFilesPerTrigger", files_per_batch).parquet(path))
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def error_monitor(calls: DataFrame, group: str, failed, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls, errors and error rate per group and tumbling event-time window; later rows are dropped."""
    w = F.window("ts", window)
    out = calls.withWatermark("ts", late).groupBy(w, group).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(failed).alias("errors"), F.avg(failed.cast("double")).alias("error_rate"))
    return out.select(group, F.col("window.start").alias("window_start"), "calls", "errors", "error_rate")


def monitor_batch(calls: DataFrame, group: str, failed, window: str = "1 hour") -> DataFrame:
    """The same table from rows at rest."""
    out = calls.groupBy(F.window("ts", window), group).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(failed).alias("errors"), F.avg(failed.cast("double")).alias("error_rate"))
    return out.select(group, F.col("window.start").alias("window_start"), "calls", "errors", "error_rate")


def streak_alerts(calls: DataFrame, run: str, order: str, failed: str, k: int, idle: str | None = None, late: str = "10 minutes") -> DataFrame:
    """One row each time a run's streak of failures reaches ``k``; needs ``ts``.

    Rows wait in the run's state until the watermark passes their time and are then folded in the order of
    (ts, order), so alerts don't depend on how rows fall into files and batches, as long as a row comes
    before the watermark passes it. The streak of a run is kept for good; with ``idle`` the state of a run that had no row
    for so long is dropped when the watermark tells, which ends its streak at a time that depends on the batches.
    """
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, ts, order_, bad = state.get if state.exists else (0, [], [], [])
        now = state.getCurrentWatermarkMs() * 1000
        ts, order_, bad = np.array(ts, np.int64), np.array(order_, np.int64), np.array(bad, bool)
        if not state.hasTimedOut:
            new = pd.concat(list(batches))
            ts, order_, bad = (np.concatenate([x, new[c].to_numpy(x.dtype)]) for x, c in ((ts, "us"), (order_, "o"), (bad, "bad")))
        at = np.lexsort((order_, ts))
        ts, order_, bad = ts[at], order_[at], bad[at]
        n = int(np.searchsorted(ts, now, "right"))
        place = np.arange(1, n + 1)
        last_good = np.maximum.accumulate(np.where(bad[:n], 0, place)) if n else place
        run_length = np.where(last_good > 0, place - last_good, place + streak)
        hits = order_[:n][bad[:n] & (run_length == k)].tolist()
        streak = int(run_length[-1]) if n else streak
        if idle and state.hasTimedOut and not len(ts):
            state.remove()
        else:
            state.update((streak, ts[n:].tolist(), order_[n:].tolist(), bad[n:].tolist()))
            # to be called again when the watermark reaches the next waiting row, or when the run has been idle
            if len(ts) > n:
                state.setTimeoutTimestamp(max(int(ts[n]) // 1000, now // 1000) + 1)
            elif idle:
                state.setTimeoutTimestamp(now // 1000 + idle_ms)
        yield pd.DataFrame({"run_id": [key[0]] * len(hits), "position": hits, "streak": [k] * len(hits)})

    amount, unit = (idle or "0 days").split()
    idle_ms = int(amount) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
    keyed = calls.withWatermark("ts", late).select(
        F.col(run).cast("string").alias("run_id"), F.col(order).cast("long").alias("o"), F.col(failed).alias("bad"), F.unix_micros("ts").alias("us"), "ts")
    return keyed.groupBy("run_id").applyInPandasWithState(
        fold, "run_id string, position long, streak int", "streak int, ts array<long>, o array<long>, bad array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a table in shared storage, and read that."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/rows")
           .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
