"""Gate fixtures, edit replay, thinking features, backfill and streaming."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tracelens.functions import patterns as P
from tracelens.operators import audit as Q
from tracelens.operators import gates as G
from tracelens.operators import thinking as K
from tracelens.sources import tables
from tracelens.streaming import monitor


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


@pytest.mark.parametrize("text,path,want", [
    ("I edit views.py now", "a/b/views.py", True), ("something else", "a/views.py", False), ("", "views.py", False),
    (None, "views.py", False), ("text", "", True), ("text", None, True), ("text", "dir/", True), ("see b/c.py", "a/b/c.py", True),
])
def test_alignment(spark, text, path, want):
    df = spark.createDataFrame([(text, path)], "t string, p string")
    assert df.select(G.aligned("t", "p")).first()[0] is want


def test_deliberation(spark):
    rows = [("x" * 150, True), ("x" * 50, False), ("x" * 100, True), (" " * 200, False), (None, False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r.got == r.want for r in df.select("want", G.deliberated("t", 100).alias("got")).collect())


def test_replay_timing_and_sources(spark):
    good, bad = "I will change views.py " + "x" * 100, "short"
    rows = [("a", 15, 30, "Edit", "v/views.py", bad, "k1"), ("b", 25, 30, "Edit", "v/views.py", bad, "k2"),
            ("c", 1, 0, "Edit", "v/views.py", bad, "k3"), ("d", 1, 3, "Write", "v/views.py", good, "k4"), ("e", 1, 3, "Bash", "", bad, "k5")]
    calls = spark.createDataFrame(rows, "run_id string, seq long, n long, tool_name string, file_path string, reasoning_text string, key string")
    log = spark.createDataFrame([("k4", "reject"), ("k2", "concern")], "key string, verdict string")
    got = {(r.condition, r.run_id): r.verdict for r in G.replay(calls, log, 100).collect()}
    assert len(got) == 6 * 4
    assert got["A1", "a"] == "approve" and got["B1", "b"] == "block" and got["A1", "c"] == "block"
    assert got["B1", "d"] == "approve" and got["B2", "d"] == "block" and got["B3", "d"] == "block"
    assert got["B2", "b"] == "concern" and got["B2", "a"] == "approve"


def test_gate_metrics_fixture(spark):
    d = [("p1", "approve"), ("p1", "approve"), ("p2", "approve"), ("p2", "block"), ("f1", "block"), ("f1", "block"), ("f2", "approve"), ("f2", "approve")]
    dec = spark.createDataFrame([("B1", r, i, v) for i, (r, v) in enumerate(d)], "condition string, run_id string, seq int, verdict string")
    runs = spark.createDataFrame([("p1", 1), ("p2", 1), ("f1", 0), ("f2", 0)], "run_id string, success int")
    r = G.gate_metrics(dec, runs).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 2, 3) and r.precision == 2 / 3 and r.recall == 0.5
    empty = G.confusion(runs, [], F.lit(False), F.col("success") != 1).first()
    assert empty.precision == 0 and empty.recall == 0 and empty.f1 == 0
    big = spark.createDataFrame([(True, True)] * 116 + [(True, False)] * 66 + [(False, False)] * 192 + [(False, True)] * 188, "b boolean, f boolean")
    m = G.confusion(big, [], F.col("b"), F.col("f")).first()
    assert [round(v, 4) for v in (m.precision, m.recall, m.f1, m.block_rate)] == [0.6374, 0.3816, 0.4774, 0.3238]


def test_edit_replay(spark):
    rows = [("r", 1, "Edit", "a.py", None, "x", "y", True), ("r", 2, "Edit", "a.py", None, "zz", "q", True), ("r", 3, "Edit", "new.py", None, "a", "b", True),
            ("r", 4, "Write", "new.py", "one one", None, None, True), ("r", 5, "Edit", "new.py", None, "one", "two", True), ("r", 6, "Edit", "../e", None, "a", "b", False)]
    edits = spark.createDataFrame(rows, "run_id string, line_no int, tool_name string, path string, content string, old string, new string, ok boolean").withColumn("block_pos", F.lit(0))
    files = spark.createDataFrame([("r", "a.py", "x.x")], "run_id string, path string, text string")
    got = {r.path: (r.text, r.applied, r.failed) for r in Q.replay_edits(edits, files).collect()}
    assert got == {"a.py": ("y.x", 1, 1), "new.py": ("two one", 2, 1), "../e": (None, 0, 1)}


def test_thinking_features(spark):
    t = "Actually no. Actually yes. The version is old. Python 3.10 fails here. Fine now. Let me try a different approach: run foo() in `a.py`, line 42. the fix is x"
    df = one(spark, t=t)
    first, second = K.first_round("t"), K.second_round("t")
    r = df.select(*[c.alias(k) for k, c in {**first, **second}.items()]).first()
    compat = re.findall(r"[^.]*(?:compat|version|install|deprecated|removed|Python 3\.\d+)[^.]*\.", t, re.I)
    assert abs(r.compat_fraction - sum(map(len, compat)) / len(t)) < 1e-12 and r.compat_fraction > 0
    k = len(t) / 1000
    assert abs(r.actually_density - 2 / k) < 1e-9 and abs(r.func_refs_per_kchar - 1 / k) < 1e-9
    assert abs(r.fix_mention_position - t.index("the fix") / len(t)) < 1e-12 and r.approach_pivots == len(re.findall(P.PIVOT, t, re.I))


def test_cross_reference_rules(spark):
    rows = [("a", 1, "pytest x.py", "1 passed", False, 1, 0), ("a", 2, "pytest want.py", "2 failed", False, 0, 2), ("a", 3, "pytest want.py", "1 passed", False, 1, 0),
            ("b", 1, "pytest x", "1 passed", False, 1, 0), ("b", 2, "pytest x", "ImportError", True, 0, 0)]
    ex = spark.createDataFrame(rows, "run_id string, line_no int, command string, output string, is_error boolean, passed int, failed int").withColumn("block_pos", F.lit(0))
    goals = spark.createDataFrame([("a", ["want.py"]), ("b", ["none.py"])], "run_id string, targets array<string>")
    got = {r.run_id: (r.verdict, r.confidence) for r in Q.cross_reference(ex, goals).collect()}
    assert got == {"a": ("fail", "high"), "b": ("env_error", "low")}


def test_replace_runs_drops_runs_reparsed_to_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "calls"), "run_id string, seq long"
    tables.replace_runs(path, spark.createDataFrame([(r, s) for r in "abcdef" for s in (1, 2)], schema), buckets=3)
    tables.replace_runs(path, spark.createDataFrame([("a", 9)], schema), buckets=3, replaced=spark.createDataFrame([("a",), ("b",), ("zz",)], "run_id string"))
    got = sorted((r.run_id, r.seq) for r in spark.read.parquet(path).collect())
    assert got == [("a", 9)] + [(r, s) for r in "cdef" for s in (1, 2)]
    tables.replace_runs(path, spark.createDataFrame([("a", 7)], schema), buckets=3, replaced=spark.createDataFrame([(r,) for r in "cdef"], "run_id string"))
    assert [(r.run_id, r.seq) for r in spark.read.parquet(path).collect()] == [("a", 7)]


def test_replace_runs_is_atomic_per_run(spark, tmp_path):
    path = str(tmp_path / "calls")
    schema = "run_id string, seq int"
    tables.replace_runs(path, spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], schema), buckets=2)
    tables.replace_runs(path, spark.createDataFrame([("a", 1)], schema), buckets=2)
    got = sorted((r.run_id, r.seq) for r in spark.read.parquet(path).collect())
    assert got == [("a", 1), ("b", 1)]


def test_streams_match_batch(spark, tmp_path):
    rows = [(i, i % 3, i % 4 == 0 or i % 5 == 0 or i % 7 < 3) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, failed boolean").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60))
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    stream = lambda: monitor.read_calls(spark, path, df.schema, "*.parquet")
    batch = {(r[0], r[1]): tuple(r)[2:] for r in monitor.monitor_batch(df, "user_id", F.col("failed")).collect()}
    got = {(r[0], r[1]): tuple(r)[2:] for r in monitor.drain(monitor.error_monitor(stream(), "user_id", F.col("failed"))).collect()}
    assert len(got) >= len(batch) - 6 and all(batch[k] == v for k, v in got.items())
    want = []
    for u in range(3):
        streak = 0
        for e, user, bad in rows:
            if user == u:
                streak = streak + 1 if bad else 0
                if streak == 3:
                    want.append((str(u), e))
    want = sorted(w for w in want if w[1] <= 399 - 10)  # up to the watermark
    alerts = monitor.drain(monitor.streak_alerts(stream(), "user_id", "event_id", "failed", 3)).collect()
    assert sorted((r.run_id, r.position) for r in alerts) == want
    # the same rows in many files, out of order inside the watermark, a file per batch
    rnd = random.Random(1)
    late = sorted(rows, key=lambda r: r[0] + 8 * rnd.random())
    many = str(tmp_path / "many")
    for i in range(0, 400, 80):
        part = spark.createDataFrame(late[i:i + 80], "event_id long, user_id long, failed boolean").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60))
        part.coalesce(1).write.mode("append").parquet(many)
        time.sleep(1.1)  # files are read by time
    stream = monitor.read_calls(spark, many, df.schema, "*.parquet", files_per_batch=1)
    alerts = monitor.drain(monitor.streak_alerts(stream, "user_id", "event_id", "failed", 3)).collect()
    assert sorted((r.run_id, r.position) for r in alerts) == want
