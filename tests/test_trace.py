"""Trace reading, attribution and sequence features against plain Python."""

import json
import random
import re

from pyspark.sql import functions as F

from tracelens.operators import attribution as A
from tracelens.operators import sequence as S
from tracelens.operators.skew import average_ranks, positions, quantile
from tracelens.sources import traces


def lines_df(spark, runs):
    rows = [(r, i, l) for r, ls in runs.items() for i, l in enumerate(ls)]
    return spark.createDataFrame(rows, "run_id string, line_no long, line string")


def test_drop_report(spark):
    a, s = '{"type":"assistant"}', '{"type":"system"}'
    df = lines_df(spark, {"a": [s, a], "b": [s, "", "  ", a], "c": [s, "not json", a], "d": ['{"type":"ok"}', "bad1", "bad2", "bad3"]})
    got = {r.run_id: (r.events, r.dropped) for r in traces.drop_report(df).collect()}
    assert got == {"a": (2, 0), "b": (2, 0), "c": (2, 1), "d": (1, 3)}


def message(*blocks):
    return json.dumps({"type": "assistant", "message": {"content": list(blocks)}})


def think(t):
    return {"type": "thinking", "thinking": t}


def say(t):
    return {"type": "text", "text": t}


def use(i, name="Edit", **inp):
    return {"type": "tool_use", "id": i, "name": name, "input": inp}


def result(i, content, err=False):
    return json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": content, "is_error": err}]}})


def test_attribution_cases(spark):
    runs = {
        "plain": [message(say("A")), message(use("t1"))],
        "mixed": [message(say("A"), use("t1", "Read"), say("B"), use("t2"))],
        "carry": [message(say("A")), message(say("B"), use("t1", "Read")), message(use("t2"))],
        "two": [message(say("A")), message(use("t1"), say("C"), use("t2"))],
        "tail": [message(use("t1"), say("A")), message(use("t2"))],
    }
    got = {}
    for r in A.with_reasoning(A.attribute(traces.blocks(lines_df(spark, runs)))).orderBy("run_id", "seq").collect():
        got.setdefault(r.run_id, []).append((r.tool_id, r.seq, r.reasoning_text))
    assert got == {
        "plain": [("t1", 1, "A")], "mixed": [("t2", 1, "B")], "carry": [("t2", 1, "A")],
        "two": [("t1", 1, "A"), ("t2", 2, "C")], "tail": [("t1", 1, None), ("t2", 2, None)],
    }


def fold(events):
    """Plain reading of the rule, for comparison."""
    pending, out = [], []
    for content in events:
        tools = [b for b in content if b["type"] == "tool_use"]
        if not tools:
            pending += [b.get("thinking") or b.get("text") for b in content]
            continue
        own = []
        for b in content:
            if b["type"] != "tool_use":
                own.append(b.get("thinking") or b.get("text"))
                continue
            if b["name"] == "Edit":
                out.append((b["id"], "\n".join(pending + own) or None))
                pending = []
            own = []
    return out


def random_runs(seed, count, length):
    rng = random.Random(seed)
    runs = {}
    for r in range(count):
        events, k = [], 0
        for _ in range(rng.randint(1, length)):
            content = []
            for _ in range(rng.randint(1, 4)):
                k += 1
                content.append(rng.choice([think(f"h{k}"), say(f"s{k}"), use(f"u{k}"), use(f"u{k}", "Read")]))
            events.append(content)
        runs[f"r{r}"] = events
    return runs


def test_attribution_random_and_cut_runs(spark):
    runs = random_runs(7, 40, 12)
    df = traces.blocks(lines_df(spark, {k: [message(*c) for c in v] for k, v in runs.items()})).cache()
    want = {k: fold(v) for k, v in runs.items()}
    for limit in (1_000_000, 3):
        got = {k: [] for k in runs}
        for r in A.with_reasoning(A.attribute(df, limit=limit)).orderBy("run_id", "seq").collect():
            got[r.run_id].append((r.tool_id, r.reasoning_text))
        assert got == want, limit


def test_results_last_wins(spark):
    runs = {"a": [message(use("t1"), use("t2")), result("t1", "one"), result("t1", [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}], True)]}
    b = traces.blocks(lines_df(spark, runs))
    got = [(r.tool_id, r.result_text, r.is_error) for r in A.attach_results(A.attribute(b), b).orderBy("seq").collect()]
    assert got == [("t1", "x\ny", True), ("t2", None, None)]


def item(kind, state="item.completed", **kw):
    return json.dumps({"type": state, "item": {"type": kind, **kw}})


def test_second_dialect(spark):
    cmd = lambda c, code=0, state="item.completed": item("command_execution", state, command=c, aggregated_output="o", exit_code=code)
    runs = {
        "dup": [item("agent_message", "item.started", text="T"), item("agent_message", text="T"), cmd("echo x > f", state="item.started"), cmd("/bin/zsh -lc 'echo x > f'", 1)],
        "carry": [item("agent_message", text="A"), cmd("cat foo.py"), item("agent_message", text="B"), cmd("echo 'fix' > foo.py")],
        "layers": [item("reasoning", text="R"), item("agent_message", text="M"), cmd("rm x")],
        "none": [cmd("rm x"), item("agent_message", text="late"), cmd("rm y"),
                 '{"type":"turn.completed","usage":{"input_tokens":1000,"output_tokens":500}}',
                 '{"type":"turn.completed","usage":{"input_tokens":200,"output_tokens":100}}'],
    }
    df = lines_df(spark, runs)
    calls = A.with_reasoning(A.attribute(traces.command_blocks(df), rule="stream"), layers=True)
    got = {}
    for r in calls.orderBy("run_id", "seq").collect():
        got.setdefault(r.run_id, []).append((r.seq, r.reasoning_text, r.own_error))
    assert got == {"dup": [(1, "T", True)], "carry": [(1, "A\nB", False)], "layers": [(1, "R", False)],
                   "none": [(1, None, False), (2, "late", False)]}
    stats = {r.run_id: (r.total_tool_calls, r.total_state_modifying_calls, r.total_tokens, r.has_reasoning) for r in traces.command_counters(df).collect()}
    assert stats == {"dup": (1, 1, 0, False), "carry": (2, 1, 0, False), "layers": (1, 1, 0, True), "none": (2, 2, 1800, False)}


def test_thinking_and_layers(spark):
    runs = {"a": [message(think("x"), say("m"), use("t1", "Read")), message(think("y"), use("t2"))]}
    df = lines_df(spark, runs)
    assert traces.thinking_text(df).collect()[0].thinking_text == "x\ny"
    got = [(r.tool_id, r.thinking_text, r.message_text) for r in A.attribute(traces.blocks(df), rule="every").orderBy("seq").collect()]
    assert got == [("t1", "x", "m"), ("t2", "y", None)]


def sequence_loop(calls):
    out = []
    for i, (tool, target, err) in enumerate(calls):
        streak = 0
        for _, _, e in reversed(calls[:i]):
            if not e:
                break
            streak += 1
        names = [c[0] for c in calls[max(0, i - 4):i + 1]]
        pairs = list(zip(names, names[1:]))
        rate = sum(a != b for a, b in pairs) / len(pairs) if pairs else 0.0
        retry = sum((t, g) == (tool, target) for t, g, _ in calls[:i])
        run = 0
        for _, _, e in reversed(calls[:i + 1]):
            if not e:
                break
            run += 1
        out.append((i + 1, streak, rate, retry, run))
    return out


def test_sequence_features_and_cut_runs(spark):
    rng = random.Random(3)
    runs = {f"r{r}": [(rng.choice("ABC"), rng.choice("xy"), rng.random() < 0.5) for _ in range(rng.randint(1, 40))] for r in range(25)}
    rows = [(k, i * 3 + 5, *c) for k, cs in runs.items() for i, c in enumerate(cs)]
    raw = spark.createDataFrame(rows, "run_id string, at long, tool_name string, tool_target string, is_error boolean").cache()
    for limit in (1_000_000, 6):
        calls = positions(raw, "run_id", F.col("at"), ["at"], limit)
        full = S.retry_count(S.annotate(calls, limit=limit), limit=limit)
        got = {}
        for r in full.orderBy("run_id", "seq").collect():
            got.setdefault(r.run_id, []).append((r.seq, r.prior_failure_streak, r.tool_switch_rate, r.retry_count, r.error_run))
            assert r.n == len(runs[r.run_id])
        assert got == {k: sequence_loop(v) for k, v in runs.items()}, limit


def test_ranks_and_quantiles_do_not_depend_on_cuts(spark):
    rng = random.Random(5)
    vals = [("a", rng.choice([rng.gauss(0, 1), float(rng.randint(0, 5))])) for _ in range(300)] + [("b", 2.0)] * 40
    df = spark.createDataFrame(vals, "g string, v double").withColumn("one", F.lit(1))
    a = sorted(v for g, v in vals if g == "a")
    for limit in (1_000_000, 20):
        got = {(r.g, r.v): r.rnk for r in average_ranks(df, ["g"], "v", "one", limit).collect()}
        for v in a:
            where = [i + 1 for i, x in enumerate(a) if x == v]
            assert got[("a", v)] == sum(where) / len(where)
        assert got[("b", 2.0)] == 20.5
        q = quantile(df, ["g"], "v", [0.5, 0.25], limit).where("g = 'a'").collect()[0]
        import numpy as np
        assert abs(q.q0 - np.quantile(a, 0.5)) < 1e-12 and abs(q.q1 - np.quantile(a, 0.25)) < 1e-12


def test_files_of_one_name_are_two_runs(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "run1.jsonl").write_text('{"type":"x"}\n{"type":"y"}\n')
    ids = lambda path: sorted({r.run_id for r in traces.read_lines(spark, path).collect()})
    assert ids(f"{tmp_path}/*/*.jsonl") == ids(str(tmp_path)) == ["a/run1", "b/run1"]
    assert ids(f"{tmp_path}/a/run1.jsonl") == ids(f"{tmp_path}/a/*.jsonl") == ["run1"]
    rows = traces.read_lines(spark, str(tmp_path)).collect()
    assert len({(r.run_id, r.line_no) for r in rows}) == 4


def test_lines_are_written_as_one_file_per_run(spark, tmp_path):
    rows = [(r, k, None if k == 3 else f'{{"k": {k}, "é": "{r}"}}', r and r % 2) for r in (None, -7, 4, 5) for k in range(6)]
    lines = spark.createDataFrame(rows, "run_id long, line_no long, line string, half long").repartition(5)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.runs.link./out", f"file://{tmp_path}")
    none = "__HIVE_DEFAULT_PARTITION__"
    for path in (f"{tmp_path}/plain", f"file://{tmp_path}/uri", "viewfs://runs/out/remote"):
        traces.write_lines(lines, path, "half")
        got = {}
        for r in sorted(traces.read_lines(spark, path).collect(), key=lambda r: r.line_no):
            got.setdefault(re.sub(r"/part[=-][^/]*", "", r.run_id), []).append(r.line)
        named = lambda r: f"half={none}/run_id={none}" if r is None else f"half={r % 2}/run_id={r}"
        assert got == {named(r): [f'{{"k": {k}, "é": "{r}"}}' if k != 3 else "" for k in range(6)] for r in (None, -7, 4, 5)}
    for at in ("plain", "uri"):  # one file a run, nothing else, no folder a run
        files = [str(p.relative_to(tmp_path / at)) for p in (tmp_path / at).rglob("*") if p.is_file()]
        assert sorted(re.sub(r"/part=\d+/", "/", f) for f in files) == sorted(f"{named(r)}.jsonl" for r in (None, -7, 4, 5))


def test_folders_of_runs_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"run{i}").mkdir()
        (tmp_path / f"run{i}" / "trace.jsonl").write_text('{"type":"x"}\n')
    sc, own = spark.sparkContext, spark.conf.get(traces.LISTING)
    sc.setJobGroup("listing", "listing")
    try:
        found = traces.read_lines(spark, str(tmp_path))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * sc.defaultParallelism and spark.conf.get(traces.LISTING) == own
    assert found.select("run_id").distinct().count() == 100


def test_files_of_runs_with_odd_ids(spark, tmp_path):
    import duckdb
    from oracle import compare

    import __spark_entry__ as entry

    spoken = [(c, k, ("system", "user", "assistant")[k % 3], "x" * (k + 7)) for c in (None, -7, 0, 12) for k in range(9)]
    spark.createDataFrame(spoken, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare(entry.queries()["d1_read_files"](spark, str(tmp_path)), con, entry.oracle_sql()["d1_read_files"]) is None


def test_parts_of_a_large_group_are_even(spark):
    from tracelens.operators.skew import split_large

    df = spark.range(20_000).selectExpr("'g' AS k", "IF(id = 0, 0D, 1e9 + id) AS x")
    sizes = [r["count"] for r in split_large(df, ["k"], F.col("x"), 1000).groupBy("_part").count().collect()]
    assert max(sizes) <= 1000 and sum(sizes) == 20_000
    none = split_large(df.limit(500), ["k"], F.col("x"), 1000)
    assert none.where("_cut OR _part <> 0").count() == 0
