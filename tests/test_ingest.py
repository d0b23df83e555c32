"""Trace lines as a stream against the same traces at rest."""

import json
import random

import pytest

from tracelens.operators import attribution as A
from tracelens.sources import traces
from tracelens.streaming import ingest as I

EDIT, READ = {"type": "tool_use", "id": "e", "name": "Edit", "input": {"file_path": "a.py"}}, {"type": "tool_use", "id": "r", "name": "Read", "input": {"file_path": "b.py"}}
BASH = {"type": "tool_use", "id": "b", "name": "Bash", "input": {"command": "bash -lc 'rm -f x'"}}


def trace(seed):
    rnd = random.Random(seed)
    out = []
    for i in range(rnd.randint(1, 40)):
        kind = rnd.random()
        if kind < 0.1:
            out.append("{broken")
        elif kind < 0.15:
            out.append("  ")
        elif kind < 0.3:
            out.append(json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "e", "content": "ok"}]}}))
        elif kind < 0.35:
            out.append(json.dumps({"type": "assistant", "message": {"content": "no list"}}))
        else:
            blocks = [rnd.choice([{"type": "thinking", "thinking": f"t{seed}.{i}.{j}"}, {"type": "text", "text": f"m{seed}.{i}.{j}"}, {"type": "text", "text": ""}, EDIT | {"id": f"e{i}.{j}"}, READ, BASH | {"id": f"b{i}.{j}"}]) for j in range(rnd.randint(0, 5))]
            out.append(json.dumps({"type": "assistant", "message": {"content": blocks}}))
    return out


def rows():
    return [(f"run{s}", i, line) for s in range(25) for i, line in enumerate(trace(s))]


@pytest.fixture(scope="module")
def at_rest(spark):
    lines = spark.createDataFrame(rows(), "run_id string, line_no long, line string")
    calls = A.with_reasoning(A.attribute(traces.blocks(lines)))
    report = {r.run_id: (r.total, r.dropped) for r in traces.drop_report(lines).collect()}
    return sorted((r.run_id, r.seq, r.line_no, r.tool_id, r.params_json, r.reasoning_text, r.reasoning_token_count) for r in calls.collect()), report


def taken(spark, table):
    found = I.read_ingested(spark, table).collect()
    return sorted((r.run_id, r.seq, r.line_no, r.tool_id, r.params_json, r.reasoning_text, r.reasoning_token_count) for r in found)


def stream(spark, folder, files_per_batch=1):
    return spark.readStream.schema("run_id string, line_no long, line string").option("maxFilesPerTrigger", files_per_batch).json(str(folder))


def put(folder, name, part):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(dict(zip(("run_id", "line_no", "line"), r))) + "\n" for r in part))


def test_one_file(spark, at_rest, tmp_path):
    put(tmp_path / "in", "all", rows())
    I.ingest(stream(spark, tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"))
    assert taken(spark, str(tmp_path / "t")) == at_rest[0]
    counts = {r.run_id: (r.lines, r.malformed) for r in I.line_counts(spark, str(tmp_path / "t")).collect()}
    blank = {s: sum(not line.strip() for run, _, line in rows() if run == s) for s in counts}
    assert {s: (n - blank[s], bad) for s, (n, bad) in counts.items()} == at_rest[1]


def test_many_files_in_any_order_and_a_restart(spark, at_rest, tmp_path):
    part = rows()
    random.Random(1).shuffle(part)
    for i in range(6):
        put(tmp_path / "in", f"f{i}", part[i::9])
    where = str(tmp_path / "t"), str(tmp_path / "c")
    I.ingest(stream(spark, tmp_path / "in"), *where, gapless=True)
    some = taken(spark, where[0])
    assert len(some) < len(at_rest[0])
    for i in range(6, 9):
        put(tmp_path / "in", f"g{i}", part[i::9])
    I.ingest(stream(spark, tmp_path / "in", 2), *where, gapless=True)
    assert taken(spark, where[0]) == at_rest[0]
    I.ingest(stream(spark, tmp_path / "in"), *where, gapless=True)  # nothing new
    assert taken(spark, where[0]) == at_rest[0]


def test_lines_that_are_appended_in_order(spark, at_rest, tmp_path):
    part = sorted(rows(), key=lambda r: r[1])
    where = str(tmp_path / "t"), str(tmp_path / "c")
    for i in range(3):
        put(tmp_path / "in", f"f{i}", part[i * len(part) // 3:(i + 1) * len(part) // 3])
        I.ingest(stream(spark, tmp_path / "in"), *where)
    assert taken(spark, where[0]) == at_rest[0]


def test_a_batch_that_runs_again_replaces_itself(spark, at_rest, tmp_path):
    put(tmp_path / "in", "all", rows())
    for checkpoint in ("c", "d"):  # the second run starts anew, as after a batch that failed before it was logged
        I.ingest(stream(spark, tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / checkpoint))
    assert taken(spark, str(tmp_path / "t")) == at_rest[0]
