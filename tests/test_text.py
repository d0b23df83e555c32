"""Fixture values for text functions and command classification."""

import pytest
from pyspark.sql import functions as F

from tracelens.functions import patterns as P
from tracelens.functions import shell, text


def values(spark, rows, expr, schema="i int, t string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], schema)
    return [r[0] for r in df.orderBy("i").select(expr.alias("v")).collect()]


COMMANDS = [
    ("ls && cat foo.py", False), ("ls && rm foo", True), ("touch newfile && ls", True),
    ("cat foo; echo bar", False), ("cat foo; rm bar", True), ("ls || mkdir fallback", True),
    ("echo hi && ls && pwd", False), ("cat foo | grep bar", False), ("echo hi | tee out.txt", True),
    ("find . | xargs rm", True), ("cat foo | sort | uniq | wc -l", False), ("echo foo > out.txt", True),
    ("echo foo >> out.txt", True), ("sed -i 's/old/new/' file.py", True), ("sed 's/old/new/' file.py", False),
    ("find . -name '*.pyc' -delete", True), ("find . -name '*.py'", False),
    ("git log | head", True), ("git branch -D x", False), ("git commit -m x", True),
    ("FOO=1 sudo -n ls -la", False), ("", False), ("python -c 'print(1)'", False),
    ("python3 -c 'open(1)'", True), ("/usr/bin/cat x", False), ("frobnicate", True),
    ("ls 2> err", False), ("sed -n -i x f", True), ("sed -e x -i f", False),
    ("cd a && git log | head", True), ("echo x 2>&1 | grep y", False),
]


def test_commands(spark):
    got = values(spark, [c for c, _ in COMMANDS], shell.command_modifies(F.col("t")))
    assert [(c, g) for (c, _), g in zip(COMMANDS, got)] == COMMANDS


def test_tools(spark):
    df = spark.createDataFrame([("Edit", ""), ("Read", ""), ("Bash", "rm x"), ("Bash", "ls"), ("Mystery", "")], "t string, c string")
    got = [r[0] for r in df.select(shell.modifies_state(F.col("t"), F.col("c"))).collect()]
    assert got == [True, False, True, False, True]


def test_unwrap(spark):
    rows = ["/bin/zsh -lc 'cat foo.py'", "/bin/bash -lc 'echo hello'", '/bin/zsh -lc "ls -la"', "cat foo.py", "/bin/sh -c ls"]
    assert values(spark, rows, shell.unwrap(F.col("t"))) == ["cat foo.py", "echo hello", "ls -la", "cat foo.py", "ls"]


def test_lexicon_and_counts(spark):
    rows = ["might fix the bug could", "fix the broken test now", "", None]
    assert values(spark, rows, text.lexicon_density("t", P.HEDGE_WORDS)) == [0.4, 0, 0, 0]
    assert values(spark, ["one two three", "", None, "  a  b "], text.token_count("t")) == [3, 0, 0, 2]
    assert values(spark, ["", None, "abc", "a" * 9], text.token_estimate("t")) == [0, 0, 1, 2]


@pytest.mark.parametrize("t,n", [
    ("I could try this, or alternatively do that.", 2),
    ("I could use regex. Alternatively, I could parse manually. Another approach is to use a library.", 4),
    ("ALTERNATIVELY, we proceed.", 1), ("Instead of parsing, use regex.", 1),
    ("Let me try a different approach to this problem.", 1),
])
def test_alternatives(spark, t, n):
    assert values(spark, [t], text.alternatives_considered("t")) == [n]


def test_backtracks(spark):
    rows = ["Actually, that was wrong.", "Wait, hmm, actually I need to rethink.", "There is no error here.", "no, that's not right"]
    assert values(spark, rows, text.backtrack_count("t")) == [1, 3, 0, 2]


def test_scores(spark):
    assert values(spark, ["Check, then verify: make sure."], text.verification_score("t")) == [3 / 5]
    assert values(spark, ["First, let me see; now I go then."], text.planning_score("t")) == [4 / 8]
    assert values(spark, ["attribute but BUT"], text.substring_density("t", ["but"])) == [1.0]
    assert values(spark, ["wait wait", "tiny"], text.alternation_density("t", P.ALTERNATIONS["metacognitive_density"], 5)) == [1.0, 0.0]
    # backticked name, snake case inside it, file token
    assert values(spark, ["see `foo_bar` in views.py and MyClass"], text.precision_naming("t")) == [4 / 6]


def test_unicode_boundaries(spark):
    assert values(spark, ["ébut … BUT"], text.pattern_hits("t", [r"\bbut\b"])) == [1]


def test_verdicts(spark):
    rows = ["APPROVE - fine", "APPROVE the edit", "CONCERN: x", "REJECT: y", "reject: z", "I would reject it",
            "some concern", "", None, "unrelated", "CONCERN no colon but reject"]
    want = ["approve", "approve", "concern", "reject", "reject", "reject", "concern", "approve", "approve", "approve", "reject"]
    assert values(spark, rows, text.verdict("t")) == want


def test_output_counts(spark):
    rows = ["5 passed, 2 failed in 0.3s", "Ran 5 tests in 1s\n\nOK", "Ran 7 tests\nFAILED (failures=2, errors=1)",
            "Ran 3 tests\nFAILED", "tests finished: 15 passed", "nothing"]
    p, f = text.test_counts("t")
    assert values(spark, rows, p) == [5, 5, 4, 2, 15, 0]
    assert values(spark, rows, f) == [2, 0, 3, 1, 0, 0]


def test_targets_and_paths(spark):
    got = values(spark, ["pytest a/b/test_x.py::TestA::test_b c/d.py test_q other"], text.test_targets("t"))
    assert got == [["TestA", "test_b", "test_x.py", "d.py", "test_q"]]
    assert values(spark, ["/tmp/workspace_ab/src/a.py", "src/a.py"], text.relative_path("t")) == ["src/a.py", "src/a.py"]
    assert values(spark, ["abcdef", "abc"], text.truncate("t", 3)) == ["abc...", "abc"]


def test_error_policies(spark):
    rows = ['{"is_error": true}', '{"is_error": false}', "{}", None, "broken", 'x "is_error":true']
    assert values(spark, rows, text.is_error("t")) == [True, False, False, False, False, False]
    assert values(spark, rows, text.is_error("t", "fail")) == [True, False, False, True, True, True]
    assert values(spark, rows, text.is_error("t", "fallback")) == [True, False, False, False, False, True]


def test_long_inputs_keep_their_meaning(spark):


    df = spark.createDataFrame([("sed " + "-n " * 1500 + "-i s/a/b/ f",), ("sed -n p f",)], "c string")
    assert [r[0] for r in df.select(shell._sed_writes(F.col("c"))).collect()] == [True, False]
    out = spark.createDataFrame([("12345678901 passed",), ("99999999999999999999999 passed",)], "o string")
    assert [r[0] for r in out.select(text.test_counts("o")[0]).collect()] == [12345678901, 0]
