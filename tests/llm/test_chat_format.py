"""Layouts, exact round trips and digests of formatted chats."""

import hashlib
import json
import random

from tracelens.llm import chat_format as C

HARD = ["", "\\", "\\\\", "#", "##", "###", "####", "### assistant: x", "</turn>", "</turn>\n### user: y", "<\\/turn>", "a\\", "#\\#", "c", "\\c", ":", "é日🎉", "\n", "<", "</", "</tur"]


def test_round_trip():
    rnd = random.Random(1)
    for _ in range(3000):
        turns = [(rnd.choice(["user", "assistant", "a: b", "", "#\\:c", "</turn>"]), "".join(rnd.choice(HARD) for _ in range(rnd.randint(0, 6)))) for _ in range(rnd.randint(1, 4))]
        made = [C.piece(*t) for t in turns]
        assert list(C.read_back("".join(m[0] for m in made))) == turns
        assert [C.unescape(m[0][m[1]:m[2]]) for m in made] == [t if r == "assistant" else "" for r, t in turns]


def test_layouts():
    same = [("user", "q"), ("assistant", "a")]
    for record in ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "x": 1}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
                   {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a", "extra": {"y": [1]}}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"}):
        assert C.record_turns(record) == same
    assert C.record_turns({"instruction": "q", "input": "i", "output": None}) == [("user", "q\n\ni"), ("assistant", "")]
    assert C.record_turns({"other": 1}) == [] and C.record_turns([1]) == []
    assert C.fingerprint({"b", "a"}) == C.fingerprint(["a", "b"]) != C.fingerprint({"a.b"})


def test_tables(spark):
    rows = spark.createDataFrame([(1, [("user", "q"), ("assistant", None)])], "conv_id long, messages array<struct<role string, content string>>")
    assert [tuple(r) for r in C.turns_of_table(rows).collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", None)]
    rows = spark.createDataFrame([(1, "q", "", "a")], "conv_id long, instruction string, input string, output string")
    assert [tuple(r) for r in C.turns_of_table(rows).collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    records = spark.createDataFrame([(1, json.dumps({"prompt": "q", "response": "a"})), (2, "{"), (3, None)], "id long, record string")
    assert [tuple(r) for r in C.turns_of_records(records, "id", "record").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]


def test_digests(spark):
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice([*HARD, None])) for c in [*range(30), None] for t in range(rnd.randint(1, 6))]
    rows += rows[:5] + [(99, t, "assistant", "long " * 2000) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as piece", "'x' as n_turns")
    got = {r.conv_id: r for r in C.digests(C.format_turns(C.turns_of_table(df))).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", x or "") for c, _, r, x in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda z: z[1:])]
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[conv]
        assert g.n_turns == len(turns) and g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert g.loss_chars == len(loss) and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert C.digests(C.format_turns(df.limit(0))).count() == 0
