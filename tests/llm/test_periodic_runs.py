"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracelens.llm.periodic_runs import block_runs, find_runs, periodic_runs, plant_runs


def brute(w):
    """(start, length, period) of all runs of a list."""
    seen = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                seen.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def shapes():
    rnd = random.Random(3)
    yield [1] * 500
    yield [1, 2] * 150 + [2, 1] * 150  # a run of every odd period around the middle
    yield ([1, 2, 3] * 40 + [1, 2]) * 4
    yield ([1] * 70 + [2]) * 9
    yield (([1, 2] * 30 + [1]) * 3 + [5, 6, 7]) * 4
    a, b = [1], [1, 2]
    while len(b) < 900:
        a, b = b, b + a  # Fibonacci words have runs at all scales
    yield b
    t = [0]
    while len(t) < 700:
        t += [1 - v for v in t]
    yield t
    for size, letters in ((300, 2), (600, 3), (900, 50), (5, 2), (0, 1), (11, 1), (12, 1), (13, 2)):
        yield [rnd.randrange(letters) for _ in range(size)]
    for _ in range(60):
        w, n = [], rnd.randint(10, 700)
        while len(w) < n:
            p = [rnd.randrange(rnd.choice([1, 2, 3, 1000])) for _ in range(rnd.choice([1, 2, 3, 7, 20, 33, 64, 90, 150]))]
            w += (p * 7)[:int(len(p) * rnd.uniform(0.5, 6))]
            if w and rnd.random() < 0.5:
                w += w[-rnd.randint(1, min(len(w), 250)):]
        yield w


def test_single_lists():
    for w in shapes():
        got = [(int(s), int(e - s), int(q)) for s, e, q in find_runs(np.array(w, np.int64))]
        assert sorted(got) == brute(w)


def test_blocks_of_documents():
    lists = list(shapes())
    codes, first = np.array([v for w in lists for v in w], np.int32), np.cumsum([0] + [len(w) for w in lists])
    rows, where = block_runs(codes, first)
    for i, w in enumerate(lists):
        assert [tuple(r) for r in rows[where[i]:where[i + 1], 1:].tolist()] == brute(w)


def test_long_lists_stay_cheap():
    w = list(range(7)) * 30_000 + list(range(40_000)) * 2 + [1] * 100_000
    got = find_runs(np.array(w, np.int64))
    assert {(0, 210_007, 7), (210_000, 290_000, 40_000)} <= {tuple(r) for r in got.tolist()}
    assert any(q == 1 and e - s >= 100_000 for s, e, q in got.tolist())


def test_hash_collisions_cost_nothing(monkeypatch):
    from tracelens.llm import periodic_runs as R
    monkeypatch.setattr(R, "mix", lambda x: x & np.uint64(7))  # nearly everything collides
    rnd = random.Random(5)
    for _ in range(5):
        p = [rnd.randrange(40) for _ in range(45)]
        w = [rnd.randrange(40) for _ in range(60)] + p * 3 + [rnd.randrange(40) for _ in range(60)]
        got = {(int(s), int(e - s), int(q)) for s, e, q in find_runs(np.array(w, np.int64))}
        assert got <= set(brute(w))


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, w):
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(v for i, v in enumerate(w) if i not in gone).encode()).hexdigest())


def test_query_rows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text) < 6000]
    docs += [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 9), (7, "x\x1cy é z " * 8), (7, "x\x1cy é z " * 8), (-4, "one " * 3000), (30, "日 本 語 " * 20)]
    docs += [(i, " ".join(str(v) for v in w)) for i, w in enumerate(list(shapes())[:12], 10_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as start", "2 as runs", "3 as `_n`")
    got = [tuple(r) for r in periodic_runs(plant_runs(df)).collect()]
    want = [expected(d, planted(d, t)) for d, t in docs]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_spans_and_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e f " * 3 + "g"), (2, "no run here")], "doc_id long, text string")
    one, two = sorted(periodic_runs(df, with_runs=True).collect())
    assert [tuple(r) for r in one.runs] == [(0, 18, 6)] and one.collapsed_text == "a b c d e f g"
    assert two.runs == [] and two.collapsed_text == "no run here" and two.start is None
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_many_rows_one_block(spark, n):
    df = spark.range(300).selectExpr("id as doc_id", "repeat(concat('w', id, ' x '), cast(id % 13 as int)) as text").repartition(n)
    for r in periodic_runs(df).collect():
        assert r.n_runs == (1 if 2 * (r.doc_id % 13) >= 12 else 0)
