"""Statistics against plain Python; held-out accuracy of classifier and rules; defined cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracelens.llm import quality_classifier, quality_rules
from tracelens.llm.statistics import statistics
from tracelens.llm.textnum import flat

SF = "/root/testdata/sf0.01"


def plain(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    win = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if win[tuple(w[i:i + 5])] > 1:
            hit |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_statistics():
    rnd = random.Random(2)
    texts = ["", " \n\n ", "a\na\na", "x", "é é é é é é é", "a b c d e\n a b c d e\na b c d e\n"]
    texts += ["".join(rnd.choice(["a ", "b ", "é", "\n", "#", "| ", "a b c d e f\n", "日本 "]) for _ in range(rnd.randint(0, 80))) for _ in range(200)]
    s = statistics(*flat(pa.array([*texts, None])))
    got = list(zip(*[s[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], strict=True))
    assert got == [plain(t) for t in [*texts, ""]]


def test_interaction_identity():
    """The linear-time form equals the sum over pairs."""
    m = quality_classifier.Machine(2)
    rng = np.random.default_rng(0)
    m.factor = rng.normal(0, 1, m.factor.shape).astype(np.float32)
    m.weight = rng.normal(0, 1, m.weight.shape).astype(np.float32)
    dense, bucket, value = rng.normal(0, 1, (1, 2)), np.array([3, 70, 900], np.int32), np.array([0.2, 0.5, 0.1], np.float32)
    idx = np.append(bucket, [quality_classifier.BUCKETS, quality_classifier.BUCKETS + 1])
    x = np.append(value, m._dense(dense)[0])
    want = m.weight[idx] @ x + sum((m.factor[idx[i]] @ m.factor[idx[j]]) * x[i] * x[j] for i in range(5) for j in range(i))
    assert m.score(dense, np.array([0, 3]), bucket, value)[0] == pytest.approx(1 / (1 + np.exp(-want)), rel=1e-4)


def tables(spark):
    return (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def test_classifier(spark):
    docs, labels = tables(spark)
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([g.predicted == q for g, q in held]) > 0.93
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in got.values())


def test_rules(spark):
    docs, labels = tables(spark)
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if r.doc_id % 3 == 0]
    assert np.mean([g.kept == bool(q) for g, q in held]) > 0.93
    assert not any(g.kept and g.base_failed for g in got.values())


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a b", None), (1, "a b", 3), (None, None, None), (2, "", 0), (3, "w " * 5000, 5)], "doc_id long, text string, n_chars long")
    docs = docs.selectExpr("*", "1 as label", "'x' as id", "2.0 as score")
    some = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels in (some, none):
        assert quality_classifier.classify(docs, labels).count() == 5
        assert quality_rules.judge(docs, labels).count() == 5
    empty = docs.limit(0)
    assert quality_classifier.classify(empty, some).count() == 0 and quality_rules.judge(empty, some).count() == 0
