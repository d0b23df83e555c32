"""Base scores against plain counts; the context tree against a plain implementation of its definition."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tracelens.llm.lm_scoring import score_documents


def tokens(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())) + [b"\n"]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


class Tree:
    """Context-tree weighting with plain dictionaries: KT counts of every context and bit node."""

    def __init__(self, streams, depth):
        self.depth, self.count = depth, defaultdict(lambda: [0, 0])
        for s in streams:
            for i in range(depth, len(s)):
                for d in range(depth + 1):
                    for k in range(8):
                        self.count[s[i - d:i], (s[i] | 256) >> (8 - k)][s[i] >> (7 - k) & 1] += 1
        self.children = defaultdict(set)
        for c, u in self.count:
            if c:
                self.children[c[1:], u].add((c, u))
        self.memo = {}

    def kt(self, node):
        a, b = self.count[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def split(self, node):
        return sum(self.weighted(c) for c in self.children.get(node, ()))

    def weighted(self, node):
        if node not in self.memo:
            own = self.kt(node)
            if len(node[0]) < self.depth:
                below = self.split(node)
                top = max(own, below)
                own = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
            self.memo[node] = own
        return self.memo[node]

    def score(self, s):
        total = 0.0
        for i in range(self.depth, len(s)):
            for k in range(8):
                u, one, p = (s[i] | 256) >> (8 - k), s[i] >> (7 - k) & 1, None
                for d in range(self.depth, -1, -1):
                    node = (s[i - d:i], u)
                    if node in self.count:
                        a, b = self.count[node]
                        own = (b + 0.5) / (a + b + 1)
                        if p is None:
                            p = own
                        else:
                            w = 1 / (1 + math.exp(min(700, max(-700, self.split(node) - self.kt(node)))))
                            p = w * own + (1 - w) * p
                p = 0.5 if p is None else p
                total += math.log10(p if one else 1 - p)
        return total


@pytest.mark.parametrize("depth", [2, 3])
def test_scores(spark, depth):
    rnd = random.Random(depth)
    docs = [(i, " ".join(rnd.choice(["The", "the", "cat", "Éa", "thé", "sat", "x" * 70, "on\n"]) for _ in range(rnd.randint(0, 25)))) for i in range(80)]
    docs += [(90, None), (91, ""), (None, "the cat"), (3, docs[3][1]), (5, "the zebra")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as score", "2 as chunk")
    got = sorted(score_documents(df, depth=depth, chunk_bytes=900).collect(), key=lambda r: (str(r.doc_id), r.score))
    train = Counter()
    for i, t in docs:
        if not held(i):
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    stream = lambda t: b"\n" * depth + b" ".join(tokens(t))  # noqa: E731  the space after the last word, then the end
    tree = Tree([stream(t) for i, t in docs if not held(i)], depth)
    want = sorted(((i, held(i), len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(t)), tree.score(stream(t)))
                   for i, t in docs), key=lambda r: (str(r[0]), r[6]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5] and g.base_score == pytest.approx(w[5], rel=1e-9) and g.score == pytest.approx(w[6], rel=1e-4)


def test_no_training_and_empty(spark):
    docs = [(i, "a b") for i in range(200) if held(i)][:3]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = score_documents(df).collect()
    assert all(r.train_tokens == 0 and r.score == pytest.approx(5 * 8 * math.log10(0.5), rel=1e-5) for r in got)
    assert score_documents(df.limit(0)).count() == 0
