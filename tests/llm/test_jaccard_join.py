"""Components of the Jaccard join against all pairs."""

import random
import re

import numpy as np

from tracelens.llm.jaccard_join import jaccard_components, least_difference, parity_bits


def sets(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=3, t=90):
    s = [sets(text, k) for _, text in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and rows[i][0] is not None and rows[j][0] is not None:
                common = len(s[i] & s[j])
                if 100 * common >= t * (len(s[i]) + len(s[j]) - common):
                    group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s[i]), None if d is None and s[i] else least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def family(rnd, size, words, edits):
    base = [f"w{rnd.randrange(400)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(size):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"E{rnd.randrange(1000)}"
        out.append(" ".join(w))
    return out


def test_components(spark):
    rnd = random.Random(5)
    texts = [t for _ in range(3) for t in family(rnd, 25, 120, 4)] + family(rnd, 30, 60, 3)[1:] + [t for _ in range(20) for t in family(rnd, 1, rnd.randint(1, 40), 1)]
    texts += [None, "", "  \n", "one", "One", "one two", "ONE  two", "x y z", "a b c d", "a b c d", "b a c d " * 50]
    rnd.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, texts[0]), (4, texts[9]), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n", "'x' as node")
    assert sorted(map(tuple, jaccard_components(df).collect()), key=str) == brute(rows)


def test_five_words_and_eighty_per_cent(spark):
    rnd = random.Random(6)
    texts = [t for _ in range(4) for t in family(rnd, 20, 200, 5)] + [t + " more words" * rnd.randint(1, 30) for t in family(rnd, 10, 150, 1)] + ["", "a b c", "a b c"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_components(df, k=5, t=80, with_text_hash=True)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == brute(rows, 5, 80) and len({r.text_hash for r in got.collect()}) == len(set(texts))


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(0)
    for n in (1, 5, 63, 64, 65, 127, 130, 1000, 1030):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[n // 10:], rng.integers(0, 2**63, n // 7).astype(np.uint64))))
        assert least_difference(parity_bits(a), parity_bits(b)) <= len(np.setxor1d(a, b))
        assert least_difference(parity_bits(a), parity_bits(a)) == 0
