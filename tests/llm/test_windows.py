"""Byte and word window dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tracelens.llm import induced, substring_dedup, suffix_dedup, textnum
from tracelens.llm.substring_dedup import dedup_substrings
from tracelens.llm.suffix_dedup import dedup_suffixes


def brute(rows, k, words):
    out, seen = [], {}
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t) if words else t
    texts = [(10**18 if i is None else i, split((t or "").encode())) for i, t in rows]
    key = lambda u: b" ".join(u) if words else u
    for i, u in texts:
        for a in range(len(u) - k + 1):
            w = key(u[a:a + k])
            seen[w] = min(seen.get(w, 10**18), i)
    for (i, u), (own, _) in zip(texts, rows, strict=True):
        hit = [False] * len(u)
        for a in range(len(u) - k + 1):
            if seen[key(u[a:a + k])] < i:
                hit[a:a + k] = [True] * k
        spans = sum(h and (a == 0 or not hit[a - 1]) for a, h in enumerate(hit))
        left = [x for x, h in zip(u, hit, strict=True) if not h]
        kept = b" ".join(left) if words else bytes(left)
        out.append((own, len(u), sum(hit), *([] if words else [spans]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choice(["ab", "éa", "c", "dd\n", "abab"]) for _ in range(rnd.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.6 else " ".join(rnd.choice("xyzuvw") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(0, 4))]
        rows.append((i, "  ".join(parts)))
    rows += [(3, rows[3][1]), (5, rows[3][1]), (None, rows[4][1]), (None, None), (n, None), (n + 1, ""), (n + 2, "a" * 900), (n + 3, "a" * 700),
             (n + 4, rows[4][1]), (n + 5, rows[4][1])]
    return rows


@pytest.mark.parametrize("hot", [1, 50_000])
def test_words(spark, hot):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as chunk")
    got = dedup_substrings(df, window=12, minimiser=4, chunk_bytes=2000, hot=hot).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 12, True)


@pytest.mark.parametrize("hot,budget,base", [(1, 1 << 20, 1 << 20), (50_000, 1 << 20, 1 << 20), (50_000, 50, 5)])
def test_bytes(spark, hot, budget, base):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as chunk")
    got = dedup_suffixes(df, window=20, minimiser=6, chunk_bytes=3000, hot=hot, budget=budget, base=base).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 20, False)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_suffixes(df).count() == 0 and dedup_substrings(df).count() == 0


def test_equal_windows_meet_at_any_shard_size(monkeypatch):
    strings, ids = [b"a b c"] * 7 + [b"d e f"] * 3, np.array([5, 9, 8, 1, 7, 6, 4, 3, 2, 9])
    for at_once in range(1, 12):
        monkeypatch.setattr(substring_dedup, "SORT_AT_ONCE", at_once)
        assert substring_dedup.sort_windows(3)(strings, ids)[0].tolist() == [1] * 7 + [2] * 3


def test_strings_without_an_equal_window_are_not_sorted(monkeypatch):
    """Strings that share their minimiser but no window stay out of the suffix array; those that share one go in."""
    rnd = random.Random(3)
    other = lambda n: bytes(rnd.choice(b"abcdefgh") for _ in range(n))
    common, passage = other(16), other(50)
    strings = [other(17) + common + other(17) for _ in range(200)] + [passage + other(20), other(9) + passage, b"a" * 60]
    ids, asked = np.arange(len(strings))[::-1] + 1, []

    def sort(text, *args):
        asked.append(len(text))
        return suffix_order(text, *args)

    suffix_order = suffix_dedup.suffix_order
    monkeypatch.setattr(suffix_dedup, "suffix_order", sort)
    got, first = suffix_dedup.sort_suffixes(50)(strings, ids)
    assert asked == [70 + 59 + 60 + 4]
    least = {}
    for s, i in zip(strings, ids.tolist(), strict=True):
        for a in range(len(s) - 49):
            least[s[a:a + 50]] = min(least.get(s[a:a + 50], i), i)
    assert got.tolist() == [least[s[a:a + 50]] for s in strings for a in range(len(s) - 49)] and first[-1] == len(got)


@pytest.mark.parametrize("work", [textnum.rolling, textnum.sliding_min])
def test_hashes_and_minima_do_not_depend_on_how_many_are_made_at_once(monkeypatch, work):
    units = textnum.mix(np.arange(1000, dtype=np.uint64))
    whole = [work(units, m) for m in (1, 16, 50, 1000)]
    monkeypatch.setattr(textnum, "AT_ONCE", 7)
    assert all((work(units, m) == w).all() and len(w) == 1001 - m for m, w in zip((1, 16, 50, 1000), whole, strict=True))
    assert not len(work(units[:3], 50))


def test_suffixes_are_in_order_with_their_common_prefixes():
    """Also where one LMS substring fills the columns in which they are compared and another one goes on behind them."""
    rnd = random.Random(8)
    begin = [2, 257, 257, 257, 257, 6]
    ends = [[5, 257], [5, 2, 257], [5, 3, 257], [5, 4, 257], [4, 257], [257]]
    for _ in range(4):
        t = np.array([x for _ in range(300) for x in [*begin, *rnd.choice(ends)]] + [0], np.int16)
        raw = t.astype(">u2").tobytes()
        want = sorted(range(len(t)), key=lambda i, raw=raw: raw[2 * i:], reverse=True)
        parts = list(induced.suffix_order(t, 6))
        pos, low = np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])
        assert pos.tolist() == want
        assert low[1:].tolist() == induced.common(t, pos[:-1], pos[1:], 6).tolist()
