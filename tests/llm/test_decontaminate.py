"""Decontamination against a plain alignment of every document with every item."""

import random
import re

import numpy as np

from tracelens.llm import decontaminate as D


def words(t):
    t = re.sub("([\u3000-\u9fff\u0e00-\u0eff])", r" \1 ", t or "")
    return [w for w in ("".join(c for c in x if ord(c) > 127 or c.isalnum()) for x in re.split(r"[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) if w]


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h)) / (2 * len(a))


def test_pairs(spark):
    rnd = random.Random(3)
    item = lambda n: [f"w{rnd.randrange(300)}" for _ in range(n)]
    items = [item(rnd.randint(8, 30)) for _ in range(12)] + [["a", "b"]]
    docs = []
    for d in range(120):
        text = item(rnd.randint(0, 60))
        if rnd.random() < 0.6:
            leak = list(items[0] if d % 3 == 0 else rnd.choice(items))
            for _ in range(rnd.randint(0, len(leak) // 6)):
                leak[rnd.randrange(len(leak))] = "edit"
            text[len(text) // 2:len(text) // 2] = [w.upper() + rnd.choice(["", ",", "!!"]) for w in leak]
        docs.append((d, " ".join(text)))
    docs += [(200, None), (201, ""), (3, docs[3][1]), (None, docs[0][1])]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, " ".join(items[0]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as score")
    other = spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(((d, i) for d, t in docs for i, w in bench if words(w) and smith_waterman(words(w), words(t)) >= 0.5), key=str)
    for block in (40, 1 << 20):
        got = D.contaminated(df, other, block_words=block).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == want
    text = dict(docs)
    assert all(abs(r.score - smith_waterman(words(dict(bench)[r.item_id]), words(text[r.doc_id]))) < 1e-9 for r in got if r.doc_id is not None)


def test_every_pair_of_the_plain_alignment(spark):
    """Copies with every third word replaced, with words put in, left out or in one row only; items of one and two words; scripts without spaces."""
    rnd = random.Random(12)
    noise = lambda n: [f"w{rnd.randrange(60)}" for _ in range(n)]
    items = [noise(rnd.randint(3, 26)) for _ in range(25)] + [["solo"], ["two", "words"], list("日本語のテスト問題です"), list("ภาษาไทยสวย"), [], ["a", "b", "c"]]
    texts = []
    for d in range(500):
        w = list(rnd.choice(items))
        kind = d % 5
        if kind == 0:
            w = ["edit" if i % 3 == 2 else v for i, v in enumerate(w)]
        elif kind == 1:
            w = [x for v in w for x in ([v, "put"] if rnd.random() < 0.8 else [v])]
        elif kind == 2:
            w = [v for v in w if rnd.random() < 0.7]
        elif kind == 3:
            w = [rnd.choice([v, v, v, "x", f"{v} y"]) for v in w]
        texts.append((d, " ".join(noise(rnd.randint(0, 12)) + w + noise(rnd.randint(0, 12)))))
    texts += [(900, "前日本語のテスト問題です後"), (901, "x日本語のテx問題です"), (902, "Two!"), (903, "words, solo")]
    bench = [(i, "".join(w) if w and ord(w[0][0]) > 255 else " ".join(w)) for i, w in enumerate(items)]
    want = {(d, i): s for d, t in texts for i, w in bench if words(w) and (s := smith_waterman(words(w), words(t))) >= 0.5}
    assert {(900, 27), (901, 27), (902, 26), (903, 25), (903, 26)} <= set(want) and len(want) > 300
    df, other = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    for block in (60, 1 << 20):
        assert {(r.doc_id, r.item_id): r.score for r in D.contaminated(df, other, block_words=block).collect()} == want


def test_items_keep_their_rarest_places():
    w = np.arange(20, dtype=np.uint64) + np.uint64(1)
    items = D.Items([1], [w])
    assert (items.places[0], items.together[0]) == (13, 3)  # 19 places begin pairs, 9 are in every contaminated passage
    counts = np.zeros(len(items.gram), np.int64)
    counts[items.number[items.place < 8]] = 50
    items.keep_rare(counts)
    assert set(items.place.tolist()) == {*range(8, 19), 0, 1} and len(items.gram) == 2 * 13 - 1


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert D.contaminated(docs.limit(0), items).count() == 0 and D.contaminated(docs, items.limit(0)).count() == 0 and D.contaminated(docs, items).count() == 1


def test_edited_copies_however_rare_or_common(spark):
    rnd = random.Random(8)
    item = [f"i{n}" for n in range(20)]
    half, split = [f"h{n}" for n in range(24)], [f"s{n}" for n in range(20)]
    bench = [(1, " ".join(item)), (2, " ".join(half)), (3, " ".join(split))]
    edited = list(item)
    for n in (3, 7, 11, 15):
        edited[n] = "edit"
    noise = lambda n: [f"w{rnd.randrange(300)}" for _ in range(n)]
    leaks = {7: edited, 8: half[:12], 9: split[:10] + noise(19) + split[10:]}
    other = spark.createDataFrame(bench, "item_id long, text string")
    for every in (None, 3):
        docs = []
        for d in range(1000):
            leak = leaks.get(d, edited if every and d % every == 0 else [])
            docs.append((d, " ".join(noise(15) + leak + noise(15))))
        want = {(d, i): s for d, t in docs for i, w in bench if (s := smith_waterman(w.split(), t.split())) >= 0.5}
        assert {(7, 1), (8, 2), (9, 3)} <= set(want) and len(want) >= (300 if every else 3)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert {(r.doc_id, r.item_id): r.score for r in D.contaminated(df, other).collect()} == want
        assert {r.doc_id for r in D.drop_contaminated(df, other).collect()} == set(range(1000)) - {d for d, _ in want}
