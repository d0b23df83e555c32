"""Language-model scoring by context-tree weighting over bytes.

The text a model sees is its words, lower-cased A-Z, each followed by a space, then one end byte. A byte is eight binary
decisions; each decision (the bits of the byte so far) has a tree of contexts of 0 to D bytes before it. Every context estimates
its next bit by Krichevsky-Trofimov counts of the training documents, and the tree mixes all depths: a
context's weight against its longer contexts is how well each coded the training text. A context
that training never met leaves the word to the longer of the shorter ones that it did meet.

Counts are exact and over all training documents: each chunk sends its distinct (context, byte)
strings and words with their counts, packed, to the part of the tree (or the range of words) that
owns them; parts are one last byte and an eighth of the byte before it, so contexts of one subtree meet. A part answers every chunk
with the log-probability of each of its strings. The top two levels of the tree are at most 2048 rows.

Defined cases: null and empty texts are the end byte alone; a null id counts as the empty text in the crc and so is
training; repeated rows count each time and give a row each; with no training document N and V are 0 and the
model says 1/2 for each bit; other columns are left out and may have any name; an empty table gives no rows.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import NULL_ID, array_of, bucket_edges, chunked, ids_of, in_order
from .textnum import LOWER, U64, flat, span_hashes, word_spans

DEPTH = 5
END_WORD = U64(0x9D5C3A7F11E26B84)
END, SPACE = 0x0A, 0x20
SPLIT = 8  # parts of one last byte
MODULUS, HELD = 7, 2
PACKED = "part int, chunk long, body binary, extra binary"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, known_log double, score double"


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x >= 0.5."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(10):
        low = x < 10
        if not low.any():
            break
        shift[low] += np.log(x[low])
        x[low] += 1
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x - shift


def ln_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return ln_gamma(zeros + 0.5) + ln_gamma(ones + 0.5) - ln_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x == NULL_ID else b"%d" % x) % MODULUS == HELD for x in ids.tolist()], bool)


class Stream:
    """A chunk's words and byte strings: one word key per token, one string key per byte (depth 0: words only)."""

    def __init__(self, rows: pa.Table, depth: int):
        self.ids = ids_of(rows)
        self.held = _held_out(self.ids)
        data, offsets = flat(rows["text"])
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        n = len(self.ids)
        # tokens with one end after each document's words
        self.token_first = first + np.arange(n + 1)
        self.words = np.full(int(self.token_first[-1]), END_WORD)
        slot = np.ones(len(self.words), bool)
        slot[self.token_first[1:] - 1] = False
        self.words[slot] = span_hashes(data, starts, ends)
        if not depth:
            return
        # bytes: `depth` end bytes as the context before, the words with a space each, the end
        size = np.concatenate(([0], np.cumsum(ends - starts + 1)))[first]
        self.byte_first = size + np.arange(n + 1) * (depth + 1)
        out = np.full(int(self.byte_first[-1]), SPACE, np.uint8)
        length = ends - starts
        doc = np.repeat(np.arange(n), np.diff(first))
        begin = np.cumsum(length + 1) - (length + 1) + depth + doc * (depth + 1)
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(begin, length) + at] = data[np.repeat(starts, length) + at]
        for k in range(depth):
            out[self.byte_first[:-1] + k] = END
        out[self.byte_first[1:] - 1] = END
        self.n_bytes = np.diff(self.byte_first) - depth
        # a string: the byte before, the one before that and so on, then the byte itself
        keys = np.zeros(max(0, len(out) - depth), np.int64)
        for k in range(1, depth + 1):
            keys = (keys << 8) | out[depth - k:len(out) - k].astype(np.int64) if len(keys) else keys
        keys = (keys << 8) | out[depth:].astype(np.int64) if len(keys) else keys
        real = np.ones(len(keys), bool)
        for d in range(1, n):
            real[self.byte_first[d] - depth:self.byte_first[d]] = False
        self.strings = keys[real]
        self.string_first = np.concatenate(([0], np.cumsum(self.n_bytes)))


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each stands in training documents."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    every = np.sort(keys)
    every = every[np.concatenate(([True], every[1:] != every[:-1]))]
    learnt = np.sort(keys[train])
    return every, np.searchsorted(learnt, every, "right") - np.searchsorted(learnt, every, "left")


def _part_of(keys: np.ndarray, depth: int) -> np.ndarray:
    """The tree part of each string: its last byte and the byte before that modulo SPLIT."""
    last, before = keys >> (8 * depth), (keys >> (8 * (depth - 1))) & 255
    return last * SPLIT + before % SPLIT


def _packed(out: list[tuple]) -> pa.Table:
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["part", "chunk", "body", "extra"])


def _send_words(word_parts: int):
    def send(rows: pa.Table) -> pa.Table:
        s, out = Stream(in_order(rows), 0), []
        key, n = _counted(s.words, np.repeat(~s.held, np.diff(s.token_first)))
        edges = bucket_edges(key, word_parts)
        for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if j > i:
                out.append((-1 - b, rows["chunk"][0].as_py(), key[i:j].tobytes(), n[i:j].tobytes()))
        return _packed(out)
    return send


def _send_strings(depth: int):
    def send(rows: pa.Table) -> pa.Table:
        s, out = Stream(in_order(rows), depth), []
        key, n = _counted(s.strings, np.repeat(~s.held, s.n_bytes))
        part = _part_of(key, depth)
        order = np.argsort(part, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
            out.append((int(part[at[0]]), rows["chunk"][0].as_py(), key[at].tobytes(), n[at].tobytes()))
        return _packed(out)
    return send


def _merge(rows: pa.Table, dtype):
    """Distinct keys of all chunks with summed counts, and each chunk's places among them."""
    keys = [array_of(x, dtype) for x in rows["body"]]
    counts = [array_of(x, np.int64) for x in rows["extra"]]
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    return key[order][at], np.add.reduceat(np.concatenate(counts)[order], at), keys


def _word_answers(rows: pa.Table) -> pa.Table:
    key, n, keys = _merge(rows, U64)
    return pa.table({"part": rows["part"], "chunk": rows["chunk"], "body": pa.array([n[np.searchsorted(key, k)].tobytes() for k in keys], pa.binary())})


def _word_totals(rows: pa.Table) -> pa.Table:
    _, n, _ = _merge(rows, U64)
    return pa.table({"tokens": pa.array([int(n.sum())], pa.int64()), "distinct": pa.array([int((n > 0).sum())], pa.int64())})


class Levels:
    """The levels 2 to D of a tree part, for one of the eight bits of the byte."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int, bit: int):
        byte = key & 255
        self.u = (byte | 256) >> (8 - bit)
        self.one = (byte >> (7 - bit)) & 1
        self.nodes = {}
        below = None
        for d in range(depth, 1, -1):
            node = ((key >> (8 + 8 * (depth - d))) << 8) | self.u
            ids, inverse = np.unique(node, return_inverse=True)
            ones = np.bincount(inverse, n * self.one, len(ids))
            zeros = np.bincount(inverse, n * (1 - self.one), len(ids))
            own = ln_kt(zeros, ones)
            if below is None:
                weighted, ratio = own, np.full(len(ids), np.inf)
            else:
                child_ids, child_weighted = below
                parent = np.searchsorted(ids, ((child_ids >> 16) << 8) | (child_ids & 255))
                split = np.bincount(parent, child_weighted, len(ids))
                ratio = own - split
                weighted = np.logaddexp(own, split) - np.log(2)
            self.nodes[d] = (inverse, zeros, ones, ratio)
            below = (ids, weighted)
        self.top = below


def _summary(depth: int):
    """Of a tree part: counts of next bytes, and the sum of log weighted probabilities of its level-2 nodes."""
    def summary(rows: pa.Table) -> pa.Table:
        key, n, _ = _merge(rows, np.int64)
        total = np.zeros(256)
        for bit in range(8):
            ids, weighted = Levels(key, n, depth, bit).top
            np.add.at(total, ids & 255, weighted)
        counts = np.bincount(key & 255, n, 256)
        return pa.table({"part": rows["part"][:1], "counts": pa.array([counts.tobytes()], pa.binary()), "sums": pa.array([total.tobytes()], pa.binary())})
    return summary


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones seen at each bit node, from counts of bytes."""
    zeros, ones = np.zeros(256), np.zeros(256)
    byte = np.arange(256)
    for bit in range(8):
        u, one = (byte | 256) >> (8 - bit), (byte >> (7 - bit)) & 1
        np.add.at(ones, u, counts * one)
        np.add.at(zeros, u, counts * (1 - one))
    return zeros, ones


def _share(ratio: np.ndarray) -> np.ndarray:
    """Weight of a context's own estimate against its longer contexts."""
    return 1 / (1 + np.exp(-np.clip(ratio, -700, 700)))


def _top(rows: pa.Table) -> pa.Table:
    """Levels 1 and 0 of the tree, for each part: own probability of a one, weight and whether it was met."""
    part = rows["part"].to_numpy()
    counts = np.stack([array_of(x, np.float64) for x in rows["counts"]])
    sums = np.stack([array_of(x, np.float64) for x in rows["sums"]])
    first: dict[int, np.ndarray] = {}
    split = np.zeros(256)
    for last in np.unique(part // SPLIT).tolist():
        at = part // SPLIT == last
        zeros, ones = _bits(counts[at].sum(0))
        own, below = ln_kt(zeros, ones), sums[at].sum(0)
        split += np.logaddexp(own, below) - np.log(2)
        first[last] = np.stack([(ones + 0.5) / (zeros + ones + 1), _share(own - below), zeros + ones > 0])
    zeros, ones = _bits(counts.sum(0))
    root = np.stack([(ones + 0.5) / (zeros + ones + 1), _share(ln_kt(zeros, ones) - split), zeros + ones > 0])
    return pa.table({"part": rows["part"], "body": pa.array([np.concatenate([first[p // SPLIT], root]).tobytes() for p in part.tolist()], pa.binary())})


def _string_answers(depth: int):
    """Log10 probability of each string's byte after its context, for every chunk of a tree part."""
    def answer(rows: pa.Table, top: pa.Table) -> pa.Table:
        key, n, keys = _merge(rows, np.int64)
        upper = array_of(top["body"][0], np.float64).reshape(6, 256)
        total = np.zeros(len(key))
        for bit in range(8):
            levels = Levels(key, n, depth, bit)
            p, met = np.full(len(key), 0.5), np.zeros(len(key), bool)

            def mixed(own, weight, seen, p, met):
                both = np.where(met, weight * own + (1 - weight) * p, own)
                return np.where(seen, both, p), met | seen

            for d in range(depth, 1, -1):
                inverse, zeros, ones, ratio = levels.nodes[d]
                own = (ones + 0.5) / (zeros + ones + 1)
                p, met = mixed(own[inverse], _share(ratio)[inverse], (zeros + ones > 0)[inverse], p, met)
            for own, weight, seen in (upper[:3], upper[3:]):
                p, met = mixed(own[levels.u], weight[levels.u], seen[levels.u] > 0, p, met)
            total += np.log10(np.where(levels.one == 1, p, 1 - p))
        return pa.table({"part": rows["part"], "chunk": rows["chunk"],
                         "body": pa.array([total[np.searchsorted(key, k)].astype(np.float32).tobytes() for k in keys], pa.binary())})
    return answer


def _score(depth: int):
    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = in_order(rows)
        s = Stream(rows, depth)
        n_known, known_log, total = (np.zeros(len(s.ids)) for _ in range(3))
        if rows.num_rows:
            part = answers["part"].to_numpy()
            bodies = answers["body"].combine_chunks() if isinstance(answers["body"], pa.ChunkedArray) else answers["body"]
            word_at = [int(i) for i in np.argsort(-part, kind="stable") if part[i] < 0]
            string_at = [int(i) for i in np.argsort(part, kind="stable") if part[i] >= 0]
            key = _counted(s.words, np.zeros(len(s.words), bool))[0]
            c = np.concatenate([array_of(bodies[i], np.int64) for i in word_at])[np.searchsorted(key, s.words)]
            n_known = np.add.reduceat((c > 0).astype(np.int64), s.token_first[:-1])
            known_log = np.add.reduceat(np.log10(c + 1.0), s.token_first[:-1])
            key = _counted(s.strings, np.zeros(len(s.strings), bool))[0]
            value = np.concatenate([array_of(bodies[i], np.float32) for i in string_at])
            by_key = np.empty(len(key))
            by_key[np.argsort(_part_of(key, depth), kind="stable")] = value
            total = np.add.reduceat(by_key[np.searchsorted(key, s.strings)], s.string_first[:-1])
        return pa.table([pa.array([None if x == NULL_ID else x for x in s.ids.tolist()], pa.int64()), pa.array(s.held), pa.array(np.diff(s.token_first), pa.int64()),
                         pa.array(n_known.astype(np.int64)), pa.array(s.n_bytes, pa.int64()), pa.array(known_log, pa.float64()), pa.array(total, pa.float64())],
                        ["doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "known_log", "score"])
    return score


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, chunk_bytes: int | None = None) -> DataFrame:
    """Per document: held_out, tokens, known tokens, N, base and model log10 probability, bits per byte."""
    if not 2 <= depth <= 6:
        raise ValueError("depth is 2 to 6 bytes")
    base, n = chunked(docs, id_col, text_col, *([chunk_bytes] if chunk_bytes else []))
    by_chunk = base.groupBy("chunk")
    words = by_chunk.applyInArrow(_send_words(max(1, n // 3) + 7), PACKED).groupBy("part")
    strings = by_chunk.applyInArrow(_send_strings(depth), PACKED).groupBy("part")
    top = strings.applyInArrow(_summary(depth), "part int, counts binary, sums binary").withColumn("whole", F.lit(0)).groupBy("whole").applyInArrow(_top, "part int, body binary")
    answers = words.applyInArrow(_word_answers, "part int, chunk long, body binary").unionByName(
        strings.cogroup(top.groupBy("part")).applyInArrow(_string_answers(depth), "part int, chunk long, body binary"))
    totals = words.applyInArrow(_word_totals, "tokens long, distinct long").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("train_words"))
    scored = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_score(depth), SCHEMA)
    return scored.crossJoin(F.broadcast(totals)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
        (F.col("known_log") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.col("train_words") + 1)).alias("base_score"),
        "score", "n_bytes", (-F.col("score") * F.lit(np.log2(10.0).item()) / F.col("n_bytes")).alias("bits_per_byte"))
