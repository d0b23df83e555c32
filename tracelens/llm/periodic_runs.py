"""Runs of repeated word sequences, found from multi-scale minimizers.

A run is a stretch of words with smallest period q (words q apart are equal) of length >= max(12, 2q) that no
neighbouring word extends. All documents of a block are one array of word codes, each ended by a code of its own.

Short periods (below ``SCAN``) are looked for by comparing the array with itself at each lag. For periods in
[L, 2L) windows of L words are cut into k = L/2 words: the first k-gram with the least hash is a window's minimizer.
A run holds a whole window in its first period and the same window one period on, so two equal minimizers
lie q apart, and each such pair at a distance in [L, 2L) seeds an extension in both directions by doubled hashes.

Equal k-grams outside runs of periods up to k/2 lie over k/2 apart, so a seed has about eight partners at most.
K-grams inside such a short run repeat at every period of it; only the first and last of each run are paired,
which finds all runs that hold an end of a short run. A run that lies in two short runs of one content
that touch has a period from their phase, so the few periods that fit are listed. Nothing is capped.

Defined cases: null and empty texts have no words and no runs; a repeated row gives a row each; a null id stays null;
other columns are left out and may have any name; an empty table gives no rows. Runs are compared word by word
before they count, so a hash collision costs a scan and no result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import IS_SPACE, U64, blocks, flat, mix, sliding_min, word_spans

SHORTEST, SCAN = 12, 32
BLOCK_BYTES = 1 << 20
_ODD = U64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal words, and the first word of each row (one more than rows)."""
    starts, ends, first = word_spans(data, offsets)
    at = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[~IS_SPACE[data]])])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32), first


def _lag(x: np.ndarray, q: int) -> np.ndarray:
    """(start, end, q) of the stretches whose words equal those q later, long enough for a run."""
    at = np.flatnonzero(x[:-q] == x[q:])
    cut = np.flatnonzero(at[1:] != at[:-1] + 1)
    first, last = at[np.concatenate(([0], cut + 1))] if len(at) else at, at[np.concatenate((cut, [len(at) - 1]))] if len(at) else at
    ok = last + 1 - first >= max(SHORTEST, 2 * q) - q
    return np.column_stack((first[ok], last[ok] + 1 + q, np.full(int(ok.sum()), q)))


def _smallest(found: np.ndarray) -> np.ndarray:
    """One row per stretch, with its least period, by start."""
    if not len(found):
        return found
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    same = (found[1:, 0] == found[:-1, 0]) & (found[1:, 1] == found[:-1, 1])
    return found[np.concatenate(([True], ~same))]


def _pairs(at: np.ndarray, code: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal codes whose distance is in [low, 2 low)."""
    order = np.lexsort((at, code))
    at, code = at[order], code[order]
    here, step, out = np.arange(len(at)), 1, []
    while len(here):
        here = here[here + step < len(at)]
        d = at[here + step] - at[here]
        alive = (code[here + step] == code[here]) & (d < 2 * low)
        here, d = here[alive], d[alive]
        out.append((at[here][d >= low], d[d >= low]))
        step += 1
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


class _Doubled:
    """Hashes of every 2^j consecutive codes, for as many of the documents as are that long."""

    def __init__(self, x: np.ndarray, reach):
        self.levels, size = [mix(x.astype(np.int64).astype(U64) * _ODD + _ODD)], 1
        while (upto := reach(size * 2)) >= size * 2:
            h = self.levels[-1][:upto - size + 1]
            with np.errstate(over="ignore"):
                self.levels.append(mix(h[:len(h) - size] * _ODD + (h[size:] ^ (h[size:] >> U64(29)))))
            size *= 2

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes from a on equal those from b on (b > a)."""
        n = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            h = self.levels[j]
            ok = b + n < len(h)
            ok[ok] = h[(a + n)[ok]] == h[(b + n)[ok]]
            n[ok] += 1 << j
        return n

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes before a equal those before b."""
        n = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            h, size = self.levels[j], 1 << j
            ok = (a - n >= size) & (b - n - size < len(h))
            ok[ok] = h[(a - n - size)[ok]] == h[(b - n - size)[ok]]
            n[ok] += size
        return n


def _seeds(h: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) pairs of which every run with a period in [2k, 4k) holds one; ``h`` are the hashes of k-grams."""
    low, bits = 2 * k, U64(len(h).bit_length())
    least = sliding_min((h >> bits << bits) | np.arange(len(h), dtype=U64), k + 1)
    at = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    short = known[(known[:, 2] * 2 <= k) & (known[:, 1] - known[:, 0] >= k)]
    if not len(short):
        return _pairs(at, h[at], low)
    run = np.searchsorted(short[:, 0], at, "right") - 1
    inside = (run >= 0) & (at <= short[run, 1] - k)
    places, lags = (list(c) for c in zip(_pairs(at[~inside], h[at[~inside]], low)))
    at, run = at[inside], run[inside]
    _, one = np.unique(np.column_stack((run, h[at].view(np.int64))), axis=0, return_index=True)
    at, run, code = at[one], run[one], h[at[one]]
    begin, end, period = short[run].T
    first, last = at - (at - begin) // period * period, at + (end - k - at) // period * period
    for ends in (first, last):
        p, d = _pairs(ends, code, low)
        places.append(p)
        lags.append(d)
    order = np.lexsort((first, code))
    for i, j in zip(order[:-1], order[1:]):
        if code[i] == code[j] and run[i] != run[j] and begin[j] <= end[i]:
            q = np.arange(low + (first[j] - first[i] - low) % period[i], min(2 * low, min(end[i] - begin[i], end[j] - begin[j]) + period[i] + 1), period[i])
            i0, i1 = np.maximum(begin[i], begin[j] - q), np.minimum(end[i], end[j] - q)
            places.append(i0[i1 - i0 >= q])
            lags.append(q[i1 - i0 >= q])
    return np.concatenate(places), np.concatenate(lags)


def find_runs(x: np.ndarray, reach=None) -> np.ndarray:
    """(start, end, period) of all runs, by start and end.

    ``reach(n)`` is the part of the array from its beginning that holds every document of n codes or more.
    """
    reach = reach or (lambda n: len(x) if n <= len(x) else 0)
    found = _smallest(np.concatenate([np.zeros((0, 3), np.int64)] + [_lag(x[:reach(max(SHORTEST, 2 * q))], q) for q in range(1, SCAN) if reach(max(SHORTEST, 2 * q)) > q]))
    if reach(2 * SCAN) == 0:
        return found
    hashes, k, level = _Doubled(x[:reach(SCAN)], reach), SCAN // 2, (SCAN // 2).bit_length() - 1
    while (upto := reach(4 * k)) >= 4 * k:
        place, lag = _seeds(hashes.levels[level][:upto - k + 1], k, found)
        if len(place):
            begin = place - hashes.left(place, place + lag)
            size = hashes.right(begin, begin + lag)
            new = np.unique(np.column_stack((begin, begin + size + lag, lag))[size >= lag], axis=0)
            wrong = [not np.array_equal(x[s:e - q], x[s + q:e]) for s, e, q in new]
            if any(wrong):
                new = np.concatenate([new[~np.array(wrong)]] + [_lag(x, int(q)) for q in set(new[np.array(wrong), 2])])
            found = _smallest(np.concatenate((found, new)))
        k, level = 2 * k, level + 1
    return found


def block_runs(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (document, start, length, period) by document, start, period, and where each document's begin."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    at = np.concatenate(([0], np.cumsum(n[order] + 1)))
    x = np.empty(at[-1], np.int64)
    x[at[1:] - 1] = -1 - np.arange(len(n))
    inside = np.ones(len(x), bool)
    inside[at[1:] - 1] = False
    begin = np.repeat(first[:-1][order] - at[:-1] + np.arange(len(n)), n[order])
    x[inside] = codes[begin + np.flatnonzero(inside) - np.repeat(np.arange(len(n)), n[order])]
    falling = -n[order]
    found = find_runs(x, lambda least: int(at[np.searchsorted(falling, -least, "right")]))
    place = np.searchsorted(at, found[:, 0], "right") - 1
    out = np.column_stack((order[place], found[:, 0] - at[place], found[:, 1] - found[:, 0], found[:, 2]))
    out = out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]
    return out, np.searchsorted(out[:, 0], np.arange(len(n) + 1))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for the words that no run (start, length, period) repeats."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_runs: bool = False) -> DataFrame:
    """A row per document: its runs, the longest of them, and the text without what they repeat.

    ``with_runs`` adds all runs (array of start, length, period) and the collapsed text itself.
    """
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    nothing = hashlib.sha256(b"").hexdigest()

    def search(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in blocks(offsets, BLOCK_BYTES):
                part, cuts = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                codes, first = word_codes(part, cuts)
                found, where = block_runs(codes, first)
                raw, out = part.tobytes(), {c: [] for c in ("n", "best", "runs_sha256", "collapsed", "all")}
                for row in range(j - i):
                    runs, words = found[where[row]:where[row + 1], 1:], raw[cuts[row]:cuts[row + 1]].split()
                    out["n"].append(len(runs))
                    if len(runs):
                        words = [words[w] for w in np.flatnonzero(kept_words(len(words), runs))]
                        top = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                        out["best"].append([*top, 1000 * top[1] // top[2]])
                        out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs.tolist()).encode()).hexdigest())
                    else:
                        out["best"].append([None] * 4)
                        out["runs_sha256"].append(nothing)
                    text = b" ".join(words)
                    out["collapsed"].append(text if with_runs else hashlib.sha256(text).hexdigest())
                    if with_runs:
                        out["all"].append([dict(zip(("start", "length", "period"), r)) for r in runs.tolist()])
                best = [pa.array(c, pa.int64()) for c in zip(*out["best"])]
                shas = out["collapsed"] if not with_runs else [hashlib.sha256(t).hexdigest() for t in out["collapsed"]]
                columns = [batch.column(0).slice(i, j - i), pa.array(out["n"], pa.int64()), *best, pa.array(out["runs_sha256"]), pa.array(shas)]
                names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
                if with_runs:
                    columns += [pa.array(out["all"], spans), pa.array([t.decode() for t in out["collapsed"]], pa.string())]
                    names += ["runs", "collapsed_text"]
                yield pa.RecordBatch.from_arrays(columns, names)

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(search, SCHEMA + (", runs array<struct<start: long, length: long, period: long>>, collapsed_text string" if with_runs else ""))


def plant_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): one document in ten, by crc32 of its id, ends in words repeated with a period that the id sets."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10).cast("long")))
    rows = rows.withColumn("_w", F.when(F.col("_g").isNotNull(), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    rows = rows.withColumn("_n", F.when(F.size("_w") > 0, F.size("_w"))).withColumn("_a", (F.col("_g") % F.col("_n")).cast("int"))
    tail = F.col("_n") - F.col("_a")
    rows = rows.withColumn("_p", (F.lit(1) + F.floor(tail / (F.lit(3) + F.col("_g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(tail / F.col("_p")).cast("int")))
    text = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(again, F.lit(1), tail)), " ")
    return rows.select("doc_id", F.when(F.col("_n").isNotNull(), text).otherwise(F.col("text")).alias("text"))
