"""Suffix-array dedup over bytes, by external induced sorting.

Bytes covered by a 50-byte string that also starts in a document with a smaller id are removed.
The windows that can repeat meet in shards (`windows` has the plan); each shard's strings are
joined to one text whose suffixes `induced` sorts through disk-backed queues, together with the common prefixes of
neighbours. Suffixes in a row with 50 common bytes are equal windows. A string none of whose windows has the hash of another
window shares no window and isn't sorted.

Defined cases: null or empty text has no bytes and nothing removed; rows with equal id don't remove
each other's bytes; a null id counts as greater than every id; repeated rows give repeated results;
other columns are kept out and may have any name; an empty table gives no rows. ``kept_text`` drops the rest
of a character that a cut went through; ``kept_sha256`` is over the remaining bytes as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import NULL_ID
from .induced import suffix_order
from .textnum import BYTE_CODE, rolling
from .windows import HOT, Spec, find_covered

WINDOW, MINIMISER = 50, 16
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def company(strings: list[bytes], k: int) -> np.ndarray:
    """Which strings have a k-byte window whose hash another window has too; equal windows have equal hashes."""
    length = np.array([len(s) for s in strings], np.int64)
    hashes = rolling(BYTE_CODE[np.frombuffer(b"".join(strings), np.uint8)], k)
    sizes = length - k + 1
    first = np.cumsum(sizes) - sizes
    hashes = hashes[np.arange(int(sizes.sum())) + np.repeat(np.cumsum(length) - length - first, sizes)]
    order = np.argsort(hashes)
    hashes = hashes[order]
    same = np.flatnonzero(hashes[1:] == hashes[:-1])
    shared = np.zeros(len(order), bool)
    shared[order[same]] = shared[order[same + 1]] = True
    return np.logical_or.reduceat(shared, first)


def sort_suffixes(k: int, budget: int = 1 << 22, base: int = 1 << 22):
    """Smallest id of each k-byte window of the strings, from the suffix array of their text."""
    def solve(strings: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.concatenate(([0], np.cumsum([len(s) - k + 1 for s in strings]))).astype(np.int64)
        out = np.repeat(ids, np.diff(first))
        sort = company(strings, k) if strings else np.zeros(0, bool)
        if sort.any():
            part, _ = solve_all([s for s, x in zip(strings, sort, strict=True) if x], ids[sort])
            out[np.repeat(sort, np.diff(first))] = part
        return out, first

    def solve_all(strings: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([len(s) for s in strings], np.int64)
        first = np.concatenate(([0], np.cumsum(length - k + 1)))
        out = np.empty(int(first[-1]), np.int64)
        if not len(out):
            return out, first
        # symbols: 0 the end, 1 after each string, 2 and up for bytes
        starts = np.cumsum(length + 1) - length - 1
        text = np.ones(int((length + 1).sum()) + 1, np.int16)
        inside = np.ones(len(text), bool)
        inside[starts + length] = inside[-1] = False
        text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 2
        text[-1] = 0
        place = np.full(len(text), -1, np.int64)  # window number of each position that begins one
        sizes = length - k + 1
        place[np.arange(len(out)) + np.repeat(starts - first[:-1], sizes)] = np.arange(len(out))
        owner = np.repeat(ids, sizes)
        carry, low = np.zeros(0, np.int64), None
        for pos, common in suffix_order(text, k, budget, base):
            w = place[pos]
            new = common < k
            if low is not None and not new[0]:  # the group goes on from the batch before
                w = np.concatenate((carry, w))
                new = np.concatenate(([True], np.zeros(len(carry) - 1, bool), new))
            new[0] = True
            at = np.flatnonzero(new)
            keep = w >= 0
            value = np.full(len(w), NULL_ID)
            value[keep] = owner[w[keep]]
            least = np.minimum.reduceat(value, at)
            spread = np.repeat(least, np.diff(np.append(at, len(w))))
            out[w[keep]] = spread[keep]
            carry, low = w[at[-1]:], int(least[-1])
        return out, first
    return solve


def _finish(with_text: bool):
    def finish(rows: pa.Table, found) -> pa.Table:
        ids, n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], [], []
        for own, b, covered in found:
            raw = b.data[~covered].tobytes()
            gone = np.concatenate(([0], np.cumsum(covered)))
            begins = covered.copy()
            begins[1:] &= ~covered[:-1]
            cut = b.first[:-1][b.first[:-1] < len(covered)]
            begins[cut] = covered[cut]
            spans = np.concatenate(([0], np.cumsum(begins)))
            ids += own.tolist()
            n_bytes += np.diff(b.first).tolist()
            n_removed += np.diff(gone[b.first]).tolist()
            n_spans += np.diff(spans[b.first]).tolist()
            left = (b.first - gone[b.first]).tolist()
            for i, j in zip(left[:-1], left[1:], strict=True):
                s = raw[i:j]
                sha.append(hashlib.sha256(s).hexdigest())
                kept.append(s.decode("utf-8", "ignore") if with_text else None)
        out = pa.table({"doc_id": pa.array([None if x == NULL_ID else x for x in ids], pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()),
                        "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
                        "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept, pa.string())})
        return out.append_column("rest", rows["rest"]) if "rest" in rows.column_names else out
    return finish


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimiser: int = MINIMISER,
                   with_text: bool = True, budget: int = 1 << 22, base: int = 1 << 22, chunk_bytes: int | None = None, hot: int = HOT, along: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: bytes, bytes and spans removed, digest of the remaining bytes and the remaining text.

    Columns named in ``along`` come back in a struct ``rest``.
    """
    rest = f", rest {docs.select(F.struct(*along).alias('rest')).schema['rest'].dataType.simpleString()}" if along else ""
    return find_covered(docs, id_col, text_col, Spec(False, window, min(minimiser, window)), sort_suffixes(window, budget, base), _finish(with_text), SCHEMA + rest, chunk_bytes, hot, along)
