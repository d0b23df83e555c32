"""Substring dedup over words, by super-k-mer partitioning.

Windows of 50 words that also start in a document with a smaller id are removed. Consecutive
windows with one minimiser travel as one packed string to the minimiser's bucket, where sorting the windows
of all strings finds equal ones exactly (`windows` has the whole plan).

Defined cases: null or empty text has no words and nothing removed; rows with equal id don't remove
each other's windows; a null id counts as greater than every id; repeated rows give repeated results; other
columns are kept out and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import NULL_ID
from .windows import HOT, Spec, find_covered

WINDOW, MINIMISER = 50, 8
SORT_AT_ONCE = 100_000
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def sort_windows(k: int):
    """Smallest id of each k-word window of the strings, by sorting windows of word numbers."""
    def solve(strings: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number: dict[bytes, int] = {}
        parts = [[number.setdefault(w, len(number)) for w in s.split(b" ")] for s in strings]
        sizes = np.array([len(p) - k + 1 for p in parts], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(int(first[-1]), np.int64)
        if not len(out):
            return out, first
        words = np.fromiter((x for p in parts for x in p), np.int32, int(sizes.sum()) + (k - 1) * len(parts))
        at = np.arange(len(out)) + np.repeat(np.arange(len(parts)) * (k - 1), sizes)
        owner = np.repeat(ids, sizes)
        # windows fall into ranges of their first words' hash, so that one sort holds a bounded number
        head = words[at].astype(np.int64) * 1000003 ^ words[at + k - 1]
        for part in _ranges(head):
            view = np.lib.stride_tricks.sliding_window_view(words, k)[at[part]]
            row = np.ascontiguousarray(view).view(np.dtype((np.void, 4 * k))).ravel()
            order = np.argsort(row)
            row = row[order]
            new = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            low = np.minimum.reduceat(owner[part][order], new)
            out[part[order]] = np.repeat(low, np.diff(np.append(new, len(row))))
        return out, first
    return solve


def _ranges(head: np.ndarray):
    """Index parts of about SORT_AT_ONCE values that keep equal values together."""
    order = np.argsort(head, kind="stable")
    value = head[order]
    i = 0
    while i < len(order):
        j = min(len(order), i + SORT_AT_ONCE)
        if j < len(order):
            j = max(int(np.searchsorted(value, value[j], "left")), i)
            j = j if j > i else int(np.searchsorted(value, value[i], "right"))
        yield order[i:j]
        i = j


def _finish(with_text: bool):
    def finish(rows: pa.Table, found) -> pa.Table:
        ids, n_words, n_removed, sha, kept = [], [], [], [], []
        for own, b, covered in found:
            size = np.diff(b.at)
            keep = np.repeat(~covered, size)
            data = b.data[keep]
            gone = np.concatenate(([0], np.cumsum(covered)))
            left = np.concatenate(([0], np.cumsum(np.where(covered, 0, size))))[b.first]
            raw = data.tobytes()
            ids += own.tolist()
            n_words += np.diff(b.first).tolist()
            n_removed += np.diff(gone[b.first]).tolist()
            for i, j in zip(left[:-1].tolist(), left[1:].tolist(), strict=True):
                s = raw[i:max(i, j - 1)]
                sha.append(hashlib.sha256(s).hexdigest())
                kept.append(s.decode("utf-8", "replace") if with_text else None)
        return pa.table({"doc_id": pa.array([None if x == NULL_ID else x for x in ids], pa.int64()), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept, pa.string())})
    return finish


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     minimiser: int = MINIMISER, with_text: bool = True, chunk_bytes: int | None = None, hot: int = HOT) -> DataFrame:
    """One row per document: words, words removed, digest of the kept words and the kept text itself."""
    return find_covered(docs, id_col, text_col, Spec(True, window, min(minimiser, window)), sort_windows(window), _finish(with_text), SCHEMA, chunk_bytes, hot)
