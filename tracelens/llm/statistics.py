"""Statistics of whole texts, for many texts at once."""

from __future__ import annotations

import numpy as np

from .textnum import IS_SPACE, LOWER, U64, mix, rolling, span_hashes, word_spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbol_share", "mean_word", "upper_share", "bang_share", "bar_share", "digit_share", "mark_share", "space_share", "wide_share",
          "distinct_share", "dup_line_share", "repeat_share", "line_words", "log_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = (LOWER != np.arange(256))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return np.diff(total[offsets])


def _groups(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (row, key), where groups of equal pairs begin, and their sizes."""
    order = np.lexsort((keys, rows))
    if not len(order):
        return order, order, order
    r, k = rows[order], keys[order]
    at = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (k[1:] != k[:-1]))))
    return order, at, np.diff(np.append(at, len(order)))


def repeated_words(words: np.ndarray, first: np.ndarray, k: int = 5) -> np.ndarray:
    """Per text: words in k-word windows that stand twice or more in it."""
    n = len(first) - 1
    window = rolling(words, k)
    stop = np.maximum(first[:-1], first[1:] - k + 1)
    size = stop - first[:-1]
    at = np.arange(int(size.sum())) + np.repeat(first[:-1] - (np.cumsum(size) - size), size)
    row = np.repeat(np.arange(n), size)
    order, begin, many = _groups(row, window[at])
    hit = at[order[np.repeat(many > 1, many)]]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + k, -1)
    return _per_row(np.cumsum(change[:-1]) > 0, first)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines that have a word, and those of them that equal an earlier one."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(data == 0x0A) + 1)))
    at = at[at < len(data)]
    end = np.append(at[1:], len(data))
    end = end - ((data[end - 1] == 0x0A) & (end > at))  # a line's own end isn't part of it
    inside = np.concatenate(([0], np.cumsum(~IS_SPACE[data], dtype=np.int64)))
    real = inside[end] > inside[at]
    at, end = at[real], end[real]
    row = np.searchsorted(offsets, at, "right") - 1
    _, begin, many = _groups(row, span_hashes(data, at, end))
    lines = np.bincount(row, minlength=n)
    order_rows = np.sort(row, kind="stable")
    distinct = np.bincount(order_rows[begin], minlength=n) if len(begin) else np.zeros(n, np.int64)
    return lines, lines - distinct


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and shares of each text, and its words under "words" and "first"."""
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    n_words = np.diff(first)
    begins = ~_CONTINUES[data]
    chars = _per_row(begins, offsets)
    lines, dup = duplicate_lines(data, offsets)
    row = np.repeat(np.arange(len(n_words)), n_words)
    _, begin, _ = _groups(row, words)
    distinct = np.bincount(np.sort(row, kind="stable")[begin], minlength=len(n_words)) if len(begin) else np.zeros(len(n_words), np.int64)
    out = {"n_words": n_words, "word_chars": _per_row(begins & ~IS_SPACE[data], offsets), "n_symbols": _per_row(_SYMBOL[data], offsets),
           "n_dup_lines": dup, "n_repeat_words": repeated_words(words, first)}
    c, w, li = np.maximum(chars, 1), np.maximum(n_words, 1), np.maximum(lines, 1)
    shares = (out["n_symbols"] / c, out["word_chars"] / w, _per_row(_UPPER[data], offsets) / c, _per_row(data == 0x21, offsets) / c, _per_row(data == 0x7C, offsets) / c,
              _per_row(_DIGIT[data], offsets) / c, _per_row(_MARK[data], offsets) / c, _per_row(IS_SPACE[data], offsets) / c, _per_row(begins & (data > 0x7F), offsets) / c,
              distinct / w, dup / li, out["n_repeat_words"] / w, n_words / li, np.log1p(n_words))
    out |= dict(zip(SHARES, shares, strict=True))
    return out | {"words": words, "first": first}


def lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words and the first of each text."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets)
    return mix(span_hashes(low, starts, ends) + U64(1)), first
