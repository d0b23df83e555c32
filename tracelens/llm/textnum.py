"""Array forms of text work inside tasks: words, hashes and sliding minima over UTF-8 buffers.

All functions take one byte buffer that holds many texts and their offsets, so that a task works
on a batch of documents at a time. Texts are never decoded; nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .caches import claim

U64 = np.uint64
#: The bytes between words: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes unchanged (bytes of longer UTF-8 sequences are above 0x7F).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POSITIONS = 64
_BYTE_AT = mix(np.arange(1, 256 * _POSITIONS + 1, dtype=U64) * _BASE)
BYTE_CODE = _BYTE_AT[:256].copy()


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column, and where each row starts (one more than rows); other operators' caches go."""
    claim("arrays")
    return buffer(column)


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """As ``flat``, for operators that hold caches of their own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.cast(column, pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows with about ``most`` bytes each; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each row (one more than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begins[cut] = inside[cut]
    stops[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are not empty, ordered and don't overlap."""
    if not len(starts):
        return np.zeros(0, U64)
    length = ends - starts
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    at = np.arange(int(length.sum())) - np.repeat(first, length)
    b = data[at + np.repeat(starts, length)].astype(np.int64)
    code = _BYTE_AT[b + ((at % _POSITIONS) << 8)]
    if int(length.max()) > _POSITIONS:
        far = at >= _POSITIONS
        code[far] = mix(code[far] + (at[far] // _POSITIONS).astype(U64) * _BASE)
    return mix(np.add.reduceat(code, first) + length.astype(U64))


#: Places that are worked out together, so that they stay in a core's cache.
AT_ONCE = 1 << 15


def _by_parts(work, x: np.ndarray, width: int) -> np.ndarray:
    """``work(x, width)``, which gives a value for each ``width`` consecutive elements, over a part of the places at a time."""
    n = len(x) - width + 1
    if n <= AT_ONCE:
        return work(x, width)
    return np.concatenate([work(x[i:i + AT_ONCE + width - 1], width) for i in range(0, n, AT_ONCE)])


def rolling(units: np.ndarray, m: int) -> np.ndarray:
    """A hash of each ``m`` consecutive units; the last m - 1 places have none."""
    return _by_parts(_rolling, units, m)


def _rolling(units: np.ndarray, m: int) -> np.ndarray:
    n = len(units) - m + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, power, size, base = None, 0, units, 1, _BASE
    scale = U64(1)
    with np.errstate(over="ignore"):
        while True:
            if m & size:
                part = power[done:done + n] * scale
                out = part if out is None else out + part
                done += size
                scale = scale * base
            if size * 2 > m:
                return mix(out)
            power = power[:-size] + base * power[size:]
            size, base = size * 2, base * base


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` consecutive values."""
    return _by_parts(_sliding_min, x, w)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size:w - size + n])


def runs(values: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin; a run also begins at each place in ``breaks``."""
    new = np.empty(len(values), bool)
    if len(values):
        new[0] = True
        np.not_equal(values[1:], values[:-1], out=new[1:])
        new[breaks[breaks < len(values)]] = True
    return np.flatnonzero(new)
