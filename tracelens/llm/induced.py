"""External suffix sorting by recursive induction, with common-prefix values.

The order of all suffixes of a text is induced from the order of its leftmost-smaller (LMS)
suffixes, which a shorter text of their ranks gives by recursion. The induction runs through
priority queues keyed by first symbol: a queue holds (position, common prefix) tuples, keeps
``budget`` of them in memory and the rest in sorted runs on disk. Tuples of one symbol leave in the
order of arrival, which is their suffix order, so a symbol's tuples are handled as arrays.

The files are a task's own scratch space, in the folders where Spark spills too, and go when the
sort ends; nothing else reads them.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


def scratch_parent() -> str | None:
    """A folder where Spark lets tasks spill, else Python's own choice."""
    for d in (os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or "").split(","):
        if d and os.access(d, os.W_OK):
            return d
    return None


class SymbolQueue:
    """Tuples by symbol, in order of arrival; over ``budget`` tuples go to disk as a sorted run."""

    def __init__(self, folder: str, name: str, budget: int):
        self.path, self.budget = os.path.join(folder, name), budget
        self.held: dict[int, list[np.ndarray]] = {}
        self.size, self.runs = 0, []

    def add(self, symbol: int, tuples: np.ndarray) -> None:
        self.held.setdefault(symbol, []).append(tuples)
        self.size += len(tuples)

    def settle(self) -> None:
        """To be called now and then after add()."""
        if self.size > self.budget:
            self._spill()

    def push(self, symbols: np.ndarray, tuples: np.ndarray) -> None:
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, tuples = symbols[order], tuples[order]
        at = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        for s, part in zip(symbols[at].tolist(), np.split(tuples, at[1:]), strict=True):
            self.add(s, part)
        self.settle()

    def _spill(self) -> None:
        path, index, at = f"{self.path}-{len(self.runs)}", {}, 0
        with open(path, "wb") as f:
            for s in sorted(self.held):
                n = sum(len(x) for x in self.held[s])
                for x in self.held[s]:
                    x.tofile(f)
                index[s] = (at, n)
                at += n
        self.runs.append((path, index))
        self.held, self.size = {}, 0

    def pop(self, symbol: int) -> list[np.ndarray]:
        parts = []
        for path, index in self.runs:
            if symbol in index:
                at, n = index.pop(symbol)
                parts.append(np.fromfile(path, TUPLE, n, offset=at * TUPLE.itemsize))
        found = self.held.pop(symbol, [])
        self.size -= sum(len(x) for x in found)
        # small arrays are joined up to the budget, so that the walk takes few steps
        joined, held, size = [], [], 0
        for x in parts + found:
            if held and size + len(x) > self.budget:
                joined.append(np.concatenate(held))
                held, size = [], 0
            held.append(x)
            size += len(x)
        return joined + ([np.concatenate(held)] if held else [])


TUPLE = np.dtype([("pos", np.int64), ("lcp", np.int32)])


def _tuples(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    out = np.empty(len(pos), TUPLE)
    out["pos"], out["lcp"] = pos, lcp
    return out


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, at most cap."""
    out = np.zeros(len(a), np.int32)
    live = np.flatnonzero(a != b)
    out[a == b] = cap
    n = len(t)
    for k in range(cap):
        x, y = a[live] + k, b[live] + k
        ok = (x < n) & (y < n)
        live, x, y = live[ok], x[ok], y[ok]
        live = live[t[x] == t[y]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _doubling(t: np.ndarray) -> np.ndarray:
    """Suffix order of a text that fits in memory."""
    n, size = len(t), 1
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[:n - size] = rank[size:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        key = key[order]
        new = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        rank[order] = new
        size *= 2
        if not n or new[-1] == n - 1 or size >= n:
            return order


def _names(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Dense rank of each LMS substring (to the next LMS position, which belongs to it)."""
    bits = max(1, int(t.max() + 1).bit_length())
    per, pad = max(1, 63 // bits), (1 << bits) - 1
    length = np.append(lms[1:] - lms[:-1] + 1, 1)
    name = np.zeros(len(lms), np.int64)
    live, column = np.arange(len(lms)), 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for j in range(column * per, column * per + per):
            inside = j < length[live]
            key <<= bits
            # a substring that ends is greater: its last symbol begins an ascent, the longer one's a descent
            key |= np.where(inside, t[np.where(inside, lms[live] + j, 0)], pad)
        order = np.lexsort((key, name[live]))
        live, key = live[order], key[order]
        group = name[live]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        first = np.concatenate(([True], group[1:] != group[:-1]))
        # ranks leave room: a group's name is the number of substrings before it
        at = np.arange(len(live))
        begin_group, begin_new = np.maximum.accumulate(np.where(first, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        name[live] = group + begin_new - begin_group
        column += 1
        size = np.diff(np.append(np.flatnonzero(new), len(live)))
        # one that ends with this column is still to be told from longer ones that go on
        live = live[(np.repeat(size, size) > 1) & (length[live] >= column * per)]
    return np.unique(name, return_inverse=True)[1]


def suffix_order(t: np.ndarray, cap: int = 0, budget: int = 1 << 22, base: int = 1 << 22, folder: str | None = None):
    """Yield (positions, common prefix with the suffix before, at most cap) from the largest suffix down.

    The last symbol of ``t`` must be 0 and stand nowhere else. The value at a place is the common
    prefix of that suffix and the *next smaller* one, which follows it in the stream. With cap 0
    prefixes aren't kept. Texts of up to ``base`` symbols below the first level are sorted in memory.
    """
    with tempfile.TemporaryDirectory(prefix="suffixes-", dir=folder or scratch_parent()) as d:
        yield from _level(t, cap, budget, base, d, 0)


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one."""
    n = len(t)
    differs = np.append(t[:-1] != t[1:], True)
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = np.append(t[:-1] < t[1:], True)
    return small[at]


def _level(t: np.ndarray, cap: int, budget: int, base: int, folder: str, depth: int):
    n = len(t)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if n == 1 or not len(lms):
        lms = np.array([n - 1])
    # the order of LMS suffixes, by recursion unless their names already tell
    name = _names(t, lms)
    if len(lms) and int(name.max()) == len(lms) - 1:
        sorted_lms = np.empty(len(lms), np.int64)
        sorted_lms[name] = lms
    elif len(lms) <= base:
        sorted_lms = lms[_doubling(name)]
    else:
        parts = [p for p, _ in _level(name, 0, budget, base, folder, depth + 1)]
        sorted_lms = lms[np.concatenate(parts)[::-1]]
    seeds = SymbolQueue(folder, f"seed{depth}", budget)
    lcp = np.zeros(len(lms), np.int32)
    if cap:
        lcp[1:] = common(t, sorted_lms[:-1], sorted_lms[1:], cap)
    step = max(1, budget // 2)
    for i in range(0, len(lms), step):
        seeds.push(t[sorted_lms[i:i + step]], _tuples(sorted_lms[i:i + step], lcp[i:i + step]))
    symbols = np.unique(t)
    large = _induce(t, small, False, symbols, seeds, cap, budget, f"large{depth}", folder)
    # upwards only the order of the larger type is kept; it seeds the second pass
    kept = SymbolQueue(folder, f"kept{depth}", budget)
    for symbol, found in large:
        kept.push(np.full(len(found), symbol), found)
    for _, found in _induce(t, small, True, symbols[::-1], kept, cap, budget, f"small{depth}", folder):
        yield found["pos"], found["lcp"]


def _induce(t, small, down, symbols, seeds, cap, budget, label, folder):
    """Walk the suffixes in order (up, or down from the largest) and queue what stands before each.

    Up: yields the L suffixes of each symbol, in order, each with the common prefix with the one
    before. Down: yields all suffixes of each symbol, largest first, each with the common prefix
    with the next smaller one of the symbol.
    """
    queue = SymbolQueue(folder, label, budget)
    pending = {}  # symbol -> least common prefix walked in the batch of its last tuple, after that tuple
    stamp = {}    # symbol -> number of batches up to that one
    least_of: list[int] = []  # least common prefix of each batch

    def feed(pos: np.ndarray, gap: np.ndarray, symbol: int) -> np.ndarray:
        """Queue the predecessors of a batch in walking order; those of the same symbol come back."""
        before = pos - 1
        at = np.flatnonzero((before >= 0) & (small[before] == down))
        s = t[before[at]]
        order = np.argsort(s, kind="stable")
        s, at = s[order], at[order]
        came = _tuples(before[at], np.zeros(len(at), np.int32))
        cuts = np.flatnonzero(s[1:] != s[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(s)] if len(s) else [0]
        if cap:
            least_of.append(int(gap.min()) if len(gap) else cap)
        k, own = len(least_of), came[:0]
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            c, group = int(s[i]), came[i:j]
            if cap:
                where = at[i:j]
                end = int(where[-1]) + 1
                begins = np.empty(j - i, np.int64)
                begins[0], begins[1:] = 0, where[:-1] + 1
                low = np.minimum.reduceat(gap[:end], begins)
                if c in pending:
                    low[0] = min(int(low[0]), pending[c], min(least_of[stamp[c]:k - 1], default=cap))
                    group["lcp"] = np.minimum(low + 1, cap)
                else:
                    group["lcp"] = np.minimum(low + 1, cap)
                    group["lcp"][0] = 0
                pending[c], stamp[c] = int(gap[end:].min()) if end < len(gap) else cap, k
            if c == symbol:
                own = group
            else:
                queue.add(c, group)
        queue.settle()
        return own

    for symbol in symbols.tolist():
        found, last = [], None

        def walk(parts, symbol=symbol, found=found):
            """Feed a symbol's tuples of the induced type, and the runs of the symbol that they induce."""
            nonlocal last
            while any(map(len, parts)):
                ahead = []
                for part in parts:
                    if not len(part):
                        continue
                    found.append(part)
                    last = int(part["pos"][-1])
                    ahead.append(feed(part["pos"], part["lcp"], symbol))
                parts = ahead

        if down and symbol == 0:  # the end of the text, which nothing induces
            found.append(_tuples(np.array([len(t) - 1]), np.zeros(1, np.int32)))
        walk(queue.pop(symbol))
        other = seeds.pop(symbol)
        for i, part in enumerate(other):
            gap = part["lcp"].copy()
            if down:  # kept tuples are ascending: turn around, common prefix with the one walked before
                continue
            if i == 0 and len(gap):
                gap[0] = 0 if last is None or not cap else common(t, np.array([last]), part["pos"][:1], cap)[0]
            feed(part["pos"], gap, symbol)
        if not down:
            if found:
                both = np.concatenate(found)
                yield symbol, both
            continue
        if other:
            up = np.concatenate(other)
            gap = np.zeros(len(up), np.int32)
            gap[1:] = up["lcp"][1:][::-1]
            pos = up["pos"][::-1]
            if last is not None and cap:
                gap[0] = common(t, np.array([last]), pos[:1].astype(np.int64), cap)[0]
            feed(pos, gap, symbol)
            found.append(_tuples(pos, gap))
        if found:
            both = np.concatenate(found)
            # common prefixes so far are with the suffix walked before, that is the next larger one
            yield symbol, both
