"""Windows of K consecutive units (bytes or words) that also start in a document with a smaller id.

1. Every chunk cuts its documents into *super-windows*: maximal runs of windows that share their
   minimiser, the least hash among the M-unit strings of a window. It sends the distinct minimisers.
2. Buckets of minimisers tell which ones stand in two or more documents; only windows under those
   can repeat, since equal windows have equal minimisers.
3. Every chunk sends its distinct super-windows under such minimisers as packed strings, each with
   the smallest id that holds it, to the shard of the minimiser. All copies of a window meet there. Under a
   minimiser with more than ``HOT`` super-windows each window goes to its own shard instead.
4. A shard finds, for each window of its strings, the smallest id that has it (the solver is the
   operator's own: sorting in one case, a suffix array in the other), and answers each chunk.
5. Every chunk marks the units that windows with a smaller id cover.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .caches import settle
from .chunks import CHUNK_BYTES, array_of, bucket_edges, chunked, ids_of, in_order
from .textnum import BYTE_CODE, IS_SPACE, U64, blocks, flat, mix, rolling, runs, sliding_min, span_hashes, word_spans

HOT = 50_000
REPEATED, IS_HOT = 1, 2


@dataclass(frozen=True)
class Spec:
    """What a unit is, windows of ``k`` units, minimisers of ``m`` units whose hashes keep ``key_bytes`` bytes.

    Short hashes may take different minimisers for one, which sends more strings but changes no result.
    """

    words: bool
    k: int
    m: int
    key_bytes: int = 8

    def pack(self, key: np.ndarray) -> bytes:
        return np.ascontiguousarray(key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - self.key_bytes:]).tobytes()

    def unpack(self, value) -> np.ndarray:
        part = array_of(value, np.uint8).reshape(-1, self.key_bytes)
        whole = np.zeros((len(part), 8), np.uint8)
        whole[:, 8 - self.key_bytes:] = part
        return whole.view(">u8").ravel().astype(U64)


class Block:
    """Some documents of a chunk: unit codes, where units lie in the buffer, super-windows."""

    def __init__(self, spec: Spec, data: np.ndarray, offsets: np.ndarray):
        self.spec = spec
        if spec.words:
            # words with one space after each, so that a run of words is one slice
            starts, ends, self.first = word_spans(data, offsets)
            codes = span_hashes(data, starts, ends)
            size = ends - starts + 1
            self.at = np.concatenate(([0], np.cumsum(size)))
            keep = ~IS_SPACE[data]
            self.data = np.full(int(self.at[-1]), 0x20, np.uint8)
            inside = np.ones(len(self.data), bool)
            inside[self.at[1:] - 1] = False
            self.data[inside] = data[keep]
        else:
            self.data, self.first, codes, self.at = data, offsets, BYTE_CODE[data], None
        self._super(codes)

    def _super(self, codes: np.ndarray) -> None:
        k, m, first = self.spec.k, self.spec.m, self.first
        least = sliding_min(rolling(codes, m), k - m + 1)
        stop = np.maximum(first[:-1], first[1:] - k + 1)  # the first unit of each document that begins no window
        begin = runs(least, np.concatenate((first[:-1], stop)))
        doc = np.searchsorted(first, begin, "right") - 1
        end = np.append(begin[1:], len(least))
        keep = begin < stop[doc]
        self.begin, self.end, self.doc = begin[keep], end[keep], doc[keep]
        self.key = mix(least[self.begin] ^ U64(0x5851F42D4C957F2D)) >> U64(64 - 8 * self.spec.key_bytes)

    def span(self, begin, end):
        """Byte range of windows begin .. end - 1 (arrays or numbers)."""
        last = end + self.spec.k - 1
        return (begin, last) if self.at is None else (self.at[begin], self.at[last] - 1)


#: Bytes of text whose units are looked at together.
BLOCK = 1 << 19


def _blocks(spec: Spec, rows: pa.Table):
    """Blocks of a chunk with the ids of their rows."""
    ids = ids_of(rows)
    data, offsets = flat(rows["text"])
    for i, j in blocks(offsets, BLOCK):
        yield ids[i:j], Block(spec, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])


def _distinct(spec: Spec, rows: pa.Table):
    """Sorted distinct minimisers of a chunk, their counts and whether two ids have one."""
    found = [(b.key, ids[b.doc]) for ids, b in _blocks(spec, rows)]
    key = np.concatenate([x for x, _ in found]) if found else np.zeros(0, U64)
    ids = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    if not len(key):
        return key, np.zeros(0, np.uint32), np.zeros(0, bool)
    order = np.argsort(key)
    key, ids = key[order], ids[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(at, len(key)))
    return key[at], count.astype(np.uint32), np.minimum.reduceat(ids, at) < np.maximum.reduceat(ids, at)


PACKED = "bucket int, chunk long, body binary, extra binary"


def _send_minimisers(spec: Spec, buckets: int):
    def send(rows: pa.Table) -> pa.Table:
        chunk = rows["chunk"][0].as_py()
        key, count, many = _distinct(spec, rows)
        extra = (np.minimum(count, 0x7FFFFFFF).astype(np.uint32) << np.uint32(1)) | many.astype(np.uint32)
        edges = bucket_edges(key << U64(64 - 8 * spec.key_bytes), buckets)
        out = [(b, chunk, spec.pack(key[i:j]), extra[i:j].tobytes()) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
        return _table(out, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["bucket", "chunk", "body", "extra"])
    return send


def _table(rows: list[tuple], types: list, names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _judge_minimisers(spec: Spec, hot: int):
    def judge(rows: pa.Table) -> pa.Table:
        keys = [spec.unpack(x) for x in rows["body"]]
        extra = np.concatenate([array_of(x, np.uint32) for x in rows["extra"]])
        key = np.concatenate(keys)
        order = np.argsort(key)
        sorted_key = key[order]
        at = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
        size = np.diff(np.append(at, len(key)))
        count = np.add.reduceat((extra[order] >> np.uint32(1)).astype(np.int64), at)
        many = (size > 1) | (np.maximum.reduceat(extra[order] & np.uint32(1), at) > 0)
        mark = np.empty(len(key), np.uint8)
        mark[order] = np.repeat(many * REPEATED + (many & (count > hot)) * IS_HOT, size)
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        return pa.table({"bucket": rows["bucket"], "chunk": rows["chunk"],
                         "body": pa.array([x.tobytes() for x in np.split(mark, cuts)], pa.binary())})
    return judge


class Pieces:
    """The distinct strings that a chunk sends, in the order of its documents."""

    def __init__(self, spec: Spec, rows: pa.Table, marks: pa.Table, shards: int, keep: bool):
        key = _distinct(spec, rows)[0]
        mark = np.zeros(len(key), np.uint8)
        if len(key):
            order = np.argsort(marks["bucket"].to_numpy())
            bodies = marks["body"].combine_chunks() if isinstance(marks["body"], pa.ChunkedArray) else marks["body"]
            mark = np.concatenate([array_of(bodies[int(i)], np.uint8) for i in order])
        index: dict[bytes, int] = {}
        self.least: list[int] = []
        self.shard: list[int] = []
        #: for each block: its ids, the block, and begin, end, document and piece of each run
        self.blocks = []
        k = spec.k
        for ids, b in _blocks(spec, rows):
            m = mark[np.searchsorted(key, b.key)] if len(key) else np.zeros(0, np.uint8)
            begin, end, doc, runs_key, mm = (x[m > 0] for x in (b.begin, b.end, b.doc, b.key, m))
            if (mm & IS_HOT).any():  # one window each
                n = np.where(mm & IS_HOT, end - begin, 1)
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                hot = np.repeat((mm & IS_HOT) > 0, n)
                begin, end, doc, runs_key = np.repeat(begin, n) + step, np.repeat(end, n), np.repeat(doc, n), np.repeat(runs_key, n)
                end = np.where(hot, begin + 1, end)
            else:
                hot = np.zeros(len(begin), bool)
            lo, hi = b.span(begin, end)
            raw, piece = b.data.tobytes(), np.empty(len(begin), np.int64)
            own = ids[doc].tolist()
            target = (runs_key % U64(shards)).tolist()
            for x, (i, j, h) in enumerate(zip(lo.tolist(), hi.tolist(), hot.tolist(), strict=True)):
                s = raw[i:j]
                p = index.setdefault(s, len(index))
                piece[x] = p
                if p == len(self.least):
                    self.least.append(own[x])
                    self.shard.append(xxhash.xxh64_intdigest(s) % shards if h else target[x])
                elif own[x] < self.least[p]:
                    self.least[p] = own[x]
            if keep:
                self.blocks.append((ids, b, begin, end, doc, piece))
        self.strings = list(index)
        self.k = k


SHIPPED = "shard int, chunk long, strings binary, lengths binary, ids binary"


def _settled(out: pa.Table) -> pa.Table:
    settle()
    return out


def _send_pieces(spec: Spec, shards: int):
    def send(rows: pa.Table, marks: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows:
            chunk, p = rows["chunk"][0].as_py(), Pieces(spec, in_order(rows), marks, shards, False)
            shard = np.array(p.shard, np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            least = np.array(p.least, np.int64)
            for part in np.split(order, cuts) if len(order) else []:
                strings = [p.strings[i] for i in part.tolist()]
                out.append((int(shard[part[0]]), chunk, b"".join(strings), np.array([len(s) for s in strings], np.uint32).tobytes(), least[part].tobytes()))
        return _settled(_table(out, [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], ["shard", "chunk", "strings", "lengths", "ids"]))
    return send


def _answer(spec: Spec, solve):
    """Per shard: smallest id of each window of each string, as runs of equal ids."""
    def answer(rows: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        least: list[int] = []
        per_chunk = []
        for strings, lengths, ids in zip(rows["strings"], rows["lengths"], rows["ids"], strict=True):
            raw, at, own = strings.as_buffer().to_pybytes(), 0, np.empty(len(array_of(lengths, np.uint32)), np.int64)
            for x, (n, d) in enumerate(zip(array_of(lengths, np.uint32).tolist(), array_of(ids, np.int64).tolist(), strict=True)):
                s = raw[at:at + n]
                at += n
                p = index.setdefault(s, len(index))
                if p == len(least):
                    least.append(d)
                elif d < least[p]:
                    least[p] = d
                own[x] = p
            per_chunk.append(own)
        windows, first = solve(list(index), np.array(least, np.int64))
        begin = runs(windows, first[:-1])
        length = np.diff(np.append(begin, len(windows)))
        run_at = np.searchsorted(begin, first)
        many = np.diff(run_at)
        counts, lengths, ids = [], [], []
        for own in per_chunk:
            n = many[own]
            pick = np.repeat(run_at[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            counts.append(n.astype(np.uint32).tobytes())
            lengths.append(length[pick].astype(np.uint32).tobytes())
            ids.append(windows[begin[pick]].tobytes())
        return _settled(pa.table({"shard": rows["shard"], "chunk": rows["chunk"], "counts": pa.array(counts, pa.binary()),
                         "lengths": pa.array(lengths, pa.binary()), "ids": pa.array(ids, pa.binary())}))
    return answer


def _covered(p: Pieces, answers: pa.Table):
    """Per block of a chunk: ids, the block, and which units are covered."""
    n = len(p.strings)
    many, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
    lengths, ids = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if n:
        shard = np.array(p.shard, np.int64)
        order = np.argsort(shard, kind="stable")
        rank = np.argsort(answers["shard"].to_numpy())
        column = {c: answers[c].combine_chunks() if isinstance(answers[c], pa.ChunkedArray) else answers[c] for c in ("counts", "lengths", "ids")}
        got = {c: np.concatenate([array_of(column[c][int(i)], d) for i in rank]) for c, d in (("counts", np.uint32), ("lengths", np.uint32), ("ids", np.int64))}
        counts, lengths, ids = got["counts"].astype(np.int64), got["lengths"].astype(np.int64), got["ids"]
        many[order] = counts
        start[order] = np.cumsum(counts) - counts
    for own, b, begin, _, doc, piece in p.blocks:
        units = int(b.first[-1])
        change = np.zeros(units + 1, np.int32)
        if len(begin):
            m = many[piece]
            pick = np.repeat(start[piece] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            size = lengths[pick]
            # windows of a run of equal ids begin where those before it in the string end
            before = np.cumsum(size) - size
            head = np.cumsum(m) - m
            at = np.repeat(begin, m) + before - np.repeat(before[head], m)
            hit = ids[pick] < np.repeat(own[doc], m)
            np.add.at(change, at[hit], 1)
            np.add.at(change, at[hit] + size[hit] + p.k - 1, -1)
        yield own, b, np.cumsum(change[:-1]) > 0


def find_covered(docs: DataFrame, id_col: str, text_col: str, spec: Spec, solve, finish, schema: str,
                 chunk_bytes: int | None = None, hot: int = HOT, along: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``finish(rows, [(ids, block, covered)]) -> arrow table`` to each chunk of documents."""
    base, n = chunked(docs, id_col, text_col, chunk_bytes or CHUNK_BYTES, along)
    # false matches stay rare: ten bits more than it takes to number all bytes
    spec = replace(spec, key_bytes=min(8, -(-((n * (chunk_bytes or CHUNK_BYTES)).bit_length() + 10) // 8)))
    buckets, shards = max(1, n // 3) + 7, max(1, n // 2) + 7
    by_chunk = base.groupBy("chunk")

    def send(rows: pa.Table) -> pa.Table:
        return _settled(_send_minimisers(spec, buckets)(in_order(rows)))

    def end(rows: pa.Table, answers: pa.Table, marks: pa.Table) -> pa.Table:
        rows = in_order(rows)
        return _settled(finish(rows, _covered(Pieces(spec, rows, marks, shards, True), answers)))

    marks = by_chunk.applyInArrow(send, PACKED).groupBy("bucket").applyInArrow(_judge_minimisers(spec, hot), "bucket int, chunk long, body binary")
    shipped = by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(_send_pieces(spec, shards), SHIPPED)
    answers = shipped.groupBy("shard").applyInArrow(_answer(spec, solve), "shard int, chunk long, counts binary, lengths binary, ids binary")
    # marks and answers come to the last pass in one table
    both = marks.selectExpr("chunk", "bucket as part", "body", "cast(null as binary) as lengths", "cast(null as binary) as ids", "0 as kind").unionByName(
        answers.selectExpr("chunk", "shard as part", "counts as body", "lengths", "ids", "1 as kind"))

    def last(rows: pa.Table, other: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return finish(rows, [])
        kind = other["kind"].to_numpy()
        marked, answered = (other.filter(pa.array(kind == x)) for x in (0, 1))
        return end(rows, answered.rename_columns(["chunk", "shard", "counts", "lengths", "ids", "kind"]),
                   marked.rename_columns(["chunk", "bucket", "body", "lengths", "ids", "kind"]))

    return by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(last, schema)
