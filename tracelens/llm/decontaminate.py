"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased (A-Z) and lose ASCII punctuation; characters of scripts without spaces are words. An item of n words is
aligned with a passage word by word (match 2, mismatch -1, gap -1); the best score over 2 n is the similarity, and pairs of at
least ``THRESHOLD`` (t) are contaminated.

Seeds are pairs of words that stand next to each other or with one word between, in item and passage alike. Between two
matched words of an alignment each further word costs 1, so of the m - 1 steps of an alignment with m matches at most
(2 m - 2 t n) / 2 skip two words or more: at least t n - 1 places of the item begin a pair that the passage has, whatever was
edited. The documents that have each pair are counted over the whole table, and an item keeps its rarest places only, as
many as it takes for ``TOGETHER`` of them to be in every such passage. Places of a passage with fewer seeds on near
diagonals are left, as are those that lack too many words of the item (``bound``); the rest is aligned. An item of so few words that one
match reaches the threshold has its words as seeds. So every pair that plain alignment finds is found.

The items are joined map-side, as they are a query set: blocks of at most ``BLOCK_WORDS`` words are broadcast, and
a larger benchmark takes two passes over the documents for each block. Documents aren't shuffled.

Defined cases: null and empty texts match nothing, items without words match nothing; a null id is kept as it is; rows of one id and
repeated rows give a row each, repeated items match as items of their own; other columns are left out and may have any
name; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .textnum import IS_SPACE, LOWER, U64, blocks, flat, mix, span_hashes, word_spans

THRESHOLD, TOGETHER = 0.5, 3
BLOCK_WORDS = 1 << 20
FILTER = 1 << 22
#: Bytes of a word that count: all but ASCII punctuation and control characters; A-Z is lower-cased.
_AS = LOWER.copy()
_AS[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
_CELLS = 1 << 20


#: First bytes of characters of three bytes in scripts without spaces (U+3000 to U+9FFF); after 0xE0 (Thai, Lao) the second.
_ALONE = np.zeros(256, bool)
_ALONE[0xE3:0xEA] = True
_ALONE_E0 = np.zeros(256, bool)
_ALONE_E0[0xB8:0xBC] = True


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without punctuation, and the first word of each row."""
    gone = (_AS[data] == 0x20) & ~IS_SPACE[data]
    kept = np.concatenate(([0], np.cumsum(~gone)))
    data, offsets = _AS[data[~gone]], kept[offsets]
    alone = _ALONE[data]
    alone[:-1] |= (data[:-1] == 0xE0) & _ALONE_E0[data[1:]]
    if alone.any():
        at = np.flatnonzero(alone)
        at = np.sort(np.concatenate((at, at + 3)))
        data, offsets = np.insert(data, at, 0x20), offsets + np.searchsorted(at, offsets)
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def pairs(words: np.ndarray, step: int) -> np.ndarray:
    """A hash of each word and the one ``step`` later; of the word alone for step 0."""
    if not step:
        return mix(words ^ U64(0x632BE59BD9B4E019))
    with np.errstate(over="ignore"):
        return mix(words[:-step] + mix(words[step:] ^ U64(0x5851F42D4C957F2D))) if len(words) > step else np.zeros(0, U64)


STEPS = (0, 1, 2)


class Items:
    """A block of test items and their seeds."""

    def __init__(self, ids: list, words: list[np.ndarray], threshold: float = THRESHOLD):
        self.ids, self.words = ids, words
        self.length = np.array([len(w) for w in words], np.int64)
        #: places that begin a shared pair in every contaminated passage; 0 where one word is enough
        need = np.maximum(np.ceil(threshold * self.length - 1 - 1e-9).astype(np.int64), 0)
        self.together = np.maximum(np.minimum(need, TOGETHER), 1)
        self.places = np.where(need > 0, self.length - 1 - need + self.together, self.length)
        gram, item, place = [], [], []
        for x, w in enumerate(words):
            for step in (1, 2) if need[x] else (0,):
                g = pairs(w, step)
                gram.append(g)
                item.append(np.full(len(g), x))
                place.append(np.arange(len(g)))
        self._seeds(np.concatenate(gram), np.concatenate(item), np.concatenate(place))

    def _seeds(self, gram: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        self.gram, self.number = np.unique(gram, return_inverse=True)
        self.item, self.place = item, place
        self.by_gram = np.argsort(self.number, kind="stable")
        self.at = np.searchsorted(self.number[self.by_gram], np.arange(len(self.gram) + 1))
        self.filter = np.zeros(FILTER, bool)
        self.filter[(self.gram & U64(FILTER - 1)).astype(np.int64)] = True
        self.steps = [s for s in STEPS if s or (self.places[self.item] == self.length[self.item]).any()]

    def keep_rare(self, documents: np.ndarray) -> None:
        """Drop the seeds of the places whose pairs most documents have; ``documents`` has a count for each gram."""
        top = int(self.length.max()) + 1
        key = self.item * top + self.place
        places, at = np.unique(key, return_inverse=True)
        common = np.bincount(at, documents[self.number]).astype(np.int64)
        item = places // top
        order = np.lexsort((places, common, item))
        rank = np.empty(len(places), np.int64)
        rank[order] = np.arange(len(places)) - np.searchsorted(item, item)[order]
        keep = (rank < self.places[item])[at]
        self._seeds(self.gram[self.number[keep]], self.item[keep], self.place[keep])

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``grams`` that are known, and which seed each is."""
        at = np.flatnonzero(self.filter[(grams & U64(FILTER - 1)).astype(np.int64)])
        n = np.searchsorted(self.gram, grams[at])
        n = np.minimum(n, len(self.gram) - 1)
        hit = self.gram[n] == grams[at]
        return at[hit], n[hit]


def _texts(column):
    """Per block of texts: its first row, words, first word of each text."""
    data, offsets = flat(column)
    for i, j in blocks(offsets):
        words, first = plain_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        yield i, words, first


def _hits(items: Items, words: np.ndarray, first: np.ndarray):
    """(place, seed, document) of the seeds that don't cross documents."""
    found = []
    for step in items.steps:
        at, n = items.find(pairs(words, step))
        doc = np.searchsorted(first, at, "right") - 1
        inside = at + step < first[doc + 1]
        found.append((at[inside], n[inside], doc[inside]))
    return tuple(np.concatenate(c) for c in zip(*found))


def document_counts(docs: DataFrame, shared, n: int) -> np.ndarray:
    """How many rows have each seed of a block of items."""
    def count(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            for _, words, first in _texts(batch.column(0)):
                _, seed, doc = _hits(shared.value, words, first)
                total += np.bincount(np.unique(doc * n + seed) % n, minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["seed", "n"])

    out = np.zeros(n, np.int64)
    for r in docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect():
        out[r["seed"]] = r["n"]
    return out


def align(item: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Best local alignment score of an item with each row of padded passages (0 is no word)."""
    n = passages.shape[1]
    before = np.zeros(passages.shape, np.int32)
    best = np.zeros(len(passages), np.int32)
    ramp = np.arange(n, dtype=np.int32)
    for w in item:
        score = np.where(passages == w, np.int32(2), np.int32(-1))
        score[:, 1:] += before[:, :-1]
        np.maximum(score, before - 1, out=score)
        np.maximum(score, 0, out=score)
        # gaps along the passage: the best earlier score less its distance
        before = np.maximum.accumulate(score + ramp, axis=1) - ramp
        np.maximum(best, before.max(1), out=best)
    return best


def bound(item: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """An upper bound of ``align``: a word of the item that a passage has nowhere costs 1 inside an alignment."""
    now = np.zeros(len(passages), np.int32)
    best = now.copy()
    for w in item:
        now = np.maximum(now + np.where((passages == w).any(1), np.int32(2), np.int32(-1)), 0)
        np.maximum(best, now, out=best)
    return best


def _passages(items: Items, hits, first: np.ndarray, threshold: float):
    """(item, document, begin, end, seeds) of the passages to align, each cluster of seeds by itself."""
    at, n, doc = hits
    many = items.at[n + 1] - items.at[n]
    pick = np.repeat(items.at[n] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    which = items.by_gram[pick]
    item, place, doc = items.item[which], items.place[which], np.repeat(doc, many)
    start, length = np.repeat(at, many) - place, items.length
    order = np.lexsort((start, doc, item))
    item, start, doc, place = item[order], start[order], doc[order], place[order]
    # an alignment of at least the threshold has no more gaps than that
    pad = np.ceil(2 * length[item] * (1 - threshold)).astype(np.int64) + 1
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > pad[1:])
    begin_at = np.flatnonzero(new)
    if not len(begin_at):
        return (np.zeros(0, np.int64),) * 5
    last = np.append(begin_at[1:], len(item)) - 1
    top = int(length.max()) + 1
    seeds = np.bincount(np.unique((np.cumsum(new) - 1) * top + place) // top, minlength=len(begin_at))
    enough = seeds >= items.together[item[begin_at]]
    begin_at, last, seeds = begin_at[enough], last[enough], seeds[enough]
    item, doc, low, high = item[begin_at], doc[begin_at], start[begin_at], start[last]
    pad = pad[begin_at]
    return item, doc, np.maximum(low - pad, first[doc]), np.minimum(high + length[item] + pad, first[doc + 1]), seeds


def _scores(items: Items, words: np.ndarray, item, begin, end, threshold: float) -> np.ndarray:
    """The similarity of each passage, 0 where it can't reach the threshold."""
    out = np.zeros(len(item))
    order = np.lexsort((end - begin, item))
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and item[order[j]] == item[order[i]] and (j == i or (j - i + 1) * int(end[order[j]] - begin[order[j]]) <= _CELLS):
            j += 1
        part = order[i:j]
        n = int((end[part] - begin[part]).max())
        place = begin[part][:, None] + np.arange(n)
        rows = np.where(place < end[part][:, None], words[np.minimum(place, len(words) - 1)], U64(0))
        own = items.words[item[order[i]]]
        near = np.flatnonzero(bound(own, rows) / (2 * len(own)) >= threshold)
        out[part[near]] = align(own, rows[near]) / (2 * len(own))
        i = j
    return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, threshold: float, most: int = BLOCK_WORDS) -> Iterator[Items]:
    """The test items in blocks of a bounded number of words, read one partition at a time."""
    ids, words, size = [], [], 0
    rows = benchmark.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    for r in rows.toLocalIterator():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        w = plain_words(data, np.array([0, len(data)]))[0]
        if not len(w):
            continue
        ids.append(r["item"])
        words.append(w)
        size += len(w)
        if size >= most:
            yield Items(ids, words, threshold)
            ids, words, size = [], [], 0
    if ids:
        yield Items(ids, words, threshold)


def _matches(items: Items, texts, threshold: float) -> list[tuple]:
    """(row, item id, score, seeds, begin, end) of the best passage of each contaminated pair."""
    rows = []
    for i, words, first in _texts(texts):
        item, doc, begin, end, seeds = _passages(items, _hits(items, words, first), first, threshold)
        score = _scores(items, words, item, begin, end, threshold)
        best: dict[tuple[int, int], int] = {}
        for x in np.flatnonzero(score >= threshold).tolist():
            key = (int(doc[x]), int(item[x]))
            if key not in best or score[x] > score[best[key]]:
                best[key] = x
        rows += [(i + d, items.ids[t], float(score[x]), int(seeds[x]), int(begin[x] - first[d]), int(end[x] - first[d])) for (d, t), x in best.items()]
    return rows


def seeded(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, threshold: float, block_words: int):
    """Broadcast blocks of items with their rarest seeds in the texts of ``docs`` (a column ``text``)."""
    spark = docs.sparkSession
    for items in item_blocks(benchmark, item_id, item_text, threshold, block_words):
        every = spark.sparkContext.broadcast(items)
        counts = document_counts(docs, every, len(items.gram))
        every.unpersist()
        items.keep_rare(counts)
        yield spark.sparkContext.broadcast(items)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, word_begin, word_end): the best passage of each contaminated pair."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = dict(benchmark.dtypes)[item_id]
    schema = f"doc_id long, item_id {kind}, score double, n_seeds long, word_begin long, word_end long"
    names = ["doc_id", "item_id", "score", "n_seeds", "word_begin", "word_end"]
    spark = docs.sparkSession
    out = None
    for shared in seeded(docs, benchmark, item_id, item_text, threshold, block_words):
        item_type = to_arrow_type(benchmark.schema[item_id].dataType)

        def find(batches, shared=shared, item_type=item_type):
            for batch in batches:
                rows = _matches(shared.value, batch.column("text"), threshold)
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                ids = batch.column("doc_id").take(pa.array(columns[0], pa.int64()))
                kinds = (item_type, pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True)]], names)

        found = docs.mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                      threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, with all their columns, that have no contaminated passage."""
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    for shared in seeded(texts, benchmark, item_id, item_text, threshold, block_words):

        def run(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r[0] for r in _matches(shared.value, batch.column(text_col), threshold)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
