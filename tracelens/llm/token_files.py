"""Token ids in ORC files, in order of document ids.

A file holds a range of document ids as rows (doc_id, first, n, ids): ``first`` is the number of ids before the
document in its file. ORC keeps the integers in run-length encoded streams, cuts a file into stripes that
tasks read apart, and keeps for each ``INDEX_ROWS`` rows the least and greatest doc_id and a Bloom filter of them, so
that ``find_documents`` skips stripes and row groups by metadata. Rows are dealt to files by ranges of (doc_id,
place in the table), so an id that a third of the rows carry is spread over files.

Where a file begins in the whole follows from one row a file (``file_starts``).

Texts are encoded by the tokenizers library. At a space or line end that stands alone, and at a comma or dot behind a letter, the pattern's
cuts don't depend on what is before it, so texts are cut there, and a worker lets the library encode each distinct piece it hasn't kept, all new
pieces of a few megabytes as one text.

Defined cases: null and empty texts are the end id alone; rows of one id follow each other in the order of the
table's files; null ids come first; other columns are left out and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_stage
from .caches import claim
from .textnum import blocks, flat

END, FILE_BYTES, STRIPE_BYTES, INDEX_ROWS = 0, 64 << 20, 16 << 20, 1_000
#: Pieces of texts that a worker keeps, and bytes of text encoded together.
KEPT, AT_ONCE = 900_000, 4 << 20
#: The letters of bytes in byte-level vocabularies: those that can't be seen have letters from 256 on.
BYTE_LETTERS = np.arange(256, dtype="<u4")
BYTE_LETTERS[[*range(0x21), *range(0x7F, 0xA1), 0xAD]] = np.arange(256, 256 + 0x21 + 0x22 + 1)
#: Pieces that are one pre-token whatever the version of Unicode.
WORD = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: White space of one byte, in any library's view.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LETTER, _SIGN = np.zeros((2, 256), bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN[[0x2C, 0x2E]] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where UTF-8 texts can be cut: each text's begin, and before each space or line end between two characters that aren't white space, before a comma or dot behind an ASCII letter."""
    n = len(data)
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    inside = np.ones(n + 1, bool)
    inside[offsets] = False
    at = at[inside[at] & inside[at + 1]]
    byte = lambda d: data[np.clip(at + d, 0, n - 1)]
    white = _WHITE[byte(-1)] | _WHITE[byte(1)]
    wide = np.flatnonzero((byte(-1) | byte(1)) >= 0x80)
    every, at = at, at[wide]
    for a, b, c, x, y in ((-3, -2, -1, -2, -1), (1, 2, 3, 1, 2)):  # a white character of three bytes or two before, behind
        lead, second, third = byte(a), byte(b), byte(c)
        white[wide] |= (byte(x) == 0xC2) & ((byte(y) == 0x85) | (byte(y) == 0xA0))
        white[wide] |= ((lead == 0xE1) & (second == 0x9A) | (lead == 0xE3) & (second == 0x80)) & (third == 0x80)
        white[wide] |= (lead == 0xE2) & ((second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)) | (second == 0x81) & (third == 0x9F))
    sign = np.flatnonzero(_SIGN[data[1:]] & _LETTER[data[:-1]]) + 1
    return np.sort(np.concatenate((offsets[:-1], every[~white], sign[inside[sign]])), kind="stable")


class Encoder:
    """The ids of the tokenizers library for the texts of a buffer."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), kept
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has one letter a byte
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        """Pieces by number; the ids of number k are ``ids[where[k]:where[k + 1]]``, and ``met[k]`` says that later texts had it too."""
        self.number: dict[bytes, int] = {}
        self.ids, self.where, self.met = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def _add(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        self.ids = np.concatenate((self.ids, ids))
        self.where = np.concatenate((self.where, self.where[-1] + np.cumsum(lengths)))
        self.met = np.concatenate((self.met, np.zeros(len(pieces), bool)))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode pieces. All that begin with a space or line end and end without are one text; its ids are cut where the pieces end.

        Of a word the model gets the letters of the vocabulary as they are.
        """
        plain = [p for p in pieces if WORD.fullmatch(p)]
        letters = BYTE_LETTERS[np.frombuffer(b"".join(plain), np.uint8)].tobytes().decode("utf-32-le")
        space = chr(BYTE_LETTERS[0x20])
        self._cut(plain, self.model, letters.replace(space, " " + space))
        plain_ones = set(plain)
        texts = {p: p.decode() for p in pieces if p not in plain_ones}
        joined = [p for p, t in texts.items() if len(t) > 1 and t[0] in " \n" and not t[1].isspace() and not t[-1].isspace()]
        self._cut(joined, self.tokenizer, b"".join(joined).decode())
        alone = list(texts.keys() - set(joined))
        self._add(alone, *self._encode([texts[p] for p in alone]))

    def _cut(self, pieces: list[bytes], tokenizer, text: str) -> None:
        if not pieces:
            return
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        upto, ends = np.cumsum(self.width[ids]), np.cumsum([len(p) for p in pieces])
        last = np.searchsorted(upto, ends)
        if len(last) and (last[-1] >= len(upto) or not np.array_equal(upto[last], ends)):
            raise ValueError("a token goes past a space: not a byte-level vocabulary with spaces before words")
        self._add(pieces, ids, np.diff(last + 1, prepend=0))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        begin = cuts(data, offsets)
        raw = data.tobytes()
        if any(a in raw for a in self.added):  # a text with an added token is one piece
            hit = np.array([any(a in raw[i:j] for a in self.added) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            row = np.searchsorted(offsets, begin, "right") - 1
            begin = begin[~hit[np.clip(row, 0, len(hit) - 1)] | np.isin(begin, offsets)]
        at = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, at, pa.py_buffer(raw)]).dictionary_encode()
        pieces, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        place = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = [pieces[i] for i in np.flatnonzero(place < 0).tolist()]
        self.met[place[place >= 0]] = True
        if len(self.number) + len(new) > self.most:  # go on with what was met again, or with what these texts use
            kept = np.flatnonzero(self.met)
            if 2 * (len(kept) + len(new)) > self.most:
                kept = np.unique(place[place >= 0])
            ids, lengths = gather(self.ids, self.where, kept)
            names, again = list(self.number), np.full(len(self.number) + 1, -1)
            again[kept] = np.arange(len(kept))
            self._forget()
            self._add([names[i] for i in kept.tolist()], ids, lengths)
            place = again[place]
        self._learn(new)
        place[place < 0] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        ids, lengths = gather(self.ids, self.where, place[code])
        # pieces of no bytes are empty texts: each begins where the next one does
        total = np.concatenate(([0], np.cumsum(lengths)))
        first = np.searchsorted(begin, offsets[:-1], "left")
        same = np.arange(len(offsets) - 1) - np.searchsorted(offsets[:-1], offsets[:-1], "left")
        upto = total[np.append(first + same, len(begin))]
        return ids, np.diff(upto)


def gather(ids: np.ndarray, where: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``where[k]:where[k + 1]`` of ids for the numbers k one after another, and their lengths."""
    lengths = where[numbers + 1] - where[numbers]
    end = np.cumsum(lengths)
    at = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(where[numbers] - end + lengths, lengths)
    return ids[at], lengths


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker and vocabulary."""
    return Encoder(path)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Encode every text and write the ids, each document's followed by ``END``, as ORC files under ``path``."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    many = max(size // file_bytes, min(size // (file_bytes // 16), docs.sparkSession.sparkContext.defaultParallelism)) + 1
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("at"))
    files = rows.repartitionByRange(int(many), "doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text", F.spark_partition_id().alias("file"))

    def encode(batches):
        first, known = 0, encoder(vocabulary)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            claim("token files", encoder.cache_clear)
            for i, j in blocks(offsets, AT_ONCE):
                part = batch.slice(i, j - i)
                found, n = known.encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                found, n = np.insert(found, np.cumsum(n), END), n + 1
                at = np.concatenate(([0], np.cumsum(n)))
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), pa.array(first + at[:-1]), pa.array(n), ids], ["file", "doc_id", "first", "n", "ids"])
                first += int(at[-1])

    options = {"orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": INDEX_ROWS, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01, "compression": "zstd"}
    files.mapInArrow(encode, "file int, doc_id long, first long, n long, ids array<int>").write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, first, n, ids) as stored."""
    return spark.read.schema("file int, doc_id long, first long, n long, ids array<int>").orc(path)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, base): the ids in all files before; reads two number columns. A row a file."""
    sizes = read_tokens(spark, path).groupBy("file").agg(F.max(F.col("first") + F.col("n")).alias("size"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))


def find_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The stored rows of a few documents: stripes and row groups without them are skipped by range and Bloom filter."""
    return read_tokens(spark, path).where(F.col("doc_id").isin([int(i) for i in ids]))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files alone."""
    def digest(batches):
        for batch in batches:
            ids, at = batch.column(3), batch.column(3).offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                                             ["file", "doc_id", "first", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("file", "doc_id", "first", "ids").mapInArrow(digest, "file int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return rows.join(file_starts(spark, path), "file").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def stored_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the files (to a new shared folder unless ``path`` is given) and digest what they hold."""
    path = path or new_stage(docs.sparkSession)
    write_tokens(docs, vocabulary, path, id_col, text_col)
    return token_digests(docs.sparkSession, path)
