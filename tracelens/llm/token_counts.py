"""Token counts of whole texts with a two-tier lookup.

Tier one is a table of the lengths of frequent pre-tokens, of at most ``FREQUENT`` entries of at most ``LONGEST``
characters, which is its bound as a broadcast. They are those of a sample of about ``SAMPLE_BYTES`` bytes of text that the driver
reads, so no pre-token is ever shuffled. Tier two is a cache in each worker: a pre-token that tier one
lacks is encoded once by the tokenizer library. The table changes the speed, never a count.

Added tokens of the vocabulary that stand in a text count as the library counts them: the text is
cut there first. Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and ids
give a row each; other columns are left out and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import claim
from .pretokens import Splitter

FREQUENT, LONGEST = 65_536, 64
SAMPLE_BYTES, LONGEST_TEXT = 4 << 20, 1 << 20
CACHED = 400_000
LIMIT = 1024


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lengths(dict):
    """Token counts by pre-token: the broadcast table, and what this worker has encoded since."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(regex.escape(a) for a in sorted(added, key=len, reverse=True))) if added else None
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.splitter = Splitter(public_tokenizers.PATTERN, lambda c: next((k for k, x in (("L", "a"), ("N", "1"), ("O", "!")) if len(cut(x + c)) == 1), "S"))
        self.frequent: dict[str, int] = {}

    def start(self, frequent: dict[str, int]) -> None:
        if frequent is not self.frequent:
            self.frequent = frequent
            self.clear()
            self.update(frequent)

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(self) > CACHED + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        if len(piece) <= 4 * LONGEST:
            self[piece] = n
        return n

    def parts(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut else [text]

    def count(self, text: str) -> int:
        parts = self.parts(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, p)) for part in parts for p in self.splitter.pieces(part))


@lru_cache(maxsize=4)
def lengths(path: str) -> Lengths:
    """One per worker and vocabulary."""
    return Lengths(path)


def frequent_pretokens(docs: DataFrame, text_col: str, path: str, most: int = FREQUENT, size: int = SAMPLE_BYTES) -> list[str]:
    """The most frequent pre-tokens of a sample of about ``size`` bytes of texts of at most ``LONGEST_TEXT`` bytes, read by the driver."""
    text = F.col(f"`{text_col}`").cast("string")
    short = docs.select(text.alias("text")).where(F.octet_length("text") <= LONGEST_TEXT)
    total = short.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    known, counter, seen = lengths(path), Counter(), 0
    for row in short.sample(min(1.0, size / max(total, 1)), seed=7).toLocalIterator():
        seen += len(row["text"])
        if seen > 2 * size:  # a draw far beyond what was asked for
            break
        for part in known.parts(row["text"]):
            for p in known.splitter.pieces(part):
                counter.update(p)
    return [p for p, n in counter.most_common(most) if n > 1 and len(p) <= LONGEST]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                 frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    spark = docs.sparkSession
    known = lengths(path)
    table = {p: len(known.tokenizer.encode(p, add_special_tokens=False).ids) for p in frequent_pretokens(docs, text_col, path, frequent)}
    shared = spark.sparkContext.broadcast(table)

    def count(batches):
        claim("token counts", lengths.cache_clear)
        tiers = lengths(path)
        tiers.start(shared.value)
        for batch in batches:
            tokens = [tiers.count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    return slim.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
