"""Chunks of documents and two-way packed exchanges.

A chunk is a group of documents of about ``CHUNK_BYTES`` together, chosen by a hash of the row, so
that one task holds a bounded number of bytes of text whatever the sources, keys or copies are (one
longer text is a chunk of its own size). Operators that need corpus-wide facts about the pieces of
a text send each piece's key once *per chunk*, packed by bucket of keys, and get the answers back
packed in the same order. A key that a third of all documents share is one entry per chunk, so no bucket is hot.

The chunked table is read by several branches of one plan; Spark reuses its exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
NULL_ID = np.iinfo(np.int64).max


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES, along: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(id, text, chunk) rows and the number of chunks, in proportion to the bytes of text.

    Columns named in ``along`` travel with the rows as a struct ``rest``.
    """
    rest = [F.struct(*[F.col(f"`{c}`") for c in along]).alias("rest")] if along else []
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *rest)
    size = slim.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("size")).first()["size"] or 0
    n = int(size // chunk_bytes) + 1
    return slim.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n))), n


ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def short_batches(spark: SparkSession, rows: int = 1000, size: int | None = None) -> None:
    """Let Arrow batches hold fewer rows (and bytes) than Spark's defaults, as rows are whole texts; a session's own choice stays."""
    if spark.conf.get(ROWS) == "10000":
        spark.conf.set(ROWS, str(rows))
    if size and spark.conf.get(BYTES).rstrip("bB") == str(64 << 20):
        spark.conf.set(BYTES, str(size))


def in_order(rows: pa.Table) -> pa.Table:
    """A chunk's rows in the same order in every pass: by id (null last), then text."""
    return rows.sort_by([("id", "ascending"), ("text", "ascending")])


def ids_of(rows: pa.Table) -> np.ndarray:
    """Ids as numbers; null is greater than every id."""
    return rows["id"].combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def bucket_edges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of 64-bit values begins among sorted keys (one more than n)."""
    return np.searchsorted(keys, np.array([(b << 64) // n for b in range(n)], np.uint64)).tolist() + [len(keys)]


def array_of(value, dtype) -> np.ndarray:
    """The array packed in a binary value."""
    return np.frombuffer(value.as_buffer() if isinstance(value, pa.Scalar) else value, dtype)
