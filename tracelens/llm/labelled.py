"""Labelled documents for training: a bounded sample, kept apart from the held-out part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODULUS, HELD = 4, 2


def held_out(id_col: str) -> F.Column:
    """True for ids whose crc32 as text leaves the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % MODULUS == HELD


def training_ids(labels: DataFrame, most: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, label) of at most ``most`` labelled rows outside the held-out part, by least hash.

    A row without id or label isn't used; an id with several labels counts with the least.
    """
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL").where(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(most)
