"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bind

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def _spark_form(df: DataFrame, dbl: list[str], lng: list[str]) -> DataFrame:
    def shape(c: str):
        if c in dbl:
            return (F.round(F.col(c).cast("double"), DIGITS) + F.lit(0.0)).alias(c)
        return F.col(c).cast("long").alias(c) if c in lng else F.col(c)
    return df.select(*[shape(c) for c in df.columns])


def _sql_form(sql: str, dbl: list[str], lng: list[str]) -> str:
    swaps = [f"ROUND(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in dbl]
    swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in lng]
    return f"SELECT * REPLACE ({', '.join(swaps)}) FROM (\n{sql}\n)" if swaps else sql


def query(name: str, sql: str | None = None, dbl: str = "", lng: str = ""):
    """Register ``fn(tables) -> DataFrame``; ``dbl``/``lng`` list the real and whole-number columns."""
    d, i = dbl.split(), lng.split()

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: _spark_form(fn(bind.Tables(spark, sf_dir)), d, i)
        if sql is not None:
            ORACLE[name] = _sql_form(bind.with_ctes(sql), d, i)
        return fn
    return wrap
