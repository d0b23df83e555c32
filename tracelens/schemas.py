"""Row layouts and schema conformance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, LongType, StringType, StructType, TimestampType,
)

_TYPES = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(),
          "boolean": BooleanType(), "timestamp": TimestampType()}


def _layout(text: str) -> StructType:
    """Like ``StructType.fromDDL`` for flat layouts, but needs no running session."""
    out = StructType()
    for field in text.split(","):
        name, kind = field.split()
        out = out.add(name, _TYPES[kind])
    return out


RUNS = _layout(
    "run_id string, task_id string, stratum string, model string, phase int, condition string, "
    "replicate_k int, wave int, created_at timestamp, start_time timestamp, end_time timestamp, "
    "task_success int, validation_source string, timed_out boolean, exit_code int, "
    "wall_clock_seconds double, total_tokens bigint, total_tool_calls bigint, "
    "total_state_modifying_calls bigint, error string"
)
TRACE_LINES = _layout("run_id string, line_no bigint, line string")
BLOCKS = _layout(
    "run_id string, line_no bigint, block_pos int, role string, kind string, text string, tool_id string, "
    "tool_name string, input_json string, is_error boolean"
)
CALLS = _layout(
    "run_id string, seq bigint, tool_name string, tool_target string, params_json string, result_json string, "
    "is_error boolean, reasoning_text string, thinking_text string, message_text string, reasoning_token_count int"
)
DECISIONS = _layout(
    "condition string, gate_type string, gate_timing string, run_id string, seq bigint, verdict string, "
    "aligned int, deliberation_length int, reason string"
)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the schema's columns: unknown ones are dropped, missing ones are null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def append(known: DataFrame, new: DataFrame, schema: StructType) -> DataFrame:
    return conform(known, schema).unionByName(conform(new, schema))
