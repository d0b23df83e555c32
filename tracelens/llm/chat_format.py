"""Chat formatting: records of many layouts become canonical turns, then one reversible text with a loss mask.

The nested field paths of a record (``messages[].role`` and so on) are hashed to a fingerprint. A fingerprint
selects a declarative mapping; it is resolved once, by the mapping whose fields are all there (the one with most fields
wins), so further fields don't matter. Tables of turns and tables with nested columns are mapped as Spark
expressions, by the fingerprint of their schema; JSON records by the fingerprint of each.

A turn is written as ``### role: text</turn>`` and a newline. Inside roles and texts a backslash, the second of
two ``#`` and the slash of ``</`` get a backslash before them (and a role's colon is ``\\c``), so neither mark can stand in
a text and reading back is exact. The loss mask is the span of an assistant's text in the piece.

Pieces are one row per turn, in order; a conversation is their concatenation and is never held as a whole: digests run
over sorted turns as a stream.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), then role, then text, so ties and
repeated rows have one order; a null conversation id is a conversation of its own; a JSON record without a known
layout, or that isn't JSON, gives no turns; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
END = "</turn>"
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: a list field with role and text fields, or fixed roles of plain fields."""

    name: str
    paths: frozenset[str]
    each: str | None = None             # the list field; "" means that a row itself is a turn
    role: str = "role"
    text: str = "text"
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (role, fields joined by a blank line)
    roles: tuple[tuple[str, str], ...] = ()              # other names of roles

    def rename(self, role: str) -> str:
        return dict(self.roles).get(role, role)


_OTHER = (("human", "user"), ("gpt", ASSISTANT), ("bot", ASSISTANT), ("model", ASSISTANT))
MAPPINGS = (
    Mapping("turn rows", frozenset({"turn", "role", "text"}), ""),
    Mapping("messages", frozenset({"messages[].role", "messages[].content"}), "messages", "role", "content", roles=_OTHER),
    Mapping("conversations", frozenset({"conversations[].from", "conversations[].value"}), "conversations", "from", "value", roles=_OTHER),
    Mapping("instruction with input", frozenset({"instruction", "input", "output"}), fixed=(("user", ("instruction", "input")), (ASSISTANT, ("output",)))),
    Mapping("instruction", frozenset({"instruction", "output"}), fixed=(("user", ("instruction",)), (ASSISTANT, ("output",)))),
    Mapping("prompt", frozenset({"prompt", "completion"}), fixed=(("user", ("prompt",)), (ASSISTANT, ("completion",)))),
    Mapping("prompt and response", frozenset({"prompt", "response"}), fixed=(("user", ("prompt",)), (ASSISTANT, ("response",)))),
    Mapping("question", frozenset({"question", "answer"}), fixed=(("user", ("question",)), (ASSISTANT, ("answer",)))),
)


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The nested field paths of a Spark type."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields)) if kind.fields else set()
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else {at}


def value_paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value; null and empty fields have no deeper paths."""
    if isinstance(value, dict):
        return set().union(*(value_paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(value_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


_RESOLVED: dict[str, Mapping | None] = {}


def resolve(paths: set[str]) -> Mapping | None:
    """The mapping of a fingerprint, kept once found."""
    key = fingerprint(paths)
    if key not in _RESOLVED:
        if len(_RESOLVED) > 10_000:
            _RESOLVED.clear()
        _RESOLVED[key] = max((m for m in MAPPINGS if m.paths <= paths), key=lambda m: len(m.paths), default=None)
    return _RESOLVED[key]


TURNS = "conv_id long, turn long, role string, text string"


def _as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def record_turns(value) -> list[tuple[str, str]]:
    """(role, text) of a JSON record."""
    m = resolve(value_paths(value)) if isinstance(value, dict) else None
    if m is None:
        return []
    if m.each is None:
        return [(role, "\n\n".join(x for x in (_as_text(value.get(f)) for f in fields) if x)) for role, fields in m.fixed]
    return [(m.rename(_as_text(t.get(m.role))), _as_text(t.get(m.text))) for t in ([value] if m.each == "" else value.get(m.each) or []) if isinstance(t, dict)]


def turns_of_records(records: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """Canonical turns of JSON records, each of any known layout."""
    def run(batches):
        for batch in batches:
            out = []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(raw) if raw else None
                except ValueError:
                    value = None
                out += [(i, n, r.encode("utf-8", "replace").decode(), t.encode("utf-8", "replace").decode()) for n, (r, t) in enumerate(record_turns(value))]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "turn", "role", "text"])
    return records.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{record_col}`").cast("string")).mapInArrow(run, TURNS)


def turns_of_table(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Canonical turns of a table whose columns have a known layout, as Spark expressions."""
    m = resolve(schema_paths(df.schema) - {id_col})
    if m is None:
        raise ValueError(f"no mapping for fields {sorted(schema_paths(df.schema))}")
    conv = F.col(f"`{id_col}`").cast("long").alias("conv_id")

    def named(role):
        for other, own in m.roles:
            role = F.when(role == other, own).otherwise(role)
        return role

    if m.each == "":
        return df.select(conv, F.col("turn").cast("long").alias("turn"), F.col(m.role).cast("string").alias("role"), F.col(m.text).cast("string").alias("text"))
    if m.each:
        return df.select(conv, F.posexplode(m.each).alias("turn", "t")).select(
            "conv_id", F.col("turn").cast("long").alias("turn"), named(F.col(f"t.`{m.role}`")).cast("string").alias("role"), F.col(f"t.`{m.text}`").cast("string").alias("text"))
    parts = F.array(*[F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *[F.when(F.col(f"`{f}`") != "", F.col(f"`{f}`").cast("string")) for f in fields]).alias("text"))
                      for role, fields in m.fixed])
    return df.select(conv, F.posexplode(parts).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</", "<\\/")


_BACK = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


def piece(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where the loss mask begins and ends in it (nowhere: 0, 0)."""
    head = OPEN + _role(role) + MID
    body = escape(text)
    mask = (len(head), len(head) + len(body)) if role == ASSISTANT else (0, 0)
    return head + body + CLOSE, *mask


@lru_cache(maxsize=1024)
def _role(role: str) -> str:
    return escape(role).replace(":", "\\c")


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    at = 0
    while at < len(formatted):
        mid, end = formatted.index(MID, at), formatted.index(END, at)
        role = _BACK.sub(lambda m: ":" if m[1] == "c" else m[1], formatted[at + len(OPEN):mid])
        yield role, unescape(formatted[mid + len(MID):end])
        at = end + len(CLOSE)


def _sorted(turns: DataFrame) -> DataFrame:
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, piece, loss_begin, loss_end: the pieces whose concatenation is the formatted conversation."""
    def run(batches):
        for batch in batches:
            made = [piece(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array([m[0] for m in made], pa.string()),
                                              pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())],
                                             ["conv_id", "turn", "piece", "loss_begin", "loss_end"])
    return _sorted(turns).mapInArrow(run, "conv_id long, turn long, piece string, loss_begin long, loss_end long")


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, begin: int, end: int) -> None:
        for role, text in read_back(formatted):
            self.all.update(f"{role}\n{text}\n".encode())
            self.turns += 1
        if end > begin:
            masked = unescape(formatted[begin:end])
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from ``format_turns``: turns, their digest, what the loss mask covers, length."""
    def run(batches):
        state, kinds = None, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def table(rows):
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            done = []
            for conv, text, begin, end in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_begin", "loss_end")], strict=True):
                if state is None or conv != state.conv:
                    if state is not None:
                        done.append(state.row())
                    state = _Digest(conv)
                state.add(text, begin, end)
            yield table(done)
        if state is not None:
            yield table([state.row()])
    # a map over a map: the order and the partitions of the pieces are those of the sorted turns
    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
