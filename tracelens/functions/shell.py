"""Which tool calls change state, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

_ASSIGNMENT = r"^(?:[A-Za-z_][A-Za-z_0-9]*=\S*\s+)+"
_REDIRECT = r"[^2]>>?\s"
_SUDO = r"^sudo\s+(?:-\S+\s+)*"


def _any_of(parts: list[str]) -> str:
    return "(?:" + "|".join(re.escape(p) for p in parts) + ")"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize(command: Column) -> Column:
    """Without surrounding blanks, leading assignments and sudo."""
    bare = F.regexp_replace(_strip(F.coalesce(command, F.lit(""))), _ASSIGNMENT, "")
    return _strip(F.regexp_replace(bare, _SUDO, ""))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _program(c: Column) -> Column:
    first = F.coalesce(F.get(_words(c), 0), F.lit(""))
    return F.lower(F.element_at(F.split(first, "/"), -1))


def _pipeline_writes(cmd: Column) -> Column:
    """Only plain read commands may appear between pipes."""
    programs = F.transform(F.split(cmd, r"\|"), _program)
    return F.exists(programs, lambda p: p.isin(P.PIPE_WRITERS) | ~p.isin(P.READ_COMMANDS))


def _sed_writes(cmd: Column) -> Column:
    """-i among the options that precede the script."""
    args = F.slice(_words(cmd), 2, F.size(_words(cmd)))
    folded = F.aggregate(
        args,
        F.struct(F.lit(True).alias("open"), F.lit(False).alias("hit")),
        lambda a, t: F.struct(
            (a["open"] & t.startswith("-") & (t != "--")).alias("open"),
            (a["hit"] | (a["open"] & (t.startswith("-i") | (t == "--in-place")))).alias("hit"),
        ),
    )
    return folded["hit"]


def _simple_writes(cmd: Column, original: Column) -> Column:
    """A single command without separators or pipes."""
    low = F.lower(cmd)
    program = _program(cmd)
    return (
        F.when(low.rlike("^" + _any_of(P.ONE_LINERS)), original.rlike(_any_of(P.ONE_LINER_WRITES)))
        .when(low.rlike("^" + _any_of(P.READ_PREFIXES)), False)
        .when(program.isin(P.READ_COMMANDS), False)
        .when(program == "sed", _sed_writes(cmd))
        .when(program == "find", low.rlike(_any_of(P.FIND_ACTIONS)))
        .otherwise(True)
    )


def _segment_writes(seg: Column) -> Column:
    cmd = seg["cmd"]
    return (
        F.when(cmd == "", False)
        .when(cmd.rlike(_REDIRECT), True)
        .when(cmd.contains("|"), _pipeline_writes(cmd))
        .otherwise(_simple_writes(cmd, seg["raw"]))
    )


def command_modifies(command: Column) -> Column:
    """True when a shell command may change state; unknown commands count as changing.

    The segments between &&, || and ; are judged one by one; a redirect anywhere decides.
    """
    def judged(whole: Column) -> Column:
        parts = F.split(whole["cmd"], r"\s*&&\s*|\s*\|\|\s*|\s*;\s*")
        each = F.transform(parts, lambda p: F.struct(normalize(p).alias("cmd"), p.alias("raw")))
        segments = F.when(F.size(parts) > 1, each).otherwise(F.array(whole))
        return whole["cmd"].rlike(_REDIRECT) | F.exists(segments, _segment_writes)

    given = F.coalesce(command, F.lit(""))
    return F.exists(F.array(F.struct(normalize(given).alias("cmd"), given.alias("raw"))), judged)


def modifies_state(tool: Column, command: Column) -> Column:
    """True for calls that may change state: the unit of analysis."""
    return (
        F.when(tool.isin(P.WRITE_TOOLS), True)
        .when(tool.isin(P.READ_TOOLS), False)
        .when(tool == "Bash", command_modifies(command))
        .otherwise(True)
    )


def unwrap(command: Column) -> Column:
    """The inner command of ``/bin/zsh -lc '…'`` and its like."""
    c = F.regexp_replace(command, r"^\s+|\s+$", "")
    quoted = F.regexp_extract(c, r"""(?s)^/bin/(?:zsh|bash|sh)\s+-\w*c\s+['"](.+)['"]$""", 1)
    plain = F.regexp_extract(c, r"(?s)^/bin/(?:zsh|bash|sh)\s+-\w*c\s+(.+)$", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(plain, F.lit("")), command)
