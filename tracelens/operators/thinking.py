"""Features of long reasoning text and gains between the halves of a block sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def _kchars(c) -> Column:
    return F.nullif(F.length(T._text(c)), F.lit(0)) / F.lit(1000.0)


def rate(c, pattern: str, flags: str = "(?iU)") -> Column:
    """Matches per thousand characters."""
    return F.coalesce(F.try_divide(T.regexp_hits(c, pattern, flags).cast("double"), _kchars(c)), F.lit(0.0))


def matched_share(c, pattern: str) -> Column:
    """Share of the characters that lie inside matches."""
    found = F.regexp_extract_all(T._text(c), F.lit("(?iU)" + pattern), F.lit(0))
    chars = F.aggregate(found, F.lit(0), lambda a, s: a + F.length(s))
    return F.coalesce(F.try_divide(chars.cast("double"), F.length(T._text(c)).cast("double")), F.lit(0.0))


def sentence_share(c, words: str) -> Column:
    """Share of the characters in sentences, dot included, that hold one of the words.

    Sentences are split at dots and searched one by one, which stays linear in the text;
    the dot of a version number such as "Python 3.10" ends no sentence.
    """
    kept = F.regexp_replace(T._text(c), r"(?i)(python 3)\.(?=\d)", "$1,")
    parts = F.split(kept, r"\.")
    ended = F.slice(parts, F.lit(1), F.size(parts) - 1)
    hit = F.filter(ended, lambda s: F.regexp_like(s, F.lit("(?i)" + words)))
    chars = F.aggregate(hit, F.lit(0), lambda a, s: a + F.length(s) + 1)
    return F.coalesce(F.try_divide(chars.cast("double"), F.length(T._text(c)).cast("double")), F.lit(0.0))


def count(c, pattern: str) -> Column:
    return T.regexp_hits(c, pattern, "(?iU)")


def first_mention(c, pattern: str = P.FIX_MENTION) -> Column:
    """Where the pattern first occurs, as a share of the text; 1 when it does not."""
    at = F.regexp_instr(T._text(c), F.lit("(?i)" + pattern))
    return F.when(at > 0, (at - 1) / F.length(T._text(c))).otherwise(1.0)


def first_round(c) -> dict[str, Column]:
    env, pivots = matched_share(c, P.ENVIRONMENT), rate(c, P.PIVOT)
    return {
        "compat_fraction": sentence_share(c, P.COMPAT_WORDS),
        "env_distraction_fraction": env,
        "pivots_per_kchar": pivots,
        "approach_pivots": count(c, P.PIVOT),
        "focus_score": rate(c, P.CODE_STRUCTURE) - env * 10 - pivots * 2,
        "func_refs_per_kchar": rate(c, P.FUNC_REF, "(?U)"),
        "dead_end_count": count(c, P.DEAD_END),
        "fix_mention_position": first_mention(c),
    }


def confusion(actually: Column, interruptions: Column, pivots: Column, diagnoses: Column) -> Column:
    return actually + interruptions + pivots + F.when(diagnoses >= 3, 1.0).otherwise(0.0)


def second_round(c) -> dict[str, Column]:
    actually = rate(c, P.ACTUALLY_START, "(?mU)")
    interrupts = rate(c, P.INTERRUPT_START, "(?mU)")
    confused = confusion(actually, interrupts, rate(c, P.PIVOT), count(c, P.REDIAGNOSIS))
    path = rate(c, P.CODE_PATH)
    precise = (rate(c, P.FUNC_REF, "(?U)") + rate(c, P.FILE_REF, "(?U)") + path + rate(c, P.LINE_REF)
               + rate(c, P.BACKTICK_ID, "(?U)")) / 5
    return {
        "confusion_score": confused, "diagnostic_precision": precise, "reasoning_clarity": precise - confused,
        "dash_density": rate(c, P.DASH, "(?U)"), "actually_density": actually, "code_path_density": path,
        "error_quote_density": rate(c, P.ERROR_QUOTE, "(?U)"), "interruption_rate": interrupts,
    }


def narrative_fraction(text, min_chars: int = 500) -> Column:
    """Aggregate: share of blocks that are long and hold no code fence."""
    long = (F.length(text) > min_chars) & ~F.col(text).contains("```")
    return F.coalesce(F.avg(long.cast("double")), F.lit(0.0))


def half_gain(patterns: list[str], text: str = "text", seq: str = "seq", n: str = "n") -> Column:
    """Aggregate: density per thousand characters in the later half of the blocks minus the earlier half."""
    late = F.col(seq) > F.floor(F.col(n) / 2)
    hits = T.pattern_hits(text, patterns)

    def dens(side: Column) -> Column:
        total = F.sum(F.when(side, hits)).cast("double")
        return F.coalesce(F.try_divide(total, F.sum(F.when(side, F.length(text))).cast("double")) * 1000, F.lit(0.0))

    return dens(late) - dens(~late)
