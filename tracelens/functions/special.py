"""Tail probabilities as SQL expressions over aggregated result rows.

Series and continued fractions run inside ``aggregate`` over a step sequence, so no
Python worker is needed. Arguments are SQL expressions of doubles; null in, null out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 400
_EXACT_DF = 5000
_MINUS_INF = "CAST('-Infinity' AS DOUBLE)"
_ROOT_PI = repr(math.sqrt(math.pi)) + "D"


def _let(values: dict[str, str], body: str) -> str:
    """Name values once for use in ``body`` as ``v.name``."""
    fields = ", ".join(f"'{k}', CAST({x} AS DOUBLE)" for k, x in values.items())
    return f"get(transform(array(named_struct({fields})), v -> {body}), 0)"


def _beta_fraction(a: str, b: str, x: str) -> str:
    """The incomplete beta function's continued fraction in product form."""
    m = "CAST(floor((j + 1) / 2) AS DOUBLE)"
    t = (f"CASE WHEN j % 2 = 1 THEN {m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m})) "
         f"ELSE -({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1)) END")
    first = f"coalesce(try_divide(1D, 1 - ({a} + {b}) * {x} / ({a} + 1)), 1e300D)"
    d = "coalesce(try_divide(1D, 1 + s.t * s.d), 1e300D)"
    c = "(1 + coalesce(try_divide(s.t, s.c), 1e300D))"
    step = (f"get(transform(array(named_struct('t', {t}, 'c', acc.c, 'd', acc.d, 'h', acc.h)), "
            f"s -> named_struct('c', {c}, 'd', {d}, 'h', s.h * {c} * {d})), 0)")
    return f"aggregate(sequence(1, {_STEPS}), named_struct('c', 1D, 'd', {first}, 'h', {first}), (acc, j) -> {step}, acc -> acc.h)"


def _log_gamma_ratio(a: str) -> str:
    """ln(Gamma(a + 1/2) / Gamma(a)): shifted up by 20, then the asymptotic series."""
    y = f"({a} + 20)"
    shift = f"aggregate(sequence(0, 19), 0D, (s, i) -> s + ln(({a} + i) / ({a} + i + 0.5D)))"
    return (f"({shift} + ln({y}) / 2 - 1 / (8 * {y}) + 1 / (192 * pow({y}, 3)) - 1 / (640 * pow({y}, 5)) "
            f"+ 17 / (14336 * pow({y}, 7)))")


def _t_exact(t2: str, df: str) -> str:
    """ln P(T^2 >= t2), the incomplete beta function at (df / 2, 1 / 2)."""
    a, x = "v.a", "v.x"
    front = f"{_log_gamma_ratio(a)} - ln({_ROOT_PI}) + {a} * ln({x}) + 0.5D * ln(1 - {x})"
    low = f"{front} + ln({_beta_fraction(a, '0.5D', x)} / {a})"
    high = f"ln(1 - exp({front}) * {_beta_fraction('0.5D', a, f'(1 - {x})')} / 0.5D)"
    body = f"CASE WHEN {x} >= 1 THEN 0D WHEN {x} <= 0 THEN {_MINUS_INF} WHEN {x} < ({a} + 1) / ({a} + 2.5D) THEN {low} ELSE {high} END"
    return _let({"a": f"({df}) / 2", "x": f"({df}) / (({df}) + {t2})"}, body)


def _t_normal(t2: str, df: str) -> str:
    """The same through the normal deviate of a t value, to third order in 1 / df."""
    a, b, y = "v.a", "(48 * v.a * v.a)", "v.y"
    z = (f"{y} + (pow({y}, 3) + 3 * {y}) / {b} - (4 * pow({y}, 7) + 33 * pow({y}, 5) + 240 * pow({y}, 3) + 855 * {y}) "
         f"/ (10 * {b} * ({b} + 0.8D * pow({y}, 4) + 100))")
    body = _ln_erfc(f"({z}) / {math.sqrt(2)!r}D", "w")
    return _let({"a": f"({df}) - 0.5D", "y": f"sqrt((({df}) - 0.5D) * ln(1 + {t2} / ({df})))"}, body)


def _ln_erfc(z: str, v: str = "v") -> str:
    """ln of the complementary error function for z >= 0."""
    two = f"{v}.z * {v}.z * 2"
    terms = (f"aggregate(sequence(1, 80), named_struct('t', {v}.z, 's', {v}.z), (acc, k) -> named_struct("
             f"'t', acc.t * {two} / (2 * k + 1), 's', acc.s + acc.t * {two} / (2 * k + 1)), acc -> acc.s)")
    near = f"ln(1 - 2 / {_ROOT_PI} * exp(-{v}.z * {v}.z) * {terms})"
    far = f"-{v}.z * {v}.z - ln({_ROOT_PI}) - ln(aggregate(sequence(80, 1, -1), {v}.z, (acc, k) -> {v}.z + (k / 2D) / acc))"
    return f"get(transform(array(named_struct('z', CAST({z} AS DOUBLE))), {v} -> CASE WHEN {v}.z < 2.5 THEN {near} ELSE {far} END), 0)"


def _erfc(z: str) -> str:
    """Complementary error function for z >= 0: a series near 0, a continued fraction beyond."""
    two = "v.z * v.z * 2"
    terms = (f"aggregate(sequence(1, 80), named_struct('t', v.z, 's', v.z), (acc, k) -> named_struct("
             f"'t', acc.t * {two} / (2 * k + 1), 's', acc.s + acc.t * {two} / (2 * k + 1)), acc -> acc.s)")
    near = f"1 - 2 / {_ROOT_PI} * exp(-v.z * v.z) * {terms}"
    far = f"exp(-v.z * v.z) / {_ROOT_PI} / aggregate(sequence(80, 1, -1), v.z, (acc, k) -> v.z + (k / 2D) / acc)"
    return _let({"z": z}, f"CASE WHEN v.z < 2.5 THEN {near} ELSE {far} END")


def t_log_pvalue(t: str, df: str) -> Column:
    """Natural log of the two-sided tail of Student's t, finite far below the least double.

    Up to ``_EXACT_DF`` degrees of freedom by the incomplete beta function, beyond by the normal
    deviate to third order; where they meet they agree to about 1e-10 of the tail.
    """
    t2 = f"({t}) * ({t})"
    return F.expr(f"CASE WHEN ({t}) IS NULL OR ({df}) <= 0 THEN NULL WHEN ({df}) > {_EXACT_DF} THEN {_t_normal(t2, df)} ELSE {_t_exact(t2, df)} END")


def t_pvalue(t: str, df: str) -> Column:
    """Two-sided tail of Student's t."""
    return F.exp(t_log_pvalue(t, df))


def normal_pvalue(z: str) -> Column:
    """Two-sided normal tail."""
    return F.expr(f"CASE WHEN ({z}) IS NOT NULL THEN {_erfc(f'abs({z}) / {math.sqrt(2)!r}D')} END")


def chi2_1df_pvalue(x: str) -> Column:
    return F.expr(f"CASE WHEN ({x}) IS NOT NULL THEN {_erfc(f'sqrt(greatest({x}, 0D) / 2)')} END")


def chi2_even_pvalue(x: str, pairs: str) -> Column:
    """Upper chi-square tail with ``2 * pairs`` degrees of freedom, in closed form with terms in logs."""
    half = f"({x}) / 2"
    total = (f"aggregate(sequence(1, CAST({pairs} AS INT)), named_struct('term', -{half}, 'total', 0D), "
             f"(acc, i) -> named_struct('term', acc.term + ln({half} / i), 'total', acc.total + exp(acc.term)), acc -> acc.total)")
    return F.expr(f"CASE WHEN ({x}) <= 0 THEN 1D ELSE least(1D, {total}) END")
