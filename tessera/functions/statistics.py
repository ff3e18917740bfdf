"""Probability functions as SQL expressions, for both dialects."""

from __future__ import annotations

# Coefficients of the rational approximations of erfc and of the normal distribution function.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
NORMAL = (0.31938153, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
NORMAL_P, NORMAL_C = 0.2316419, 0.39894228
LEAST_P = "CAST(4.9E-324 AS DOUBLE)"


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = str(f"CAST({coefficients[-1]} AS DOUBLE)")
    for c in reversed(coefficients[:-1]):
        out = f"(CAST({c} AS DOUBLE) + {x} * {out})"
    return out


def erfc(z: str) -> str:
    """Of a value that is not negative."""
    t = f"(CAST(1 AS DOUBLE) / (1 + ({z}) / 2))"
    return f"({t} * exp(-({z}) * ({z}) + {_horner(ERFC, t)}))"


def clamp_p(p: str) -> str:
    return f"greatest({LEAST_P}, least(CAST(1 AS DOUBLE), {p}))"


def chi_square_p(statistic: str) -> str:
    return clamp_p(erfc(f"sqrt(greatest(CAST(0 AS DOUBLE), {statistic}) / 2)"))


def normal_cdf(x: str) -> str:
    """Of a value that is not negative."""
    t = f"(CAST(1 AS DOUBLE) / (1 + CAST({NORMAL_P} AS DOUBLE) * ({x})))"
    return f"(CASE WHEN {x} > 8 THEN CAST(1 AS DOUBLE) ELSE 1 - CAST({NORMAL_C} AS DOUBLE) * exp(-({x}) * ({x}) / 2) * {t} * {_horner(NORMAL, t)} END)"


def chi_square(a: str, b: str, c: str, d: str) -> str:
    """Of a 2 by 2 table, in double precision throughout; 0 where a margin is empty."""
    a, b, c, d = (f"CAST({x} AS DOUBLE)" for x in (a, b, c, d))
    margins = f"(({a} + {b}) * ({c} + {d}) * ({a} + {c}) * ({b} + {d}))"
    return f"(CASE WHEN {margins} > 0 THEN ({a} + {b} + {c} + {d}) * ({a} * {d} - {b} * {c}) * ({a} * {d} - {b} * {c}) / {margins} ELSE CAST(0 AS DOUBLE) END)"


def jukes_cantor(p: str) -> str:
    return f"(CASE WHEN {p} >= 0.749999 THEN CAST(3 AS DOUBLE) ELSE -0.75 * ln(1 - 4 * CAST({p} AS DOUBLE) / 3) END)"


def geneconv_g0(run: str, eligible: str, matches: str) -> str:
    mismatches = f"({eligible} - {matches})"
    mean = f"({mismatches} * power(CAST({matches} AS DOUBLE) / {eligible}, {run}))"
    return f"(CASE WHEN {run} <= 3 OR {matches} <= 0 OR {mismatches} <= 0 THEN CAST(1 AS DOUBLE) ELSE {clamp_p(f'1 - exp(-{mean})')} END)"
