"""Log-gamma, the regularised incomplete beta function and the tails that follow from it, on arrays, for use inside Arrow functions."""

from __future__ import annotations

import math

import numpy as np

# The Lanczos approximation with g = 7 and nine terms.
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
TINY = 1e-300
TERMS, ENOUGH = 500, 1e-15


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers."""
    x = np.asarray(x, float)
    small = x < 0.5
    y = np.where(small, 1 - x, x) - 1
    series = LANCZOS[0] + sum(c / (y + k) for k, c in enumerate(LANCZOS[1:], 1))
    t = y + LANCZOS_G + 0.5
    out = 0.5 * math.log(2 * math.pi) + (y + 0.5) * np.log(t) - t + np.log(series)
    return np.where(small, np.log(math.pi / np.abs(np.sin(math.pi * np.where(small, x, 0.5)))) - out, out)


def _continued_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The fraction of the incomplete beta function, forwards: numerators and denominators are kept as ratios."""

    def away(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < TINY, TINY, v)

    ratio = 1 / away(1 - (a + b) * x / (a + 1))
    value, above = ratio.copy(), np.ones_like(ratio)
    for m in range(1, TERMS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            ratio = 1 / away(1 + term * ratio)
            above = away(1 + term / above)
            change = ratio * above
            value = value * change
        if np.abs(change - 1).max(initial=0) < ENOUGH:
            break
    return value


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The share of the beta distribution below x, for a and b above 0; from the side on which the fraction converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inner = np.clip(x, TINY, 1 - 1e-16)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    left = inner < (a + 1) / (a + b + 2)
    own = _continued_fraction(np.where(left, a, b), np.where(left, b, a), np.where(left, inner, 1 - inner))
    out = np.where(left, front * own / a, 1 - front * own / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.clip(out, 0, 1)))


def binomial_tail(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The chance of at least k successes in n trials."""
    k, n, p = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, n, p)))
    inside = (k > 0) & (k <= n)
    return np.where(k <= 0, 1.0, np.where(inside, incomplete_beta(np.where(inside, k, 1), np.where(inside, n - k + 1, 1), p), 0.0))


def student_t_tail(t: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    """The chance of so large a t of either sign."""
    t, degrees = np.asarray(t, float), np.asarray(degrees, float)
    return incomplete_beta(degrees / 2, 0.5, degrees / (degrees + t * t))


# Tracts are brought to at most this many sites before the binomial tail, and its least result.
MOST_SITES, LEAST_P, NO_P = 169, 1e-300, 0.05


def identity_p(tract: np.ndarray, common: np.ndarray, share: np.ndarray, sites: np.ndarray) -> np.ndarray:
    """The chance of so many common sites in a tract anywhere: a binomial tail times the places of a tract among the sites; long tracts are shrunk and the result raised to the power of the shrinkage."""
    tract, common, share, sites = (np.asarray(v, float) for v in (tract, common, share, sites))
    long = tract > MOST_SITES
    power = np.where(long, tract / MOST_SITES, 1.0)
    n = np.where(long, MOST_SITES, tract)
    k = np.where(long, MOST_SITES - np.floor((tract - common) * MOST_SITES / np.maximum(tract, 1) + 0.5), common)
    p = binomial_tail(k, n, np.clip(share, 1e-12, 1 - 1e-12)) * sites / np.maximum(n, 1)
    p = np.where(long, np.where(p > 0, np.power(np.maximum(p, LEAST_P), power), NO_P), p)
    return np.clip(p, LEAST_P, 1.0)
