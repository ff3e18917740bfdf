"""Special functions against exact sums and integrals, and the identity scan against a site-by-site version."""

import math
import random
from fractions import Fraction

import numpy as np

from tessera.functions import special
from tessera.operators import identity


def test_log_gamma_and_incomplete_beta():
    x = np.concatenate([np.linspace(0.05, 3, 60), [10, 100.5, 1e4, 1e6]])
    assert np.allclose(special.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    for a, b in ((0.5, 0.5), (2, 5), (30, 3.5)):
        for v in (0.03, 0.4, 0.97):
            t = (np.arange(400_000) + 0.5) / 400_000
            s = t * t * (3 - 2 * t) * v  # a change of variable that flattens both ends
            density = np.exp((a - 1) * np.log(s) + (b - 1) * np.log1p(-s) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
            assert abs(special.incomplete_beta(a, b, v) - np.mean(density * 6 * t * (1 - t) * v)) < 1e-6
    assert special.incomplete_beta(2, 3, 0) == 0 and special.incomplete_beta(2, 3, 1) == 1


def test_binomial_tail_equals_exact_sums():
    for n, p in ((1, Fraction(1, 3)), (20, Fraction(1, 7)), (169, Fraction(2, 5)), (600, Fraction(9, 10))):
        for k in {0, 1, n // 3, n // 2, n, n + 1}:
            exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))
            assert math.isclose(float(special.binomial_tail(k, n, float(p))), float(exact), rel_tol=1e-9, abs_tol=1e-300)


def test_student_t_tail():
    # one degree of freedom is Cauchy, two have a closed form
    assert math.isclose(float(special.student_t_tail(2.0, 1)), 1 - 2 * math.atan(2.0) / math.pi, rel_tol=1e-10)
    assert math.isclose(float(special.student_t_tail(-1.5, 2)), 1 - 1.5 / math.sqrt(2 + 1.5**2), rel_tol=1e-10)


def test_identity_p_shrinks_long_tracts():
    tail = lambda k, n, s: float(special.binomial_tail(k, n, s))
    assert math.isclose(float(special.identity_p(10, 8, 0.3, 99)), tail(8, 10, 0.3) * 99 / 10)
    assert math.isclose(float(special.identity_p(169, 100, 0.5, 400)), tail(100, 169, 0.5) * 400 / 169)
    assert math.isclose(float(special.identity_p(338, 200, 0.5, 400)), (tail(169 - 69, 169, 0.5) * 400 / 169) ** 2)
    assert special.identity_p(10, 0, 0.3, 99) == 1 and special.identity_p(400, 400, 0.03, 500) == 1e-300
    # a tail that underflows counts as no evidence, as in the rule
    assert special.identity_p(400, 400, 0.001, 500) == 0.05


def slow(kind, window):
    """Every window counted anew, every step one site."""
    half, n = max(window, 5) // 2, len(kind)
    count = [kind.count(k) for k in range(3)]
    if n < 2 * half + 1 or min(count) < half // 3:
        return set()
    high, medium, low = sorted(range(3), key=lambda k: (-count[k], k))
    cycles = [(high, medium, low), (high, low, medium)] + ([(medium, high, low)] if count[high] / n < 0.7 else [])
    near = [[sum(kind[(i + d) % n] == k for d in range(-half, half + 1)) for k in range(3)] for i in range(n)]
    out = set()
    for usual, ahead, third in cycles:
        strict = [w[ahead] > w[usual] and w[ahead] > w[third] for w in near]
        for s in range(n):
            if not strict[s] or (s and strict[s - 1]):
                continue
            first = s
            while first and kind[first - 1] == ahead:
                first -= 1
            while first < n and kind[first] != ahead:
                first += 1
            if first == n:
                continue
            at = first
            while at + 1 < n and (kind[at + 1] == ahead or (near[at + 1][ahead] >= near[at + 1][usual] and near[at + 1][ahead] >= near[at + 1][third])):
                at += 1
            last = max(i for i in range(first, at + 1) if kind[i] == ahead)
            inside = kind[first : last + 1]
            common = inside.count(ahead)
            if len(inside) > 2 and common > 0.8 * (len(inside) - common):
                a, b = common, inside.count(usual)
                c, d = count[ahead] - a, count[usual] - b
                if a * d != b * c and (a + b) * (c + d) * (a + c) * (b + d):
                    out.add((usual, ahead, first, last, common))
    return out


def test_tracts_equal_a_site_by_site_scan():
    rng, seen = random.Random(5), 0
    for _ in range(150):
        n, window = rng.randint(5, 120), rng.choice([3, 8, 15, 30])
        kind = [rng.choices((0, 1, 2), (5, 3, 2))[0] for _ in range(n)]
        a = rng.randrange(n)
        for i in range(a, min(n, a + 25)):
            kind[i] = rng.choices((0, 1, 2), (1, 8, 1))[0]
        want = slow(kind, window)
        assert {r[:5] for r in identity.tracts(np.array(kind), window)} == want
        seen += len(want)
    assert seen > 200


def test_planted_tract_is_exact(spark):
    rng = np.random.default_rng(8)
    # only informative sites: the first sequence is the second outside the tract and the third inside
    b = rng.integers(0, 4, 500)
    c = (b + rng.integers(1, 4, 500)) % 4
    a = b.copy()
    a[200:290] = c[200:290]
    third = rng.random(500) < 0.12
    third[[199, 200, 289, 290]] = False
    a[third] = (np.maximum(b, c)[third] + 1) % 4
    c[third] = b[third]
    sites = spark.createDataFrame([(i, s, int(row[s])) for i, row in enumerate((a, b, c)) for s in range(500)], "seq_id long, site int, base int")
    best = identity.identity_events(sites).orderBy("p").first()
    assert (best.recombinant, best.major, best.minor, best.tract_start, best.tract_end) == (0, 1, 2, 200, 290) and best.p < 1e-20
