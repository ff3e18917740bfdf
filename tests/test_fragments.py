"""Fragments against a quadratic search, their calibration, and planted tracts."""

import math
import random

import numpy as np
import pytest

from tessera.operators import fragments as f


def quadratic(length, gap, penalty):
    """The fragment of every run by trying all ends."""
    at, start, end = 0, [], []
    for n, g in zip(length, gap, strict=True):
        at -= penalty * g
        start.append(at)
        at += n
        end.append(at)
    out = []
    for i in range(len(length)):
        best, last = end[i], i
        for j in range(i + 1, len(length)):
            if start[j] < start[i]:
                break
            if end[j] >= best:
                best, last = end[j], j
        out.append((i, last, best - start[i]))
    return out


def test_extensions_equal_the_quadratic_search_ties_included():
    rng = random.Random(1)
    ties = 0
    for _ in range(400):
        n = rng.randint(1, 25)
        length, gap = [rng.randint(1, 4) for _ in range(n)], [rng.randint(0 if i == 0 else 1, 3) for i in range(n)]
        penalty = rng.randint(1, 3)
        want = quadratic(length, gap, penalty)
        assert f.extensions(np.array(length), np.array(gap), penalty) == want
        ties += any(last > i and score == length[i] for i, last, score in want)
    assert ties > 20


@pytest.mark.parametrize(("sites", "mismatches", "penalty"), [(100, 40, 3), (300, 20, 16), (50, 49, 2)])
def test_calibration_solves_its_equation(sites, mismatches, penalty):
    rate, constant = f.calibration(sites, mismatches, penalty)
    p, q, z = mismatches / sites, 1 - mismatches / sites, math.exp(rate)
    assert z > 1 and abs(q * z + p * z**-penalty - 1) < 1e-12
    assert abs(math.exp(constant) / sites - (z - 1) * (q - penalty * p * z ** (-penalty - 1))) < 1e-12
    assert f.calibration(10, 1, 2) is None


def whole_search(bases, scale, alpha):
    """The queue as a sort, over all runs and all ends."""
    site, kind = f.categories(bases)
    n, found = len(site), []
    for track, hits in enumerate(f.MATCHES):
        match = [k in hits for k in kind.tolist()]
        mismatches = max(1, match.count(False))
        penalty = math.floor(n * scale / mismatches) + 1
        known = f.calibration(n, mismatches, penalty)
        if known is None:
            continue
        for s in range(n):
            if match[s] and (s == 0 or not match[s - 1]):
                at, best, last = 0, 0, s
                for e in range(s, n):
                    at += 1 if match[e] else -penalty
                    if at < 0:
                        break
                    if at >= best and match[e]:
                        best, last = at, e + 1
                if best >= 4:
                    found.append((-(known[0] * best - known[1]), track, s, last, best))
    taken, out = [], []
    for ka, track, s, e, score in sorted(found):
        if f.tail(-ka) <= alpha and all(e <= a or s >= b for a, b in taken):
            taken.append((s, e))
            out.append((track, site[s - 1] + 1 if s else 0, site[e] if e < n else bases.shape[1], score))
    return out


def test_the_queue_equals_a_sort_of_all_fragments():
    rng, seen = np.random.default_rng(3), 0
    for _ in range(60):
        base = rng.integers(0, 4, 150)
        bases = np.where(rng.random((3, 150)) < 0.5, rng.integers(0, 4, (3, 150)), base)
        a = rng.integers(0, 100)
        bases[0, a : a + 40] = bases[1 + rng.integers(0, 2), a : a + 40]
        bases[rng.random((3, 150)) < 0.03] = 4
        got = f.of_triplet(bases, 1.0, 0.5)
        assert [r[:4] for r in got] == whole_search(bases, 1.0, 0.5)
        seen += len(got)
    assert seen > 60


def test_planted_fragment_and_roles(spark):
    rng = np.random.default_rng(4)
    m = rng.integers(0, 4, (5, 400))
    m[0, 120:180] = m[1, 120:180]
    sites = spark.createDataFrame([(i + 10, s, int(m[i, s])) for i in range(5) for s in range(400)], "seq_id long, site int, base int")
    got = f.fragments(sites, alpha=1e-9).collect()
    assert {(r.a, r.b, r.c) for r in got} == {(10, 11, c) for c in (12, 13, 14)}
    for r in got:
        assert r.track == 0 and (r.recombinant, r.minor, r.major) == (10, 11, r.c)
        # every site between the nearest differing ones
        assert r.tract_start <= 120 and r.tract_end >= 180 and (m[0, r.tract_start : r.tract_end] == m[1, r.tract_start : r.tract_end]).mean() > 0.95


def test_lopsided_and_uniform_triplets_have_none():
    one = np.zeros((3, 50), int)
    assert f.of_triplet(one) == []
    one[2] = 1
    assert f.of_triplet(one) == []
    one[1, :2] = 2
    assert f.of_triplet(one) == []
    assert f.of_triplet(np.full((3, 50), 4)) == []
