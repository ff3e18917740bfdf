"""Scans of triplets and quartets against loops over sites."""

from itertools import combinations

import numpy as np
import pytest

from tessera.operators import scans


def frame(spark, m):
    return spark.createDataFrame([(i, s, int(m[i, s])) for i in range(m.shape[0]) for s in range(m.shape[1])], "seq_id long, site int, base int")


def test_unrank_counts_through_all_combinations():
    for size in (3, 4):
        got = scans.unrank(np.arange(len(list(combinations(range(11), size)))), size)
        assert sorted(map(tuple, got.tolist())) == list(combinations(range(11), size))
    big = scans.unrank(np.array([10**15]), 3)[0]
    assert sum(int(scans._choose(np.array([m]), k + 1)[0]) for k, m in enumerate(big)) == 10**15


@pytest.mark.parametrize(("n", "half"), [(6, 0), (7, 0), (16, 0), (17, 0), (18, 6), (20, 7), (39, 14), (40, 20), (600, 20)])
def test_half_window(n, half):
    assert scans.half_window(n) == half


def slow_profile(score, site, missing, half):
    """Boundary by boundary, with both windows counted anew."""
    out = [0.0] * len(score)
    for b in range(half, len(score) - half + 1):
        left, right = score[b - half : b].sum(), score[b : b + half].sum()
        if abs(int(left) - int(right)) > 2 and not missing[site[b - half] : site[b + half - 1] + 1].any():
            table = np.array([[left, half - left], [right, half - right]], float)
            expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
            out[b] = float(((table - expected) ** 2 / expected).sum())
    return out


def test_profile_against_loops():
    rng = np.random.default_rng(5)
    missing = rng.random(300) < 0.02
    site = np.flatnonzero(~missing & (rng.random(300) < 0.7))
    score = (rng.random(len(site)) < np.where(site < 150, 0.8, 0.3)).astype(int)
    track = scans.Track(score, site, np.concatenate([[0], np.cumsum(missing)]), 24, False)
    chi = track.profile()
    assert np.allclose(chi, slow_profile(score, site, missing, 12)) and chi.max() > 0
    smooth = track.smooth(chi)
    n = len(chi)
    assert np.allclose(smooth, [np.mean([chi[(k + d) % n] for d in range(-5, 6)]) for k in range(n)])


def planted(length, tracts):
    """Three sequences of informative sites alone: the first is the second, and the third in the tracts."""
    rng = np.random.default_rng(2)
    b = rng.integers(0, 4, length)
    c = (b + rng.integers(1, 4, length)) % 4
    a = b.copy()
    for s, e in tracts:
        a[s:e] = c[s:e]
    return np.stack([a, b, c]).astype(np.uint8)


def test_paired_peaks_are_the_tracts(spark):
    m = planted(640, [(90, 170), (330, 460)])
    found = scans.chi_events(frame(spark, m)).collect()
    maxchi = {(r.tract_start, r.tract_end) for r in found if r.method == "maxchi"}
    assert {(90, 170), (330, 460)} <= maxchi
    target = [r for r in found if r.method == "chimaera" and r.track == 0]
    assert sorted((r.tract_start, r.tract_end) for r in target) == [(90, 170), (330, 460)]
    assert all(r.n == 640 and r.half == 20 and r.p < 1e-6 and not r.wraps and r.left_width >= 20 for r in target)


def test_circular_pair_wraps():
    m = planted(600, [(0, 60), (520, 600)])
    wrapped = [r for r in scans.chi_detector(m, circular=True) if r[4]]
    assert wrapped and all((r[2], r[3]) == (520, 60) for r in wrapped)
    assert not [r for r in scans.chi_detector(m) if r[4]]


def test_no_events_without_shifts():
    same = np.tile(np.arange(300) % 4, (3, 1)).astype(np.uint8)
    assert scans.chi_detector(same) == [] and scans.chi_detector(np.full((3, 50), 4, np.uint8)) == []


def slow_split(w, x, y, z):
    def support(p, q):
        if p[0] == p[1] and q[0] == q[1] and p[0] != q[0]:
            return 2
        if p[0] == p[1] and len({p[0], q[0], q[1]}) == 3:
            return 1
        return int(q[0] == q[1] and len({q[0], p[0], p[1]}) == 3)

    return [0, 0, 0] if max(w, x, y, z) >= 4 else [support((w, x), (y, z)), support((w, y), (x, z)), support((w, z), (x, y))]


def test_quartet_shift_against_loops(spark):
    rng = np.random.default_rng(9)
    m = rng.integers(0, 5, (7, 50)).astype(np.uint8)
    events = [("e1", 1, 3, 5, 12, 31), ("e2", 0, 6, 2, 0, 20)]
    got = {(r.event_id, r.role): (r.shift, r.quartets) for r in scans.quartet_shift(frame(spark, m), spark.createDataFrame(events, "event_id string, recombinant long, major long, minor long, tract_start int, tract_end int")).collect()}
    for name, *candidates, start, end in events:
        for role, candidate in zip(("recombinant", "major", "minor"), candidates, strict=True):
            shifts = []
            for q in combinations(range(7), 4):
                if candidate in q:
                    splits = np.array([slow_split(*(int(m[i, s]) for i in q)) for s in range(50)])
                    inside, outside = splits[start:end].sum(0), np.delete(splits, slice(start, end), axis=0).sum(0)
                    if inside.sum() and outside.sum():
                        shifts.append(np.abs(inside / inside.sum() - outside / outside.sum()).sum())
            assert got[name, role] == (pytest.approx(np.mean(shifts), abs=1e-9), len(shifts))


def test_empty_alignment(spark):
    none = spark.createDataFrame([], "seq_id long, site int, base int")
    assert scans.chi_events(none).count() == 0
