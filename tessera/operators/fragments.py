"""Fragments of unusual agreement between two of three sequences (or of one against the two others), by a penalised score.

A triplet is read once: the sites at which all three have a base and are not all equal, in six tracks.  In a track a match counts
1 and a mismatch minus a penalty that grows with the share of matches, so a fragment scores above 0 only where matches are denser than
usual.  From every run of matches the fragment goes on while its score stays at or above 0 and ends at the last place of its highest score; one
pass over the runs from right to left with a stack of runs finds all of them.  The fragments of all six tracks then compete in one
queue, the most significant first, and one that meets a fragment taken before is left out."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import scans

# Categories that count as matches by track (0 to 2: the agreeing pair; 6: all differ), and the sequences that are recombinant, minor and major parent.
MATCHES = ((0,), (1,), (2,), (2, 6), (1, 6), (0, 6))
ROLES = ((0, 1, 2), (0, 2, 1), (1, 2, 0), (0, 1, 2), (1, 0, 2), (2, 1, 0))
CRITICAL = 4
FEW_MISMATCHES, LOPSIDED = 3, 10
FRAGMENTS = "track int, recombinant_slot int, minor_slot int, major_slot int, tract_start int, tract_end int, score long, ka double, p double"


def extensions(length: np.ndarray, gap: np.ndarray, penalty: int) -> list[tuple[int, int, int]]:
    """(first run, last run, score) of the fragment from each run of matches: ``length`` of the runs, and mismatches before each."""
    start = np.cumsum(np.concatenate([[0], length[:-1]])) - penalty * np.cumsum(gap)
    end = (start + length).tolist()
    start = start.tolist()
    out: list[tuple[int, int, int]] = []
    # runs whose start no later open run has gone below: (start, highest end reached from there, run of that end)
    open_runs: list[tuple[int, int, int]] = []
    for i in range(len(end) - 1, -1, -1):
        best, last = end[i], i
        while open_runs and open_runs[-1][0] >= start[i]:
            _, reached, run = open_runs.pop()
            if reached >= best:
                best, last = reached, run
        open_runs.append((start[i], best, last))
        out.append((i, last, best - start[i]))
    return out[::-1]


def calibration(sites: int, mismatches: int, penalty: int) -> tuple[float, float] | None:
    """lambda and log(K * sites) of the score's tail; None if scores do not fall off."""
    p, q = mismatches / sites, 1 - mismatches / sites
    if q <= 0 or penalty * p <= q:
        return None
    z = math.exp(2 * math.log(penalty * p / q) / (penalty + 1))
    for _ in range(100):
        step = (q * z + p * z**-penalty - 1) / (q - penalty * p * z ** (-penalty - 1))
        z -= step
        if abs(step) <= 1e-14 * z:
            break
    if z <= 1:
        return None
    k = (z - 1) * (q - penalty * p * z ** (-penalty - 1))
    return (math.log(z), math.log(k * sites)) if k > 0 else None


def tail(ka: float) -> float:
    return -math.expm1(-math.exp(-ka)) if ka < 32 else math.exp(-ka)


def categories(bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and categories of the sites of a triplet that are complete and not all equal."""
    a, b, c = bases
    kind = np.where(a == b, 0, np.where(a == c, 1, np.where(b == c, 2, 6)))
    site = np.flatnonzero((bases < 4).all(axis=0) & ~((a == b) & (b == c)))
    return site, kind[site]


def of_triplet(bases: np.ndarray, scale: float = 1.0, alpha: float = 0.05) -> list[tuple[int, int, int, int, float, float]]:
    """(track, start, end, score, ka, p) of the fragments taken, in the order of the queue."""
    site, kind = categories(bases)
    n = len(site)
    pairs = [n - int((kind == k).sum()) for k in range(3)]
    if n == 0 or min(pairs) == 0 or (min(pairs) < FEW_MISMATCHES and max(pairs) > LOPSIDED * min(pairs)):
        return []
    queue: list[tuple[float, int, int, int, int]] = []
    for track, hits in enumerate(MATCHES):
        match = np.isin(kind, hits)
        mismatches = max(1, n - int(match.sum()))
        penalty = int(n * scale / mismatches) + 1
        known = calibration(n, mismatches, penalty)
        if known is None or not match.any():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], match, [False]])))
        first, last = edges[::2], edges[1::2]
        for i, j, score in extensions(last - first, first - np.concatenate([[0], last[:-1]]), penalty):
            if score >= CRITICAL:
                queue.append((-(known[0] * score - known[1]), track, int(first[i]), int(last[j]), score))
    heapq.heapify(queue)
    taken, out = np.zeros(n, bool), []
    while queue:
        ka, track, first, last, score = heapq.heappop(queue)
        if tail(-ka) > alpha:
            break
        if not taken[first:last].any():
            taken[first:last] = True
            out.append((track, int(site[first - 1]) + 1 if first else 0, int(site[last]) if last < n else bases.shape[1], score, -ka, tail(-ka)))
    return out


def _columns(rows: list[tuple]) -> dict[str, np.ndarray]:
    names = {"triplet": np.int64, "track": np.int32, "recombinant_slot": np.int32, "minor_slot": np.int32, "major_slot": np.int32, "tract_start": np.int32, "tract_end": np.int32, "score": np.int64, "ka": np.float64, "p": np.float64}
    return {k: np.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(names.items())}


def fragments(sites: DataFrame, scale: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """The fragments of all triplets with p of at most ``alpha``: a, b, c, track, recombinant, minor, major, tract, score, ka, p.  A tract reaches to the neighbouring variable sites."""
    whole, n, length = scans.sequences(sites)
    rows = whole.select(F.col("seq_id").alias("row_id"), F.col("seq_id").alias("origin"), "number", "bases")

    def kernel(bases: np.ndarray) -> dict[str, np.ndarray]:
        return _columns([(t, track, *ROLES[track], *rest) for t, triplet in enumerate(bases) for track, *rest in of_triplet(triplet, scale, alpha)])

    found = scans.touching(rows, n, length, n, kernel, FRAGMENTS)
    slot = F.array("a", "b", "c")
    return found.select("a", "b", "c", "track", *(slot[F.col(f"{role}_slot")].alias(role) for role in ("recombinant", "minor", "major")), "tract_start", "tract_end", "score", "ka", "p")
