"""Tracts of a triplet in which the second of its three agreements outdoes the other two, with the chance of so dense a tract.

Over the sites at which exactly two of three sequences agree, a circular window counts each agreement.  Runs of windows in which one
agreement is strictly ahead of the others are seeds; a seed's tract begins with that agreement's own run of sites and goes on while the
agreement is not behind in the window, or is there itself, and ends at its last site.  This is done for three orders of the agreements: the most frequent with
the second and with the third in its place, and, unless the first rules the whole alignment, the second with the first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import alignment, detectors, scans  # noqa: F401  the views that COUNTS needs
from tessera.plans.operator import TABLES, Operator

# Fixed values of the rule.
WINDOW, LEAST_WINDOW = 30, 5
RULING = 0.7
DENSE = 0.8
LEAST_TRACT = 3
PAIRS = ((0, 1), (0, 2), (1, 2))
EVENTS = "recombinant_slot int, major_slot int, minor_slot int, tract_start int, tract_end int, informative int, tract int, common int, chi_square double, p double"


def roles(home: int, ahead: int) -> tuple[int, int, int]:
    """Recombinant, major and minor parent when one agreement is usual and another is ahead: the recombinant is in both."""
    (recombinant,) = set(PAIRS[home]) & set(PAIRS[ahead])
    return recombinant, sum(PAIRS[home]) - recombinant, sum(PAIRS[ahead]) - recombinant


def orders(count: np.ndarray) -> list[tuple[int, int, int]]:
    """(usual, ahead, third) agreements."""
    first, second, third = sorted(range(3), key=lambda k: (-count[k], k))
    every = [(first, second, third), (first, third, second), (second, first, third)]
    return every if count[first] / count.sum() < RULING else every[:2]


def around(mark: np.ndarray, half: int) -> np.ndarray:
    """Marks within ``half`` places of each place of a circle."""
    total = np.concatenate([[0], np.cumsum(np.concatenate([mark[-half:], mark, mark[:half]]))]) if half else np.concatenate([[0], np.cumsum(mark)])
    return total[2 * half + 1 :] - total[: len(mark)]


def chi_square(table: tuple[int, int, int, int]) -> float:
    a, b, c, d = map(float, table)
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return (a + b + c + d) * (a * d - b * c) ** 2 / margins if margins > 0 else 0.0


def tracts(kind: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int, float, int]]:
    """(usual, ahead, first, last, common, chi-square, count of the agreement ahead) of all tracts, by places among the informative sites."""
    half, n = max(window, LEAST_WINDOW) // 2, len(kind)
    count = np.bincount(kind, minlength=3)
    if n < 2 * half + 1 or count.min() < half // 3:
        return []
    near = [around(kind == k, half) for k in range(3)]
    found: dict[tuple[int, int, int, int], tuple] = {}
    for usual, ahead, third in orders(count):
        own = kind == ahead
        rival = np.maximum(near[usual], near[third])
        leads, holds = near[ahead] > rival, (near[ahead] >= rival) | own
        sums = {k: np.concatenate([[0], np.cumsum(kind == k)]) for k in (usual, ahead)}
        places, others = np.flatnonzero(own), np.flatnonzero(~own)
        ends = np.flatnonzero(~holds)
        for seed in np.flatnonzero(leads & ~np.concatenate([[False], leads[:-1]])).tolist():
            # the agreement's run of sites that reaches the seed, or else its next site
            before = np.searchsorted(others, seed)
            first = int(others[before - 1]) + 1 if before else 0
            if first >= seed:
                later = np.searchsorted(places, seed)
                if later == len(places):
                    continue
                first = int(places[later])
            stop = np.searchsorted(ends, first, "right")
            beyond = int(ends[stop]) if stop < len(ends) else n
            last = int(places[np.searchsorted(places, beyond) - 1])
            tract, common = last - first + 1, int(sums[ahead][last + 1] - sums[ahead][first])
            if tract < LEAST_TRACT or common <= DENSE * (tract - common):
                continue
            inside = common, int(sums[usual][last + 1] - sums[usual][first])
            statistic = chi_square((*inside, int(count[ahead]) - inside[0], int(count[usual]) - inside[1]))
            if statistic > 0:
                found[usual, ahead, first, last] = usual, ahead, first, last, common, statistic, int(count[ahead])
    return list(found.values())


def kernel(window: int) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    def run(bases: np.ndarray) -> dict[str, np.ndarray]:
        rows = []
        for t, (a, b, c) in enumerate(bases):
            category = np.where((a == b) & (a != c), 0, np.where((a == c) & (a != b), 1, np.where((b == c) & (a != b), 2, 3)))
            site = np.flatnonzero((category < 3) & (bases[t] < 4).all(axis=0))
            kind = category[site]
            for usual, ahead, first, last, common, statistic, count in tracts(kind, window):
                rows.append((t, *roles(usual, ahead), site[first], site[last] + 1, len(kind), last - first + 1, common, statistic, count / len(kind)))
        names = ("triplet", "recombinant_slot", "major_slot", "minor_slot", "tract_start", "tract_end", "informative", "tract", "common", "chi_square", "share")
        out = {k: np.array([r[i] for r in rows], np.int64 if k == "triplet" else float if i > 8 else np.int32) for i, k in enumerate(names)}
        return out | {"p": special.identity_p(out["tract"], out["common"], out.pop("share"), out["informative"] - 1)}

    return run


def identity_events(sites: DataFrame, window: int = WINDOW) -> DataFrame:
    """The tracts of all triplets: a, b, c, recombinant, major, minor, tract, informative sites, sites and common sites of the tract, chi_square, p."""
    whole, n, length = scans.sequences(sites)
    rows = whole.select(F.col("seq_id").alias("row_id"), F.col("seq_id").alias("origin"), "number", "bases")
    found = scans.touching(rows, n, length, n, kernel(window), EVENTS)
    slot = F.array("a", "b", "c")
    return found.select("a", "b", "c", *(slot[F.col(f"{r}_slot")].alias(r) for r in ("recombinant", "major", "minor")), "tract_start", "tract_end", "informative", "tract", "common", "chi_square", "p")


#: Informative sites of each triplet, and its two most frequent agreements.
COUNTS = Operator(
    "identity_counts",
    ("informative",),
    lambda d: "SELECT a, b, c, CAST(n AS INT) AS n, CAST(high AS INT) AS high, CAST(n - high - low AS INT) AS medium FROM (SELECT a, b, c, n0 + n1 + n2 AS n, greatest(n0, n1, n2) AS high, least(n0, n1, n2) AS low FROM (SELECT a, b, c, sum(CASE WHEN category = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN category = 1 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN category = 2 THEN 1 ELSE 0 END) AS n2 FROM informative GROUP BY a, b, c) x) y",
    "",
)


def identity_tail(counts: DataFrame) -> DataFrame:
    """Triplets (n, high, medium) with the binomial tail of their most frequent agreement at the rate of the second, and the chance of a tract like that."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            share = np.clip(b.medium / b.n, 1e-12, 1 - 1e-12)
            yield b.assign(tail=special.binomial_tail(b.high, b.n, share), p=special.identity_p(b.n, b.high, share, b.n - 1))

    return counts.mapInPandas(run, "a long, b long, c long, n int, high int, medium int, tail double, p double").select("a", "b", "c", "n", "high", "medium", F.round("tail", 9).alias("tail"), F.round("p", 9).alias("p"))


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, _ = COUNTS._parts(set(TABLES))
    return identity_tail(COUNTS.run(spark, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}))


QUERIES = {"identity_tail": _query}
_SUM = "list_sum([exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) + j * ln(s) + ({n} - j) * ln(1 - s)) FOR j IN range({k}, {n} + 1)])"
ORACLE_SQL = {
    "identity_tail": f"""WITH c AS ({COUNTS.duckdb()}), s AS (SELECT *, greatest(1e-12, least(1 - 1e-12, medium / n)) AS s, least(n, 169) AS m, CASE WHEN n > 169 THEN 169 - CAST(floor((n - high) * 169 / n + 0.5) AS INT) ELSE high END AS k FROM c),
t AS (SELECT *, least(1, {_SUM.format(n='n', k='high')}) AS tail, least(1, {_SUM.format(n='m', k='k')}) * (n - 1) / m AS q FROM s)
SELECT a, b, c, n, high, medium, round(tail, 9) AS tail, round(greatest(1e-300, least(1, CASE WHEN n > 169 THEN CASE WHEN q > 0 THEN pow(q, n / 169) ELSE 0.05 END ELSE q END)), 9) AS p FROM t"""
}
