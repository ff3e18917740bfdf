"""Operator 11: whitening of embeddings by upper-triangle column aggregates.

Each entry c of a vector becomes the long x = floor(1024 * c) + 100000.  Three aggregations over all vectors, none of which
sends more than a number a pair of dimensions to the driver:

1. Sums.  Rows, exact sums and bounds of every dimension.
2. Covariance.  One SQL expression for every pair of dimensions i <= j, sum((x_i - S_i / n) * (x_j - S_j / n)), all in one
   aggregation: the upper triangle of the covariance.  The driver puts the symmetric matrix together and decomposes it with
   LAPACK (``numpy.linalg.eigh``).  It holds dimension ** 2 numbers, however many rows there are.
3. Check.  The covariance of the whitened values, again one expression a pair, against the identity.

The centre, the components and the check are then constants of one projection over the rows.

A difference of two values near 100000 and a centre is exact to about 1e-11, so centring before multiplying keeps the small
variance that the sum of squares minus the square of the sum would lose.

Results of odd input: vectors that are null, empty, or hold null or non-finite entries, entries beyond 2 ** 43 (whose x and
products leave the range of a long), or another dimension than most (ties: the smaller dimension) are dropped; a row
without an id stays, with a null id; rows of one id are rows of their own; components whose eigenvalue is within rounding of 0 (fewer rows than
dimensions, constant dimensions, copies only) have a null ``whitened`` and are left out of ``identity_error``, which is 0
if no component is left; ``explained`` is 0 where nothing varies; a deviation beyond a long is null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
MOST_ENTRY = 2.0**43
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """n vectors with the sums, the covariance and its components (rows, by falling eigenvalue)."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    #: Whether the sum of squares of n * x - S, and all on the way to it, fits a long for every row.
    narrow: bool

    def alive(self, k: int) -> bool:
        """Whether a component varies by more than rounding."""
        largest = max(float(self.eigenvalues[0]), 0.0)
        return float(self.eigenvalues[k]) > len(self.sums) * np.finfo(float).eps * largest * 8


def fixed_point(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and x (longs) of the vectors that take part, and their dimension."""
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    v = v.where(f"size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) <= {MOST_ENTRY!r}D)")
    widths = v.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = widths[0]["width"] if widths else 0
    x = F.expr(f"transform(v, c -> cast(floor({SCALE} * c) as bigint) + {SHIFT}L)")
    return v.where(F.size("v") == width).select("vec_id", x.alias("x")), width


def upper_triangle(names: list[str]) -> list[str]:
    """SQL of the sums of products of every pair of columns, each once."""
    return [f"sum({a} * {b})" for a, b in combinations_with_replacement(names, 2)]


def _matrix(sums: list[float], width: int, n: int) -> np.ndarray:
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = np.array(sums, float) / n
    return out + np.triu(out, 1).T


def fit(fixed: DataFrame, width: int) -> Whitening | None:
    """Components over all rows; null for a table without any."""
    at = [f"x[{i}]" for i in range(width)]
    every = [f"{f}(cast({a} as decimal(38,0)))" if f == "sum" else f"{f}({a})" for a in at for f in ("sum", "min", "max")]
    first = fixed.selectExpr("count(1)", *every).first() if width else None
    if first is None or not first[0]:
        return None
    n = first[0]
    sums, low, high = ([int(x) for x in first[1 + k :: 3]] for k in range(3))
    centred = fixed.selectExpr(*(f"{a} - {s / n!r}D as d{i}" for i, (a, s) in enumerate(zip(at, sums, strict=True))))
    covariance = _matrix(list(centred.selectExpr(*upper_triangle(centred.columns)).first()), width, n)
    values, vectors = np.linalg.eigh(covariance)
    furthest = [max(n * h - s, s - n * lo) for s, lo, h in zip(sums, low, high, strict=True)]
    narrow = sum(f * f for f in furthest) < 2**63 and n * max(*map(abs, low), *map(abs, high)) < 2**63
    return Whitening(n, tuple(sums), covariance, values[::-1], vectors.T[::-1], narrow)


def _dot(found: Whitening, k: int) -> Column:
    """The projection of a centred row on a component, in units of its deviation."""
    if not found.alive(k):
        return F.lit(None).cast("double")
    weights = found.components[k] / np.sqrt(found.eigenvalues[k])
    return F.expr(" + ".join(f"(x[{i}] - {s / found.n!r}D) * {float(w)!r}D" for i, (s, w) in enumerate(zip(found.sums, weights, strict=True))))


def _deviation(found: Whitening) -> Column:
    if found.narrow:
        return F.expr(" + ".join(f"({found.n}L * x[{i}] - {s}L) * ({found.n}L * x[{i}] - {s}L)" for i, s in enumerate(found.sums)))
    # a difference of over ten digits has a square beyond a long: it becomes null, and so does the sum
    terms = [f"try_cast(cast({found.n}L as decimal(19,0)) * cast(x[{i}] as decimal(19,0)) - cast('{s}' as decimal(38,0)) as decimal(10,0))" for i, s in enumerate(found.sums)]
    return F.expr(f"try_cast({' + '.join(f'{d} * {d}' for d in terms)} as bigint)")


def whitened(fixed: DataFrame, found: Whitening, components: int) -> DataFrame:
    """vec_id, deviation and the whitened values w0, w1, ... of each row."""
    return fixed.select("vec_id", _deviation(found).alias("deviation"), *(_dot(found, k).alias(f"w{k}") for k in range(components)))


def identity_error(values: DataFrame, n: int, names: list[str]) -> float:
    """The largest absolute entry of the covariance of the named columns minus the identity."""
    if not names:
        return 0.0
    means = values.selectExpr(*(f"avg({w})" for w in names)).first()
    centred = values.selectExpr(*(f"{w} - {m!r}D as {w}" for w, m in zip(names, means, strict=True)))
    covariance = _matrix(list(centred.selectExpr(*upper_triangle(names)).first()), len(names), n)
    return float(np.abs(covariance - np.eye(len(names))).max())


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row a vector and component: see RESULT."""
    fixed, width = fixed_point(rows, vec_id, embedding)
    found = fit(fixed, width)
    if found is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    count = min(components, width)
    values = whitened(fixed, found, count)
    error = identity_error(values, found.n, [f"w{k}" for k in range(count) if found.alive(k)])
    trace = float(np.trace(found.covariance))
    told = F.array(*(F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k}").alias("whitened"), F.lit(float(found.eigenvalues[k]) / trace if trace > 0 else 0.0).alias("explained")) for k in range(count)))
    out = values.select("vec_id", "deviation", F.explode(told).alias("told"))
    return out.select("vec_id", "told.component", F.lit(found.n).cast("long").alias("n"), "deviation", "told.whitened", "told.explained", F.lit(error).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
