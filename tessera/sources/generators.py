"""Alignments with known truth, generated on the executors: every base is a hash of (seed, lineage, site), so any site can be made anywhere and reruns agree.

Sequence i belongs to the lineage i % lineages.  A lineage differs from the ancestor, and a sequence from its lineage, at
sites picked by hash; a mosaic takes the lineage of its donor inside its tract, which wraps around the origin if it ends before it starts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tract:
    """Sites [start, end) of a recombinant that come from the donor's lineage."""

    recombinant: int
    donor: int
    start: int
    end: int


@dataclass(frozen=True)
class Design:
    n: int
    length: int
    tracts: tuple[Tract, ...]
    lineages: int = 4


# Sizes and tracts of the example library.
DESIGNS = {
    "minimal_triplet": Design(8, 1200, (Tract(0, 1, 360, 760),)),
    "tutorial": Design(12, 2400, (Tract(0, 1, 782, 1538), Tract(4, 1, 795, 1531))),
    "virus_family": Design(36, 12000, (Tract(0, 1, 2100, 4650), Tract(4, 2, 7250, 10300), Tract(8, 3, 4800, 6150))),
    "circular_family": Design(28, 3200, (Tract(0, 1, 2720, 470), Tract(4, 2, 1180, 1940))),
    "segmented": Design(48, 24000, (Tract(0, 1, 0, 6000), Tract(4, 2, 6000, 12000), Tract(8, 3, 12000, 18000))),
    "nested_mosaics": Design(60, 18000, (Tract(0, 1, 2400, 12600), Tract(0, 2, 6050, 7900), Tract(4, 2, 10100, 15800), Tract(8, 3, 16200, 1100))),
    "bacterial_core": Design(72, 80000, tuple(Tract(4 * k, 1 + k % 3, 5000 + 18000 * k, 5000 + 18000 * k + 6400 + 2300 * k) for k in range(4))),
    "outbreak_stress": Design(520, 12000, tuple(Tract(4 * k, 1 + k % 3, 400 * k, 400 * k + 900 + 40 * k) for k in range(24))),
}


def _uniform(*parts: Column) -> Column:
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def planted_sites(spark: SparkSession, n: int, length: int, tracts: Sequence[Tract] = (), lineages: int = 4, seed: int = 1511506142, between: float = 0.12, within: float = 0.01) -> DataFrame:
    """(seq_id, site, base) of an alignment with the given tracts; later tracts lie over earlier ones."""
    site, seq = F.col("site"), F.col("seq_id")
    source = F.pmod(seq, F.lit(lineages))
    for t in tracts:
        inside = (site >= t.start) & (site < t.end) if t.start < t.end else (site >= t.start) | (site < t.end)
        source = F.when((seq == t.recombinant) & inside, F.lit(t.donor % lineages)).otherwise(source)
    cells = spark.range(n * length).select((F.col("id") / length).cast("long").alias("seq_id"), (F.col("id") % length).cast("int").alias("site")).withColumn("lineage", source.cast("int"))

    def changed(base: Column, rate: float, *key: Column) -> Column:
        step = F.floor(_uniform(F.lit(seed), F.lit("step"), *key) * 3).cast("int") + 1
        return F.when(_uniform(F.lit(seed), F.lit("hit"), *key) < rate, (base + step) % 4).otherwise(base)

    base = F.floor(_uniform(F.lit(seed), F.lit("root"), site) * 4).cast("int")
    base = changed(base, between, F.lit("lineage"), F.col("lineage"), site)
    base = changed(base, within, F.lit("sequence"), seq, site)
    return cells.select("seq_id", "site", base.cast("int").alias("base"))


def example(spark: SparkSession, name: str) -> DataFrame:
    """A design of the library as an alignment."""
    d = DESIGNS[name]
    return planted_sites(spark, d.n, d.length, d.tracts, d.lineages)


def truth(spark: SparkSession) -> DataFrame:
    """The tracts of every design."""
    rows = [(name, t.recombinant, t.donor, t.start, t.end, t.start > t.end) for name, d in DESIGNS.items() for t in d.tracts]
    return spark.createDataFrame(rows, "design string, recombinant long, donor long, tract_start int, tract_end int, wraps boolean")
