"""``python -m tessera INPUT OUTPUT``: an alignment file scanned for recombination; detections as Parquet and a project as JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.plans.catalogue import OPERATORS
from tessera.session import ship
from tessera.sources import project, readers


def scan(spark: SparkSession, source: str, target: str, alpha: float = 0.05) -> None:
    """Writes target/signals (every detection of at most alpha before correction) and target/project (the strongest of each recombinant)."""
    records = readers.finalize(readers.alignment(readers.files(spark, source)))
    sites = readers.sites(records).select("seq_id", "site", "base")
    signals = OPERATORS["three_seq_siegmund"].run(spark, sites=sites).where(F.col("p") <= alpha)
    signals.write.mode("overwrite").parquet(f"{target}/signals")
    found = spark.read.parquet(f"{target}/signals")
    best = found.groupBy("recombinant").agg(F.min_by(F.struct("event_id", "major", "minor", "tract_start", "tract_end", "p"), F.struct("p", -F.col("descent"), "event_id")).alias("e"))
    events = best.select("recombinant", "e.*", F.lit("unreviewed").alias("status"))
    project.save(records.select((F.col("position") - 1).cast("long").alias("seq_id"), "name", "sequence"), events, f"{target}/project")


def main() -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("source", help="a FASTA, CLUSTAL, NEXUS or PHYLIP file")
    parser.add_argument("target", help="a folder for the results")
    parser.add_argument("--alpha", type=float, default=0.05)
    options = parser.parse_args()
    spark = ship(SparkSession.builder.appName("tessera").getOrCreate())
    scan(spark, options.source, options.target, options.alpha)


if __name__ == "__main__":
    main()
