"""Projects as JSON lines: one line a sequence and one an event, so that a project of any size is written and read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "kind string, seq_id long, name string, sequence string, event_id string, recombinant long, major long, minor long, tract_start int, tract_end int, p double, status string"
STATUSES = ("unreviewed", "accepted", "rejected")
EVENT = ("event_id", "recombinant", "major", "minor", "tract_start", "tract_end", "p", "status")


def lines(sequences: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of one JSON text: sequences with (seq_id, name, sequence), events with the columns of EVENT."""
    a = sequences.select(F.to_json(F.struct(F.lit("sequence").alias("kind"), "seq_id", "name", "sequence")).alias("value"))
    return a.unionByName(events.select(F.to_json(F.struct(F.lit("event").alias("kind"), *EVENT)).alias("value")))


def save(sequences: DataFrame, events: DataFrame, path: str) -> None:
    lines(sequences, events).write.mode("overwrite").text(path)


def restore(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences and events of JSON lines (value).  Fields out of range are brought into it: tracts into the alignment, p into [0, 1], an unknown status is unreviewed.

    Lines that are not JSON, sequences without an id and events that name a sequence which is not there, or one twice, are left out."""
    rows = texts.select(F.from_json("value", LINE).alias("x")).select("x.*")
    sequences = rows.where("kind = 'sequence' and seq_id is not null").select("seq_id", F.coalesce("name", F.concat(F.lit("Sequence_"), F.col("seq_id") + 1)).alias("name"), F.coalesce("sequence", F.lit("")).alias("sequence"))
    events = rows.where("kind = 'event' and event_id is not null and recombinant <> major and recombinant <> minor and major <> minor").select(*EVENT)
    ids = sequences.select("seq_id", F.length("sequence").alias("length"))
    for role in ("recombinant", "major", "minor"):
        there = ids.select(F.col("seq_id").alias(role), *(["length"] if role == "recombinant" else []))
        events = events.join(there, role)
    bounded = lambda c: F.greatest(F.lit(0), F.least(F.col("length"), F.coalesce(c, F.lit(0))))
    events = events.withColumn("tract_start", bounded("tract_start")).withColumn("tract_end", F.greatest("tract_start", bounded("tract_end")))
    events = events.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl("p", F.lit(1.0)), F.lit(1.0)))))
    status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(STATUSES[0])
    return sequences, events.withColumn("status", status).select(*EVENT)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return restore(spark.read.text(path))
