"""Incremental scans: sequences that arrive as a stream are compared with those already there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_pairs(known: DataFrame, arrived: DataFrame) -> DataFrame:
    """Distances of the pairs that involve a sequence which arrived; both sides hold (seq_id, site, base)."""
    fine = F.col("base") < 4
    a = arrived.where(fine).select(F.col("seq_id").alias("new_id"), "site", F.col("base").alias("new_base"))
    k = known.unionByName(arrived).where(fine)
    both = a.join(k, "site").where("new_id <> seq_id")
    return both.groupBy("new_id", "seq_id").agg(F.count(F.lit(1)).alias("valid_sites"), F.sum((F.col("new_base") != F.col("base")).cast("long")).alias("differences"))


def maintain(stream: DataFrame, store: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Keeps a store of sites and a table of pair distances up to date, batch by batch; a batch repeated after a failure is written over itself."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema("seq_id long, site int, base int, batch long").parquet(store).where(F.col("batch") < number).drop("batch")
        new_pairs(known, batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
