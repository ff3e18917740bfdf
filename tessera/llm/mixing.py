"""Operator 8: mixing sources to target weights by capped water-filling.

Sources in code-point order (null last) have the weights 3, 1, 2, repeating.  They share ``total`` (a
multiple of all sizes) in proportion to weight; a source whose share would exceed ``most_epochs``
times its size is clamped there and the excess is shared again by weight.  The fixed point of that
is the water level of the sources sorted by cap / weight, found with one window over the aggregated
table of sources (one row a source, never one row a document).

A source with the target r * size takes every document floor(r) times and a seeded choice of its
documents once more: documents in the order of a seeded hash of their columns, until the running size reaches the
fraction that is left; so the sum misses the target by less than one document.  Rows equal in all columns have one
hash; where the quota ends among them, as many as come nearest to it are taken, by a rank that runs through
the partitions of their written copy.  The running
size is not one long window: documents are dealt into buckets of the hash, bucket totals are summed
first, and only the one bucket of a source that the target falls into is ordered row by row.
All of it is DataFrame work; a source with a third of all rows is spread over all its buckets.

Results of odd input: a null text has size 0 and is taken 0 words; the null source is a source of its
own; repeated rows are documents of their own, told apart by that rank; an empty table gives an empty
result; other input columns are carried by ``mix`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import blocks

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
MOST_EPOCHS = 2.0
SEED = 20240229
MOST_BROADCAST_ROWS = 100_000
WHITE = " \t\n\x0b\x0c\r"


def word_count(text: str) -> Column:
    trimmed = F.btrim(F.col(text), F.lit(WHITE))
    return F.when(F.col(text).isNull() | (trimmed == ""), F.lit(0)).otherwise(F.size(F.split(trimmed, r"[ \x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size, weight and target of each source; sizes has source and size."""
    grouped = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    s = grouped.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
    s = s.withColumns({"budget": F.least(F.sum("source_size").over(everything) * F.lit(float(total)), F.sum("cap").over(everything)), "weights": F.sum("weight").over(everything)})
    below = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(below), F.lit(0.0))))
    # a source floats at the level if that level is under its own cap; the first such level is the water's
    water = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(everything)["level"]
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(water * F.col("weight"), F.col("cap")))).select("source", "source_size", "source_rows", "weight", "target")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most_epochs: float = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row a document: doc (a struct of all its columns), size, source_size, target, and copies (whole repetitions taken)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text) and "map<" not in docs.schema[c].dataType.simpleString()]
    sized = docs.select(F.struct("*").alias("doc"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(F.col(text)), *others).alias("u"))
    slim = blocks.cut_lineage(sized.select("source", "size", "u"))
    targets = blocks.cut_lineage(source_targets(slim, weights, total, most_epochs))
    n_sources, largest = targets.agg(F.count(F.lit(1)), F.max("source_rows")).first()
    few = F.broadcast if n_sources <= MOST_BROADCAST_ROWS else (lambda table: table)
    n = max(16, math.ceil(math.sqrt(largest or 0)))  # as many buckets as rows in each: neither is ordered in one task beyond the root of a source
    bucket = F.floor((F.col("u") / F.lit(2.0**63) + 1) / 2 * n)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # what is left after the whole repetitions, to be taken from the documents in hash order
    quota = targets.select("source", "source_size", "target", F.floor(rate).alias("whole"), (F.col("target") - F.floor(rate) * F.col("source_size")).alias("left"))
    totals = slim.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0))).join(few(quota), totals["source"].eqNullSafe(quota["source"])).drop(quota["source"])
    split = starts.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("size") >= F.col("left")))
    # inside the bucket where the quota ends: rows in hash order, rows of one hash together
    at = slim.withColumn("bucket", bucket).alias("r").join(split.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), "before", "left"), F.expr("r.source <=> s_source and r.bucket = s_bucket"))
    ordered = at.groupBy("r.source", "u", "before", "left").agg(F.sum("r.size").alias("size"), F.count(F.lit(1)).alias("rows"))
    above = Window.partitionBy("source").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    ordered = ordered.withColumn("missing", F.col("left") - F.col("before") - F.coalesce(F.sum("size").over(above), F.lit(0)))
    # the hash at which the quota ends; of its rows, as many as come nearest to it
    cut = ordered.where("missing > 0 and missing <= size").select(F.col("source").alias("c_source"), F.col("u").alias("last_u"), "rows", F.round(F.col("missing") * F.col("rows") / F.col("size")).cast("long").alias("last_rows"))
    plan = quota.join(cut, quota["source"].eqNullSafe(cut["c_source"]), "left").select(F.col("source").alias("q_source"), "source_size", "target", "whole", "last_u", "last_rows", (F.col("last_rows").between(1, F.col("rows") - 1)).alias("some"))
    plan = blocks.cut_lineage(plan)
    joined = sized.join(few(plan), sized["source"].eqNullSafe(plan["q_source"]), "left")
    last = F.coalesce(F.col("u") == F.col("last_u"), F.lit(False))
    chosen = joined.withColumn("extra", F.coalesce(F.col("u") < F.col("last_u"), F.lit(False)) | (last & (F.col("last_rows") > 0)))
    if plan.where("some").take(1):  # equal rows of which only some are taken once more
        split_here = last & F.col("some")
        ranked = _ranked(chosen.where(split_here)).withColumn("extra", F.col("rank") <= F.col("last_rows")).drop("rank")
        chosen = chosen.where(~split_here | ~F.col("some")).unionByName(ranked)
    copies = F.least(F.col("whole") + F.col("extra").cast("long"), F.lit(math.floor(most_epochs)))
    return chosen.select("doc", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(F.least(F.lit(1), copies)).cast("int").alias("copies"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows numbered from 1 within their source; numbers run through the partitions of a written copy, so no task holds a whole source."""
    written = blocks.cut_lineage(rows.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), "earlier")
    within = F.row_number().over(Window.partitionBy("source", "part").orderBy("place"))
    numbered = written.withColumn("within", within).join(parts, written["source"].eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    return numbered.withColumn("rank", F.col("within") + F.col("earlier")).drop("within", "earlier", "p_source", "p_part", "part", "place")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
