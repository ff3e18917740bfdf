"""A corpus pipeline: quality rules, near-duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of ``documents``, except for the last.
``run`` applies them to the table ``documents`` with the result of each stage written before the next begins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import blocks, mixing, near, pieces, quality, substring
from tessera.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return quality.judge(docs.select(*COLUMNS)).where("quality.kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Documents without an id are in no group; of rows that share an id one stays."""
    ship(spark)
    kept = near.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi")
    again = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.take(1):
        copies = named.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*(c for c in COLUMNS if c != "doc_id"))).alias("one")).select("doc_id", "one.*")
        named = named.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(copies)
    return named.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words or more that a document with a smaller id has; documents that lose all words go."""
    ship(spark)
    spans = substring.duplicate_spans(docs, carry=("lang", "source", "n_chars"))
    cut = substring.remove_spans(spans.where("n_removed = 0 or n_removed < n_words"))
    return cut.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.select("doc.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, the bytes their spans cover, and a digest of the decoded text."""
    ship(spark)
    return pieces.encode_decode(docs, pieces.default_model(), outputs=("ids", "n_tokens", "n_bytes", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The mix draws documents by a hash that DuckDB does not have, and ids come from a tokenizer: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = blocks.cut_lineage(docs)
    return docs
