"""Queries that write the test alignment in each file format, five files of it, and read them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.kernels import frame
from tessera.plans.operator import Operator
from tessera.sources import readers

WIDTH = 60
LINES = "array_join(transform(array_sort(collect_list(struct(block, seq_id, line))), x -> x.line), '\\n')"


def written(letters: DataFrame, kind: str) -> DataFrame:
    """path and text of files with the sequences of equal id modulo five, in lines of WIDTH letters."""
    rows = letters.select(F.concat(F.lit("f"), F.col("seq_id") % 5).alias("path"), "seq_id", F.concat(F.lit("n"), "seq_id").alias("name"), "sequence")
    if kind == "fasta":
        lines = rows.select("path", "seq_id", F.lit(0).alias("block"), F.length("sequence").alias("m"), F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace("sequence", f"(.{{{WIDTH}}})", "$1\n")).alias("line"))
    else:
        cut = rows.withColumn("block", F.explode(F.expr(f"sequence(0, int((length(sequence) - 1) / {WIDTH}))")))
        chunk = F.expr(f"substr(sequence, block * {WIDTH} + 1, {WIDTH})")
        named = F.concat("name", F.lit("   "), chunk)
        lines = cut.select("path", "seq_id", "block", F.length("sequence").alias("m"), (F.when(F.col("block") > 0, chunk).otherwise(named) if kind == "phylip" else named).alias("line"))
    body = lines.groupBy("path").agg(F.expr(LINES).alias("body"), F.countDistinct("seq_id").alias("n"), F.max("m").alias("m"))
    text = {"fasta": F.col("body"), "clustal": F.concat(F.lit("CLUSTAL\n\n"), "body"), "nexus": F.concat(F.lit("#NEXUS\nbegin data;\nmatrix\n"), "body", F.lit("\n;\nend;\n")), "phylip": F.concat("n", F.lit(" "), "m", F.lit("\n"), "body")}
    return body.select("path", text[kind].alias("text"))


def _query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        letters = frame(spark, "letters", **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier")})
        return readers.alignment(written(letters, kind))

    return run


#: What is read back is what was written: the sequences by file in the order of their ids.
READ_BACK = Operator("read_back", ("letters",), lambda d: "SELECT concat('f', CAST(seq_id % 5 AS VARCHAR)) AS path, CAST(row_number() OVER (PARTITION BY seq_id % 5 ORDER BY seq_id) AS INT) AS position, concat('n', CAST(seq_id AS VARCHAR)) AS name, sequence FROM letters", "")
QUERIES = {f"read_{kind}": _query(kind) for kind in readers.FORMATS}
