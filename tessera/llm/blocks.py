"""Documents dealt into blocks, and a two-way exchange between blocks and key buckets.

Several operators ask a corpus-wide question about hashes found in documents (how often? in which
smallest document?).  A block of documents asks each distinct hash once, so that a hash in a third of
all rows costs one entry a block, never one a row; the buckets that own ranges of the hash space
answer in the order asked.  Both sides are grouped Arrow functions over Spark shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
BUCKET_KEYS = 1 << 20


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column: one scan, two numbers for the driver."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return row["n"], row["b"] or 0


def block_count(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """Blocks for about block_bytes each, at least two for each shuffle partition; and the bytes."""
    _, size = text_bytes(docs, text)
    return max(2 * shuffle_partitions(docs), math.ceil(size / block_bytes)), size


def block_of(doc_id: str, text: str, n: int) -> Column:
    """Rows of one id stay together; rows without an id are dealt by their text."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.col(text))), F.lit(n)).cast("int")


def packed(dealt: DataFrame) -> DataFrame:
    """block and rows: the rows of a block, as far as one Arrow batch holds them, in zstd.  Texts are exchanged in this form, at about a third of their size."""
    schema = _arrow(dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                block = batch.column("block").to_numpy()
                order = np.argsort(block, kind="stable")
                named, first = np.unique(block[order], return_index=True)
                batch = batch.take(pa.array(order)).cast(schema)
                parts = [press(batch.slice(a, e - a).serialize()) for a, e in zip(first, [*first[1:], len(order)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(named, pa.int32()), pa.array(parts, pa.binary())], names=["block", "rows"])

    return dealt.mapInArrow(run, "block int, rows binary")


def unpacked(rows: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The batches of a block; ``schema`` is that of ``packed_schema``."""
    for part in rows.column("rows"):
        yield pa.ipc.read_record_batch(pa.py_buffer(unpress(part.as_py())), schema)


def _arrow(dealt: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(dealt.schema)


packed_schema = _arrow


def press(blob: bytes) -> bytes:
    """A length and the bytes in zstd, whose entropy coding gets at what Spark's block compressor leaves."""
    return len(blob).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(blob, asbytes=True)


def unpress(blob: bytes) -> bytes:
    return pa.Codec("zstd", 3).decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def bucket_count(docs: DataFrame, keys: int) -> int:
    return max(shuffle_partitions(docs), math.ceil(keys / BUCKET_KEYS))


def shared_dir(df: DataFrame) -> None:
    """Makes the shared folder that the session names the checkpoint folder; only where it names none, as in tests, one of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read back."""
    shared_dir(df)
    return df.checkpoint(eager=True)
