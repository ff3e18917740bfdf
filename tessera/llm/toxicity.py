"""Operator 7: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct words, pairs of neighbouring words and pairs with one word
between, hashed into 2**BITS slots.  Weights are learnt by follow-the-regularised-leader with a
learning rate for each coordinate and L1 sparsity; only non-zero weights leave the training task.  They are
at most 2**BITS numbers, whatever the corpus, so they are broadcast.

The classifier is fitted on at most ``most_rows`` labelled rows (the first in the order of a seeded hash of
the id), which bounds the training task at every corpus size; scoring covers every row.

Results of odd input: null and empty texts get the score of the bias alone; labels that are null
are left out, and of several labels of one id the largest counts; several rows of one labelled id give one
example; without any label all scores are 0; repeated rows get equal scores; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernel import ALNUM, U, Words, mix, portions

BITS = 20
MOST_ROWS = 8000
SEED = 20240229


@dataclass(frozen=True)
class Ftrl:
    """The L1 penalty is l1 times the root of the number of examples."""

    alpha: float = 0.7
    beta: float = 1.0
    l1: float = 0.134
    l2: float = 1.0
    epochs: int = 6


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every feature occurrence; slot 0 is left to the bias."""
    w = Words(texts, ALNUM, lower=True)
    h, doc, shift = w.hash, w.doc, U(64 - bits)
    rows, slots = [doc], [h >> shift]
    for skip in (1, 2):
        if len(h) > skip:
            same = doc[skip:] == doc[:-skip]
            pair = mix(h[:-skip] * U(0xD6E8FEB86659FD93) + h[skip:] + U(skip))
            rows.append(doc[:-skip][same])
            slots.append(pair[same] >> shift)
    return np.concatenate(rows), np.maximum(np.concatenate(slots).astype(np.int64), 1)


def examples(texts: pa.Array, bits: int = BITS) -> list[np.ndarray]:
    """The distinct slots of each text, with the bias."""
    rows, slots = features(texts, bits)
    both = np.unique(rows.astype(np.int64) << bits | slots)
    bounds = np.searchsorted(both >> bits, np.arange(len(texts) + 1))
    return [np.concatenate([[0], both[a:e] & ((1 << bits) - 1)]) for a, e in zip(bounds[:-1], bounds[1:], strict=True)]


def train(texts: pa.Array, labels: np.ndarray, how: Ftrl = Ftrl(), bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:  # noqa: B008
    """Non-zero slots and their weights."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    l1 = how.l1 * np.sqrt(len(labels))

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2)
        w[i == 0] = -zi[i == 0] / ((how.beta + np.sqrt(n[0])) / how.alpha)  # the bias is not shrunk
        return w

    seen = [x for a, e in portions(texts) for x in examples(texts[a:e], bits)]
    for _ in range(how.epochs):
        for i, y in zip(seen, labels, strict=True):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / how.alpha * w
            n[i] += g * g
    w = weights(np.arange(1 << bits))
    return np.flatnonzero(w), w[w != 0]


def fold(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS, how: Ftrl = Ftrl(), bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:  # noqa: B008
    """Weights from a bounded sample of the labelled rows outside the held-out fold."""
    order = F.xxhash64(F.lit(SEED), F.col("id"))
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & (fold("id") != 0))
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(order, "id").limit(most_rows)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # most_rows rows at most: a proven bound
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")).withColumn("o", order)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("o", "ascending"), ("id", "ascending")])
        slots, weights = train(table.column("text").combine_chunks(), table.column("y").to_numpy(), how, bits)
        return pa.table({"slot": pa.array(slots, pa.int32()), "weight": pa.array(weights)})

    rows = sample.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: run(t), "slot int, weight double").collect()
    return np.array([r["slot"] for r in rows], np.int64), np.array([r["weight"] for r in rows], np.float64)


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id and score of every row."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = src.sparkSession.sparkContext.broadcast(weights)
    fitted = len(weights[0]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, values = shared.value
        table = np.zeros(1 << bits)
        table[slots] = values
        bias, table[0] = table[0], 0.0
        for batch in batches:
            for a, e in portions(batch.column("text")):
                part = batch.slice(a, e - a)
                rows, found = features(part.column("text"), bits)
                used = table[found] != 0
                both = np.unique(rows[used].astype(np.int64) << bits | found[used])
                total = bias + np.bincount(both >> bits, weights=table[both & ((1 << bits) - 1)], minlength=e - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))) if fitted else np.zeros(e - a))], names=["doc_id", "score"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
