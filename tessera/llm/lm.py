"""Operator 1: language-model scoring with an n-gram trie in Elias-Fano levels.

The model is a hierarchy of interpolated n-gram models.  P1 is the add-half unigram model of the base
score; for n > 1, Pn(w | c) = count(c w) / (count(c) + MU) + MU / (count(c) + MU) * Pn-1(w | c'), c' being c without
its first word.  Text ends are tokens, and the context of a first word is the end before it.  The first
term is the smoothed probability that the trie stores for the n-gram, in one 16-bit code; with the
weight of the order below, which follows from count(c), the probabilities after a context sum to 1.

Orders are learnt and looked up one after the other, each by one exchange between blocks of documents and
buckets of the n-gram space.  A block sends every distinct n-gram of its documents once, with its count in
training documents, and what is missing from its own counts to count(c), which it knows from the order below.
A bucket adds up, works out the smoothed probabilities, builds its part of the trie, and answers each
block from it.  A bucket's trie is a file mapped into memory (a scratch file of one task, removed at its
end): sorted contexts, monotone pointers to their successors, successors searched relative to their
context, and the codes.  So the model grows with the corpus but no task ever holds more than one bucket
of it, and an n-gram in every document costs one entry a block.

A context seen more than SLICE times is cut into slices by its successors, each of which is a context of its
own in the trie; all blocks know its count, so they cut alike, and "the" is spread over all buckets.
Codes are 0.025 % at most from their probability; counts decoded from them, for the next order, are exact up
to 2,000 and within that of it above.

Words are 64-bit hashes in the unigram model.  In the trie a context has CONTEXT_BITS and a successor, hashed with
its whole context, SUCCESSOR_BITS bits: an unseen n-gram is taken for a seen one with probability
m / 2**56 + s / 2**26 for m stored n-grams and s <= SLICE successors in its slice; two stored ones are taken for one alike.

Results of odd input: null and empty texts have the one token of their end; rows without a doc_id are
training rows; repeated rows count repeatedly and get equal scores; without training rows the base
is log10(0.5 / 0.5) a token; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.blocks import press, unpress
from tessera.llm.eliasfano import Trie, probability, quantise
from tessera.llm.kernel import SPACED, U, Words, distinct_places, mix, pack_sorted, planes, portions, unpack_sorted, unplanes

ORDER = 3
MU = (0.0, 0.0, 300.0, 10.0, 4.0, 4.0)
CONTEXT_BITS, SUCCESSOR_BITS = 30, 26
KEY_BITS = CONTEXT_BITS + SUCCESSOR_BITS
SLICE = 1 << 16
#: Larger blocks than elsewhere: an n-gram is sent once a block, and denser sorted keys take fewer bits each.
BLOCK_BYTES = 8 << 20
END = U(0x5EED0F7E47)
_ODD, _TURN = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
ASKED = "bucket int, block int, keys binary, counts binary, missing binary"
_ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("missing", pa.binary())])
TOLD = "bucket int, block int, told binary, n long, v long"
_TOLD = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("told", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class _Tokens:
    """All tokens of a block in order: hash, row, and whether the row is for training; and what was told about their n-grams so far."""

    def __init__(self, batches: list[pa.RecordBatch], slice_counts: int = SLICE):
        self.slice_counts = slice_counts
        hashes, rows, held, done = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], 0
        for batch in batches:
            held.append(np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool))
            for a, e in portions(batch.column("text")):
                w = Words(batch.column("text").slice(a, e - a), SPACED, lower=True)
                h = np.full(len(w.hash) + e - a, END)
                h[np.arange(len(w.hash)) + w.doc] = w.hash
                hashes.append(h)
                rows.append(np.repeat(np.arange(done, done + e - a), w.count + 1))
                done += e - a
        self.hash, self.row, self.n_rows = np.concatenate(hashes), np.concatenate(rows), done
        self.train = ~np.concatenate(held)[self.row]
        self.starts = np.concatenate([[True], self.row[1:] != self.row[:-1]])
        first = np.flatnonzero(self.starts) if len(self.hash) else np.zeros(0, np.int64)
        self.place = np.arange(len(self.hash)) - np.repeat(first, np.diff(np.append(first, len(self.hash))))
        #: Training counts of the n-gram that ends at each token, of the order last told, and its context's.
        self.count = np.zeros(0, np.int64)
        self.context_count = np.zeros(len(self.hash), np.int64)
        #: Of each order from 2 on: the probability told for each token's n-gram, and the weight of the order below.
        self.terms: list[tuple[np.ndarray, np.ndarray]] = []

    def _context(self, order: int) -> np.ndarray:
        h, n = self.hash, len(self.hash)
        out = np.full(n, U(order))
        for back in range(order - 1, 0, -1):
            before = np.full(n, END)
            before[back:] = h[:-back] if back < n else h[:0]
            before[self.place < back] = END
            out = mix(out * _ODD + before)
        return out

    def keys(self, order: int) -> np.ndarray:
        """Of each token: its hash, or for n-grams the slice of its context and itself in KEY_BITS bits at the top."""
        if order == 1:
            return self.hash
        context = self._context(order)
        own = mix(self.hash + context * _TURN)
        slices = np.maximum(1, -(-self.context_count // self.slice_counts)).astype(U)
        place = np.where(slices > 1, mix(context + (own % slices) * _ODD), context)
        return ((place >> U(64 - CONTEXT_BITS)) << U(SUCCESSOR_BITS) | own >> U(64 - SUCCESSOR_BITS)) << U(64 - KEY_BITS)

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys, and the place of each token's key."""
        return distinct_places(self.keys(order))

    def next_order(self) -> None:
        """The count of each token's next longer context: that of the n-gram that ends one token earlier; ends stand before first words."""
        if len(self.hash):
            ends = self.ends
            self.context_count = np.concatenate([[ends], self.count[:-1]])
            self.context_count[self.starts] = ends

    def hear(self, told: list[list[dict]], mu: tuple[float, ...]) -> None:
        """Takes in the answers to the orders asked so far, from 1 on."""
        for order, answers in enumerate(told, 1):
            parts = [unpress(r["told"]) for r in sorted(answers, key=lambda r: r["bucket"])]
            keys, inverse = self.distinct(order)
            heard = np.concatenate([np.zeros(0, np.int64), *(unplanes(x, np.int64 if order == 1 else np.uint16).astype(np.int64) for x in parts)])
            assert len(heard) == len(keys)
            if order == 1:
                self.unigrams = self.count = heard[inverse]
                self.ends = int(self.count[self.hash == END][0]) if len(self.hash) else 0
            else:
                below = self.context_count + mu[order]
                p = probability(heard)[inverse]
                self.count = np.rint(p * below).astype(np.int64)
                self.terms.append((p, mu[order] / below))
            self.next_order()


def _runs(trained: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the first of each context's, for each key; and the sum of the context's counts."""
    if not len(trained):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = trained >> U(64 - CONTEXT_BITS)
    first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
    size = np.diff(np.append(first, len(trained)))
    return np.repeat(first, size), np.repeat(np.add.reduceat(counts, first), size)


def _missing(trained: np.ndarray, counts: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
    """What these counts lack of their contexts' counts, as differences inside each context: mostly 0."""
    first, own = _runs(trained, counts)
    lack = context_counts - own
    return np.where(first == np.arange(len(first)), lack, lack - np.concatenate([lack[:1], lack[:-1]]))


def _context_counts(trained: np.ndarray, counts: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """The inverse of _missing."""
    first, own = _runs(trained, counts)
    total = np.cumsum(missing)
    return total - total[first] + missing[first] + own


def _ask(block: int, tokens: _Tokens, order: int, n_buckets: int) -> Iterator[dict]:
    keys, inverse = tokens.distinct(order)
    counts = np.bincount(inverse[tokens.train], minlength=len(keys))
    context_counts = np.zeros(len(keys), np.int64)
    context_counts[inverse] = tokens.context_count
    cuts = np.concatenate([[0], np.searchsorted(keys, np.array([(i * 2**64) // n_buckets for i in range(1, n_buckets)], U)), [len(keys)]])
    for b in np.flatnonzero(np.diff(cuts)):
        k, c, of = (x[cuts[b] : cuts[b + 1]] for x in (keys, counts, context_counts))
        missing = press(planes(_missing(k[c > 0], c[c > 0], of[c > 0]))) if order > 1 else b""
        yield {"bucket": int(b), "block": block, "keys": press(pack_sorted(k)), "counts": press(planes(c.astype(np.uint32))), "missing": missing}


def _answer(asked: pa.Table, order: int, mu: float) -> Iterator[dict]:
    """Adds up one bucket's counts, and answers each block in the order of its keys; n and v, the bucket's tokens and words, are told once."""
    rows = asked.to_pylist()
    keys = [unpack_sorted(unpress(r["keys"])) for r in rows]
    counts = [unplanes(unpress(r["counts"]), np.uint32).astype(np.int64) for r in rows]
    every, some = np.concatenate(keys), np.concatenate(counts)
    wanted, place = distinct_places(every)
    total = np.bincount(place, weights=some, minlength=len(wanted)).astype(np.int64)
    if order == 1:
        at = 0
        for r, k in zip(rows, keys, strict=True):
            found = total[place[at : at + len(k)]]
            yield {"bucket": r["bucket"], "block": r["block"], "told": press(planes(found)), "n": 0 if at else int(total.sum()), "v": 0 if at else int((total > 0).sum())}
            at += len(k)
        return
    context = np.zeros(len(wanted), np.int64)
    context[place[some > 0]] = np.concatenate([_context_counts(k[c > 0], c[c > 0], unplanes(unpress(r["missing"]), np.int64)) for r, k, c in zip(rows, keys, counts, strict=True)])
    stored = total > 0
    drop = U(64 - KEY_BITS)
    handle, path = tempfile.mkstemp(suffix=".trie")
    os.close(handle)
    try:
        Trie.write(path, wanted[stored] >> drop, quantise(np.minimum(1.0, total[stored] / (context[stored] + mu))), SUCCESSOR_BITS)
        codes, at = Trie(path, SUCCESSOR_BITS).lookup(wanted >> drop)[place], 0
        for r, k in zip(rows, keys, strict=True):
            yield {"bucket": r["bucket"], "block": r["block"], "told": press(planes(codes[at : at + len(k)])), "n": 0, "v": 0}
            at += len(k)
    finally:
        os.unlink(path)


def _score(batches: list[pa.RecordBatch], tokens: _Tokens, n: int, v: int) -> pa.Table:
    p = (tokens.unigrams + 0.5) / (n + 0.5 * (v + 1))
    base = np.log10(p)
    for term, weight in tokens.terms:
        p = term + weight * p
    by_row = lambda x: np.bincount(tokens.row, weights=x, minlength=tokens.n_rows)
    table = pa.Table.from_batches(batches)
    return pa.Table.from_arrays(
        [table.column("doc_id"), table.column("held_out"), pa.array(np.bincount(tokens.row, minlength=tokens.n_rows).astype(np.int64)), pa.array(by_row(tokens.unigrams > 0).astype(np.int64)), pa.array(np.full(tokens.n_rows, n, np.int64)), pa.array(by_row(base)), pa.array(by_row(np.log10(p)))],
        schema=_SCORES,
    )


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: str = "pmod(crc32(cast(doc_id as string)), 5) = 1", order: int = ORDER, mu: tuple[float, ...] = MU, block_bytes: int = BLOCK_BYTES, slice_counts: int = SLICE) -> DataFrame:
    """Learns from the rows that ``held_out`` (SQL over doc_id) does not name, and scores every row."""
    parts, size = blocks.shuffle_partitions(docs), blocks.text_bytes(docs, text)[1]
    n_blocks, n_buckets = max(parts, math.ceil(size / block_bytes)), max(math.ceil(parts / 2), math.ceil(size // 6 / blocks.BUCKET_KEYS))
    dealt = docs.select(blocks.block_of(doc_id, text, n_blocks).alias("block"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(False)))
    schema = blocks.packed_schema(dealt)
    by_block = blocks.packed(dealt).groupBy("block")
    told: DataFrame | None = None

    def tokens_of(batches: list[pa.RecordBatch], right: pa.Table | None, upto: int) -> _Tokens:
        tokens = _Tokens(batches, slice_counts)
        if right is not None:
            tokens.hear([right.column(f"told_{k}")[0].as_py() for k in range(1, upto)], mu)
        return tokens

    def ask(kind: int, key, texts: pa.Table, right: pa.Table | None = None) -> pa.Table:
        if not texts.num_rows:
            return _ASKED.empty_table()
        return pa.Table.from_pylist(list(_ask(key[0].as_py(), tokens_of(list(blocks.unpacked(texts, schema)), right, kind), kind, n_buckets)), schema=_ASKED)

    def asking(kind: int) -> DataFrame:
        if told is None:
            return by_block.applyInArrow(lambda key, texts: ask(kind, key, texts), ASKED)
        return by_block.cogroup(told.groupBy("block")).applyInArrow(lambda key, texts, right: ask(kind, key, texts, right), ASKED)

    def answering(kind: int) -> DataFrame:
        return asking(kind).groupBy("bucket").applyInArrow(lambda asked: pa.Table.from_pylist(list(_answer(asked, kind, mu[kind])), schema=_TOLD), TOLD)

    for kind in range(1, order + 1):
        # the answers to a block are at most as many as its n-grams
        totals_too = (F.sum("n").alias("n"), F.sum("v").alias("v")) if kind == 1 else ()
        whole = answering(kind).groupBy("block").agg(F.collect_list(F.struct("bucket", "told")).alias(f"told_{kind}"), *totals_too)
        if told is None:
            told, totals = whole.drop("n", "v"), whole.agg(F.struct(F.sum("n").alias("n"), F.sum("v").alias("v")))
        else:
            told = told.join(whole, "block")

    def finish(texts: pa.Table, right: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _SCORES.empty_table()
        both = right.column("totals")[0].as_py()
        batches = list(blocks.unpacked(texts, schema))
        return _score(batches, tokens_of(batches, right, order + 1), both["n"], both["v"])

    return by_block.cogroup(told.withColumn("totals", totals.scalar()).groupBy("block")).applyInArrow(finish, SCORES)


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
