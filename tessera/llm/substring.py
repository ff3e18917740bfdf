"""Operator 3: substring deduplication by relative Lempel-Ziv parsing.

Every document is factored against the indexed blocks of all documents.  A factor says: these words are those
of a reference document from a word on.  The reference of a window of ``window`` words is the smallest document
that holds it, at its first place there.  Reference blocks are indexed in two steps, spread over buckets
of the hash space:

1. Sieve.  Each window has one anchor, its smallest hash among the ``ANCHOR``-word shingles inside it.
   Equal windows have equal anchors, so only windows whose anchor is found in two documents can be
   repeats.  A block asks each anchor once.
2. Index.  The windows left over go to the bucket of their hash with the smallest document of the block
   that holds them and their place in it; the bucket answers with the reference, if that is a document of
   another block.

A block then parses its documents from left to right: at a window with a smaller reference document it takes the
longest factor, going on as long as the next window's reference is the next word of the same document.  Where
a factor ends, the windows that straddle its end have references of their own and start the next factor, which
may overlap it, so no repeat is lost at factor boundaries.  A factor of k windows is window + k - 1 words, hence
never shorter than ``window``; factors that overlap or touch form a duplicate span.  As references are the smallest
documents, a factor also ends where a still smaller document begins to hold the words: it is the longest in the
references chosen, not over all documents.  Which words are covered does not depend on that.

Windows are compared by 64-bit hashes of word hashes: over n windows two different ones meet with
probability about n * n / 2**65.

Results of odd input: a null text counts as empty; a text of fewer than ``window`` words loses
nothing; rows that share a doc_id never remove each other's words; rows without a doc_id are neither
a reference nor changed; further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.blocks import press, unpress
from tessera.llm.kernel import U, Words, distinct_places, ngrams, pack_sorted, planes, portions, slice_bounds, unpack_sorted, unplanes

WINDOW = 13
ANCHOR = 5
NO_ID = np.iinfo(np.int64).max
ASKED = "bucket int, block int, kind int, keys binary, docs binary, places binary"
SPANS = "doc_id long, text string, n_words long, n_removed long, spans array<struct<first:long,last:long,char_start:long,char_end:long>>, factors array<struct<first:long,length:long,reference_id:long,reference_first:long>>, kept string"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of width values, in log(width) passes."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


class _Parsed:
    """Windows of some texts: hash, anchor, place of the first word, and row."""

    def __init__(self, texts: pa.Array, window: int, anchor: int):
        self.words = w = Words(texts)
        m = len(w.hash) - window + 1
        if m <= 0:
            self.at, self.hash, self.anchor = np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
        else:
            self.hash, self.at = ngrams(w.hash, w.doc, window)
            flat = np.zeros(len(w.hash) - anchor + 1, U)
            shingles, at = ngrams(w.hash, w.doc, anchor)
            flat[at] = shingles
            self.anchor = _sliding_min(flat, window - anchor + 1)[:m][self.at]
        self.row = w.doc[self.at]


def _least(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct key, sorted, with its smallest and its largest document."""
    if not len(keys):
        return keys, docs, docs
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)


def _first_of_least(keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct key, sorted, with its smallest document and the first place there."""
    distinct, inverse = distinct_places(keys)
    least = np.full(len(distinct), NO_ID)
    np.minimum.at(least, inverse, docs)
    place = np.full(len(distinct), np.iinfo(np.int32).max, np.int32)
    own = docs == least[inverse]
    np.minimum.at(place, inverse[own], places[own])
    return distinct, least, place


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(NO_ID).to_numpy(zero_copy_only=False), np.int64)


def _runs(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, _Parsed]]:
    for batch in batches:
        for a, e in portions(batch.column("text")):
            part = batch.slice(a, e - a)
            yield part, a, _ids(part.column("doc_id")), _Parsed(part.column("text"), window, anchor)


def _anchors(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct anchors, and whether two documents of the block hold them."""
    keys, docs = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for _, _, ids, p in _runs(batches, window, anchor):
        new = np.ones(len(p.anchor), bool)
        new[1:] = (p.anchor[1:] != p.anchor[:-1]) | (p.row[1:] != p.row[:-1])
        d = ids[p.row[new]]
        keys.append(p.anchor[new][d != NO_ID])
        docs.append(d[d != NO_ID])
    k, least, most = _least(np.concatenate(keys), np.concatenate(docs))
    return k, least < most


def _rows(buckets: list[int], block: int, kind: int, keys: list[bytes], docs: list[bytes], places: list[bytes]) -> pa.RecordBatch:
    n = len(buckets)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([block] * n, pa.int32()), pa.array([kind] * n, pa.int32()), *(pa.array(x, pa.binary()) for x in (keys, docs, places))], schema=_ASKED_ARROW)


def _asked(block: int, kind: int, keys: np.ndarray, docs: np.ndarray, places: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    cuts = slice_bounds(keys, n_buckets)
    own = [(b, a, e) for b, (a, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > a]
    if own:
        yield _rows([b for b, _, _ in own], block, kind, [press(pack_sorted(keys[a:e])) for _, a, e in own], [press(planes(docs[a:e])) for _, a, e in own], [press(planes(places[a:e])) for _, a, e in own])


def _answers(block: int, kind: int, parts: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    return _rows([p[0] for p in parts], block, kind, *([p[k] for p in parts] for k in (1, 2, 3)))


def _gather(asked: pa.Table) -> tuple[list[dict], list[dict]]:
    """Rows to answer (kind 0 or 1), and rows that only pass through (kind 2)."""
    rows = asked.to_pylist()
    return [r for r in rows if r["kind"] < 2], [r for r in rows if r["kind"] == 2]


def _sieve_bucket(asked: pa.Table) -> pa.Table:
    """Answers, bit by bit, whether an anchor is in two documents."""
    rows, _ = _gather(asked)
    out = []
    keys = [unpack_sorted(unpress(r["keys"])) for r in rows]
    many = [np.frombuffer(unpress(r["docs"]), np.uint8).astype(bool) for r in rows]
    distinct, inverse = distinct_places(np.concatenate(keys))
    shared = np.bincount(inverse, minlength=len(distinct)) > 1
    shared[inverse[np.concatenate(many)]] = True
    hit, at = shared[inverse], 0
    for r, k in zip(rows, keys, strict=True):
        out.append(_answers(r["block"], 2, [(r["bucket"], np.packbits(hit[at : at + len(k)]).tobytes(), b"", b"")]))
        at += len(k)
    return pa.Table.from_batches(out, schema=_ASKED_ARROW)


def _index_bucket(asked: pa.Table) -> pa.Table:
    """Answers, bit by bit, whether a window starts in a document smaller than any of the asking block's own; and where, for those that do."""
    rows, passed = _gather(asked)
    out = [_answers(r["block"], 2, [(r["bucket"], r["keys"], b"", b"")]) for r in passed]
    if not rows:
        return pa.Table.from_batches(out, schema=_ASKED_ARROW)
    keys = [unpack_sorted(unpress(r["keys"])) for r in rows]
    own = np.concatenate([unplanes(unpress(r["docs"]), np.int64) for r in rows])
    places = np.concatenate([unplanes(unpress(r["places"]), np.int32) for r in rows])
    distinct, inverse = distinct_places(np.concatenate(keys))
    least = np.full(len(distinct), NO_ID)
    np.minimum.at(least, inverse, own)
    first = np.zeros(len(distinct), np.int32)
    holds = least[inverse] == own
    first[inverse[holds]] = places[holds]
    hit, at = ~holds, 0
    for r, k in zip(rows, keys, strict=True):
        part = slice(at, at + len(k))
        some = inverse[part][hit[part]]
        out.append(_answers(r["block"], 1, [(r["bucket"], np.packbits(hit[part]).tobytes(), press(planes(least[some])), press(planes(first[some])))]))
        at += len(k)
    return pa.Table.from_batches(out, schema=_ASKED_ARROW)


def _told(answers: pa.Table, kind: int, keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bits told of the block's sorted keys, put together again from the buckets."""
    out, cuts = np.zeros(len(keys), bool), slice_bounds(keys, n_buckets)
    for r in answers.to_pylist():
        if r["kind"] == kind:
            a, e = cuts[r["bucket"]], cuts[r["bucket"] + 1]
            out[a:e] = np.unpackbits(np.frombuffer(r["keys"], np.uint8), count=e - a).astype(bool)
    return out


def _references(answers: pa.Table, keys: np.ndarray, least: np.ndarray, first: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document of each window and its place there: those told, or the block's own where no other block has a smaller one."""
    hit = _told(answers, 1, keys, n_buckets)
    told = sorted((r["bucket"], r["docs"], r["places"]) for r in answers.to_pylist() if r["kind"] == 1)
    least, first = least.copy(), first.copy()
    least[hit] = np.concatenate([np.zeros(0, np.int64), *(unplanes(unpress(d), np.int64) for _, d, _ in told)])
    first[hit] = np.concatenate([np.zeros(0, np.int32), *(unplanes(unpress(p), np.int32) for _, _, p in told)])
    return least, first


def _sieved(keys: np.ndarray, shared: np.ndarray, p: _Parsed, ids: np.ndarray) -> np.ndarray:
    """Which windows stand on a shared anchor and have a document id."""
    left = keys[shared]
    if not len(left) or not len(p.anchor):
        return np.zeros(len(p.anchor), bool)
    at = np.minimum(np.searchsorted(left, p.anchor), len(left) - 1)
    return (left[at] == p.anchor) & (ids[p.row] != NO_ID)


def _windows(batches: list[pa.RecordBatch], keys: np.ndarray, shared: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, docs, places = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for _, _, ids, p in _runs(batches, window, anchor):
        on = _sieved(keys, shared, p, ids)
        found.append(p.hash[on])
        docs.append(ids[p.row[on]])
        places.append((p.at[on] - p.words.first[p.row[on]]).astype(np.int32))
    return _first_of_least(np.concatenate(found), np.concatenate(docs), np.concatenate(places))


def _factors(at: np.ndarray, reference: np.ndarray, place: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Factors (first word, words, reference document, its first word) from the sorted places of repeated windows and their references."""
    if not len(at):
        return []
    goes_on = (np.diff(at) == 1) & (np.diff(reference) == 0) & (np.diff(place) == 1)
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    size = np.diff(np.append(first, len(at))) + window - 1
    return list(zip(at[first].tolist(), size.tolist(), reference[first].tolist(), place[first].tolist(), strict=True))


def _covered(factors: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Spans [first, last) of factors that overlap or touch."""
    out: list[tuple[int, int]] = []
    for first, size, _, _ in factors:
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], first + size)
        else:
            out.append((first, first + size))
    return out


def _parse(batches: list[pa.RecordBatch], answers: pa.Table, window: int, anchor: int, n_buckets: int, carry: list[str]) -> Iterator[pa.RecordBatch]:
    anchors, _ = _anchors(batches, window, anchor)
    shared = _told(answers, 2, anchors, n_buckets)
    keys, least, first = _windows(batches, anchors, shared, window, anchor)
    least, first = _references(answers, keys, least, first, n_buckets)
    for part, _, ids, p in _runs(batches, window, anchor):
        on = np.flatnonzero(_sieved(anchors, shared, p, ids))
        at = np.searchsorted(keys, p.hash[on])
        smaller = least[at] < ids[p.row[on]]
        repeat, at = on[smaller], at[smaller]
        w, rows = p.words, []
        bounds = np.searchsorted(p.row[repeat], np.arange(len(ids) + 1))
        blob = w.raw.tobytes()
        for d, (doc_id, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)):
            a, n = int(w.first[d]), int(w.count[d])
            own = slice(bounds[d], bounds[d + 1])
            factors = _factors(p.at[repeat[own]] - a, least[at[own]], first[at[own]], window)
            spans = _covered(factors)
            cuts = [0, *(x for s in spans for x in s), n]
            kept, out, origin = [], [], int(w.offsets[d])
            for i in range(0, len(cuts), 2):
                kept += [blob[w.start[j] : w.end[j]] for j in range(a + cuts[i], a + cuts[i + 1])]
            for f, e in spans:
                starts, ends = int(w.start[a + f]), int(w.end[a + e - 1])
                out.append({"first": f, "last": e, "char_start": len(blob[origin:starts].decode()), "char_end": len(blob[origin:ends].decode())})
            told = [{"first": f, "length": k, "reference_id": r, "reference_first": q} for f, k, r, q in factors]
            rows.append({"doc_id": doc_id, "text": text, "n_words": n, "n_removed": sum(e - f for f, e in spans), "spans": out, "factors": told, "kept": b" ".join(kept).decode()})
        if rows:
            made = pa.RecordBatch.from_pylist(rows, schema=_SPANS_ARROW)
            yield pa.RecordBatch.from_arrays([*made.columns, *(part.column(c) for c in carry)], names=[*made.schema.names, *carry])


_SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64())]))), ("factors", pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64()), ("reference_id", pa.int64()), ("reference_first", pa.int64())]))), ("kept", pa.string())])


def duplicate_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = blocks.BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: text, n_words, n_removed, the duplicate spans (words and characters, half open), the factors they are made of, the kept words joined by a space, and the input columns named in carry."""
    if not 1 <= anchor <= window:
        raise ValueError("anchor must be between 1 and window")
    n_blocks, size = blocks.block_count(docs, text, block_bytes)
    n_buckets = blocks.bucket_count(docs, size // 16)
    dealt = docs.select(blocks.block_of(doc_id, text, n_blocks).alias("block"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    carried = [f"carried_{c}" for c in carry]

    schema = blocks.packed_schema(dealt)

    def ask(key, texts):
        keys, many = _anchors(list(blocks.unpacked(texts, schema)), window, anchor)
        return pa.Table.from_batches(list(_asked(key[0].as_py(), 0, keys, many.astype(np.uint8), np.zeros(len(keys), np.uint8), n_buckets)), schema=_ASKED_ARROW)

    def ask_windows(key, texts, answers):
        block, batches = key[0].as_py(), list(blocks.unpacked(texts, schema))
        anchors, _ = _anchors(batches, window, anchor)
        shared = _told(answers, 2, anchors, n_buckets)
        told = [(r["bucket"], r["keys"], b"", b"") for r in answers.to_pylist()]
        out = [*([_answers(block, 2, told)] if told else []), *_asked(block, 1, *_windows(batches, anchors, shared, window, anchor), n_buckets)]
        return pa.Table.from_batches(out, schema=_ASKED_ARROW)

    def parse(key, texts, answers):
        made = list(_parse(list(blocks.unpacked(texts, schema)), answers, window, anchor, n_buckets, carried))
        return pa.Table.from_batches(made) if made else pa.table({f.name: pa.array([], f.type) for f in [*_SPANS_ARROW, *(schema.field(c) for c in carried)]})

    by_block = blocks.packed(dealt).groupBy("block")
    sieve = by_block.applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(_sieve_bucket, ASKED)
    index = by_block.cogroup(sieve.groupBy("block")).applyInArrow(ask_windows, ASKED).groupBy("bucket").applyInArrow(_index_bucket, ASKED)
    columns = ", ".join([SPANS, *(f"`carried_{c}` {dealt.schema[f'carried_{c}'].dataType.simpleString()}" for c in carry)])
    out = by_block.cogroup(index.groupBy("block")).applyInArrow(parse, columns)
    return out.withColumnsRenamed({f"carried_{c}": c for c in carry})


_ASKED_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())])


def remove_spans(spans: DataFrame) -> DataFrame:
    """The result of duplicate_spans with the duplicate spans taken out of the text; a text that has none stays as it is."""
    cut = F.expr(
        "array_join(transform(sequence(0, size(spans)), i -> substring(text, "
        "if(i = 0, 1, spans[i - 1].char_end + 1), "
        "if(i = size(spans), length(text), spans[i].char_start) - if(i = 0, 0, spans[i - 1].char_end))), ' ')"
    )
    return spans.withColumn("text", F.when(F.size("spans") == 0, F.col("text")).otherwise(F.trim(cut)))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return duplicate_spans(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT win, min(doc_id) AS d FROM g GROUP BY win HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT g.doc_id, g.i FROM g JOIN m USING (win) WHERE m.d < g.doc_id), (SELECT unnest(range(0, 13)) AS k)),
r AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id),
x AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p WHERE c.p IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
