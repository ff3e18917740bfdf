"""Operator 12: repeated byte strings by column-wise construction of a Burrows-Wheeler transform of many documents.

Every text is cut into pieces so that equal windows (``width`` bytes) of all documents meet in one bucket, and a bucket builds
the transform of its pieces with their common prefixes (``columnwise``): one symbol of every piece a round, in
files that are read from start to end.  Suffixes that share ``width`` bytes with the one before are one class of equal windows, and
the smallest place (doc_id, then byte) of a class is the one that stays.

1. Sieve.  A window's anchor is the smallest hash among its GRAM-byte strings, the first of equal ones.  Equal windows have equal anchors, so
   only windows whose anchor is found twice can be repeats.  A block of documents asks each distinct anchor once.
2. Fingerprints, for hot anchors only.  Where an anchor begins more than ``hot_runs`` runs of windows (a common line in
   ever new surroundings), its windows are asked too, by a hash of the window, spread over all buckets; those found once go.
3. Pieces.  Neighbouring windows of one anchor make a piece (LONGEST_RUN windows at most).  Equal pieces of a block are one, with the smallest place;
   equal pieces of a bucket too.  The bucket builds transforms of about ``collection`` bytes of pieces, anchors never divided (a piece alone with its anchor has no equal), and answers
   for each piece which of its windows are the first of their class.
4. Every block covers the bytes of the windows that are not, and cuts them out.

So a passage in a third of all documents is one piece a block, and no task holds a group of documents.  Hashes only choose
who meets whom; windows are compared byte by byte.  What a bucket builds lies in files of the task that go with it: a lost executor costs the task only.

Results of odd input: a null text counts as empty; a text of fewer than ``width`` bytes loses nothing; rows that share a doc_id are one
document that starts over: a window goes if any of them holds it at an earlier byte; rows without a doc_id are neither a reference nor changed;
a cut inside a character leaves the other bytes of it (``kept`` is binary); further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks, columnwise
from tessera.llm.blocks import press, unpress
from tessera.llm.kernel import U, distinct_places, mix, pack_sorted, planes, portions, slice_bounds, text_buffers, unpack_sorted, unplanes

WIDTH = 100
GRAM = 32
LONGEST_RUN = 100
COLLECTION = 1 << 20
#: Pieces of an anchor are at most so many, of 200 bytes at most; beyond, fingerprints thin them out first.
HOT_RUNS = 1 << 15
#: Bytes of text hashed at once.
PORTION = 1 << 18
BEYOND = np.iinfo(np.int64).max
_SYMBOL = np.random.default_rng(20240301).integers(0, 2**32, 256, dtype=np.uint32)
MESSAGE = "bucket int, block int, kind int, keys binary, docs binary, starts binary, sizes binary, body binary"
_MESSAGE = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("keys", "docs", "starts", "sizes", "body"))])
SPANS = "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, kept binary, kept_sha256 string"
_SPANS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("kept", pa.binary()), ("kept_sha256", pa.string())])
#: Kinds of messages, asked and told; TOLD less the kind for what only goes on.
ANCHORS, PRINTS, PIECES, TOLD = 0, 1, 2, 9
UNSHARED, SHARED, HOT = 0, 1, 2


@dataclass(frozen=True)
class Shape:
    width: int = WIDTH
    gram: int = GRAM
    collection: int = COLLECTION
    hot_runs: int = HOT_RUNS


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of the ``gram`` bytes from each place on, put together from hashes of doubling length."""
    out, have = _SYMBOL[data], 1
    while have < gram:
        step = min(have, gram - have)
        out = (out[: len(out) - step] * np.uint32(0x85EBCA6B)) + out[step:]
        out ^= out >> np.uint32(15)
        have += step
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


_numbers = np.zeros(0, U)


def _count(n: int) -> np.ndarray:
    """0 to n - 1, kept from call to call."""
    global _numbers
    if len(_numbers) < n:
        _numbers = np.arange(n, dtype=U)
    return _numbers[:n]


def _content_keys(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes at each place."""
    out, words = np.full(len(at), U(width)), width // 8
    for a in range(0, len(at), 1 << 15):
        rows = data[at[a : a + (1 << 15), None] + np.arange(width)]
        whole = np.ascontiguousarray(rows[:, : 8 * words]).view(U)
        part = out[a : a + (1 << 15)]
        for k in range(words):
            part[:] = mix(part ^ whole[:, k])
        for k in range(8 * words, width):
            part[:] = mix(part ^ rows[:, k])
    return out


class Runs:
    """The runs of neighbouring windows with one anchor, of some texts.

    row, first: text and place in data of a run's first window; count: its windows; key: hash of its anchor; many: whether the anchor stands in it more than once."""

    def __init__(self, texts: pa.Array, shape: Shape):
        self.data, self.offsets = text_buffers(texts)
        n, width, gram = len(self.data), shape.width, shape.gram
        none = np.zeros(0, np.int64)
        self.row, self.first, self.count, self.key, self.many = none, none, none, np.zeros(0, U), np.zeros(0, bool)
        if n < width:
            return
        anchor = _gram_hashes(self.data, gram).astype(U)
        anchor <<= U(32)
        anchor |= _count(len(anchor))
        anchor = _sliding_min(anchor, width - gram + 1)
        ends = self.offsets[1:] - width + 1
        lasting = ends > self.offsets[:-1]
        edges = np.zeros(n + 1, np.int8)
        edges[self.offsets[:-1][lasting]] += 1
        edges[ends[lasting]] -= 1
        inside = np.cumsum(edges[: len(anchor)], dtype=np.int8).astype(bool)
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new[1:] |= inside[1:] > inside[:-1]
        first = np.flatnonzero(new & inside)
        if not len(first):
            return
        key = _content_keys(self.data, (anchor[first] & U(0xFFFFFFFF)).astype(np.int64), gram)
        row = np.searchsorted(self.offsets, first, "right") - 1
        count = np.minimum(np.append(first[1:], n), ends[row]) - first
        # neighbours of one key (a period) are one run, which holds its anchor twice
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
        at = np.flatnonzero(new)
        total = np.add.reduceat(count, at)
        many = np.diff(np.append(at, len(count))) > 1
        # long runs in parts
        parts = -(-total // LONGEST_RUN)
        part = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        of = np.repeat(np.arange(len(at)), parts)
        self.row, self.key, self.many = row[at][of], key[at][of], many[of]
        self.first = first[at][of] + part * LONGEST_RUN
        self.count = np.minimum(total[of] - part * LONGEST_RUN, LONGEST_RUN)


def _parsed(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[tuple[np.ndarray, Runs, np.ndarray]]:
    """Document ids, runs, and which runs are of a row with an id; some texts at a time."""
    for batch in batches:
        for a, e in portions(batch.column("text"), PORTION):
            part = batch.slice(a, e - a)
            column, runs = part.column("doc_id"), Runs(part.column("text"), shape)
            ids, nameless = np.asarray(column.fill_null(0).to_numpy(zero_copy_only=False), np.int64), np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
            yield np.ma.array(ids, mask=nameless), runs, ~nameless[runs.row]


def _table(rows: list[dict]) -> pa.Table:
    blank = {c: b"" for c in ("keys", "docs", "starts", "sizes", "body")}
    return pa.Table.from_pylist([blank | r for r in rows], schema=_MESSAGE)


def _sent(block: int, kind: int, keys: np.ndarray, n_buckets: int, **columns: np.ndarray) -> list[dict]:
    """Messages to the buckets of sorted keys."""
    cuts = slice_bounds(keys, n_buckets)
    own = [(b, cuts[b], cuts[b + 1]) for b in np.flatnonzero(np.diff(cuts))]
    return [{"bucket": int(b), "block": block, "kind": kind, "keys": press(pack_sorted(keys[a:e]))} | {c: press(planes(x[a:e])) for c, x in columns.items()} for b, a, e in own]


def _asked_keys(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each is held."""
    every, held = np.concatenate([np.zeros(0, U), *keys]), np.concatenate([np.zeros(0), *times])
    if not len(every):
        return every, held.astype(np.uint16)
    distinct, place = distinct_places(every)
    return distinct, np.minimum(np.bincount(place, weights=held), 65535).astype(np.uint16)


def _answered_keys(rows: list[dict], kind: int, hot_runs: int) -> list[dict]:
    """Tells each block, in the order of its keys, which are held more than once and which are hot."""
    keys = [unpack_sorted(unpress(r["keys"])) for r in rows]
    held = np.concatenate([unplanes(unpress(r["sizes"]), np.uint16) for r in rows])
    _, place = distinct_places(np.concatenate(keys))
    total = np.bincount(place, weights=held)
    told = np.where(total > hot_runs, HOT, np.where(total > 1, SHARED, UNSHARED)).astype(np.uint8)[place]
    cuts = np.cumsum([0, *map(len, keys)])
    return [{"bucket": r["bucket"], "block": r["block"], "kind": kind, "keys": b"hot" if (told[a:e] == HOT).any() else b"", "sizes": press(told[a:e].tobytes())} for r, a, e in zip(rows, cuts[:-1], cuts[1:], strict=True)]


def _told_keys(rows: list[dict], kind: int) -> np.ndarray:
    own = sorted((r["bucket"], r["sizes"]) for r in rows if r["kind"] == kind)
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(unpress(s), np.uint8) for _, s in own)])


class Block:
    """A block's documents with what the buckets have told it so far."""

    def __init__(self, texts: pa.Table, schema: pa.Schema, told: pa.Table | None, shape: Shape):
        self.shape, self.parsed = shape, list(_parsed(blocks.unpacked(texts, schema), shape))
        self.told = told.to_pylist() if told is not None else []
        self._pieces: list[tuple] | None = None

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        return _asked_keys([runs.key[named] for _, runs, named in self.parsed], [1.0 + runs.many[named] for _, runs, named in self.parsed])

    def _found(self) -> Iterator[tuple[np.ndarray, Runs, np.ndarray, np.ndarray]]:
        """Ids, runs, the runs on shared anchors, and which of these are hot."""
        keys, told = self.anchors()[0], _told_keys(self.told, ANCHORS)
        left, state = keys[told > UNSHARED], told[told > UNSHARED]
        for ids, runs, named in self.parsed:
            at = np.minimum(np.searchsorted(left, runs.key), max(len(left) - 1, 0))
            own = np.flatnonzero((left[at] == runs.key) & named) if len(left) else np.zeros(0, np.int64)
            yield ids, runs, own, state[at[own]] == HOT if len(left) else np.zeros(0, bool)

    def _windows(self, runs: Runs, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Run, place and fingerprint of every window of these runs."""
        count = runs.count[own]
        of = np.repeat(own, count)
        at = runs.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        return of, at, _content_keys(runs.data, at, self.shape.width)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        keys = [self._windows(runs, own[hot])[2] for _, runs, own, hot in self._found()]
        return _asked_keys(keys, [np.ones(len(k)) for k in keys])

    def pieces(self) -> list[tuple]:
        """Ids, runs; and of each piece that may hold repeats: row, place in the data, windows, key, and whether its anchor may stand in it more than once."""
        if self._pieces is not None:
            return self._pieces
        found = list(self._found())
        hot_windows = [self._windows(runs, own[hot]) for _, runs, own, hot in found]
        prints, _ = _asked_keys([w[2] for w in hot_windows], [np.ones(len(w[2])) for w in hot_windows])
        shared = prints[_told_keys(self.told, PRINTS) > UNSHARED] if len(prints) else prints
        self._pieces = []
        for (ids, runs, own, hot), (of, at, own_prints) in zip(found, hot_windows, strict=True):
            cold = own[~hot]
            row, first, count, key = runs.row[cold], runs.first[cold], runs.count[cold], runs.key[cold]
            if len(shared) and len(of):
                kept = shared[np.minimum(np.searchsorted(shared, own_prints), len(shared) - 1)] == own_prints
                of, at = of[kept], at[kept]
                new = np.flatnonzero(np.concatenate([np.ones(min(len(of), 1), bool), (np.diff(of) > 0) | (np.diff(at) > 1)]))
                row, first = np.append(row, runs.row[of[new]]), np.append(first, at[new])
                count, key = np.append(count, np.diff(np.append(new, len(of)))), np.append(key, runs.key[of[new]])
            self._pieces.append((ids, runs, row, first, count, key, np.append(runs.many[cold], np.ones(len(row) - len(cold), bool))))
        return self._pieces

    def distinct(self) -> tuple[dict[bytes, tuple[int, int]], dict[bytes, tuple[int, bool]]]:
        """The distinct pieces with their smallest place (document, byte); and with their keys and whether they may repeat themselves."""
        place: dict[bytes, tuple[int, int]] = {}
        keys: dict[bytes, tuple[int, bool]] = {}
        for ids, runs, row, first, count, key, many in self.pieces():
            blob, beyond = runs.data.tobytes(), self.shape.width - 1
            start = first - runs.offsets[row]
            for a, n, k, at in zip(first.tolist(), count.tolist(), zip(key.tolist(), many.tolist(), strict=True), zip(ids[row].tolist(), start.tolist(), strict=True), strict=True):
                piece = blob[a : a + n + beyond]
                if (seen := place.get(piece)) is None:
                    place[piece], keys[piece] = at, k
                elif at < seen:
                    place[piece] = at
        return place, keys


def _by_key(keys: dict[bytes, tuple[int, bool]]) -> tuple[list[bytes], np.ndarray]:
    """The pieces in the order of their keys, those of one key by their bytes, and the keys.

    Rows come in another order each time that an exchange is read, and answers are told by the order of the pieces."""
    key, pieces = np.array([k for k, _ in keys.values()], U), list(keys)
    order = np.argsort(key, kind="stable")
    ends = np.flatnonzero(np.append(key[order][1:] != key[order][:-1], True)) + 1 if len(key) else np.zeros(0, np.int64)
    for a, e in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=False):
        if e - a > 1:
            order[a:e] = sorted(order[a:e].tolist(), key=pieces.__getitem__)
    return [pieces[i] for i in order.tolist()], key[order]


def _pieces_sent(block: int, place: dict[bytes, tuple[int, int]], keys: dict[bytes, tuple[int, bool]], n_buckets: int) -> list[dict]:
    """Messages with the distinct pieces by key; a size is doubled, and odd if the piece may repeat itself."""
    ordered, key = _by_key(keys)
    docs, starts = (np.array([place[p][k] for p in ordered], np.int64) for k in (0, 1))
    rows = _sent(block, PIECES, key, n_buckets, docs=docs, starts=starts, sizes=np.array([2 * len(p) + keys[p][1] for p in ordered], np.int32))
    cuts = slice_bounds(key, n_buckets)
    for r in rows:
        r["body"] = press(b"".join(ordered[cuts[r["bucket"]] : cuts[r["bucket"] + 1]]))
    return rows


def _first_windows(pieces: list[bytes], docs: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For every window of the pieces, in their order, whether it is the smallest place of its class."""
    string, first, kind = columnwise.windows(pieces, width, columnwise.widest_stride(pieces, width))
    new = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(kind))))
    doc, start = docs[string], starts[string] + first
    best = doc == np.minimum.reduceat(doc, new)[of]
    start = np.where(best, start, BEYOND)
    best &= start == np.minimum.reduceat(start, new)[of]
    count = np.array([len(p) - width + 1 for p in pieces])
    out = np.zeros(int(count.sum()), bool)
    out[(np.cumsum(count) - count)[string] + first] = best
    return out


def _answered_pieces(rows: list[dict], shape: Shape) -> list[dict]:
    """Tells each block which windows of its pieces are the first of all, as bits; a piece that another block holds at a smaller place has none."""
    every: list[bytes] = []
    told_sizes = [unplanes(unpress(r["sizes"]), np.int32) for r in rows]
    many = np.concatenate(told_sizes) % 2 == 1
    for r, sizes in zip(rows, [x // 2 for x in told_sizes], strict=True):
        body, ends = unpress(r["body"]), np.cumsum(sizes)
        every += [body[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
    keys = np.concatenate([unpack_sorted(unpress(r["keys"])) for r in rows])
    docs, starts = (np.concatenate([unplanes(unpress(r[c]), np.int64) for r in rows]) for c in ("docs", "starts"))
    slot: dict[bytes, int] = {}
    of = np.array([slot.setdefault(p, len(slot)) for p in every])
    order = np.lexsort((starts, docs, of))
    lead = order[np.concatenate([[True], np.diff(of[order]) > 0])]
    pieces, doc, start = list(slot), docs[lead], starts[lead]
    by_key = np.argsort(keys[lead], kind="stable")
    size = np.array([len(p) for p in pieces])
    # collections end where a key does, once they are large enough
    ends = np.cumsum(size[by_key])
    sorted_keys = keys[lead][by_key]
    cuts, at = [0], 0
    last_of_key = np.append(np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]), len(by_key) - 1)
    while at < len(by_key):
        enough = np.searchsorted(ends, (ends[at - 1] if at else 0) + shape.collection)
        at = int(last_of_key[min(np.searchsorted(last_of_key, enough), len(last_of_key) - 1)]) + 1
        cuts.append(at)
    count = size - shape.width + 1
    offset = np.cumsum(count) - count
    bits = np.zeros(int(count.sum()), bool)
    # a piece alone with its anchor, which stands in it once, has no other window to be equal to
    first_of_key = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    alone = first_of_key & np.append(first_of_key[1:], True) & ~many[lead][by_key]
    for i in by_key[alone].tolist():
        bits[offset[i] : offset[i] + count[i]] = True
    for a, e in zip(cuts[:-1], cuts[1:], strict=True):
        some = by_key[a:e][~alone[a:e]]
        if not len(some):
            continue
        firsts = _first_windows([pieces[i] for i in some], doc[some], start[some], shape.width)
        own = count[some]
        bits[np.repeat(offset[some] - (np.cumsum(own) - own), own) + np.arange(len(firsts))] = firsts
    out, at = [], 0
    for r, n in zip(rows, map(len, told_sizes), strict=True):
        mine, at = slice(at, at + n), at + n
        lead_here = (docs[mine] == doc[of[mine]]) & (starts[mine] == start[of[mine]])
        told = [bits[offset[i] : offset[i] + count[i]] if is_lead else np.zeros(count[i], bool) for i, is_lead in zip(of[mine].tolist(), lead_here.tolist(), strict=True)]
        out.append({"bucket": r["bucket"], "block": r["block"], "kind": PIECES, "body": press(np.packbits(np.concatenate(told)).tobytes())})
    return out


def _covered(block: Block, n_buckets: int) -> Iterator[tuple[np.ndarray, Runs, np.ndarray]]:
    """Ids, runs, and which bytes of the data lie in a window that is not the first of its class."""
    place, keys = block.distinct()
    ordered, key = _by_key(keys)
    width, cuts = block.shape.width, slice_bounds(key, n_buckets)
    firsts: dict[bytes, np.ndarray] = {}
    for r in block.told:
        if r["kind"] == PIECES:
            own = ordered[cuts[r["bucket"]] : cuts[r["bucket"] + 1]]
            ends = np.cumsum([len(p) - width + 1 for p in own])
            bits = np.unpackbits(np.frombuffer(unpress(r["body"]), np.uint8), count=int(ends[-1])).astype(bool)
            firsts.update(zip(own, np.split(bits, ends[:-1]), strict=True))
    for ids, runs, row, first, count, _, _ in block.pieces():
        blob, repeated = runs.data.tobytes(), np.zeros(len(runs.data) + 1, np.int32)
        for a, n, d, start in zip(first.tolist(), count.tolist(), ids[row].tolist(), (first - runs.offsets[row]).tolist(), strict=True):
            piece = blob[a : a + n + width - 1]
            repeated[a + 1 : a + 1 + n] = ~firsts[piece] if place[piece] == (d, start) else 1
        sums = np.cumsum(repeated)
        yield ids, runs, sums[1:] > sums[np.maximum(np.arange(len(runs.data)) + 1 - width, 0)]


def _cut(block: Block, n_buckets: int, kept: bool) -> pa.Table:
    rows = []
    for ids, runs, covered in _covered(block, n_buckets):
        blob, left, nameless = runs.data, ~covered, np.ma.getmaskarray(ids)
        edges = np.flatnonzero(np.diff(covered, prepend=False, append=False).astype(bool))
        for i, (a, e) in enumerate(zip(runs.offsets[:-1].tolist(), runs.offsets[1:].tolist(), strict=True)):
            # a span that touches the text before is another one
            own = edges[np.searchsorted(edges, a, "right") : np.searchsorted(edges, e)]
            own = np.concatenate([[a] if a < e and covered[a] else [], own, [e] if a < e and covered[e - 1] else []]).astype(np.int64) - a
            rest = blob[a:e][left[a:e]].tobytes()
            rows.append({"doc_id": None if nameless[i] else int(ids[i]), "n_bytes": e - a, "n_removed": e - a - len(rest), "spans": [{"first": f, "last": t} for f, t in own.reshape(-1, 2).tolist()], "kept": rest if kept else None, "kept_sha256": hashlib.sha256(rest).hexdigest()})
    return pa.Table.from_pylist(rows, schema=_SPANS)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shape: Shape = Shape(), block_bytes: int = blocks.BLOCK_BYTES, kept: bool = True) -> DataFrame:
    """One row a document: n_bytes, n_removed, the removed spans (bytes, half open), a digest of what is left, and with ``kept`` the bytes left."""
    if shape.gram > shape.width:
        raise ValueError("the gram must fit the window")
    # a block sends a message to every bucket, so there are no more blocks than the cluster or the texts need
    parts, size = blocks.shuffle_partitions(docs), blocks.text_bytes(docs, text)[1]
    n_blocks = max(parts, math.ceil(size / block_bytes))
    n_buckets = blocks.bucket_count(docs, size // 16)
    dealt = docs.select(blocks.block_of(doc_id, text, n_blocks).alias("block"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = blocks.packed_schema(dealt)
    by_block = blocks.packed(dealt).groupBy("block")

    def ask_anchors(key, texts):
        keys, held = Block(texts, schema, None, shape).anchors()
        return _table(_sent(key[0].as_py(), ANCHORS, keys, n_buckets, sizes=held))

    def ask_prints(key, texts, told):
        rows = go_on(told)
        if any(r["keys"] for r in rows):
            keys, held = Block(texts, schema, told, shape).prints()
            rows += _sent(key[0].as_py(), PRINTS, keys, n_buckets, sizes=held)
        return _table(rows)

    def ask_pieces(key, texts, told):
        return _table([*go_on(told), *_pieces_sent(key[0].as_py(), *Block(texts, schema, told, shape).distinct(), n_buckets)])

    def cut(key, texts, told):
        return _cut(Block(texts, schema, told, shape), n_buckets, kept)

    def go_on(told):
        # what a block has been told goes on with its next question, so that the plan is one and its exchanges are used again
        return [r | {"kind": TOLD - r["kind"]} for r in told.to_pylist()]

    def answer(asked):
        rows = asked.to_pylist()
        out, rows = [r | {"kind": TOLD - r["kind"]} for r in rows if r["kind"] > PIECES], [r for r in rows if r["kind"] <= PIECES]
        if rows:
            out += _answered_pieces(rows, shape) if rows[0]["kind"] == PIECES else _answered_keys(rows, rows[0]["kind"], shape.hot_runs)
        return _table(out)

    def answered(asked: DataFrame) -> DataFrame:
        return asked.groupBy("bucket").applyInArrow(answer, MESSAGE)

    told = answered(by_block.applyInArrow(ask_anchors, MESSAGE))
    told = answered(by_block.cogroup(told.groupBy("block")).applyInArrow(ask_prints, MESSAGE))
    told = answered(by_block.cogroup(told.groupBy("block")).applyInArrow(ask_pieces, MESSAGE))
    return by_block.cogroup(told.groupBy("block")).applyInArrow(cut, SPANS)


def op12_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_spans(docs, kept=False).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS win FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w),
r AS (SELECT doc_id, i, CASE WHEN i <= max(i) OVER before + 100 THEN 0 ELSE 1 END AS new FROM f WHERE k > 1 WINDOW before AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS e FROM g GROUP BY doc_id, g),
c AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS last FROM s),
k AS (SELECT c.doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || max(CASE WHEN last = 1 THEN substr(h, 2 * e + 1) ELSE '' END) AS kept FROM c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
