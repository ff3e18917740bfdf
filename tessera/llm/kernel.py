"""NumPy helpers that run inside Arrow tasks: word spans, 64-bit word hashes and n-gram hashes
of a whole batch of texts at once.

Words are told apart by UTF-8 bytes; every class used here is closed under that (non-ASCII
characters are word characters).  Word identity is a 64-bit hash: two different words of a corpus
of V distinct words share one with probability about V * V / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
WORD_CLASS = r"[^\x20\x09-\x0D]+"

SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

ALNUM = np.ones(256, bool)
ALNUM[:0x80] = False
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=U)
_BASE = U(0x9E3779B97F4A7C15)
_powers = np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits each depend on all input bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, 256), _BASE, U)]), dtype=U)
    return _powers


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about most_bytes of text each (one row may exceed it), so that scratch stays bounded."""
    _, offsets = text_buffers(texts)
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


class Words:
    """Spans, documents and hashes of all words of some texts.

    doc: row of each word; start, end: byte span in data; first: n + 1 word offsets by row."""

    def __init__(self, texts: pa.Array, kinds: np.ndarray = SPACED, lower: bool = False):
        self.data, self.offsets = text_buffers(texts)
        self.raw = self.data
        if lower:
            self.data = LOWER[self.data]
        n, inside = len(self.data), kinds[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before &= ~edge[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self._inside = inside
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            if not len(self.start):
                self._hash = np.zeros(0, U)
            else:
                length = self.end - self.start
                first = np.cumsum(length) - length
                place = np.arange(int(length.sum())) - np.repeat(first, length)
                terms = _BYTE[self.data[self._inside]] * powers(int(length.max()))[place]
                self._hash = mix(np.add.reduceat(terms, first) + length.astype(U))
        return self._hash


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive words of one document, and the place of their first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    out = hashes[:m] * U(0xD6E8FEB86659FD93)
    for j in range(1, n):
        out = (out ^ (out >> U(32))) * U(0xD6E8FEB86659FD93) + hashes[j : j + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(out[at]), at


def distinct_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key among them.

    Keys are sorted as plain numbers, by their top bits with their number in the bits below; keys that
    share all those top bits and come out in the wrong order are then sorted in full."""
    n = len(keys)
    low = U((1 << n.bit_length()) - 1)
    packed = (keys & ~low) | np.arange(n, dtype=U)
    packed.sort()
    order = (packed & low).astype(np.int64)
    ordered = keys[order]
    wrong = np.flatnonzero(ordered[1:] < ordered[:-1])
    if len(wrong):
        top = ordered & ~low
        shared = np.unique(top[wrong])
        edge = np.zeros(n + 1, np.int64)
        edge[np.searchsorted(top, shared)] += 1
        edge[np.searchsorted(top, shared, "right")] -= 1
        some = np.flatnonzero(np.cumsum(edge[:-1]))
        order[some] = order[some][np.argsort(ordered[some], kind="stable")]
        ordered = keys[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def slice_bounds(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets that cut sorted 64-bit keys into n equal ranges of the key space."""
    cuts = (np.arange(n + 1, dtype=object) * 2**64) // n
    return np.concatenate([[0], np.searchsorted(sorted_keys, np.array([int(c) for c in cuts[1:-1]], U)), [len(sorted_keys)]]).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """The bytes of fixed-width numbers, plane by plane, so that a block compressor finds the zero bytes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=U(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob, U), dtype=U)
