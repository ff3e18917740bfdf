"""Elias-Fano sequences and a two-level n-gram trie over them, in one memory-mapped file.

A sequence stays packed while it is asked: low bits in byte columns, high bits in unary in 64-bit words,
and one count of ones a word by which the place of any one or zero is found."""

from __future__ import annotations

import numpy as np

from tessera.llm.kernel import U

_BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BYTES.sum(axis=1, dtype=np.int64)
#: The place of the k-th one of each byte.
_PLACE = np.argsort(1 - _BYTES, axis=1, kind="stable")


def _in_words(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one (from 0) inside each word."""
    parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(_ONES[parts], axis=1)
    byte = (upto <= k[:, None]).sum(axis=1)
    rows = np.arange(len(k))
    left = k - np.where(byte > 0, upto[rows, byte - 1], 0)
    return 8 * byte + _PLACE[parts[rows, byte], left]


class EliasFano:
    """A sorted sequence of n integers: about 3 + log2(bound / n) bits a value, the low part rounded up to whole bytes."""

    def __init__(self, low: np.ndarray, words: np.ndarray, ones: np.ndarray, width: int, n: int):
        self.low, self.words, self.ones, self.width, self.n = low, words, ones, width, n
        self.zeros = 64 * len(words) - n  # those after the last value count too

    @staticmethod
    def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Low bytes, words of high bits, ones before each word, and the number of low bits."""
        n = len(values)
        bound = int(values[-1]) + 1 if n else 1
        width = max(0, (bound // max(1, n)).bit_length() - 1)
        width = min(56, (width + 7) // 8 * 8) if width else 0
        high = (values >> U(width)).astype(np.int64)
        bits = np.zeros(((int(high[-1]) if n else 0) + n + 64) // 64 * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(U)
        ones = np.concatenate([[0], np.cumsum(_ONES[words.view(np.uint8)].reshape(-1, 8).sum(axis=1))[:-1]]).astype(np.int64)
        low = values & U((1 << width) - 1)
        return np.ascontiguousarray(low.view(np.uint8).reshape(n, 8)[:, : width // 8]), words, ones, width

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), U)
        for k in range(self.width // 8):
            out |= self.low[at, k].astype(U) << U(8 * k)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, at, "right") - 1
        place = 64 * word + _in_words(self.words[word], at - self.ones[word])
        return ((place - at).astype(U) << U(self.width)) | self._low(at)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have high bits below each of these: the ones before the high-th zero."""
        inside = (high > 0) & (high <= self.zeros)
        out = np.where(high > 0, self.n, 0)
        k = high[inside] - 1
        zeros = 64 * np.arange(len(self.words)) - self.ones
        word = np.searchsorted(zeros, k, "right") - 1
        out[inside] = 64 * word + _in_words(~self.words[word], k - zeros[word]) - k
        return out

    def search(self, x: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The place of each x, or -1: a jump by high bits, cut down to [start, end), then halving among the low bits there."""
        high = (x >> U(self.width)).astype(np.int64)
        low, top = self._below(high), self._below(high + 1)
        if start is not None:
            low, top = np.maximum(low, start), np.minimum(top, end)
        last, want = top.copy(), x & U((1 << self.width) - 1)
        while True:
            some = np.flatnonzero(low < top)
            if not len(some):
                break
            middle = (low[some] + top[some]) >> 1
            less = self._low(middle) < want[some]
            low[some[less]] = middle[less] + 1
            top[some[~less]] = middle[~less]
        found = low < last
        found[found] = self._low(low[found]) == want[found]
        return np.where(found, low, -1)


#: Probabilities from 1 down to 10 ** -DECADES in even steps of their logarithm: 0.025 % at most from their code's value.  Code 0 is none.
DECADES, CODES = 14, 65534


def quantise(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, 1 + np.rint(np.clip(-np.log10(np.maximum(p, 1e-300)), 0, DECADES) * (CODES / DECADES)), 0).astype(np.uint16)


def probability(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10 ** ((1.0 - codes) * (DECADES / CODES)), 0.0)


class Trie:
    """Contexts, and under each its successors with their quantised probabilities.

    Level 1 holds the sorted contexts; pointers, a rising sequence, give each one's range of level 2.
    Successors are made one rising sequence by adding to each the place of its context times the
    bound of successors; a successor is searched inside the range of its context."""

    MAGIC = 0x7E55E2B
    PARTS = ("contexts", "pointers", "successors")

    def __init__(self, path: str, bits: int):
        blob = np.memmap(path, np.uint8, "r")
        head = blob[:256].view(np.int64)
        assert head[0] == self.MAGIC
        at, self.bits = 256, bits

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return blob[at - size : at]

        for k, part in enumerate(self.PARTS):
            n, width, n_words = (int(v) for v in head[1 + 3 * k : 4 + 3 * k])
            words, ones = take(8 * n_words).view(U), take(8 * n_words).view(np.int64)
            setattr(self, part, EliasFano(take(n * (width // 8)).reshape(n, width // 8), words, ones, width, n))
            take(-at % 8)
        self.codes = take(2 * self.successors.n).view(np.uint16)

    @classmethod
    def write(cls, path: str, keys: np.ndarray, codes: np.ndarray, bits: int) -> None:
        """keys: sorted distinct context << bits | successor."""
        contexts, first = np.unique(keys >> U(bits), return_index=True)
        place = np.repeat(np.arange(len(contexts), dtype=U), np.diff(np.append(first, len(keys))))
        levels = [contexts, np.append(first, len(keys)).astype(U), (place << U(bits)) | (keys & U((1 << bits) - 1))]
        head, body = [cls.MAGIC], []
        for level in levels:
            low, words, ones, width = EliasFano.encode(level)
            head += [len(level), width, len(words)]
            body += [words, ones, low, np.zeros(-low.size % 8, np.uint8)]
        with open(path, "wb") as f:
            f.write(np.array(head + [0] * (32 - len(head)), np.int64).tobytes())
            for b in body:
                f.write(b.tobytes())
            f.write(codes.astype(np.uint16).tobytes())

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The code of each of some sorted context << bits | successor; 0 if it is not there."""
        out = np.zeros(len(keys), np.uint16)
        if not self.contexts.n or not len(keys):
            return out
        context = keys >> U(self.bits)
        changes = np.concatenate([[True], context[1:] != context[:-1]])
        place = self.contexts.search(context[changes])
        known = np.flatnonzero(place >= 0)
        start, end = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        start[known], end[known] = self.pointers.get(place[known]), self.pointers.get(place[known] + 1)
        which = np.cumsum(changes) - 1
        there = np.flatnonzero(place[which] >= 0)
        own = which[there]
        found = self.successors.search((place[own].astype(U) << U(self.bits)) | (keys[there] & U((1 << self.bits) - 1)), start[own], end[own])
        out[there[found >= 0]] = self.codes[found[found >= 0]]
        return out
