"""A Burrows-Wheeler transform of many strings at once, with common prefixes, built column by column.

Each round adds one symbol of every string, from its end to its start, so that after round j the transform is
that of all suffixes of up to j symbols.  The suffix a round adds to a string begins with the symbol the round before wrote for it; its
place is found by counting: all suffixes that begin with smaller symbols, and the equal symbols above the last place.
Transform and common prefixes lie in files that a round reads from start to end and writes anew.

A symbol is ``stride`` bytes, and a string is entered ``stride`` times, without its last 0, 1, ... bytes, so that a suffix from any byte is there:
a round rewrites the files, and wide symbols make the rounds few.

Strings are bytes without 0xFF (as UTF-8 is).  Symbol 0 stands for the end of a string; the ends differ from one
another, so no common prefix goes beyond a string."""

from __future__ import annotations

import tempfile
from types import TracebackType
from typing import Self

import numpy as np

#: Bytes of a symbol: it and a place share 64 bits.  Collections of more symbols than a place has bits for take narrower ones.
STRIDES = (5, 4, 2)
#: Symbols of a string at most, as common prefixes are kept in a byte.
LONGEST = 250


class Sequential:
    """A file of numbers that is read whole and replaced: the old and the new version take turns, and go with the object."""

    def __init__(self, kind: type) -> None:
        self._kind, self._old, self._new = kind, tempfile.TemporaryFile(), tempfile.TemporaryFile()

    def __enter__(self) -> Self:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self._old.close()
        self._new.close()

    def read(self) -> np.ndarray:
        self._old.seek(0)
        return np.frombuffer(self._old.read(), self._kind)

    def write(self, values: np.ndarray) -> None:
        self._new.seek(0)
        self._new.write(np.ascontiguousarray(values).data)
        self._new.truncate()
        self._old, self._new = self._new, self._old


def columns(strings: list[bytes], stride: int) -> np.ndarray:
    """The symbols of the strings, a column a string, from their ends on and then 0; first all strings as they are, then all without their last byte, and so on."""
    length = np.array([len(s) for s in strings])
    longest = -(-int(length.max()) // stride) * stride
    if longest > LONGEST * stride:
        raise ValueError(f"a string is longer than {LONGEST} symbols")
    whole = np.zeros((len(strings), longest + stride), np.uint8)
    whole[np.arange(whole.shape[1]) >= (whole.shape[1] - length)[:, None]] = np.frombuffer(b"".join(strings), np.uint8) + 1
    out = []
    for short in range(stride):
        part = whole[:, stride - short : stride - short + longest].reshape(len(strings), -1, stride)
        symbol = np.zeros(part.shape[:2], np.uint64)
        for k in range(stride):
            symbol = (symbol << np.uint64(8)) | part[:, :, k]
        out.append(np.where(part[:, :, 0] > 0, symbol, np.uint64(0)))
    return np.ascontiguousarray(np.concatenate(out).T[::-1])


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The smallest of values[first + 1 .. last] for each pair; every range has an entry at least."""
    out = np.empty(len(first), values.dtype)
    level = np.frexp((last - first).astype(float))[1] - 1
    table, width = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[first[own] + 1], table[last[own] - width + 1])
        table = np.minimum(table[:-width], table[width:]) if width < len(table) else table
        width *= 2
    return out


def _inserted(old: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.empty(len(old) + len(at), old.dtype)
    kept = np.ones(len(out), bool)
    kept[at] = False
    out[kept] = old
    out[at] = new
    return out


class _Ordered:
    """The places of a transform by symbol, then place: one packed number each.  ``scratch`` keeps the memory of the round before."""

    def __init__(self, symbols: np.ndarray, stride: int, scratch: dict[str, np.ndarray]):
        self.bits = np.uint64(64 - 8 * stride)
        if len(scratch.get("count", ())) < len(symbols):
            room = len(symbols) + (len(symbols) >> 2)
            scratch["count"], scratch["keys"] = np.arange(room, dtype=np.uint64), np.empty(room, np.uint64)
        self.keys = scratch["keys"][: len(symbols)]
        np.left_shift(symbols, self.bits, out=self.keys)
        self.keys |= scratch["count"][: len(symbols)]
        self.keys.sort()
        self.ended = len(symbols) - int(np.count_nonzero(symbols))

    def place(self, turn: np.ndarray | slice) -> np.ndarray:
        return (self.keys[turn] & ((np.uint64(1) << self.bits) - np.uint64(1))).astype(np.int64)

    def symbol(self, turn: np.ndarray) -> np.ndarray:
        return self.keys[turn] >> self.bits

    def turns(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where these symbols at these places stand."""
        return np.searchsorted(self.keys, (symbols << self.bits) | places.astype(np.uint64))


def construct(strings: list[bytes], stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The transform, and for each suffix the symbols it shares with the one before it."""
    with Sequential(np.uint64) as transform, Sequential(np.uint8) as shared:
        column, m = columns(strings, stride), stride * len(strings)
        transform.write(column[0])
        shared.write(np.zeros(m, np.uint8))
        place, string, scratch = np.arange(m), np.arange(m), {}
        for j in range(1, len(column) + 1):
            symbols, prefixes = transform.read(), shared.read()
            goes_on = symbols[place] > 0
            place, string = place[goes_on], string[goes_on]
            if not len(place):
                break
            ordered = _Ordered(symbols, stride, scratch)
            turn = ordered.turns(symbols[place], place)
            sorting = np.argsort(turn)
            turn, string, last = turn[sorting], string[sorting], place[sorting]
            place = m + turn - ordered.ended
            written = column[j][string] if j < len(column) else np.zeros(len(string), np.uint64)
            own, final = ordered.symbol(turn), len(symbols) - 1
            with_left = (turn > 0) & (ordered.symbol(turn - 1) == own)
            with_right = (turn < final) & (ordered.symbol(np.minimum(turn + 1, final)) == own)
            before, after = np.zeros(len(turn), np.uint8), np.zeros(len(turn), np.uint8)
            least = range_minima(prefixes, np.append(ordered.place(turn[with_left] - 1), last[with_right]), np.append(last[with_left], ordered.place(turn[with_right] + 1))) + 1
            before[with_left], after[with_right] = np.split(least, [np.count_nonzero(with_left)])
            prefixes = _inserted(prefixes, place, before)
            follows = place + 1 < len(prefixes)
            prefixes[place[follows] + 1] = after[follows]
            transform.write(_inserted(symbols, place, written))
            shared.write(prefixes)
        return transform.read(), shared.read()


def widest_stride(strings: list[bytes], width: int) -> int:
    """Bytes a symbol may have so that windows are whole symbols and the places of all suffixes fit beside them."""
    size = sum(map(len, strings))
    return next((s for s in STRIDES if width % s == 0 and size + s * len(strings) < 1 << (64 - 8 * s)), 1)


def windows(strings: list[bytes], width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every substring of ``width`` bytes (a number of whole symbols): its string, its first byte and its class; equal ones, and only they, are of one class.

    Rows are in the order of the suffixes, so a class is a run of them."""
    if width % stride:
        raise ValueError(f"a window must be a multiple of {stride} bytes")
    symbols, prefixes = construct(strings, stride)
    m = stride * len(strings)
    ordered = _Ordered(symbols, stride, {})
    step = np.zeros(len(symbols), np.int64)
    step[ordered.place(slice(ordered.ended, None))] = m + np.arange(len(symbols) - ordered.ended)
    string, first = np.full(len(symbols), -1, np.int32), np.zeros(len(symbols), np.int32)
    place, own = np.arange(m), np.tile(np.arange(len(strings)), stride)
    end = np.tile([len(s) for s in strings], stride) - np.repeat(np.arange(stride), len(strings))
    for j in range(1, int(end.max()) // stride + 1):
        goes_on = symbols[place] > 0
        place, own, end = step[place[goes_on]], own[goes_on], end[goes_on]
        if j * stride >= width:
            string[place] = own
            first[place] = end - j * stride
    whole = string >= 0
    return string[whole], first[whole], np.cumsum(prefixes < width // stride)[whole]
