"""All pairs of packed sequences without a row a pair and word: sequences are dealt into tiles, and every tile meets every other once.

A tile holds its sequences as bit planes (valid sites, low and high bits of the bases; 64 sites a number), sorted by id, in one row of about
TILE * 32 bytes for 64 sites.  Tiles are dealt into blocks, and a task holds the tiles of one block and reads those of another one after the other.
The number of blocks follows from the cores, so a tile crosses the shuffle equally often in a small and in a large table; only where a block would
be over HELD bytes are there more of them.  The work grows with the square of the sequences, a few nanoseconds a pair and 64 sites."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

TILE, LEAST_TILE = 8192, 256
#: Pairs worked on at once.
PAIRS = 1 << 14
#: Sequences that all of a tile meet before the next are met: ids that soon come again take little room in files of columns.
RUN = 1 << 8
#: Bytes of a block, if it has more than one tile.
HELD = 1 << 24
EVEN = 0x55555555
U = np.uint64


@dataclass(frozen=True)
class Tiling:
    """How many sequences and cores; the first word and how many; whether every sequence has every word (then all pairs share one); and whether only pairs with a valid site in common count."""

    n: int
    cores: int
    low: int
    n_words: int
    complete: bool
    by_site: bool = False

    @property
    def columns(self) -> int:
        return -(-self.n_words // 4)

    @property
    def planes(self) -> int:
        return 3 * self.columns + (0 if self.complete else -(-self.n_words // 64))

    def blocks(self, ordered: bool) -> tuple[int, int]:
        """How many blocks, and how many tiles in each: no more blocks than give every core some tasks of enough pairs."""
        parts = math.ceil(self.n / LEAST_TILE)
        count = min(2 * self.cores, parts) if ordered else math.ceil((math.sqrt(8 * min(4 * self.cores, parts) + 1) - 1) / 2)
        count = max(1, count, math.ceil(self.n / max(TILE, HELD // (8 * (self.planes + 1)))))
        return count, max(1, math.ceil(self.n / (count * TILE)))


def _squeezed(x: np.ndarray) -> np.ndarray:
    """The even bits of 32-bit numbers, side by side."""
    x = x & U(EVEN)
    for k, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        x = (x | (x >> U(k))) & U(mask)
    return x


def tiling(words: DataFrame, by_site: bool = False) -> Tiling | None:
    """How to tile these packed words; none where lanes hold more than a base, as when a site is there twice, or where ids are not whole numbers."""
    if not isinstance(words.schema["seq_id"].dataType, IntegralType):
        return None
    n, rows, low, high, fits = words.where("seq_id IS NOT NULL").agg(F.countDistinct("seq_id"), F.count("seq_id"), F.min("word"), F.max("word"), F.min((F.col("bases").between(0, 2**32 - 1)) & (F.col("valid").bitwiseAND(F.lit(~EVEN)) == 0))).first()
    if n and not fits:
        return None
    low, n_words = (low, high - low + 1) if n else (0, 1)
    return Tiling(n, words.sparkSession.sparkContext.defaultParallelism, low, n_words, by_site or rows == n * n_words, by_site)


def _packed(words: DataFrame, t: Tiling, count: int) -> DataFrame:
    """tile, ids (sorted) and planes: valid, low and high columns, and which words are there unless all are."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        ids, row = np.unique(rows.column("seq_id").to_numpy(), return_inverse=True)
        word = rows.column("word").to_numpy() - t.low
        shift, column = U(16) * (word % 4).astype(U), word // 4
        bases, valid = (rows.column(c).to_numpy().astype(U) for c in ("bases", "valid"))
        planes = np.zeros((t.planes, len(ids)), U)
        for k, bits in enumerate((valid, bases, bases >> U(1))):
            np.bitwise_or.at(planes, (k * t.columns + column, row), _squeezed(bits) << shift)
        if not t.complete:
            np.bitwise_or.at(planes, (3 * t.columns + word // 64, row), U(1) << (word % 64).astype(U))
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "planes": pa.array([planes.tobytes()], pa.binary())})

    dealt = words.where("seq_id IS NOT NULL").select(F.pmod(F.xxhash64("seq_id"), F.lit(count)).cast("int").alias("tile"), F.col("seq_id").cast("long"), F.col("word").cast("long"), "bases", "valid")
    return dealt.groupBy("tile").applyInArrow(pack, "tile int, ids binary, planes binary")


Side = tuple[np.ndarray, np.ndarray]


def _meetings(words: DataFrame, t: Tiling, ordered: bool, run: Callable[[Iterator[tuple[Side, Side, bool]]], Iterator[pa.RecordBatch]], columns: str) -> DataFrame:
    """Runs over a task's meetings of tiles (ids and planes of both, and whether both are one); every two tiles meet once, or if ``ordered`` once at each.

    A task has one block and all others if ``ordered``, else two blocks, or one that meets itself.  At step 0 a tile meets those of its own block,
    at 1 it is only kept, and at 2 it meets those that are kept."""
    count, each = t.blocks(ordered)
    own, other = F.col("tile") % count, F.col("other")
    low, high = F.least(own, other), F.greatest(own, other)
    if ordered:
        tasks, home, step = count, other, F.when(own == other, 0).otherwise(2)
    else:  # blocks that meet themselves have half the pairs and come last
        tasks, home = count * (count + 1) // 2, F.when(low == high, count * (count - 1) // 2 + low).otherwise((high * (high - 1) / 2).cast("int") + low)
        step = F.when(low == high, 0).when(own == low, 1).otherwise(2)
    steps = _packed(words, t, count * each).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select(home.alias("home"), step.alias("step"), "ids", "planes")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Side, Side, bool]]:
        home, kept = None, []
        for b in batches:
            for at, step, ids, planes in zip(b.column("home").to_pylist(), b.column("step").to_pylist(), b.column("ids"), b.column("planes"), strict=True):
                found = np.frombuffer(ids.as_buffer(), np.int64)
                side = found, np.frombuffer(planes.as_buffer(), U).reshape(-1, len(found))
                if at != home:
                    home, kept = at, []
                if step == 0:
                    yield side, side, True
                for x in kept if step != 1 else []:
                    yield x, side, False
                    if ordered and step == 0:
                        yield side, x, False
                if step < 2:
                    kept.append(side)

    dealt = steps.repartitionById(tasks, F.col("home")).sortWithinPartitions("home", "step")
    return dealt.mapInArrow(lambda batches: run(meet(batches)), columns)


def _counted(t: Tiling, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Valid sites and differences of some sequences with all of a tile, a row each; and which pairs count, or none if all do."""
    c = t.columns
    valid = differences = None
    for k in range(c):
        both = own[k][:, None] & other[k]
        apart = own[c + k][:, None] ^ other[c + k]
        apart |= own[2 * c + k][:, None] ^ other[2 * c + k]
        apart &= both
        v, d = np.bitwise_count(both), np.bitwise_count(apart)
        if c == 1:
            valid, differences = v, d
        else:
            valid, differences = (v.astype(np.int64), d.astype(np.int64)) if valid is None else (valid + v, differences + d)
    shared = valid > 0 if t.by_site else None
    if not t.complete:
        shared = np.zeros(valid.shape, bool)
        for k in range(3 * c, len(own)):
            shared |= (own[k][:, None] & other[k]) != 0
    return valid, differences, shared


def _slices(n: int, width: int, most: int = PAIRS) -> Iterator[slice]:
    step = max(1, most // max(1, width))
    for a in range(0, n, step):
        yield slice(a, min(n, a + step))


def _share(valid: np.ndarray, differences: np.ndarray) -> np.ndarray:
    return differences / np.maximum(valid, 1).astype(float)


def _upper(rows: slice, columns: slice) -> np.ndarray:
    """Of a tile with itself: each pair once."""
    return np.arange(columns.start, columns.stop) > np.arange(rows.start, rows.stop)[:, None]


def pairs(words: DataFrame, t: Tiling) -> DataFrame:
    """left_id < right_id, valid_sites and differences of all pairs that share a word."""

    def run(meetings: Iterator[tuple[Side, Side, bool]]) -> Iterator[pa.RecordBatch]:
        for (ids, own), (others, other), same in meetings:
            for part in _slices(len(others), 1, RUN):
                for rows in _slices(part.stop if same else len(ids), part.stop - part.start):
                    valid, differences, shared = _counted(t, own[:, rows], other[:, part])
                    if same:
                        shared = _upper(rows, part) if shared is None else shared & _upper(rows, part)
                    one, two = np.broadcast_to(ids[rows, None], valid.shape), np.broadcast_to(others[part], valid.shape)
                    found = [np.minimum(one, two), np.maximum(one, two), valid.astype(np.int64), differences.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x.ravel() if shared is None else x[shared]) for x in found], names=["left_id", "right_id", "valid_sites", "differences"])

    return _meetings(words, t, False, run, "left_id long, right_id long, valid_sites long, differences long")


def extremes(words: DataFrame, t: Tiling) -> DataFrame:
    """One row: the largest distance and the number of pairs."""

    def run(meetings: Iterator[tuple[Side, Side, bool]]) -> Iterator[pa.RecordBatch]:
        best, n = -1.0, 0
        for (ids, own), (others, other), same in meetings:
            for rows in _slices(len(ids), len(others)):
                valid, differences, shared = _counted(t, own[:, rows], other)
                p = _share(valid, differences)
                if same:
                    upper = _upper(rows, slice(0, len(ids)))
                    shared = upper if shared is None else shared & upper
                if shared is not None:
                    p = p[shared]
                best, n = max(best, float(p.max(initial=-1.0))), n + p.size
        if n:
            yield pa.RecordBatch.from_pydict({"p": [best], "n": [n]})

    found = _meetings(words, t, False, run, "p double, n long")
    return found.agg(F.round(F.max("p"), 9).alias("max_p"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_pairs"))


class _Nearest:
    """The nearest of each sequence of a tile so far: distances and ids, nearest first, the smaller id first among equals."""

    def __init__(self, ids: np.ndarray, size: int):
        self.ids, self.p, self.near = ids, np.full((len(ids), size), np.inf), np.full((len(ids), size), np.iinfo(np.int64).max)

    def take(self, row: np.ndarray, p: np.ndarray, near: np.ndarray) -> None:
        """More candidates, grouped by row."""
        own, size = np.unique(row), self.p.shape[1]
        row = np.concatenate([np.repeat(own, size), row])
        p, near = np.concatenate([self.p[own].ravel(), p]), np.concatenate([self.near[own].ravel(), near])
        order = np.lexsort((near, p, row))
        place = np.searchsorted(row[order], own)[:, None] + np.arange(size)
        self.p[own], self.near[own] = p[order][place], near[order][place]

    def batch(self) -> pa.RecordBatch:
        row, rank = np.nonzero(np.isfinite(self.p))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.near[row, rank]), pa.array(self.p[row, rank]), pa.array((rank + 1).astype(np.int32))], names=["target", "neighbour", "p", "rank"])


def nearest(words: DataFrame, t: Tiling, size: int = 8) -> DataFrame:
    """The nearest of each sequence: target, neighbour, p_distance, rank; ties to the smaller id."""

    def run(meetings: Iterator[tuple[Side, Side, bool]]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, _Nearest] = {}
        for (ids, own), (others, other), same in meetings:
            if same:
                kept[int(ids[0])] = _Nearest(ids, size)
            best = kept[int(ids[0])]
            for rows in _slices(len(ids), len(others), 4 * PAIRS):
                valid, differences, shared = _counted(t, own[:, rows], other)
                p = _share(valid, differences)
                if same:
                    p[np.arange(p.shape[0]), np.arange(rows.start, rows.stop)] = np.inf
                if shared is not None:
                    p[~shared] = np.inf
                if len(others) > size:
                    # the bound of this tile alone already keeps the rows short
                    bound = np.minimum(best.p[rows, -1], np.partition(p, size - 1, axis=1)[:, size - 1]) if np.isinf(best.p[rows, -1]).any() else best.p[rows, -1]
                else:
                    bound = best.p[rows, -1]
                at, of = np.nonzero((p <= bound[:, None]) & (p < np.inf))
                found, near, at = p[at, of], others[of], at + rows.start
                nearer = (found < best.p[at, -1]) | (near < best.near[at, -1])
                if nearer.any():
                    best.take(at[nearer], found[nearer], near[nearer])
        for best in kept.values():
            yield best.batch()

    return _meetings(words, t, True, run, "target long, neighbour long, p double, rank int").select("target", "neighbour", F.round("p", 9).alias("p_distance"), "rank")
