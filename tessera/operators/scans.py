"""Scans of all triplets or quartets of an alignment without a row a site: combinations are numbers of a range that tasks
turn into sequences, and a detector sees whole sequences as bytes.

Sequences are joined to their triplets by number; the join is a broadcast while all sequences together are at most MOST_BROADCAST
bytes, and a shuffle beyond."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_BROADCAST = 64 << 20
CHI_WINDOW = 40
LEAST_LENGTH = 4
SMOOTHED = 5
#: Fixed values of the window rules.
CRITICAL = 2
LEAST_SITES = 7
LEAST_HALF = 6
SHARE = 0.75
ROUNDING = 0.51


def sequences(sites: DataFrame) -> tuple[DataFrame, int, int]:
    """number (from 0, by seq_id), seq_id and bases (a byte a site, 4 where there is no row); and how many, and how long."""
    length, n = sites.agg(F.max("site"), F.countDistinct("seq_id")).first()
    length = 0 if length is None else length + 1

    def fill(key, rows):
        out = np.full(length, 4, np.uint8)
        out[rows.column("site").to_numpy()] = np.minimum(rows.column("base").to_numpy(), 4)
        return pa.table({"seq_id": pa.array([key[0].as_py()], pa.int64()), "bases": pa.array([out.tobytes()], pa.binary())})

    whole = sites.groupBy("seq_id").applyInArrow(fill, "seq_id long, bases binary")
    # only the ids are numbered in one place, not the bases
    numbers = sites.select("seq_id").distinct().withColumn("number", F.row_number().over(Window.orderBy("seq_id")) - 1)
    return whole.join(numbers, "seq_id"), n, length


def unrank(rank: np.ndarray, size: int) -> np.ndarray:
    """The combinations with these numbers, rising, one a row: number = C(last, size) + C(last but one, size - 1) + ..."""
    rank, out = rank.astype(np.int64).copy(), []
    for k in range(size, 0, -1):
        # the largest m with C(m, k) <= rank, from an estimate by the k-th root
        m = np.floor((rank * float(math.factorial(k))) ** (1 / k)).astype(np.int64) + k
        while (over := _choose(m, k) > rank).any():
            m = m - over
        rank -= _choose(m, k)
        out.append(m)
    return np.stack(out[::-1], axis=1)


def _choose(m: np.ndarray, k: int) -> np.ndarray:
    out = np.ones(len(m), np.int64)
    for j in range(k):
        out = out * (m - j) // (j + 1)
    return np.where(m >= k, out, 0)


def combinations(sites: DataFrame, size: int) -> DataFrame:
    """All combinations of a size: numbers n0, n1, ... in rising order, dealt evenly over tasks."""
    n = sites.select("seq_id").distinct().count()
    spark, total = sites.sparkSession, math.comb(n, size)
    tasks = max(4 * spark.sparkContext.defaultParallelism, math.ceil(total / 8192))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = unrank(b.column("id").to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(size)], names=[f"n{k}" for k in range(size)])

    return spark.range(0, total, 1, min(tasks, max(1, total))).mapInArrow(run, ", ".join(f"n{k} long" for k in range(size)))


def touching(rows: DataFrame, n: int, length: int, affected: int, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], columns: str) -> DataFrame:
    """Runs a kernel on all triplets of n rows (row_id, origin, number, bases) that have one of the last ``affected`` numbers and three different origins.

    The numbers of such triplets are the end of the range of all combinations, so no other triplet is made.  A kernel takes many triplets
    (triplets, 3, sites), each by rising row_id, and gives columns; "triplet" says which one a value is of."""
    first, total, spark = math.comb(n - affected, 3), math.comb(n, 3), rows.sparkSession
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, (total - first) // 256), (total - first) // 8192)
    near = F.broadcast if n * length <= MOST_BROADCAST else (lambda table: table)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = unrank(b.column("id").to_numpy(), 3)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(3)], names=["n0", "n1", "n2"])

    triplets = spark.range(first, total, 1, tasks).mapInArrow(numbers, "n0 long, n1 long, n2 long")
    for k in range(3):
        own = rows.select(F.col("number").cast("long").alias(f"n{k}"), F.col("row_id").alias(f"row_{k}"), F.col("origin").alias(f"origin_{k}"), F.col("bases").alias(f"bases_{k}"))
        triplets = triplets.join(near(own), f"n{k}")
    triplets = triplets.where("origin_0 <> origin_1 and origin_0 <> origin_2 and origin_1 <> origin_2")
    declared = f"a long, b long, c long, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, (1 << 20) // max(length, 1))
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                ids = np.stack([batch.column(f"row_{k}").to_numpy() for k in range(3)], axis=1)
                order = np.argsort(ids, axis=1)
                bases = np.stack([np.frombuffer(b"".join(batch.column(f"bases_{k}").to_pylist()), np.uint8).reshape(-1, length) for k in range(3)], axis=1)
                found = kernel(np.take_along_axis(bases, order[:, :, None], axis=1))
                ids = np.take_along_axis(ids, order, axis=1)[found.pop("triplet")]
                yield pa.RecordBatch.from_arrays([*(pa.array(ids[:, k]) for k in range(3)), *(pa.array(x) for x in found.values())], names=["a", "b", "c", *found])

    return triplets.select(*(f"{c}_{k}" for k in range(3) for c in ("row", "bases"))).mapInArrow(run, declared)


WALKS = "target int, up int, down int, descent int, tract_start int, tract_end int"


def walks(bases: np.ndarray) -> dict[str, np.ndarray]:
    """The largest descent of the walk of each target of each triplet: a step up where the target equals one parent alone, down where it equals the other."""
    a, b, c = bases[:, 0], bases[:, 1], bases[:, 2]
    whole = (bases < 4).all(axis=1)
    ab, ac, bc = (whole & (x == y) & (x != z) for x, y, z in ((a, b, c), (a, c, b), (b, c, a)))
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("triplet", "target", "up", "down", "descent", "tract_start", "tract_end")}
    site = np.arange(bases.shape[2], dtype=np.int32)
    for target, (rise, fall) in enumerate(((ac, bc), (ab, ac), (bc, ab))):
        height = np.cumsum(rise.astype(np.int32) - fall, axis=1)
        peak = np.maximum(np.maximum.accumulate(height, axis=1), 0)
        before = np.concatenate([np.zeros((len(bases), 1), np.int32), peak[:, :-1]], axis=1)
        drop = peak - height
        end = drop.argmax(axis=1)
        # the last new height at or before the end of the descent; the descent starts at the next step
        record = np.where(height > before, site, -1)
        last = np.maximum.accumulate(record, axis=1)[np.arange(len(bases)), end]
        start = ((rise | fall) & (site > last[:, None])).argmax(axis=1)
        deepest = drop[np.arange(len(bases)), end]
        own = np.flatnonzero(deepest > 0)
        for name, x in (("triplet", own), ("target", np.full(len(own), target)), ("up", rise.sum(axis=1)[own]), ("down", fall.sum(axis=1)[own]), ("descent", deepest[own]), ("tract_start", start[own]), ("tract_end", end[own] + 1)):
            out[name].append(x if name == "triplet" else x.astype(np.int32))
    return {k: np.concatenate(x) for k, x in out.items()}


def scan_triplets(sites: DataFrame, detector: Callable[[np.ndarray], list[tuple]], columns: str, names: list[str]) -> DataFrame:
    """Runs a detector on each triplet: from a matrix of three rows of bases to rows of ``columns``; a, b and c are put before them."""
    whole, n, length = sequences(sites)
    near = F.broadcast if n * length <= MOST_BROADCAST else (lambda table: table)
    rows = combinations(sites, 3)
    for k, letter in enumerate("abc"):
        own = whole.select(F.col("number").cast("long").alias(f"n{k}"), F.col("seq_id").alias(letter), F.col("bases").alias(f"bases_{letter}"))
        rows = rows.join(near(own), f"n{k}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(x).to_pylist() for x in "abc"]
            bases = [batch.column(f"bases_{x}").to_pylist() for x in "abc"]
            out = []
            for a, b, c, *of in zip(*ids, *bases, strict=True):
                out += [(a, b, c, *row) for row in detector(np.frombuffer(b"".join(of), np.uint8).reshape(3, -1))]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(["a", "b", "c", *names], row, strict=True)) for row in out], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    declared = f"a long, b long, c long, {columns}"
    schema = to_arrow_schema(StructType.fromDDL(declared))
    return rows.select("a", "b", "c", "bases_a", "bases_b", "bases_c").mapInArrow(run, declared)


def half_window(n: int, full: int = CHI_WINDOW) -> int:
    """Half the window for a track of n sites, or 0 if the track is too short for any: the asked one if the track holds it, else one
    cut from SHARE of the track, and if that tells nothing (a shift must pass CRITICAL sites) one cut from the whole track."""

    def cut(share: float) -> int:
        return int(share * n / 2 + ROUNDING) - 1

    asked = math.ceil(full / 2)
    offers = (asked if n >= 2 * asked else cut(SHARE), cut(1))
    chosen = next((h for h in offers if h > CRITICAL), 0)
    return chosen if n >= LEAST_SITES and chosen >= LEAST_HALF else 0


class Track:
    """One row of ones and zeros along some sites of a triplet, with sums to any rank; ``gaps`` counts the missing sites before each site."""

    def __init__(self, score: np.ndarray, site: np.ndarray, gaps: np.ndarray, full: int, circular: bool):
        self.n, self.site, self.gaps, self.circular = len(score), site, gaps, circular
        self.half = half_window(self.n, full)
        # three turns of the circle, so that any window around a rank of the middle one is a difference of sums
        self.sums = np.concatenate([[0], np.cumsum(np.tile(score.astype(np.int64), 3))])

    def around(self, rank: np.ndarray | int, width: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Ones in the ``width`` ranks before a rank, and in those from it on."""
        at = np.asarray(rank) + self.n
        return self.sums[at] - self.sums[at - width], self.sums[at + width] - self.sums[at]

    @staticmethod
    def shift(left: np.ndarray, right: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Chi-square of two windows of one width."""
        both = left + right
        margins = both * (2.0 * width - both)
        return np.where(margins > 0, 2.0 * width * (left - right) ** 2 / np.where(margins > 0, margins, 1), 0.0)

    def _whole(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether no site between two ranks is missing."""
        return self.gaps[self.site[last] + 1] == self.gaps[self.site[first]]

    def profile(self) -> np.ndarray:
        rank = np.arange(self.n)
        left, right = self.around(rank, self.half)
        chi = np.where(np.abs(left - right) > CRITICAL, self.shift(left, right, self.half), 0.0)
        if not self.circular:
            inside = (rank >= self.half) & (rank + self.half <= self.n)
            chi[~inside] = 0.0
            some = rank[inside]
            chi[some[~self._whole(some - self.half, some + self.half - 1)]] = 0.0
        return chi

    def smooth(self, chi: np.ndarray) -> np.ndarray:
        """The mean of eleven ranks of the circle, also for linear scans."""
        return np.mean([np.roll(chi, k) for k in range(-SMOOTHED, SMOOTHED + 1)], axis=0)

    def grown(self, peak: int, start: float) -> tuple[int, int]:
        """The largest shift at a peak over widening windows, in thousandths, and its width; gives up after many widths without a gain."""
        narrow = min(max(int(self.half / 4 + ROUNDING), LEAST_HALF), self.half, self.n // 2)
        fails_left = most = max(1, min(2 * self.half, (self.n - 2 * narrow) // 2))
        width = np.arange(narrow + 1, self.n // 2 + 1)
        if not self.circular:
            width = width[(peak - width >= 0) & (peak + width - 1 < self.n)]
            whole = self._whole(peak - width, peak + width - 1)
            width = width if whole.all() else width[: int(np.argmin(whole))]
        best, best_width = start, self.half
        for w, x in zip(width.tolist(), self.shift(*self.around(peak, width), width).tolist(), strict=True):
            if x >= best:
                best, best_width, fails_left = x, w, most
            else:
                fails_left -= 1
                if fails_left < 0:
                    break
        return int(min(best, 2_000_000.0) * 1000), best_width

    def peaks(self) -> list[tuple[int, int, int, int]]:
        """Rank, sign, shift in thousandths and width of each peak, by rank: the highest first, each clearing the basin that falls away from it on both sides."""
        chi = self.profile()
        smooth = self.smooth(chi)
        falls = {way: (smooth > 0) & ((smooth >= np.roll(smooth, -way)) | (smooth >= np.roll(smooth, -2 * way))) for way in (1, -1)}
        ends = {way: np.flatnonzero(~np.tile(falls[way], 3)) for way in (1, -1)}
        found = []
        while chi.max(initial=0.0) > 0:
            peak = int(np.argmax(chi))
            left, right = self.around(peak, self.half) if self.circular else self._clipped(peak)
            found.append((peak, 1 if left >= right else -1, *self.grown(peak, float(chi[peak]))))
            at = peak + self.n
            after = ends[1][np.searchsorted(ends[1], at) :][:1]
            before = ends[-1][: np.searchsorted(ends[-1], at, "right")][-1:]
            if not len(after) or not len(before) or after[0] - before[0] >= self.n - 1:
                break
            chi[np.arange(before[0], after[0] + 1) % self.n] = 0.0
        return sorted(found)

    def _clipped(self, peak: int) -> tuple[int, int]:
        low, high = max(0, peak - self.half), min(self.n, peak + self.half)
        return self.sums[peak] - self.sums[low], self.sums[high] - self.sums[peak]

    def events(self, length: int) -> list[tuple]:
        """start, end, wraps, shift of the weaker end in thousandths, n, half window, and the widths: peaks of one sign, the highest of them, up to the next of the other sign."""
        if not self.half:
            return []
        place = lambda rank: 0 if rank <= 0 else length if rank >= self.n else int(self.site[rank])
        out, peaks, at = [], self.peaks(), 0
        while at + 1 < len(peaks):
            other = next((k for k in range(at + 1, len(peaks)) if peaks[k][1] != peaks[at][1]), None)
            if other is None:
                break
            opens, closes = max(peaks[at:other], key=lambda p: p[2]), peaks[other]
            if place(closes[0]) - place(opens[0]) >= LEAST_LENGTH:
                out.append((place(opens[0]), place(closes[0]), False, min(opens[2], closes[2]), self.n, self.half, opens[3], closes[3]))
            at = other + 1
        if self.circular and len(peaks) > 1 and peaks[-1][1] != peaks[0][1]:
            opens, closes = peaks[-1], peaks[0]
            size = length - place(opens[0]) + place(closes[0])
            if LEAST_LENGTH <= size < length - LEAST_LENGTH:
                out.append((place(opens[0]), place(closes[0]), True, min(opens[2], closes[2]), self.n, self.half, opens[3], closes[3]))
        return out


def chi_tracks(bases: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """Method, track, scores and sites: agreement of each pair over sites that vary, and of each target with its first parent where its parents differ and it has a parent's base."""
    fine = (bases < 4).all(axis=0)
    a, b, c = bases
    same = (a == b, a == c, b == c)
    site = np.flatnonzero(fine & ~(same[0] & same[1]))
    for pair in range(3):
        yield "maxchi", pair, same[pair][site], site
    for target in range(3):
        t, first, second = bases[target], bases[(target + 1) % 3], bases[(target + 2) % 3]
        site = np.flatnonzero(fine & (first != second) & ((t == first) | (t == second)))
        yield "chimaera", target, (t == first)[site], site


def chi_detector(bases: np.ndarray, full: int = CHI_WINDOW, circular: bool = False) -> list[tuple]:
    gaps = np.concatenate([[0], np.cumsum(~(bases < 4).all(axis=0))])
    out = []
    for method, track, score, site in chi_tracks(bases):
        for start, end, wraps, shift, n, half, left, right in Track(score, site, gaps, full, circular).events(bases.shape[1]):
            p = min(1.0, math.erfc(math.sqrt(shift / 2000)) * max(1.0, n / half) * 3)
            out.append((method, track, start, end, wraps, shift / 1000, max(p, 4.9e-324), n, half, left, right))
    return out


def chi_events(sites: DataFrame, full: int = CHI_WINDOW, circular: bool = False) -> DataFrame:
    """Tracts between paired peaks of the window profiles of all triplets: a, b, c, method, track (pair or target), tract, shift, p, informative sites, half window, widths."""
    return scan_triplets(
        sites,
        lambda bases: chi_detector(bases, full, circular),
        "method string, track int, tract_start int, tract_end int, wraps boolean, shift double, p double, n int, half int, left_width int, right_width int",
        ["method", "track", "tract_start", "tract_end", "wraps", "shift", "p", "n", "half", "left_width", "right_width"],
    )


def quartet_splits(bases: np.ndarray) -> np.ndarray:
    """For quartets (quartets, 4, sites) the support of the three splits at each site: 2 if both pairs agree and differ from one another, 1 if one pair alone agrees."""
    fine = (bases < 4).all(axis=1)
    eq = {(i, j): bases[:, i] == bases[:, j] for i in range(4) for j in range(i + 1, 4)}
    equal_pairs = sum(x.astype(np.int8) for x in eq.values())
    out = []
    for one, other in (((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))):
        # two equal pairs and no third: both pairs, of different bases; a single equal pair: that pair alone
        full = eq[one] & eq[other] & (equal_pairs == 2)
        half = (eq[one] | eq[other]) & (equal_pairs == 1)
        out.append((2 * full + half) * fine)
    return np.stack(out, axis=1).astype(np.int32)


def quartet_shift(sites: DataFrame, events: DataFrame, most_bytes: int = MOST_BROADCAST) -> DataFrame:
    """For each event (event_id, recombinant, major, minor, tract_start, tract_end) and candidate role: the mean shift of split shares between tract and
    background over all quartets with that sequence, and how many there are.

    Quartets are dealt over tasks; a task works out the splits of its quartets once for all events, and tells sums.  Sequences and events are sent to the
    tasks; both together must fit ``most_bytes``."""
    whole, n, length = sequences(sites)
    held = events.select("event_id", "recombinant", "major", "minor", "tract_start", "tract_end").limit(most_bytes // 64 + 1).collect()
    if n * length + 64 * len(held) > most_bytes:
        raise ValueError("sequences and events are larger than most_bytes")
    matrix = whole.orderBy("number").collect()
    place = {r.seq_id: r.number for r in matrix}
    bases = np.stack([np.frombuffer(r.bases, np.uint8) for r in matrix]) if matrix else np.zeros((0, 0), np.uint8)
    roles = np.array([[place.get(x, -1) for x in (e.recombinant, e.major, e.minor)] for e in held]).reshape(-1, 3)
    spans = np.array([(e.tract_start, e.tract_end) for e in held]).reshape(-1, 2)
    shared = sites.sparkSession.sparkContext.broadcast((bases, roles, spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, roles, spans = shared.value
        total, count = np.zeros((len(roles), 3)), np.zeros((len(roles), 3), np.int64)
        for batch in batches:
            numbers = np.stack([batch.column(f"n{k}").to_numpy() for k in range(4)], axis=1)
            for a in range(0, len(numbers), 512):
                some = numbers[a : a + 512]
                sums = np.concatenate([np.zeros((len(some), 3, 1), np.int64), np.cumsum(quartet_splits(bases[some]), axis=2)], axis=2)
                every = sums[:, :, -1]
                for e, (role, (start, end)) in enumerate(zip(roles, spans, strict=True)):
                    has = (some[:, :, None] == role[None, None, :]).any(axis=1)
                    at = np.flatnonzero(has.any(axis=1))
                    inside = sums[at, :, end] - sums[at, :, start]
                    outside = every[at] - inside
                    i, o = inside.sum(axis=1), outside.sum(axis=1)
                    ok = (i > 0) & (o > 0)
                    shift = np.abs(inside[ok] / i[ok, None] - outside[ok] / o[ok, None]).sum(axis=1)
                    total[e] += shift @ has[at[ok]]
                    count[e] += has[at[ok]].sum(axis=0)
        e, r = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(e.astype(np.int64)), pa.array(r.astype(np.int32)), pa.array(total[e, r]), pa.array(count[e, r])], names=["event", "role", "total", "quartets"])

    names = sites.sparkSession.createDataFrame([(k, e.event_id) for k, e in enumerate(held)], "event long, event_id string")
    sums = combinations(sites, 4).mapInArrow(run, "event long, role int, total double, quartets long").groupBy("event", "role").agg(F.sum("total").alias("total"), F.sum("quartets").alias("quartets"))
    role = F.element_at(F.array(F.lit("recombinant"), F.lit("major"), F.lit("minor")), F.col("role") + 1)
    return sums.join(F.broadcast(names), "event").select("event_id", role.alias("role"), F.round(F.col("total") / F.col("quartets"), 9).alias("shift"), "quartets")
