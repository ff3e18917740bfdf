"""Breakpoints as switches of a hidden ancestry: a three-state model of each triplet, trained from several seeded starts, gives a path,
posteriors (forward-backward in logarithms) and an interval around each switch; the edges of events are matched to switches and polished.

Sequences come to a task as bytes, and the model of all triplets of a batch is run at once, rank by rank, so no row a site is shuffled.
Coordinates are sites from 0; a switch's ``position`` is the first site of its new state, and its intervals hold both their ends.  On a circle
an interval whose low end is above its high end passes the origin."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import scans
from tessera.plans.operator import OPERATORS, TABLES, Operator, SparkDialect, operator, view
from tessera.session import shared_dir

STATES, PAD = 3, 3
SEED = 1511506142
ROUNDS = 20
#: Fixed values of the model and of the matching.
STARTS = 21
SWITCHES_AT_FIRST = 5
MOVE_COUNT, EMIT_COUNT = 0.01, 0.25
SURE, SURER = 0.995, 0.999
LEAST_INFORMATIVE = 4
SAME_SWITCH = 2
LEAST_VARIABLE = 3


def starts(length: np.ndarray, count: int = STARTS) -> tuple[np.ndarray, np.ndarray]:
    """Emissions (state, symbol, start) and moves (state, state, start x tracks) before training: the first start prefers a symbol a state,
    the others are drawn from the seed; each expects SWITCHES_AT_FIRST switches a track of this length."""
    draws = np.random.default_rng(SEED).dirichlet(np.ones(3), (count, STATES)).transpose(1, 2, 0)
    draws[:, :, 0] = 0.2 + 0.4 * np.eye(3)
    leave = np.clip(SWITCHES_AT_FIRST / np.maximum(length, 1), 1e-6, 0.5)
    move = np.where(np.eye(3, dtype=bool)[:, :, None], 1 - leave, leave / 2)
    return draws, move


def _logs(emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms; a rank past the end of a track has the symbol PAD, which tells nothing."""
    return np.concatenate([np.log(emit), np.zeros((STATES, 1, emit.shape[2]))], axis=1), np.log(move)


def viterbi(obs: np.ndarray, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest path of each track (rank, track), the first state of equals, and its log-probability; all states are as likely at the start."""
    e, m = _logs(emit, move)
    track, ranks = np.arange(obs.shape[1]), obs.shape[0]
    back = np.zeros((ranks, STATES, obs.shape[1]), np.int8)
    score = e[:, obs[0], track] - math.log(STATES)
    for t in range(1, ranks):
        live, new = obs[t] < PAD, np.empty_like(score)
        for j in range(STATES):
            come = score + m[:, j]
            new[j] = np.maximum(np.maximum(come[0], come[1]), come[2])
            back[t, j] = np.where(live, np.where(come[0] == new[j], 0, np.where(come[1] == new[j], 1, 2)), j)
        score = np.where(live, new + e[:, obs[t], track], score)
    path = np.zeros(obs.shape, np.int8)
    path[-1] = score.argmax(axis=0)
    for t in range(ranks - 1, 0, -1):
        path[t - 1] = back[t, path[t], track]
    return path, score.max(axis=0)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def posteriors(obs: np.ndarray, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability of each state at each rank given the whole track: (rank, state, track)."""
    e, m = _logs(emit, move)
    track, ranks = np.arange(obs.shape[1]), obs.shape[0]
    ahead, behind = np.zeros((ranks, STATES, obs.shape[1])), np.zeros((ranks, STATES, obs.shape[1]))
    ahead[0] = e[:, obs[0], track] - math.log(STATES)
    for t in range(1, ranks):
        for j in range(STATES):
            ahead[t, j] = _log_sum(ahead[t - 1] + m[:, j]) + e[j, obs[t], track]
    for t in range(ranks - 2, -1, -1):
        seen = behind[t + 1] + e[:, obs[t + 1], track]
        for i in range(STATES):
            behind[t, i] = _log_sum(m[i] + seen)
    return np.exp(ahead + behind - _log_sum(ahead[-1]))


def _shares(key: np.ndarray, live: np.ndarray, width: int, pseudo: float) -> np.ndarray:
    """Rates of the columns of each row of a table of counts (state, width, track), counted from keys state * width + column."""
    tracks = key.shape[1]
    cell = key.astype(np.int64) * tracks + np.arange(tracks)
    count = np.bincount(cell[live], minlength=STATES * width * tracks).reshape(STATES, width, tracks) + pseudo
    return count / count.sum(axis=1, keepdims=True)


def fit(obs: np.ndarray, count: int = STARTS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path, emissions and moves of each track, trained on its own paths from every start; the start with the likeliest path wins, the first of equals.

    A track is trained until its path stays as it is, or for ``rounds`` rounds."""
    tracks = obs.shape[1]
    first, moves = starts((obs < PAD).sum(axis=0), count)
    every = np.tile(obs, (1, count))
    emit, move = np.repeat(first, tracks, axis=2), np.tile(moves, (1, 1, count))
    path, score = viterbi(every, emit, move)
    active = np.arange(every.shape[1])
    for _ in range(rounds):
        seen, way = every[:, active], path[:, active].astype(np.int16)
        emit[:, :, active] = _shares(way * 3 + np.minimum(seen, 2), seen < PAD, 3, EMIT_COUNT)
        move[:, :, active] = _shares(way[:-1] * STATES + way[1:], seen[1:] < PAD, STATES, MOVE_COUNT)
        new, score[active] = viterbi(seen, emit[:, :, active], move[:, :, active])
        changed = (new != path[:, active]).any(axis=0)
        path[:, active] = new
        active = active[changed]
        if not len(active):
            break
    best = np.round(score.reshape(count, tracks), 9).argmax(axis=0) * tracks + np.arange(tracks)
    return path[:, best], emit[:, :, best], move[:, :, best]


def _interval(site: np.ndarray, sure: np.ndarray, rank: int, length: int, circular: bool) -> tuple[int, int]:
    """From the site after the one before the last sure rank up to ``rank``, to the site before the one after the first sure rank beyond it.

    Without a sure rank on a side the interval ends with the sequence, or on a circle takes all of it."""
    n = len(site)
    if not circular:
        before, after = sure[sure <= rank], sure[sure > rank]
        low = int(site[before[-1] - 1]) + 1 if len(before) and before[-1] > 0 else 0
        high = int(site[after[0] + 1]) - 1 if len(after) and after[0] < n - 1 else length - 1
        return low, high
    if not len(sure):
        middle = int(site[rank])
        return (middle + 1) % length, middle
    turns = np.concatenate([sure - n, sure, sure + n])
    low, high = turns[turns <= rank][-1] - 1, turns[turns > rank][0] + 1
    if high - low >= n:
        middle = int(site[rank])
        return (middle + 1) % length, middle
    return int(site[low % n] + 1) % length, int(site[high % n] - 1) % length


COLUMNS = "rank int, position int, low_995 int, high_995 int, low int, high int, from_state int, to_state int"


def switches_of(bases: np.ndarray, circular: bool = False, count: int = STARTS) -> dict[str, np.ndarray]:
    """All switches of a batch of triplets (triplet, 3, site); a state is named by the agreement that it emits most (0: first two rows, 1: first and third, 2: last two).

    ``rank`` is the number of informative sites before the switch."""
    names = ["triplet", *(c.split()[0] for c in COLUMNS.split(", "))]
    a, b, c = bases[:, 0], bases[:, 1], bases[:, 2]
    symbol = np.where((a == b) & (a != c), 0, np.where((a == c) & (a != b), 1, np.where((b == c) & (a != b), 2, 9)))
    symbol[(bases > 3).any(axis=1)] = 9
    tracks = [(t, np.flatnonzero(s < 3)) for t, s in enumerate(symbol)]
    tracks = [(t, site) for t, site in tracks if len(site) >= LEAST_INFORMATIVE]
    rows: list[tuple] = []
    if tracks:
        # a circle is read from half a turn before its first rank to half a turn after its last
        order = [(np.arange(2 * len(s)) - len(s) // 2) % len(s) if circular else np.arange(len(s)) for _, s in tracks]
        obs = np.full((max(map(len, order)), len(tracks)), PAD, np.int8)
        for k, ((t, site), o) in enumerate(zip(tracks, order, strict=True)):
            obs[: len(o), k] = symbol[t, site[o]]
        path, emit, move = fit(obs, count)
        most = posteriors(obs, emit, move).max(axis=1)
        name = emit.argmax(axis=1)
        for k, (t, site) in enumerate(tracks):
            n, skip = len(site), len(site) // 2 if circular else 0
            way, sure = path[skip : skip + n, k], most[skip : skip + n, k]
            levels = [np.flatnonzero(sure > x) for x in (SURE, SURER)]
            ends = np.append(way[1:], way[0] if circular else way[-1])
            for r in np.flatnonzero(way != ends):
                gap = int(site[(r + 1) % n] - site[r]) % bases.shape[2]
                position = (int(site[r]) + (gap + 1) // 2) % bases.shape[2]
                inner, outer = (_interval(site, x, int(r), bases.shape[2], circular) for x in levels)
                rows.append((t, r + 1, position, *inner, *outer, name[way[r], k], name[ends[r], k]))
    table = np.array(rows, np.int64).reshape(len(rows), len(names))
    return {x: table[:, i] if x == "triplet" else table[:, i].astype(np.int32) for i, x in enumerate(names)}


def _with_bases(sites: DataFrame, rows: DataFrame, *ids: str) -> DataFrame:
    """Rows with the bases of the sequences that some of their columns name; a broadcast while all sequences are small, a shuffle beyond."""
    whole, n, length = scans.sequences(sites)
    near = F.broadcast if n * length <= scans.MOST_BROADCAST else (lambda table: table)
    for x in ids:
        rows = rows.join(near(whole.select(F.col("seq_id").alias(x), F.col("bases").alias(f"bases_{x}"))), x)
    return rows


def hidden_switches(sites: DataFrame, triplets: DataFrame | None = None, circular: bool = False, count: int = STARTS) -> DataFrame:
    """The switches of the given triplets (a < b < c), or of all."""

    def kernel(bases: np.ndarray) -> dict[str, np.ndarray]:
        return switches_of(bases, circular, count)

    if triplets is None:
        whole, n, length = scans.sequences(sites)
        rows = whole.select(F.col("seq_id").alias("row_id"), F.col("seq_id").alias("origin"), "number", "bases")
        return scans.touching(rows, n, length, n, kernel, COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bases = np.stack([np.frombuffer(b"".join(batch.column(f"bases_{x}").to_pylist()), np.uint8).reshape(batch.num_rows, -1) for x in "abc"], axis=1)
                found = kernel(bases)
                own = batch.take(pa.array(found.pop("triplet")))
                yield pa.RecordBatch.from_arrays([*(own.column(x) for x in "abc"), *map(pa.array, found.values())], names=["a", "b", "c", *found])

    dealt = triplets.select("a", "b", "c").distinct()
    dealt = dealt.repartition(max(1, 4 * sites.sparkSession.sparkContext.defaultParallelism), "a", "b", "c")
    return _with_bases(sites, dealt, "a", "b", "c").select("a", "b", "c", "bases_a", "bases_b", "bases_c").mapInArrow(run, f"a long, b long, c long, {COLUMNS}")


@view("switches", "informative")
def _(d: SparkDialect) -> str:
    """Switches told by runs alone: between one run of at least three informative sites of one agreement and the next such run of another.

    Any other switches (a, b, c, rank, position, low, high), for example ``hidden_switches``, may stand in its place."""
    return f"""SELECT a, b, c, CAST(last_rank + {d.idiv('(gap_ranks + 1)', '2')} AS INT) AS rank, CAST(last_site + {d.idiv('(next_site - last_site + 1)', '2')} AS INT) AS position, CAST(last_site + 1 AS INT) AS low, CAST(next_site AS INT) AS high FROM (
SELECT *, lead(category) OVER w AS next_category, lead(first_site) OVER w AS next_site, (lead(first_rank) OVER w) - last_rank - 1 AS gap_ranks FROM (
SELECT a, b, c, category, min(site) AS first_site, max(site) AS last_site, min(rank) AS first_rank, max(rank) AS last_rank FROM (
SELECT *, rank - row_number() OVER (PARTITION BY a, b, c, category ORDER BY site) AS island FROM informative) i GROUP BY a, b, c, category, island HAVING count(*) >= 3) r
WINDOW w AS (PARTITION BY a, b, c ORDER BY first_rank)) x WHERE next_category <> category"""


@view("tract_edges", "accepted", "informative")
def _(d: SparkDialect) -> str:
    """Both edges of each accepted tract with their triplet, and the number of informative sites before them."""
    of = "least(recombinant, major, minor) AS a, recombinant + major + minor - least(recombinant, major, minor) - greatest(recombinant, major, minor) AS b, greatest(recombinant, major, minor) AS c"
    edges = " UNION ALL ".join(f"SELECT event_id, '{edge}' AS edge, {of}, tract_{edge} AS site FROM accepted" for edge in ("start", "end"))
    return f"""SELECT e.event_id, e.edge, e.a, e.b, e.c, e.site, CAST(coalesce(sum(CASE WHEN i.site < e.site THEN 1 ELSE 0 END), 0) AS INT) AS rank, CAST(count(i.site) AS INT) AS ranks FROM ({edges}) e LEFT JOIN informative i ON i.a = e.a AND i.b = e.b AND i.c = e.c GROUP BY e.event_id, e.edge, e.a, e.b, e.c, e.site"""


def nearest(circular: bool) -> str:
    """Each edge's switch: one whose interval holds it before any other, then the fewest informative sites between, then the first position."""
    apart = "abs(e.rank - s.rank)"
    apart = f"least({apart}, e.ranks - {apart})" if circular else apart
    inside = "CASE WHEN s.low <= s.high THEN e.site BETWEEN s.low AND s.high ELSE e.site >= s.low OR e.site <= s.high END"
    return f"""SELECT event_id, edge, a, b, c, site, position, low, high, inside, CAST(apart AS INT) AS apart FROM (
SELECT *, row_number() OVER (PARTITION BY event_id, edge ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, apart, position, low, high) AS k FROM (
SELECT e.event_id, e.edge, e.a, e.b, e.c, e.site, s.position, s.low, s.high, {inside} AS inside, {apart} AS apart FROM tract_edges e JOIN switches s ON s.a = e.a AND s.b = e.b AND s.c = e.c) y) x WHERE k = 1"""


@operator("nearest_switch", "tract_edges", "switches")
def _(d: SparkDialect) -> str:
    """The switch that each edge of an accepted tract is matched to; an edge of a triplet without switches is left out."""
    return nearest(False)


ON_CIRCLE = Operator("nearest_switch_circular", ("tract_edges", "switches"), lambda d: nearest(True), "As nearest_switch, with ranks counted around a circle.")


def polish(bases: np.ndarray, start: int, end: int, first: tuple | None, last: tuple | None, circular: bool) -> tuple[int, int, bool, bool, str]:
    """A tract [start, end) with edges moved to the switches (position, low, high, inside) that they match.

    An edge moves if it lies in its switch's interval or nearer than half the tract; edges with one switch in common let only the nearer one move,
    and only if near.  A moved edge goes on to the missing sites of its interval that lie farthest into the tract, unless the other switch
    comes before them; both edges leave missing sites behind.  The tract stays as it was if under LEAST_VARIABLE variable sites are left inside or outside."""
    length, whole = bases.shape[1], (bases < 4).all(axis=0)
    half = ((end - start) % length if circular else end - start) / 2

    def apart(x: int, y: int) -> int:
        return min(abs(x - y), length - abs(x - y)) if circular else abs(x - y)

    s, e, why = start, end, "moved"
    to_start = first is not None and (first[3] or apart(start, first[0]) < half)
    to_end = last is not None and (last[3] or apart(end, last[0]) < half)
    if first is not None and last is not None and abs(first[0] - last[0]) <= SAME_SWITCH:
        ds, de, why = apart(start, first[0]), apart(end, last[0]), "one switch"
        to_start, to_end = ds <= de and ds < half, de < ds and de < half
    if to_start:
        s = first[0]
        beyond = np.arange(s, first[2] if s <= first[2] else first[2] + length)
        gaps = beyond[~whole[beyond % length]]
        if len(gaps) and (last is None or last[0] <= s or gaps[-1] < last[0]):
            s = int(gaps[-1] + 1) % length if circular else int(gaps[-1] + 1)
    if to_end:
        e = last[0]
        beyond = np.arange(last[1] if last[1] <= e else last[1] - length, e)
        gaps = beyond[~whole[beyond % length]]
        if len(gaps) and (first is None or first[0] >= e or gaps[0] > first[0]):
            e = int(gaps[0]) % length if circular else int(gaps[0])
    # a tract starts and ends with complete sites
    here = np.flatnonzero(whole)
    if len(here):
        after, before = here[here >= s], here[here < e]
        s = int(after[0]) if len(after) else int(here[0]) if circular else s
        e = int(before[-1]) + 1 if len(before) else int(here[-1]) + 1 if circular else e
    variable = np.flatnonzero(whole & ((bases != bases[0]).any(axis=0)))
    within = (variable >= s) & (variable < e) if s < e else (variable >= s) | (variable < e) if circular else np.zeros(len(variable), bool)
    if min(within.sum(), (~within).sum()) < LEAST_VARIABLE:
        return start, end, False, False, "too few sites"
    return s, e, bool(to_start), bool(to_end), why if to_start or to_end else "stayed"


POLISHED = "event_id {}, recombinant long, major long, minor long, tract_start int, tract_end int, polished_start int, polished_end int, start_moved boolean, end_moved boolean, outcome string"


def polished(sites: DataFrame, events: DataFrame, matches: DataFrame, circular: bool = False) -> DataFrame:
    """Events (event_id, recombinant, major, minor, tract_start, tract_end) with their edges polished by the switches that ``nearest_switch`` matched."""
    for edge in ("start", "end"):
        # as one array of numbers, which stays whole where an edge has no match
        own = matches.where(F.col("edge") == edge).select("event_id", F.array("position", "low", "high", F.col("inside").cast("int")).alias(f"{edge}_match"))
        events = events.join(own, "event_id", "left")
    ids = ("recombinant", "major", "minor")
    rows = _with_bases(sites, events, *ids).select("event_id", *ids, "tract_start", "tract_end", "start_match", "end_match", *(f"bases_{x}" for x in ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def match(x) -> tuple | None:
            return None if x is None else (int(x[0]), int(x[1]), int(x[2]), bool(x[3]))

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                bases = np.stack([np.frombuffer(getattr(r, f"bases_{x}"), np.uint8) for x in ids])
                out.append(polish(bases, r.tract_start, r.tract_end, match(r.start_match), match(r.end_match), circular))
            names = ["polished_start", "polished_end", "start_moved", "end_moved", "outcome"]
            yield pd.concat([b[["event_id", *ids, "tract_start", "tract_end"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return rows.mapInPandas(run, POLISHED.format(events.schema["event_id"].dataType.simpleString()))


def triplet_edges(sites: DataFrame, events: DataFrame) -> DataFrame:
    """The view ``tract_edges`` of the given events, counted in their sequences."""
    low, high = F.least("recombinant", "major", "minor"), F.greatest("recombinant", "major", "minor")
    rows = events.select("event_id", low.alias("a"), (F.col("recombinant") + F.col("major") + F.col("minor") - low - high).alias("b"), high.alias("c"), "tract_start", "tract_end")
    kind = events.schema["event_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                a, b, c = (np.frombuffer(x, np.uint8) for x in (r.bases_a, r.bases_b, r.bases_c))
                site = np.flatnonzero((np.maximum(np.maximum(a, b), c) < 4) & ((a == b).astype(int) + (a == c) + (b == c) == 1))
                out += [(r.event_id, edge, r.a, r.b, r.c, x, int(np.searchsorted(site, x)), len(site)) for edge, x in (("start", r.tract_start), ("end", r.tract_end))]
            yield pd.DataFrame(out, columns=["event_id", "edge", "a", "b", "c", "site", "rank", "ranks"])

    return _with_bases(sites, rows, "a", "b", "c").mapInPandas(run, f"event_id {kind}, edge string, a long, b long, c long, site int, rank int, ranks int")


def polished_tracts(sites: DataFrame, events: DataFrame, circular: bool = False, count: int = STARTS) -> DataFrame:
    """Events polished by the hidden switches of their own triplets.  The events and the edges are written once to the session's folder for checkpoints."""
    spark = sites.sparkSession
    shared_dir(spark)
    sites, events = sites.checkpoint(), events.select("event_id", "recombinant", "major", "minor", "tract_start", "tract_end").checkpoint()
    edges = triplet_edges(sites, events).checkpoint()
    found = hidden_switches(sites, edges, circular, count)
    match = ON_CIRCLE if circular else OPERATORS["nearest_switch"]
    return polished(sites, events, match.run(spark, tract_edges=edges, switches=found), circular)


def _tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    leaves = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in Operator(name, (name,), lambda _: "", "")._parts(set(TABLES))[0]}
    return Operator(name, (name,), lambda _: f"SELECT * FROM {name}", "").run(spark, **leaves)


QUERIES = {
    "hidden_switches": lambda spark, sf_dir: hidden_switches(_tables(spark, sf_dir, "sites")),
    "polished_tracts": lambda spark, sf_dir: polished_tracts(_tables(spark, sf_dir, "sites"), _tables(spark, sf_dir, "accepted")),
}
