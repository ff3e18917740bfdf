"""Disassembly as an ordered fold, and incremental detection against full rescans."""

import random

import numpy as np
import pytest

from tessera.operators import components as c
from tessera.operators import scans
from tessera.plans.cyclic import cyclic_events
from tessera.plans.operator import OPERATORS


def show(bases, segments):
    return bytes(b if any(a <= i < e for a, e in segments) else 4 for i, b in enumerate(bases))


def plain(bases, events, length):
    """Every row as bytes, cut event by event."""
    rows = {c.Address(o): b for o, b in bases.items()}
    held = []
    for e in events:
        if not e.members or any(m not in rows for m in e.members):
            held.append(e.event_id)
            continue
        for m in e.members:
            row = rows.pop(m)
            tract = e.tract(length)
            rows[c.Address(m.origin, m.kind, (*m.lineage, e.event_id))] = bytes(4 if any(a <= i < z for a, z in tract) else b for i, b in enumerate(row))
            rows[c.Address(m.origin, c.TRACT, (*m.lineage, e.event_id, "inside"))] = show(row, tract)
    return rows, held


def frames(spark, bases):
    return spark.createDataFrame([(o, bytearray(b)) for o, b in bases.items()], "seq_id long, bases binary")


def test_three_nested_tracts_and_one_held(spark):
    rng = random.Random(1)
    bases = {o: bytes(rng.randrange(4) for _ in range(100)) for o in range(4)}
    inner = c.Address(0, c.TRACT, ("e1", "inside"))
    events = [
        c.Event("e1", (c.Address(0),), 20, 80),
        c.Event("e2", (inner, c.Address(2)), 30, 60),
        c.Event("e3", (c.Address(0, c.TRACT, ("e1", "inside", "e2", "inside")),), 40, 50),
        # sequence 0 is no longer whole, so nothing of this event is applied, not even to sequence 1
        c.Event("e4", (c.Address(1), c.Address(0)), 5, 10),
        c.Event("e5", (c.Address(3),), 90, 10),
    ]
    state = c.fold(events, 100, 10)
    assert state.held == ["e4"]
    want, held = plain(bases, events, 100)
    assert held == ["e4"]
    got = c.rows_of(frames(spark, bases), state).collect()
    assert {(r.origin, r.kind, tuple(r.lineage)): bytes(r.bases) for r in got} == {(a.origin, a.kind, a.lineage): b for a, b in want.items()}
    assert len({r.row_id for r in got}) == len(got) == 4 + 5 and {r.row_id for r in got if r.kind == c.REMAINDER} == {0, 1, 2, 3}
    # the innermost tract shows its own sites alone
    assert next(s for a, (_, s) in state.parts.items() if a.lineage[-3:] == ("inside", "e3", "inside")) == [(40, 50)]


def test_random_folds_equal_cutting_bytes(spark):
    rng = random.Random(2)
    for _ in range(40):
        bases = {o: bytes(rng.randrange(4) for _ in range(30)) for o in range(3)}
        known, events = [c.Address(o) for o in bases], []
        for k in range(8):
            members = tuple(dict.fromkeys(rng.choice(known) for _ in range(rng.randint(1, 2))))
            events.append(c.Event(f"e{k}", members, rng.randrange(30), rng.randrange(1, 31)))
            known += [x for m in members for x in (c.Address(m.origin, m.kind, (*m.lineage, f"e{k}")), c.Address(m.origin, c.TRACT, (*m.lineage, f"e{k}", "inside")))]
        want, held = plain(bases, events, 30)
        state = c.fold(events, 30, 100)
        assert state.held == held
        got = {a: show(bases[a.origin], s) for a, (_, s) in state.parts.items()}
        assert got == {a: b for a, b in want.items() if a.origin in state.touched}


def planted(seed, n, length, tracts):
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 4, length)
    m = np.where(rng.random((n, length)) < 0.45, rng.integers(0, 4, (n, length)), common)
    for k, (child, major, minor, a, e) in enumerate(tracts):
        if child not in [t[0] for t in tracts[:k]]:
            m[child] = m[major]
        m[child, a:e] = m[minor, a:e]
    return m


def sites_of(spark, m):
    return spark.createDataFrame([(i, s, int(m[i, s])) for i in range(m.shape[0]) for s in range(m.shape[1])], "seq_id long, site int, base int").repartition(2)


@pytest.mark.parametrize(
    ("seed", "n", "tracts"),
    [(1, 6, [(0, 1, 2, 100, 260)]), (2, 7, [(0, 1, 2, 60, 200), (3, 4, 5, 300, 480)]), (3, 6, [(0, 1, 2, 50, 420), (0, 1, 3, 150, 290)])],
)
def test_incremental_detection_equals_full_rescans(spark, seed, n, tracts):
    sites = sites_of(spark, planted(seed, n, 600, tracts))
    some = cyclic_events(spark, sites, correct=True, alpha=0.001).orderBy("pass").collect()
    full = cyclic_events(spark, sites, correct=True, alpha=0.001, incremental=False).orderBy("pass").collect()
    assert [r[:-1] for r in some] == [r[:-1] for r in full] and len(some) >= len(tracts)
    assert some[0].scanned == full[0].scanned and all(a.scanned < b.scanned for a, b in zip(some[1:], full[1:], strict=True))
    for child, _, _, a, e in tracts:
        assert any(child in (r.recombinant_origin, r.major_origin, r.minor_origin) and min(e, r.tract_end) - max(a, r.tract_start) > (e - a) / 2 for r in some)
    assert all(len({r.recombinant_origin, r.major_origin, r.minor_origin}) == 3 for r in some)


def test_walks_equal_the_sql_operator(spark):
    rng = np.random.default_rng(7)
    m = np.where(rng.random((7, 90)) < 0.6, rng.integers(0, 4, (7, 90)), rng.integers(0, 4, 90))
    m[rng.random(m.shape) < 0.05] = 4
    m[6] = m[5]
    sites = sites_of(spark, m)
    whole, n, length = scans.sequences(sites)
    rows = whole.selectExpr("seq_id as row_id", "seq_id as origin", "number", "bases")
    got = scans.touching(rows, n, length, n, scans.walks, scans.WALKS)
    want = OPERATORS["three_seq_walk"].run(spark, sites=sites)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 50


def test_only_triplets_with_changed_rows_are_made(spark):
    m = planted(4, 7, 60, [])
    whole, n, length = scans.sequences(sites_of(spark, m))
    rows = whole.selectExpr("seq_id as row_id", "if(seq_id = 3, 2, seq_id) as origin", "number", "bases")
    seen = scans.touching(rows, n, length, 2, lambda b: {"triplet": np.arange(len(b)), "one": np.ones(len(b), np.int32)}, "one int").collect()
    want = [(a, b, d) for a in range(7) for b in range(a + 1, 7) for d in range(b + 1, 7) if d >= 5 and not {2, 3} <= {a, b, d}]
    assert sorted((r.a, r.b, r.c) for r in seen) == want
