"""Hidden switches, their intervals, and tracts polished by them."""

import itertools

import numpy as np
import pytest

from tessera.operators import switches
from tessera.plans.catalogue import OPERATORS


def model(rng, tracks):
    return rng.dirichlet(np.ones(3), (tracks, 3)).transpose(1, 2, 0), rng.dirichlet(np.ones(3) * 2, (tracks, 3)).transpose(1, 2, 0)


def test_paths_and_posteriors_equal_an_enumeration_of_all_paths():
    rng = np.random.default_rng(3)
    lengths = [6, 4, 1, 5]
    obs = np.full((6, 4), switches.PAD, np.int8)
    for k, n in enumerate(lengths):
        obs[:n, k] = rng.integers(0, 3, n)
    emit, move = model(rng, 4)
    path, score = switches.viterbi(obs, emit, move)
    found = switches.posteriors(obs, emit, move)
    for k, n in enumerate(lengths):
        weight = np.zeros((n, 3))
        best = (-1.0, None)
        for way in itertools.product(range(3), repeat=n):
            p = 1 / 3
            for t, x in enumerate(way):
                p *= emit[x, obs[t, k], k] * (move[way[t - 1], x, k] if t else 1)
            for t, x in enumerate(way):
                weight[t, x] += p
            best = max(best, (p, way))
        assert np.allclose(found[:n, :, k], weight / weight.sum(axis=1, keepdims=True), atol=1e-12)
        assert tuple(path[:n, k]) == best[1] and np.isclose(np.exp(score[k]), best[0])


def test_a_batch_gives_what_each_triplet_gives_alone():
    rng = np.random.default_rng(5)
    bases = np.where(rng.random((6, 3, 90)) < 0.1, 4, rng.integers(0, 3, (6, 3, 90))).astype(np.uint8)
    bases[5] = 1  # no informative site
    for circular in (False, True):
        together = switches.switches_of(bases, circular, 4)
        alone = [switches.switches_of(bases[t : t + 1], circular, 4) for t in range(6)]
        for name in ("rank", "position", "low", "high", "from_state", "to_state"):
            assert together[name].tolist() == [x for one in alone for x in one[name].tolist()]


def mosaic(length=600, tract=(200, 380), seed=2, noise=0.0):
    """A recombinant (row 0) like row 1, but like row 2 inside the tract (over the origin if it ends before it starts)."""
    rng = np.random.default_rng(seed)
    one, two = rng.integers(0, 4, length), rng.integers(0, 4, length)
    site = np.arange(length)
    start, end = tract
    inside = (site >= start) & (site < end) if start < end else (site >= start) | (site < end)
    row = np.where(inside, two, one)
    row = np.where(rng.random(length) < noise, rng.integers(0, 4, length), row)
    return np.stack([row, one, two]).astype(np.uint8)


@pytest.mark.parametrize(("tract", "circular"), [((200, 380), False), ((480, 90), True)])
def test_planted_edges_lie_in_their_intervals(tract, circular):
    found = switches.switches_of(mosaic(tract=tract, noise=0.02)[None], circular)
    assert len(found["position"]) == 2
    for edge in tract:
        k = int(np.argmin(np.abs(found["position"] - edge)))
        assert abs(int(found["position"][k]) - edge) <= 6
        assert found["low"][k] <= edge <= found["high"][k] and found["low"][k] <= found["low_995"][k] <= found["high_995"][k] <= found["high"][k]
    assert set(zip(found["from_state"].tolist(), found["to_state"].tolist(), strict=True)) == {(0, 1), (1, 0)}


def test_a_track_without_a_switch_has_none():
    assert len(switches.switches_of(mosaic(tract=(0, 0))[None], False)["position"]) == 0
    assert len(switches.switches_of(np.zeros((0, 3, 40), np.uint8))["position"]) == 0


def test_polish_rules():
    bases = mosaic()
    near, far = (200, 190, 210, True), (380, 370, 390, True)
    assert switches.polish(bases, 195, 386, near, far, False) == (200, 380, True, True, "moved")
    # outside the interval: moved if nearer than half the tract, else not
    assert switches.polish(bases, 230, 380, (200, 190, 210, False), far, False)[:3] == (200, 380, True)
    assert switches.polish(bases, 330, 380, (200, 190, 210, False), far, False)[:3] == (330, 380, False)
    # one switch for both edges moves the nearer only
    assert switches.polish(bases, 196, 300, near, near, False) == (200, 300, True, False, "one switch")
    # missing sites of the interval: the start goes past the last, the end to the first
    gaps = bases.copy()
    gaps[1, 204:207] = 4
    gaps[2, [373, 375]] = 4
    assert switches.polish(gaps, 195, 386, near, far, False)[:2] == (207, 373)
    # complete sites at both ends, also without a match: sites 204 to 206 and 375 are missing, 374 is not
    assert switches.polish(gaps, 205, 376, None, None, False) == (207, 375, False, False, "stayed")
    # too few variable sites left
    assert switches.polish(bases, 190, 260, (258, 255, 259, True), (261, 259, 262, True), False) == (190, 260, False, False, "too few sites")


def test_polished_tracts_find_planted_edges(spark):
    bases = mosaic(noise=0.02)
    sites = spark.createDataFrame([(i, s, int(bases[i, s])) for i in range(3) for s in range(600)], "seq_id long, site int, base int")
    events = spark.createDataFrame([(7, 0, 1, 2, 212, 366), (8, 0, 1, 2, 190, 395)], "event_id long, recombinant long, major long, minor long, tract_start int, tract_end int")
    got = {r.event_id: r for r in switches.polished_tracts(sites, events).collect()}
    assert set(got) == {7, 8} and all(abs(r.polished_start - 200) <= 6 and abs(r.polished_end - 380) <= 6 and r.outcome == "moved" for r in got.values())
    every = switches.hidden_switches(sites).orderBy("rank").collect()
    assert [tuple(r) for r in every] == [tuple(r) for r in switches.hidden_switches(sites, spark.createDataFrame([(0, 1, 2)] * 2, "a long, b long, c long")).orderBy("rank").collect()]
    counted = [OPERATORS["nearest_switch"].run(spark, switches=switches.hidden_switches(sites), **own) for own in ({"tract_edges": switches.triplet_edges(sites, events)}, {"sites": sites, "accepted": events})]
    assert counted[0].count() == 4 and sorted(map(tuple, counted[0].collect())) == sorted(map(tuple, counted[1].collect()))
    # an edge without a match beside one with: only the other moves
    matches = spark.createDataFrame([(7, "start", 200, 190, 215, True)], "event_id long, edge string, position int, low int, high int, inside boolean")
    got = {r.event_id: tuple(r)[6:] for r in switches.polished(sites, events, matches).collect()}
    assert got == {7: (200, 366, True, False, "moved"), 8: (190, 395, False, False, "stayed")}
    nothing = switches.polished_tracts(sites, events.where("false"))
    assert nothing.count() == 0


def test_nearest_switch_prefers_an_interval_that_holds_the_edge(spark):
    edges = spark.createDataFrame([(1, "start", 0, 1, 2, 100, 10, 60), (1, "end", 0, 1, 2, 400, 58, 60)], "event_id long, edge string, a long, b long, c long, site int, rank int, ranks int")
    found = spark.createDataFrame([(0, 1, 2, 11, 103, 102, 110), (0, 1, 2, 15, 130, 90, 140), (0, 1, 2, 2, 20, 15, 25), (0, 1, 2, 50, 350, 340, 360)], "a long, b long, c long, rank int, position int, low int, high int")
    line = {r.edge: r for r in OPERATORS["nearest_switch"].run(spark, tract_edges=edges, switches=found).collect()}
    assert (line["start"].position, line["start"].inside, line["end"].position, line["end"].apart) == (130, True, 350, 8)
    circle = {r.edge: r for r in switches.ON_CIRCLE.run(spark, tract_edges=edges, switches=found).collect()}
    assert (circle["end"].position, circle["end"].apart) == (20, 4)
