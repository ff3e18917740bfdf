"""The review plan against a queue and a loop in plain Python, and role sets against a closure by sets."""

import random
from collections import deque

from tessera.operators import planning
from tessera.plans.catalogue import OPERATORS


def test_a_plan_of_many_events_equals_a_queue(spark):
    rnd = random.Random(4)
    n = 5000
    kind = [rnd.choices(["accept", "reject", "review"], [70, 20, 10])[0] if i > 40 else "accept" for i in range(n)]
    links = {i: sorted({min(n - 1, i + rnd.randint(1, 300)) for _ in range(rnd.randint(0, 2))} - {i}) for i in range(n)}
    risk = {i: rnd.choice([3, 20, 55]) for i in range(n) if links[i]}
    waiting, seen, held = deque(i for i in range(n) if kind[i] == "review"), set(), {i for i in range(n) if kind[i] == "review"}
    while waiting:
        i = waiting.popleft()
        if i in seen:
            continue
        seen.add(i)
        if risk.get(i, 0) >= planning.THRESHOLD:
            waiting += [j for j in links[i] if j not in held]
            held.update(links[i])
    recommended = spark.createDataFrame([(f"e{i}", i + 1, i, kind[i]) for i in range(n)], "event_id string, event_index int, recombinant long, recommendation string")
    impacts = spark.createDataFrame([(f"e{i}", i + 1, f"e{j}", j + 1, j) for i in links for j in links[i]], "source string, source_index int, target string, target_index int, sequence long")
    risks = spark.createDataFrame([(f"e{i}", i + 1, r, 1) for i, r in risk.items()], "source string, source_index int, risk int, dependants long")
    got = {r.event_id: r for r in OPERATORS["review_plan"].run(spark, recommended=recommended, impacts=impacts, source_risk=risks).collect()}
    assert len(got) == n and {int(k[1:]) for k, r in got.items() if r.recommendation == "review"} == held
    assert {int(k[1:]) for k, r in got.items() if r.blocked} == {i for i in held if kind[i] != "review"}
    own = [(i + 1, risk.get(i, 0) if kind[i] == "accept" and i not in held else 0) for i in range(n)]
    last = barrier(own)
    assert last is not None and all(r.applied == (r.recommendation != "review" and r.event_index <= last) for r in got.values())


def barrier(rows):
    pending, first, trigger = 0, None, None
    for index, risk in rows:
        if risk:
            pending, first, trigger = round(100 * (1 - (1 - pending / 100) * (1 - risk / 100)) + 1e-9), first or index, index
        if first and pending >= planning.THRESHOLD and index - first + 1 >= planning.LEAST_BETWEEN:
            return index
    return trigger if pending >= planning.THRESHOLD else None


def test_barriers(spark):
    cases = [
        [(1, 60), (2, 0), (3, 0), (4, 0)],
        [(1, 0), (2, 60)],
        [(1, 0), (2, 60), (3, 10)],
        [(i, 2) for i in range(1, 9)],
        [],
        [(i, 1 if i % 3000 == 0 else 0) for i in range(1, 200000, 1000)],
        [(1000 * i, 9) for i in range(1, 30)],
    ]
    for rows in cases:
        plan = spark.createDataFrame([(f"e{i}", i, "accept", False, r) for i, r in rows], "event_id string, event_index int, recommendation string, blocked boolean, risk int")
        assert [r.after_index for r in planning.first_barrier(plan).collect()] == [barrier(rows)], rows[:3]


def test_role_sets_equal_a_closure_by_sets(spark):
    rnd = random.Random(9)
    events = [(f"e{i}", *rnd.sample(range(14), 3), s, s + rnd.randint(5, 60)) for i in range(12) for s in [rnd.randint(0, 200)]]
    table = spark.createDataFrame(events, "event_id string, recombinant long, major long, minor long, tract_start int, tract_end int")
    got = {}
    for r in OPERATORS["role_sets"].run(spark, accepted=table).collect():
        assert r.sequence not in got.setdefault((r.event_id, r.slot), set())
        got[r.event_id, r.slot].add(r.sequence)
    for name, *roles, start, end in events:
        sets = [{x} for x in roles]
        edges = [set(e[1:4]) for e in events if e[0] != name and e[4] < end and start < e[5]]
        while True:
            before = [set(s) for s in sets]
            for s in sets:
                for e in edges:
                    if s & e:
                        s |= e
            for x in set().union(*sets):
                if sum(x in s for s in sets) == 2:
                    for s in sets:
                        s.add(x)
            if before == sets:
                break
        assert [got[name, k] for k in range(3)] == sets
