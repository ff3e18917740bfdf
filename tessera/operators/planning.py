"""The review plan of many events, and the sets of sequences that events tie to an event's roles: fix-points over links between events.

A fix-point grows by joins: each round joins only the rows that the last one found, and its rows are written to the session's folder for
checkpoints, so plans stay short and a lost executor costs one round.  The SQL of the same views is recursive."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.operator import SparkDialect, built, operator, stored, view
from tessera.session import shared_dir

#: Fixed values of the balanced review profile.
OVERLAP, SAME_RECOMBINANT, LEAST_SHARE, AS_PARENT, RECIPROCAL = 0.25, 46, 0.35, 54, 0.55
THRESHOLD, LEAST_BETWEEN, FULL_FROM = 48, 3, 0.3
BUCKET = 4096


def grown(seed: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of the seed, and all that ``step`` makes of them and of what it made, each once."""
    shared_dir(seed.sparkSession)
    found = last = seed.distinct().checkpoint()
    while True:
        # copies of the frames of earlier rounds by name, so that a round's join sees no column of itself
        last = step(last).select(*found.columns).distinct().join(found.select(*found.columns), found.columns, "left_anti").checkpoint()
        if last.isEmpty():
            return found
        found = found.unionByName(last)


@stored("impacts", "best_events")
def _(d: SparkDialect) -> str:
    """Later events that a decision on an event touches: overlapping tracts of its recombinant (share), its recombinant as a parent, a parent of it as recombinant."""
    shared = "CAST(least(x.tract_end, y.tract_end) - greatest(x.tract_start, y.tract_start) AS DOUBLE) / greatest(1, least(x.tract_end - x.tract_start, y.tract_end - y.tract_start))"
    ids = "x.event_id AS source, x.event_index AS source_index, y.event_id AS target, y.event_index AS target_index, y.recombinant AS sequence"
    kinds = [(shared, 0, 0, f"x.recombinant = y.recombinant AND {shared} >= {OVERLAP}"), ("CAST(0 AS DOUBLE)", 1, 0, "x.recombinant = y.major"), ("CAST(0 AS DOUBLE)", 1, 0, "x.recombinant = y.minor"), ("CAST(0 AS DOUBLE)", 0, 1, "x.major = y.recombinant"), ("CAST(0 AS DOUBLE)", 0, 1, "x.minor = y.recombinant")]
    links = " UNION ALL ".join(f"SELECT {ids}, {share} AS share, {parent} AS parent, {back} AS reciprocal FROM best_events x JOIN best_events y ON {on} AND x.event_index < y.event_index" for share, parent, back, on in kinds)
    return f"SELECT source, source_index, target, target_index, sequence, max(share) AS share, max(parent) AS parent, max(reciprocal) AS reciprocal FROM ({links}) l GROUP BY source, source_index, target, target_index, sequence"


@view("source_risk", "impacts")
def _(d: SparkDialect) -> str:
    """The risk of a decision on each event, out of 100."""
    same = f"CASE WHEN max(share) > 0 THEN {SAME_RECOMBINANT} * greatest({LEAST_SHARE}, max(share)) ELSE 0 END"
    return f"SELECT source, source_index, CAST(floor(least(100, round({same} + {AS_PARENT} * max(parent) + {AS_PARENT * RECIPROCAL} * max(reciprocal), 9)) + 0.5) AS INT) AS risk, count(*) AS dependants FROM impacts GROUP BY source, source_index"


@stored("recommended", "scored")
def _(d: SparkDialect) -> str:
    """The recommendation for each event before it waits for others, as ``event_score`` gives it."""
    from tessera.plans.operator import OPERATORS

    return f"SELECT s.event_id, s.event_index, s.recombinant, r.recommendation FROM scored s JOIN ({OPERATORS['event_score'].text(d)}) r ON r.event_id = s.event_id"


@view("blocking", "impacts", "source_risk")
def _(d: SparkDialect) -> str:
    """Links along which an open event holds up a later one."""
    return f"SELECT i.source, i.target FROM impacts i JOIN source_risk r ON r.source = i.source WHERE r.risk >= {THRESHOLD}"


@built(
    "held",
    "recommended",
    "blocking",
    sql="WITH RECURSIVE held AS (SELECT event_id FROM recommended WHERE recommendation = 'review' UNION SELECT b.target FROM held h JOIN blocking b ON b.source = h.event_id) SELECT event_id FROM held",
)
def held_up(recommended: DataFrame, blocking: DataFrame) -> DataFrame:
    """Events for a reviewer: those recommended for review, and in turn all that a risky one of these holds up."""
    shared_dir(blocking.sparkSession)
    links = blocking.select("source", "target").checkpoint()
    return grown(recommended.where("recommendation = 'review'").select("event_id"), lambda last: last.join(links, F.col("event_id") == F.col("source")).select(F.col("target").alias("event_id")))


@stored("plan", "recommended", "held", "source_risk")
def _(d: SparkDialect) -> str:
    """Each event with what is left of its recommendation and the risk of carrying it out; only acceptance changes anything, as no event is accepted yet."""
    return """SELECT r.event_id, r.event_index, CASE WHEN h.event_id IS NULL THEN r.recommendation ELSE 'review' END AS recommendation, r.recommendation <> 'review' AND h.event_id IS NOT NULL AS blocked, CASE WHEN h.event_id IS NULL AND r.recommendation = 'accept' THEN coalesce(k.risk, 0) ELSE 0 END AS risk
FROM recommended r LEFT JOIN held h ON h.event_id = r.event_id LEFT JOIN source_risk k ON k.source = r.event_id"""


def _fold(risks: list[int], start: int) -> int:
    for r in risks:
        start = (100 * (start + r) - start * r + 50) // 100
    return start


@built(
    "barrier",
    "plan",
    sql=f"""WITH RECURSIVE triggers AS MATERIALIZED (SELECT event_index, risk, row_number() OVER (ORDER BY event_index) AS k FROM plan WHERE risk > 0),
folded AS (SELECT 0::BIGINT AS k, 0::BIGINT AS event_index, 0::BIGINT AS pending UNION ALL SELECT t.k, t.event_index, (100 * (f.pending + t.risk) - f.pending * t.risk + 50) // 100 FROM folded f JOIN triggers t ON t.k = f.k + 1 WHERE f.pending < {THRESHOLD})
SELECT CAST(least(greatest(min(event_index) FILTER (WHERE pending >= {THRESHOLD}), (SELECT min(event_index) FROM triggers) + {LEAST_BETWEEN - 1}), CASE WHEN (SELECT max(event_index) FROM plan) < (SELECT min(event_index) FROM triggers) + {LEAST_BETWEEN - 1} THEN (SELECT max(event_index) FROM triggers) ELSE (SELECT max(event_index) FROM plan) END) AS BIGINT) AS after_index FROM folded""",
)
def first_barrier(plan: DataFrame) -> DataFrame:
    """One row: the event after which to scan again, or null for none.

    Risks of carried-out events are combined in order, a + b - ab / 100 rounded each time, until they reach THRESHOLD and LEAST_BETWEEN events have passed
    since the first; if the events end before that many, the barrier is after the last risk.  A risk is a whole number up to 100, so a bucket of the order is
    a table from the risk before it to the risk after it; buckets are worked out in parallel, and only their tables meet in one place."""
    spans = plan.agg(F.min(F.when(F.col("risk") > 0, F.col("event_index"))).alias("first"), F.max(F.when(F.col("risk") > 0, F.col("event_index"))).alias("last"), F.max("event_index").alias("end"))

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_index")
        ends, reached = [], []
        for state in range(THRESHOLD):
            at = -1
            for index, risk in zip(rows.event_index, rows.risk, strict=True):
                state = _fold([int(risk)], state)
                if state >= THRESHOLD:
                    at = int(index)
                    break
            ends.append(state)
            reached.append(at)
        return pd.DataFrame({"bucket": [int(rows.event_index.iat[0]) // BUCKET], "ends": [ends], "reached": [reached]})

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        state = 0
        for ends, reached in zip(*(rows.sort_values("bucket")[c] for c in ("ends", "reached")), strict=True):
            if reached[state] >= 0:
                return pd.DataFrame({"reached": [int(reached[state])]})
            state = int(ends[state])
        return pd.DataFrame({"reached": pd.Series([], dtype="int64")})

    buckets = plan.where("risk > 0").select(F.col("event_index").cast("long").alias("event_index"), "risk", F.floor(F.col("event_index") / BUCKET).alias("part")).groupBy("part").applyInPandas(table, "bucket long, ends array<int>, reached array<long>")
    point = buckets.groupBy(F.lit(0).alias("one")).applyInPandas(join, "reached long")
    enough = F.greatest("reached", F.col("first") + LEAST_BETWEEN - 1)
    late = F.when(F.col("end") < F.col("first") + LEAST_BETWEEN - 1, F.col("last")).otherwise(F.col("end"))
    return spans.join(point, how="left").select(F.when(F.col("reached").isNotNull(), F.least(enough, late)).cast("long").alias("after_index"))


@operator("review_plan", "plan", "barrier")
def _(d: SparkDialect) -> str:
    """Each event's recommendation, whether others hold it up, the risk of its decision, and whether it is carried out before the first rescan."""
    return "SELECT p.event_id, CAST(p.event_index AS INT) AS event_index, p.recommendation, p.blocked, CAST(p.risk AS INT) AS risk, p.recommendation <> 'review' AND p.event_index <= coalesce(b.after_index, p.event_index) AS applied FROM plan p CROSS JOIN barrier b"


@operator("rescan_targets", "plan", "barrier", "impacts", "ids")
def _(d: SparkDialect) -> str:
    """Sequences to scan again at the barrier: the recombinants of all events that the decisions up to it touch, or all sequences if these are a large share."""
    return f"""SELECT i.seq_id, t.sequence IS NOT NULL AS touched FROM ids i LEFT JOIN (SELECT DISTINCT m.sequence FROM plan p JOIN barrier b ON p.event_index <= b.after_index AND p.risk > 0 JOIN impacts m ON m.source = p.event_id) t ON t.sequence = i.seq_id
WHERE t.sequence IS NOT NULL OR (SELECT count(DISTINCT m.sequence) FROM plan p JOIN barrier b ON p.event_index <= b.after_index AND p.risk > 0 JOIN impacts m ON m.source = p.event_id) >= {FULL_FROM} * (SELECT count(*) FROM ids)"""


@stored("tracts", "accepted")
def _(d: SparkDialect) -> str:
    return "SELECT event_id, recombinant, major, minor, tract_start, tract_end FROM accepted"


@view("slot_members", "tracts")
def _(d: SparkDialect) -> str:
    """The three sequences of each event by slot."""
    return " UNION ALL ".join(f"SELECT event_id, {k} AS slot, {role} AS sequence FROM tracts" for k, role in enumerate(("recombinant", "major", "minor")))


@view("ties", "tracts")
def _(d: SparkDialect) -> str:
    """Sequences that an event's overlapping other events tie together."""
    roles = ("recombinant", "major", "minor")
    pairs = " UNION ALL ".join(f"SELECT event_id, tract_start, tract_end, {x} AS one, {y} AS other FROM tracts" for x in roles for y in roles if x != y)
    return f"SELECT DISTINCT e.event_id AS focal, t.one, t.other FROM tracts e JOIN ({pairs}) t ON t.event_id <> e.event_id AND t.tract_start < e.tract_end AND e.tract_start < t.tract_end"


@built(
    "reached",
    "slot_members",
    "ties",
    sql="WITH RECURSIVE reached AS (SELECT event_id, slot, sequence FROM slot_members UNION SELECT r.event_id, r.slot, t.other FROM reached r JOIN ties t ON t.focal = r.event_id AND t.one = r.sequence) SELECT event_id, slot, sequence FROM reached",
)
def reached_sets(slot_members: DataFrame, ties: DataFrame) -> DataFrame:
    """All sequences that the ties of an event lead to from each of its roles."""
    shared_dir(ties.sparkSession)
    links = ties.select("focal", "one", "other").checkpoint()
    return grown(slot_members.select("event_id", "slot", "sequence"), lambda last: last.join(links, (F.col("event_id") == F.col("focal")) & (F.col("sequence") == F.col("one"))).select("event_id", "slot", F.col("other").alias("sequence")))


@operator("role_sets", "reached")
def _(d: SparkDialect) -> str:
    """The set of each role of each event, closed: sequences tied to it by overlapping events, and those that both other roles' sets hold.

    The last rule adds nothing further to tie in, as two sets with a common sequence are one component."""
    return """SELECT event_id, CAST(slot AS INT) AS slot, sequence FROM reached UNION SELECT x.event_id, 3 - x.slot - y.slot AS slot, x.sequence FROM reached x JOIN reached y ON y.event_id = x.event_id AND y.sequence = x.sequence AND x.slot < y.slot"""
