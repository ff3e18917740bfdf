"""Scoring, dependencies and review state of events."""

from __future__ import annotations

from tessera.plans.operator import SparkDialect, operator, view


@view("scored", "best_events", "triplets", "informative")
def _(d: SparkDialect) -> str:
    """Events with the qualities that a balanced review profile weighs: significance, information and precision, from 0 to 1."""
    sites = "(SELECT a, b, c, count(*) AS n FROM informative GROUP BY a, b, c)"
    least_, most = "least(recombinant, major, minor)", "greatest(recombinant, major, minor)"
    return f"""SELECT e.*, i.n AS informative_sites, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), -log10(greatest(CAST(1E-300 AS DOUBLE), e.p)) / (2 * -log10(CAST(0.05 AS DOUBLE))))) AS significance, least(CAST(1 AS DOUBLE), CAST(i.n AS DOUBLE) / 48) AS information, greatest(CAST(0 AS DOUBLE), 1 - CAST(8 AS DOUBLE) / (2 * greatest(1, e.tract_end - e.tract_start)) / 0.6) AS precision_
FROM best_events e JOIN {sites} i ON i.a = {least_} AND i.c = {most} AND i.b = recombinant + major + minor - {least_} - {most}"""


@operator("event_score", "scored")
def _(d: SparkDialect) -> str:
    """Weighted score of each event out of 100 and a recommendation with hard gates."""
    return """SELECT event_id, score, CASE WHEN p <= 0.05 AND informative_sites >= 24 AND score >= 74 THEN 'accept' WHEN p > 0.05 AND score <= 30 THEN 'reject' ELSE 'review' END AS recommendation FROM (SELECT event_id, p, informative_sites, CAST(floor(100 * round((significance * 22 + information * 16 + precision_ * 14) / 52, 9) + 0.5) AS INT) AS score FROM scored) x"""


@view("edges", "best_events")
def _(d: SparkDialect) -> str:
    """Dependencies of later events on earlier ones: overprinted tracts of one recombinant, and recombinants used as parents."""
    return """SELECT x.event_id AS source, y.event_id AS target, 'possible-overprint' AS kind, x.event_index AS source_index, y.event_index AS target_index FROM best_events x JOIN best_events y ON x.recombinant = y.recombinant AND x.event_index < y.event_index AND 4 * (least(x.tract_end, y.tract_end) - greatest(x.tract_start, y.tract_start)) >= least(x.tract_end - x.tract_start, y.tract_end - y.tract_start)
UNION ALL SELECT x.event_id, y.event_id, 'recombinant-parent', x.event_index, y.event_index FROM best_events x JOIN best_events y ON x.event_index < y.event_index AND (x.recombinant = y.major OR x.recombinant = y.minor) AND x.recombinant <> y.recombinant"""


@operator("dependency_edges", "edges")
def _(d: SparkDialect) -> str:
    """All dependency edges between events."""
    return "SELECT source, target, kind FROM edges"


@operator("impact_risk", "edges")
def _(d: SparkDialect) -> str:
    """How much hangs on each event: 10 for an overprint, 4 for a parent, at most 100."""
    return "SELECT source AS event_id, CAST(least(100, sum(CASE WHEN kind = 'possible-overprint' THEN 10 ELSE 4 END)) AS INT) AS risk, count(*) AS dependants FROM edges GROUP BY source"


@operator("review_queue", "best_events", "scored")
def _(d: SparkDialect) -> str:
    """Events in review order with their neighbours, the last leading to the first."""
    return """SELECT event_id, event_index, coalesce(lead(event_id) OVER (ORDER BY event_index), first_value(event_id) OVER (ORDER BY event_index)) AS next_event, lag(event_id) OVER (ORDER BY event_index) AS previous_event FROM best_events"""


@operator("stale_propagation", "best_events", "edges")
def _(d: SparkDialect) -> str:
    """After an edit of the first event: later events are stale, those it touches directly as well as by order."""
    return """SELECT e.event_id, e.event_index > 1 AS stale, d.target IS NOT NULL AS direct FROM best_events e LEFT JOIN (SELECT DISTINCT target FROM edges WHERE source_index = 1) d ON d.target = e.event_id"""


@operator("blockers", "edges", "scored")
def _(d: SparkDialect) -> str:
    """Earliest event that each event waits for."""
    return "SELECT target AS event_id, min_by(source, source_index) AS blocker, count(*) AS n_blockers FROM edges GROUP BY target"


@operator("event_summary", "best_events")
def _(d: SparkDialect) -> str:
    """Events by recombinant, and in all (-1)."""
    return "SELECT CASE WHEN grouping(recombinant) = 1 THEN -1 ELSE recombinant END AS recombinant, count(*) AS n, CAST(max(descent) AS INT) AS most_descent, round(min(p), 9) AS best_p FROM best_events GROUP BY GROUPING SETS ((recombinant), ())"
