"""Interval algebra over detections, multiple-testing corrections, consolidation and masking."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tessera.plans.operator import SparkDialect, built, operator, view

EVENTS = 0.05


def _string(d: SparkDialect, x: str) -> str:
    return f"CAST({x} AS {'STRING' if d.name == 'spark' else 'VARCHAR'})"


@view("best_events", "signals")
def _(d: SparkDialect) -> str:
    """The strongest detection of each recombinant and pair of parents' smaller one."""
    return """SELECT event_id, recombinant, major, minor, tract_start, tract_end, descent, p, CAST(row_number() OVER (ORDER BY round(p, 12), descent DESC, event_id) AS INT) AS event_index FROM (SELECT *, row_number() OVER (PARTITION BY recombinant, major ORDER BY round(p, 12), descent DESC, event_id) AS k FROM signals) x WHERE k = 1"""


@view("event_overlaps", "best_events")
def _(d: SparkDialect) -> str:
    """Pairs of events of one recombinant whose tracts overlap, with the overlap as a share of the shorter."""
    return """SELECT x.event_id AS left_event, y.event_id AS right_event, x.recombinant, least(x.tract_end, y.tract_end) - greatest(x.tract_start, y.tract_start) AS shared, CAST(least(x.tract_end, y.tract_end) - greatest(x.tract_start, y.tract_start) AS DOUBLE) / greatest(1, least(x.tract_end - x.tract_start, y.tract_end - y.tract_start)) AS share
FROM best_events x JOIN best_events y ON x.recombinant = y.recombinant AND x.event_index < y.event_index AND greatest(x.tract_start, y.tract_start) < least(x.tract_end, y.tract_end)"""


@operator("interval_overlap", "event_overlaps")
def _(d: SparkDialect) -> str:
    """Overlapping events of one recombinant."""
    return "SELECT left_event, right_event, recombinant, CAST(shared AS INT) AS shared, round(share, 9) AS share FROM event_overlaps"


@operator("co_location", "event_overlaps")
def _(d: SparkDialect) -> str:
    """For each event the overlapping event it is best confirmed by, at a quarter of the shorter tract or more."""
    return "SELECT left_event, right_event, round(share, 9) AS share FROM (SELECT *, row_number() OVER (PARTITION BY left_event ORDER BY round(share, 12) DESC, right_event) AS k FROM event_overlaps WHERE share >= 0.25) x WHERE k = 1"


@operator("same_breakpoints", "best_events")
def _(d: SparkDialect) -> str:
    """Events with the same unordered parents whose boundaries differ by at most 12 sites."""
    return """SELECT x.event_id AS left_event, y.event_id AS right_event, CAST(greatest(abs(x.tract_start - y.tract_start), abs(x.tract_end - y.tract_end)) AS INT) AS distance FROM best_events x JOIN best_events y ON least(x.major, x.minor) = least(y.major, y.minor) AND greatest(x.major, x.minor) = greatest(y.major, y.minor) AND x.event_index < y.event_index AND greatest(abs(x.tract_start - y.tract_start), abs(x.tract_end - y.tract_end)) <= 12"""


@operator("bonferroni", "signals", "triplets")
def _(d: SparkDialect) -> str:
    """Probabilities of all signals times the number of triplets compared."""
    return f"SELECT event_id, round(least(CAST(1 AS DOUBLE), p * n), 9) AS corrected, p * n <= {EVENTS} AS supported FROM signals CROSS JOIN (SELECT count(*) AS n FROM triplets) t"


@operator("holm", "best_events")
def _(d: SparkDialect) -> str:
    """Step-down correction: the running maximum of p times the tests that are left."""
    return """SELECT event_id, round(least(CAST(1 AS DOUBLE), max(p * (m - k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)), 9) AS corrected FROM (SELECT event_id, p, row_number() OVER (ORDER BY round(p, 12), event_id) AS k, count(*) OVER () AS m FROM best_events) x"""


@view("evidence", "signals", "runs", "chi_profile", "triplets")
def _(d: SparkDialect) -> str:
    """Supporting methods by triplet: descents, long fragments and chi-square peaks."""
    from tessera.functions.statistics import chi_square_p, geneconv_g0

    return f"""SELECT a, b, c, method, p FROM (
SELECT a, b, c, 'geneconv' AS method, min({geneconv_g0('length', 'n', 'matches')}) AS p FROM runs GROUP BY a, b, c
UNION ALL SELECT a, b, c, 'maxchi', min(least(CAST(1 AS DOUBLE), {chi_square_p('chi')} * greatest(1, CAST(n AS DOUBLE) / 20) * 3)) FROM chi_profile GROUP BY a, b, c
UNION ALL SELECT least(recombinant, major, minor), recombinant + major + minor - least(recombinant, major, minor) - greatest(recombinant, major, minor), greatest(recombinant, major, minor), 'threeseq', min(p) FROM signals GROUP BY 1, 2, 3) u"""


@operator("min_methods_filter", "evidence")
def _(d: SparkDialect) -> str:
    """Triplets that at least two methods support at five per cent, with their best probability."""
    return "SELECT a, b, c, CAST(sum(CASE WHEN p <= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS methods, round(min(p), 9) AS best_p FROM evidence GROUP BY a, b, c HAVING sum(CASE WHEN p <= 0.05 THEN 1 ELSE 0 END) >= 2"


@operator("evidence_pivot", "evidence")
def _(d: SparkDialect) -> str:
    """The evidence of each triplet side by side; a method without a signal counts as 1."""
    cells = ", ".join(f"round(coalesce(min(CASE WHEN method = '{m}' THEN p END), CAST(1 AS DOUBLE)), 9) AS {m}" for m in ("geneconv", "maxchi", "threeseq"))
    return f"SELECT a, b, c, {cells} FROM evidence GROUP BY a, b, c"


@operator("primary_signal", "evidence")
def _(d: SparkDialect) -> str:
    """The method with the least probability for each triplet; ties by name."""
    return "SELECT a, b, c, method, round(p, 9) AS p FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY round(p, 12), method) AS k FROM evidence) x WHERE k = 1"


#: The same acceptance as SQL: each step leaves the signals that do not meet their recombinant's strongest one of the step before.
ACCEPTED = f"""WITH RECURSIVE supported AS MATERIALIZED (SELECT event_id, recombinant, major, minor, tract_start, tract_end, descent, p, row_number() OVER (PARTITION BY recombinant ORDER BY round(p, 12), descent DESC, event_id) AS k FROM signals WHERE round(p, 12) <= {EVENTS}),
left_over AS (SELECT recombinant, k, tract_start, tract_end, 1 AS pick FROM supported
UNION ALL SELECT recombinant, k, tract_start, tract_end, pick + 1 FROM (SELECT *, first_value(k) OVER w AS best, first_value(tract_start) OVER w AS best_start, first_value(tract_end) OVER w AS best_end FROM left_over WINDOW w AS (PARTITION BY recombinant ORDER BY k)) x WHERE k > best AND (tract_start >= best_end OR best_start >= tract_end))
SELECT s.event_id, s.recombinant, s.major, s.minor, s.tract_start, s.tract_end, s.descent, s.p, CAST(t.pick AS INTEGER) AS pick FROM supported s JOIN (SELECT recombinant, pick, min(k) AS k FROM left_over GROUP BY recombinant, pick) t ON t.recombinant = s.recombinant AND t.k = s.k"""


@built("accepted", "signals", sql=ACCEPTED)
def disjoint_tracts(signals: DataFrame, alpha: float = EVENTS) -> DataFrame:
    """Every supported tract of each recombinant that meets no stronger one it keeps: its signals at or under ``alpha`` from the strongest on
    (ties by descent, then event_id), each kept unless it overlaps a kept one.  ``pick`` numbers a recombinant's tracts in that order.

    Signals of one tract are reduced to the strongest before the shuffle.  A task reads its recombinants' tracts in order and remembers only the
    kept ones of the recombinant at hand, which are disjoint, so its memory does not grow with the number of signals."""
    spark = signals.sparkSession
    rank = [F.round("p", 12).alias("order"), (-F.col("descent")).alias("less"), "event_id", "major", "minor", "descent", "p"]
    strongest = signals.where(F.round("p", 12) <= alpha).groupBy("recombinant", "tract_start", "tract_end").agg(F.min(F.struct(*rank)).alias("best"))
    tracts = strongest.select("best.event_id", "recombinant", "best.major", "best.minor", "tract_start", "tract_end", "best.descent", "best.p", "best.order", "best.less")
    tracts = tracts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "recombinant").sortWithinPartitions("recombinant", "order", "less", "event_id")
    schema = tracts.drop("order", "less").schema.add("pick", IntegerType())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, starts, ends = None, [], []
        for batch in batches:
            kept, picks = [], []
            for i, (recombinant, start, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("recombinant", "tract_start", "tract_end")), strict=True)):
                if recombinant != row:
                    row, starts, ends = recombinant, [], []
                at = bisect_left(starts, start)
                if (at > 0 and ends[at - 1] > start) or (at < len(starts) and starts[at] < end):
                    continue
                starts.insert(at, start)
                ends.insert(at, end)
                kept.append(i)
                picks.append(len(starts))
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in schema.names[:-1]), pa.array(picks, pa.int32())], names=schema.names)

    return tracts.mapInArrow(keep, schema)


@operator("accepted_tracts", "accepted")
def _(d: SparkDialect) -> str:
    """All disjoint supported tracts of each recombinant, in the order in which they are accepted."""
    return "SELECT event_id, recombinant, major, minor, tract_start, tract_end, round(p, 9) AS p, pick FROM accepted"


@operator("mask_tracts", "sites", "accepted")
def _(d: SparkDialect) -> str:
    """Recombination-free export, mode mask: bases inside accepted tracts become missing."""
    return "SELECT s.seq_id, s.site, CAST(CASE WHEN e.event_id IS NOT NULL THEN 4 ELSE s.base END AS INT) AS base FROM sites s LEFT JOIN accepted e ON e.recombinant = s.seq_id AND s.site >= e.tract_start AND s.site < e.tract_end"


@operator("remove_recombinants", "sites", "accepted")
def _(d: SparkDialect) -> str:
    """Recombination-free export, mode remove: sequences without any event of at most one in a thousand."""
    return "SELECT s.seq_id, count(*) AS n_sites FROM sites s WHERE NOT EXISTS (SELECT 1 FROM accepted e WHERE e.recombinant = s.seq_id AND e.p < 0.001) GROUP BY s.seq_id"


@operator("erase_extract", "sites", "accepted")
def _(d: SparkDialect) -> str:
    """Disassembly: each sequence loses its tracts, and each tract goes to a component of its own (0 is the remainder)."""
    inside = "s.site >= e.tract_start AND s.site < e.tract_end"
    return f"""SELECT s.seq_id AS origin, 'remainder' AS kind, 0 AS component, s.site, CAST(CASE WHEN e.event_id IS NOT NULL THEN 4 ELSE s.base END AS INT) AS base FROM sites s LEFT JOIN accepted e ON e.recombinant = s.seq_id AND {inside}
UNION ALL SELECT s.seq_id, 'tract', e.pick, s.site, CAST(CASE WHEN {inside} THEN s.base ELSE 4 END AS INT) FROM sites s JOIN accepted e ON e.recombinant = s.seq_id"""


@operator("structural_pieces", "sites")
def _(d: SparkDialect) -> str:
    """Maximal stretches of four sites or more without missing bases."""
    return """SELECT seq_id, CAST(min(site) AS INT) AS piece_start, CAST(max(site) + 1 AS INT) AS piece_end FROM (SELECT seq_id, site, site - row_number() OVER (PARTITION BY seq_id ORDER BY site) AS island FROM sites WHERE base < 4) x GROUP BY seq_id, island HAVING count(*) >= 4"""


@operator("split_partitions", "accepted", "sites")
def _(d: SparkDialect) -> str:
    """Global partitions of the alignment at all accepted breakpoints."""
    return """SELECT CAST(point AS INT) AS part_start, CAST(next_point AS INT) AS part_end FROM (SELECT point, lead(point) OVER (ORDER BY point) AS next_point FROM (SELECT tract_start AS point FROM accepted UNION SELECT tract_end FROM accepted UNION SELECT 0 UNION SELECT max(site) + 1 FROM sites) p) q WHERE next_point > point"""


@operator("rotate_intervals", "best_events", "sites")
def _(d: SparkDialect) -> str:
    """Tracts in the coordinates of the half-rotated view; an end at the origin stays the length."""
    h = d.idiv("len", "2")
    return f"""SELECT event_id, CAST(s AS INT) AS rotated_start, CAST(CASE WHEN e = 0 THEN len ELSE e END AS INT) AS rotated_end, s > CASE WHEN e = 0 THEN len ELSE e END AS wraps FROM (SELECT event_id, len, (tract_start - {h} + len) % len AS s, (tract_end - {h} + len) % len AS e FROM best_events CROSS JOIN (SELECT max(site) + 1 AS len FROM sites) l) x"""


@operator("super_event_distance", "best_events", "packed_trade")
def _(d: SparkDialect) -> str:
    """Distance of overlapping events of different recombinants: half their sequences' distance, half their lack of overlap."""
    return """SELECT x.event_id AS left_event, y.event_id AS right_event, round((p.p + 1 - CAST(least(x.tract_end, y.tract_end) - greatest(x.tract_start, y.tract_start) AS DOUBLE) / greatest(1, least(x.tract_end - x.tract_start, y.tract_end - y.tract_start))) / 2, 9) AS distance
FROM best_events x JOIN best_events y ON x.recombinant < y.recombinant AND x.major = y.major AND greatest(x.tract_start, y.tract_start) < least(x.tract_end, y.tract_end) JOIN packed_trade p ON p.left_id = x.recombinant AND p.right_id = y.recombinant"""


@view("packed_trade", "pairs")
def _(d: SparkDialect) -> str:
    return "SELECT left_id, right_id, CAST(differences AS DOUBLE) / valid_sites AS p FROM pairs"


@operator("breakpoint_density", "best_events")
def _(d: SparkDialect) -> str:
    """How many tracts start in one bin of 20 sites and end in another, counted both ways."""
    s, e = d.idiv("tract_start", "20"), d.idiv("(tract_end - 1)", "20")
    return f"SELECT CAST(row_bin AS INT) AS row_bin, CAST(col_bin AS INT) AS col_bin, count(*) AS n FROM (SELECT {s} AS row_bin, {e} AS col_bin FROM best_events UNION ALL SELECT {e}, {s} FROM best_events) x GROUP BY 1, 2"


@operator("region_separation", "best_events", "sites")
def _(d: SparkDialect) -> str:
    """How often two bins lie on different sides of a tract, against placing tracts at random on the circle."""
    mid = "(bin * 20 + 10)"
    inside = f"CASE WHEN tract_start <= {mid} AND {mid} < tract_end THEN 1 ELSE 0 END"
    return f"""SELECT row_bin, col_bin, observed, round(expected, 6) AS expected, round(CASE WHEN variance <= 1E-9 THEN CAST(0 AS DOUBLE) ELSE (observed - expected) / sqrt(variance) END, 6) AS z FROM (
SELECT x.bin AS row_bin, y.bin AS col_bin, CAST(sum(CASE WHEN x.i <> y.i THEN 1 ELSE 0 END) AS BIGINT) AS observed, sum(q) AS expected, sum(q * (1 - q)) AS variance FROM (
SELECT x.*, least(CAST(1 AS DOUBLE), CAST(2 AS DOUBLE) * least(least(abs(x.bin - y.bin) * 20, x.len - abs(x.bin - y.bin) * 20), least(x.size, x.len - x.size)) / x.len) AS q, y.bin AS ybin, y.i AS yi FROM (SELECT event_id, CAST(bin AS INT) AS bin, {inside} AS i, tract_end - tract_start AS size, len FROM best_events CROSS JOIN (SELECT len, {d.each('0', d.idiv('len', '20') + ' - 1')} AS bin FROM (SELECT CAST(max(site) + 1 AS INT) AS len FROM sites) l) b) x
JOIN (SELECT event_id, CAST(bin AS INT) AS bin, {inside} AS i FROM best_events CROSS JOIN (SELECT {d.each('0', d.idiv('len', '20') + ' - 1')} AS bin FROM (SELECT CAST(max(site) + 1 AS INT) AS len FROM sites) l) b) y ON x.event_id = y.event_id AND x.bin < y.bin) z GROUP BY 1, 2) w""".replace("x.bin AS row_bin, y.bin AS col_bin, CAST(sum(CASE WHEN x.i <> y.i", "bin AS row_bin, ybin AS col_bin, CAST(sum(CASE WHEN i <> yi")


@operator("hotspot_observed", "best_events")
def _(d: SparkDialect) -> str:
    """Breakpoints by bin of 50 sites, and whether a bin is the largest."""
    return f"SELECT bin, n, n = max(n) OVER () AS hottest FROM (SELECT CAST(bin AS INT) AS bin, count(*) AS n FROM (SELECT {d.idiv('tract_start', '50')} AS bin FROM best_events UNION ALL SELECT {d.idiv('(tract_end - 1)', '50')} FROM best_events) x GROUP BY bin) y"
