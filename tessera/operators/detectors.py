"""Triplets and the detectors that windows can express."""

from __future__ import annotations

from tessera.functions.statistics import chi_square, chi_square_p, geneconv_g0, normal_cdf
from tessera.plans.operator import SparkDialect, operator, view

HALF = 20


@view("ids", "sites")
def _(d: SparkDialect) -> str:
    return "SELECT DISTINCT seq_id FROM sites"


@view("triplets", "ids")
def _(d: SparkDialect) -> str:
    return "SELECT x.seq_id AS a, y.seq_id AS b, z.seq_id AS c FROM ids x JOIN ids y ON x.seq_id < y.seq_id JOIN ids z ON y.seq_id < z.seq_id"


@view("columns", "sites")
def _(d: SparkDialect) -> str:
    """Complete sites of each triplet; category 0, 1 or 2 names the pair that agrees, 3 all equal, 6 none."""
    return """SELECT x.seq_id AS a, y.seq_id AS b, z.seq_id AS c, x.site, CASE WHEN x.base = y.base AND y.base = z.base THEN 3 WHEN x.base = y.base THEN 0 WHEN x.base = z.base THEN 1 WHEN y.base = z.base THEN 2 ELSE 6 END AS category
FROM sites x JOIN sites y ON x.site = y.site AND x.seq_id < y.seq_id JOIN sites z ON y.site = z.site AND y.seq_id < z.seq_id WHERE x.base < 4 AND y.base < 4 AND z.base < 4"""


@view("informative", "columns")
def _(d: SparkDialect) -> str:
    return "SELECT a, b, c, site, category, CAST(row_number() OVER (PARTITION BY a, b, c ORDER BY site) AS INT) AS rank FROM columns WHERE category < 3"


@view("variable_ranks", "columns")
def _(d: SparkDialect) -> str:
    return "SELECT a, b, c, site, category, CAST(row_number() OVER (PARTITION BY a, b, c ORDER BY site) AS INT) AS rank, CAST(count(*) OVER (PARTITION BY a, b, c) AS INT) AS n FROM columns WHERE category <> 3"


@operator("triplet_enumeration", "triplets")
def _(d: SparkDialect) -> str:
    """Every unordered triplet of sequences once."""
    return "SELECT a, b, c FROM triplets"


@operator("triplet_category_counts", "columns")
def _(d: SparkDialect) -> str:
    """How often each pair of a triplet agrees alone."""
    n = ", ".join(f"CAST(sum(CASE WHEN category = {k} THEN 1 ELSE 0 END) AS BIGINT) AS n{k}" for k in (0, 1, 2, 3, 6))
    return f"SELECT a, b, c, {n} FROM columns GROUP BY a, b, c"


@operator("informative_ranks", "informative")
def _(d: SparkDialect) -> str:
    """Informative sites of every triplet with their ranks."""
    return "SELECT a, b, c, rank, site, CAST(category AS INT) AS category FROM informative"


@operator("triplet_counts_chi2", "informative")
def _(d: SparkDialect) -> str:
    """Tract against background, the tract being ranks of the middle third: minor (1) and major (0) agreement, chi-square and its tail."""
    chi = chi_square("im", "ij", "om", "oj")
    return f"""SELECT a, b, c, im AS inside_minor, ij AS inside_major, om AS outside_minor, oj AS outside_major, round({chi}, 6) AS chi_square, round({chi_square_p(chi)}, 9) AS p FROM (
SELECT a, b, c, {", ".join(f"CAST(sum(CASE WHEN (3 * rank BETWEEN n + 1 AND 2 * n) = {inside} AND category = {k} THEN 1 ELSE 0 END) AS BIGINT) AS {name}" for name, inside, k in (("im", "true", 1), ("ij", "true", 0), ("om", "false", 1), ("oj", "false", 0)))}
FROM (SELECT *, count(*) OVER (PARTITION BY a, b, c) AS n FROM informative) r GROUP BY a, b, c) t"""


@operator("baseline_topology", "columns")
def _(d: SparkDialect) -> str:
    """The closest pair of each triplet over the whole alignment by exact counts; 2 unless one is strictly closest."""
    return """SELECT a, b, c, CAST(CASE WHEN n0 > n1 AND n0 > n2 THEN 0 WHEN n1 > n0 AND n1 > n2 THEN 1 ELSE 2 END AS INT) AS topology FROM (
SELECT a, b, c, sum(CASE WHEN category = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN category = 1 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN category = 2 THEN 1 ELSE 0 END) AS n2 FROM columns GROUP BY a, b, c) x"""


@view("chi_profile", "variable_ranks")
def _(d: SparkDialect) -> str:
    """For the three pairs of a triplet: chi-square of agreement in the HALF ranks to the left against those to the right."""
    x = chi_square("lm", "ln - lm", "rm", "rn - rm")
    return f"""SELECT a, b, c, pair, rank, site, n, CASE WHEN ln < {HALF} OR rn < {HALF} OR abs(lm - rm) <= 2 THEN CAST(0 AS DOUBLE) ELSE {x} END AS chi FROM (
SELECT a, b, c, pair, rank, site, n, coalesce(sum(same) OVER l, 0) AS lm, count(*) OVER l AS ln, coalesce(sum(same) OVER r, 0) AS rm, count(*) OVER r AS rn FROM (SELECT v.*, p.pair, CASE WHEN v.category = p.pair THEN 1 ELSE 0 END AS same FROM variable_ranks v CROSS JOIN (SELECT {d.each('0', '2')} AS pair) p) s
WINDOW l AS (PARTITION BY a, b, c, pair ORDER BY rank ROWS BETWEEN {HALF - 1} PRECEDING AND CURRENT ROW), r AS (PARTITION BY a, b, c, pair ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND {HALF} FOLLOWING)) w"""


@operator("maxchi_profile", "chi_profile")
def _(d: SparkDialect) -> str:
    """The strongest boundary of each pair: first of the largest chi-square values, with its windowed tail probability."""
    return f"""SELECT a, b, c, CAST(pair AS INT) AS pair, rank, site, round(chi, 6) AS chi, round(least(CAST(1 AS DOUBLE), {chi_square_p('chi')} * greatest(1, CAST(n AS DOUBLE) / {HALF}) * 3), 9) AS p FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c, pair ORDER BY round(chi, 9) DESC, rank) AS best FROM chi_profile) x WHERE best = 1"""


@operator("chi_smooth", "chi_profile")
def _(d: SparkDialect) -> str:
    """The profile smoothed over eleven ranks of the circle: the last ranks stand before the first too, and the first after the last."""
    padded = "SELECT a, b, c, pair, rank, n, chi FROM chi_profile UNION ALL SELECT a, b, c, pair, rank - n, n, chi FROM chi_profile WHERE rank > n - 5 UNION ALL SELECT a, b, c, pair, rank + n, n, chi FROM chi_profile WHERE rank <= 5"
    return f"SELECT a, b, c, CAST(pair AS INT) AS pair, CAST(rank AS INT) AS rank, round(s, 6) AS smooth FROM (SELECT a, b, c, pair, rank, n, avg(chi) OVER (PARTITION BY a, b, c, pair ORDER BY rank ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s FROM ({padded}) y) x WHERE rank BETWEEN 1 AND n"


@operator("chimaera_profile", "informative")
def _(d: SparkDialect) -> str:
    """For each target of a triplet, sites at which its parents differ and it matches one: the largest shift between adjacent windows."""
    x = chi_square("lm", "ln - lm", "rm", "rn - rm")
    return f"""SELECT a, b, c, CAST(target AS INT) AS target, round(max(CASE WHEN ln = {HALF} AND rn = {HALF} AND abs(lm - rm) > 2 THEN {x} ELSE CAST(0 AS DOUBLE) END), 6) AS max_chi, CAST(max(k) AS INT) AS n FROM (
SELECT a, b, c, target, k, sum(same) OVER l AS lm, count(*) OVER l AS ln, coalesce(sum(same) OVER r, 0) AS rm, count(*) OVER r AS rn FROM (SELECT i.a, i.b, i.c, t.target, i.rank, row_number() OVER (PARTITION BY i.a, i.b, i.c, t.target ORDER BY i.rank) AS k, CASE WHEN i.category = t.first THEN 1 ELSE 0 END AS same
FROM informative i JOIN (SELECT 0 AS target, 0 AS first, 1 AS second UNION ALL SELECT 1, 0, 2 UNION ALL SELECT 2, 1, 2) t ON i.category = t.first OR i.category = t.second) s
WINDOW l AS (PARTITION BY a, b, c, target ORDER BY k ROWS BETWEEN {HALF - 1} PRECEDING AND CURRENT ROW), r AS (PARTITION BY a, b, c, target ORDER BY k ROWS BETWEEN 1 FOLLOWING AND {HALF} FOLLOWING)) w GROUP BY a, b, c, target"""


@view("runs", "variable_ranks")
def _(d: SparkDialect) -> str:
    """Maximal runs of agreement in the six tracks of a triplet: three of equal pairs, three of odd sequences."""
    hit = "CASE WHEN t.track < 3 THEN v.category = t.track ELSE v.category = 5 - t.track OR v.category = 6 END"
    return f"""SELECT a, b, c, track, n, matches, start_site, end_site, length FROM (SELECT a, b, c, track, island, max(n) AS n, max(matches) AS matches, min(site) AS start_site, max(site) AS end_site, CAST(count(*) AS INT) AS length FROM (
SELECT *, rank - row_number() OVER (PARTITION BY a, b, c, track ORDER BY rank) AS island, count(*) OVER (PARTITION BY a, b, c, track) AS matches FROM (SELECT v.a, v.b, v.c, v.site, v.rank, v.n, t.track FROM variable_ranks v CROSS JOIN (SELECT {d.each('0', '5')} AS track) t WHERE {hit}) h) i GROUP BY a, b, c, track, island) r"""


@operator("geneconv_runs", "runs")
def _(d: SparkDialect) -> str:
    """The longest run of each track, and how many runs of four sites or more there are."""
    return "SELECT a, b, c, CAST(track AS INT) AS track, max(length) AS longest, CAST(sum(CASE WHEN length >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_long FROM runs GROUP BY a, b, c, track"


@operator("geneconv_g0_pvalue", "runs")
def _(d: SparkDialect) -> str:
    """Fragments of four sites or more with the probability of so long a run without mismatches."""
    return f"SELECT a, b, c, CAST(track AS INT) AS track, start_site, end_site, length, round({geneconv_g0('length', 'n', 'matches')}, 9) AS p FROM runs WHERE length >= 4"


@view("walk", "informative")
def _(d: SparkDialect) -> str:
    """The plus-minus-one walk of each target: up where it matches one parent, down where the other."""
    return """SELECT a, b, c, target, rank, site, step, lead(site) OVER w AS next_site, sum(step) OVER (PARTITION BY a, b, c, target ORDER BY rank ROWS UNBOUNDED PRECEDING) AS height, first_value(site) OVER w AS first_site
FROM (SELECT i.a, i.b, i.c, i.rank, i.site, t.target, t.step FROM informative i JOIN (SELECT 0 AS category, 1 AS target, 1 AS step UNION ALL SELECT 0, 2, -1 UNION ALL SELECT 1, 0, 1 UNION ALL SELECT 1, 1, -1 UNION ALL SELECT 2, 0, -1 UNION ALL SELECT 2, 2, 1) t ON i.category = t.category) s
WINDOW w AS (PARTITION BY a, b, c, target ORDER BY rank)"""


@view("descents", "walk")
def _(d: SparkDialect) -> str:
    """Largest descent of each walk, where it starts (after the first maximum) and ends, and the steps of the walk."""
    return """SELECT a, b, c, target, CAST(up AS INT) AS up, CAST(down AS INT) AS down, CAST(drop AS INT) AS descent, CAST(start_site AS INT) AS tract_start, CAST(site + 1 AS INT) AS tract_end FROM (
SELECT *, row_number() OVER (PARTITION BY a, b, c, target ORDER BY drop DESC, rank) AS best FROM (SELECT a, b, c, target, rank, site, peak - height AS drop, coalesce(max(CASE WHEN height = peak AND height > before THEN next_site END) OVER (PARTITION BY a, b, c, target ORDER BY rank ROWS UNBOUNDED PRECEDING), first_site) AS start_site,
  sum(CASE WHEN step > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY a, b, c, target) AS up, sum(CASE WHEN step < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY a, b, c, target) AS down FROM (
SELECT *, greatest(0, max(height) OVER (PARTITION BY a, b, c, target ORDER BY rank ROWS UNBOUNDED PRECEDING)) AS peak, greatest(0, coalesce(max(height) OVER (PARTITION BY a, b, c, target ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM walk) x) y) z WHERE best = 1 AND drop > 0"""


@operator("three_seq_walk", "descents")
def _(d: SparkDialect) -> str:
    """The maximum descent of every target of every triplet."""
    return "SELECT a, b, c, CAST(target AS INT) AS target, up, down, descent, tract_start, tract_end FROM descents"


def _siegmund() -> str:
    b, n = "(descent - CAST(0.5 AS DOUBLE))", "CAST(up + down AS DOUBLE)"
    x = "(down - up)"
    p1 = f"exp(least(CAST(700 AS DOUBLE), -2 * {b} * ({b} - {x}) / {n}))"
    p2 = f"({p1} * (2 * (2 * {b} - {x}) * ({b} - {x}) / {n} + 1))"
    a = f"(2 * (2 * {b} - {x}) / {n})"
    half = f"({a} / 2)"
    density = f"(exp(-0.5 * {half} * {half}) / sqrt(2 * pi()))"
    cdf = normal_cdf(half)
    nu = f"((({cdf}) - CAST(0.5 AS DOUBLE)) * 2 / ({a} * ({density} + {a} * ({cdf}) / 2)))"
    return f"(1 - exp(-{nu} * {nu} * {p2}))"


def descent_p() -> str:
    """The approximate tail probability of a descent, over up, down and descent."""
    ok = "up > 0 AND down > 0 AND 2 * (descent - 0.5) - (down - up) > 0"
    return f"CASE WHEN {ok} THEN greatest(CAST(1E-300 AS DOUBLE), least(CAST(1 AS DOUBLE), {_siegmund()})) ELSE CAST(1 AS DOUBLE) END"


@view("signals", "descents")
def _(d: SparkDialect) -> str:
    """Descents of four or more as detections: recombinant, parents, tract and an approximate tail probability."""
    return f"""SELECT concat(CAST(a AS {'STRING' if d.name == 'spark' else 'VARCHAR'}), '-', CAST(b AS {'STRING' if d.name == 'spark' else 'VARCHAR'}), '-', CAST(c AS {'STRING' if d.name == 'spark' else 'VARCHAR'}), '-', CAST(target AS {'STRING' if d.name == 'spark' else 'VARCHAR'})) AS event_id, CASE target WHEN 0 THEN c WHEN 1 THEN a ELSE b END AS recombinant, CASE target WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS major, CASE target WHEN 0 THEN b WHEN 1 THEN c ELSE a END AS minor,
tract_start, tract_end, up, down, descent, {descent_p()} AS p FROM descents WHERE descent >= 4"""


@operator("three_seq_siegmund", "signals")
def _(d: SparkDialect) -> str:
    """Detections with the tail probability of so large a descent."""
    return "SELECT event_id, recombinant, major, minor, tract_start, tract_end, descent, round(p, 9) AS p FROM signals"


@operator("dominance_windows", "informative")
def _(d: SparkDialect) -> str:
    """Windows of 31 informative sites in which the least frequent agreement of a triplet dominates the other two strictly."""
    w = "(PARTITION BY a, b, c ORDER BY rank ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)"
    return f"""SELECT a, b, c, count(*) AS windows, CAST(sum(CASE WHEN w2 > w1 AND w2 > w0 THEN 1 ELSE 0 END) AS BIGINT) AS seeds_2, CAST(sum(CASE WHEN w1 > w2 AND w1 > w0 THEN 1 ELSE 0 END) AS BIGINT) AS seeds_1 FROM (SELECT a, b, c, {", ".join(f"sum(CASE WHEN category = {k} THEN 1 ELSE 0 END) OVER {w} AS w{k}" for k in range(3))} FROM informative) x GROUP BY a, b, c"""


@view("outgroups", "triplets", "pairs")
def _(d: SparkDialect) -> str:
    """For each triplet the sequence outside it with the least mean distance to it; ties to the smaller id."""
    both = "(SELECT left_id AS x, right_id AS y, CAST(differences AS DOUBLE) / valid_sites AS p FROM pairs UNION ALL SELECT right_id, left_id, CAST(differences AS DOUBLE) / valid_sites FROM pairs)"
    return f"""SELECT a, b, c, o FROM (SELECT t.a, t.b, t.c, pa.y AS o, row_number() OVER (PARTITION BY t.a, t.b, t.c ORDER BY round(pa.p + pb.p + pc.p, 12), pa.y) AS k FROM triplets t JOIN {both} pa ON pa.x = t.a JOIN {both} pb ON pb.x = t.b AND pb.y = pa.y JOIN {both} pc ON pc.x = t.c AND pc.y = pa.y) r WHERE k = 1"""


@operator("outgroup_choice", "outgroups")
def _(d: SparkDialect) -> str:
    """The nearest outgroup of every triplet."""
    return "SELECT a, b, c, o AS outgroup FROM outgroups"


# Four-sequence pattern by triplet state (1 all differ, 2 a = b, 3 a = c, 4 b = c, 5 all equal) and by what the outgroup equals (a, b, c, none).
PATTERNS = ((4, 6, 7, 1), (12, 2, 8, 2), (13, 9, 3, 3), (10, 14, 5, 5), (15, 11, 11, 11))


@operator("siscan_patterns", "sites", "outgroups")
def _(d: SparkDialect) -> str:
    """Pattern counts of each triplet with its outgroup."""
    state = "CASE WHEN x.base = y.base AND y.base = z.base THEN 1 + 4 WHEN x.base = y.base THEN 2 WHEN x.base = z.base THEN 3 WHEN y.base = z.base THEN 4 ELSE 1 END"
    relation = "CASE WHEN w.base = x.base THEN 1 WHEN w.base = y.base THEN 2 WHEN w.base = z.base THEN 3 ELSE 4 END"
    table = " ".join(f"WHEN {10 * s + r} THEN {p}" for s, row in enumerate(PATTERNS, 1) for r, p in enumerate(row, 1))
    return f"""SELECT g.a, g.b, g.c, CAST(CASE {state} * 10 + {relation} {table} END AS INT) AS pattern, count(*) AS n FROM outgroups g JOIN sites x ON x.seq_id = g.a JOIN sites y ON y.seq_id = g.b AND y.site = x.site JOIN sites z ON z.seq_id = g.c AND z.site = x.site JOIN sites w ON w.seq_id = g.o AND w.site = x.site
WHERE x.base < 4 AND y.base < 4 AND z.base < 4 AND w.base < 4 GROUP BY 1, 2, 3, 4"""
