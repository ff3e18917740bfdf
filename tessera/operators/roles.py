"""Roles of an event's three sequences: distance profiles, votes, parent order, regions, diagnostics and matching.

Every view joins events with sites by site and sequence and aggregates before it meets other events, so the
work grows with events times sequences times sites, never with pairs of events."""

from __future__ import annotations

from tessera.plans.operator import SparkDialect, operator, view

# Full and partial points of the three profile tests, and whether the lowest value wins.
VOTES = {"phpr": (8, 4, True), "subphpr": (2, 1, False), "subdist": (10, 5, False)}
FLANK = 60
INSIDE = "s.site >= m.tract_start AND s.site < m.tract_end"


def _pearson(x: str, y: str) -> str:
    """Correlation of the pairs in which both are known; 1 where there are not two or one side is constant."""
    vx, vy = (f"(count(*) * sum({v} * {v}) - sum({v}) * sum({v}))" for v in (x, y))
    r = f"(count(*) * sum({x} * {y}) - sum({x}) * sum({y})) / sqrt(greatest(CAST(1E-300 AS DOUBLE), {vx} * {vy}))"
    return f"CASE WHEN count(*) < 2 OR {vx} <= 1E-12 OR {vy} <= 1E-12 THEN CAST(1 AS DOUBLE) ELSE greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), {r})) END"


@view("role_members", "accepted")
def _(d: SparkDialect) -> str:
    return "SELECT event_id, tract_start, tract_end, role, CASE role WHEN 0 THEN recombinant WHEN 1 THEN major ELSE minor END AS member FROM accepted CROSS JOIN (SELECT 0 AS role UNION ALL SELECT 1 UNION ALL SELECT 2) r"


@view("role_profiles", "role_members", "sites")
def _(d: SparkDialect) -> str:
    """Distances of each role's sequence to every other sequence, inside the tract and outside; null where they share no site."""
    count = lambda inside, what: f"sum(CASE WHEN {'' if inside else 'NOT '}({INSIDE}) AND {what} THEN 1 ELSE 0 END)"
    share = lambda inside: f"CASE WHEN {count(inside, '1 = 1')} > 0 THEN CAST({count(inside, 's.base <> o.base')} AS DOUBLE) / {count(inside, '1 = 1')} END"
    return f"""SELECT m.event_id, m.role, m.member, o.seq_id AS other, {share(True)} AS inside_p, {share(False)} AS outside_p
FROM role_members m JOIN sites s ON s.seq_id = m.member JOIN sites o ON o.site = s.site AND o.seq_id <> m.member WHERE s.base < 4 AND o.base < 4 GROUP BY m.event_id, m.role, m.member, o.seq_id"""


@operator("role_distance_profiles", "role_profiles")
def _(d: SparkDialect) -> str:
    """Each role's distances to the cohort, tract against background."""
    return "SELECT event_id, CAST(role AS INT) AS role, member, other, round(inside_p, 9) AS inside_p, round(outside_p, 9) AS outside_p FROM role_profiles"


@view("role_scores", "role_profiles", "role_members")
def _(d: SparkDialect) -> str:
    """Profile correlation of each role, its total shift, and the mean correlation of the other two without it."""
    known = "p.inside_p IS NOT NULL AND p.outside_p IS NOT NULL"
    return f"""SELECT x.event_id, x.role, x.member, round(x.phpr, 9) AS phpr, round(x.subphpr, 9) AS subphpr, round(y.subdist, 9) AS subdist FROM (
SELECT p.event_id, p.role, p.member, {_pearson('p.outside_p', 'p.inside_p')} AS phpr, sum(abs(p.outside_p - p.inside_p)) AS subphpr FROM role_profiles p WHERE {known} GROUP BY p.event_id, p.role, p.member) x
JOIN (SELECT event_id, removed, avg(r) AS subdist FROM (SELECT p.event_id, m.role AS removed, p.role, {_pearson('p.outside_p', 'p.inside_p')} AS r FROM role_profiles p JOIN role_members m ON m.event_id = p.event_id AND m.role <> p.role AND m.member <> p.other WHERE {known} GROUP BY p.event_id, m.role, p.role) z GROUP BY event_id, removed) y
ON y.event_id = x.event_id AND y.removed = x.role"""


@view("role_points", "role_scores")
def _(d: SparkDialect) -> str:
    """The best value gets full points; a value that beats another gets partial points."""
    tests = []
    for name, (full, part, low) in VOTES.items():
        best, worst = ("min", "max") if low else ("max", "min")
        tests.append(f"CASE WHEN {name} = {best}({name}) OVER w THEN {full} WHEN {name} <> {worst}({name}) OVER w THEN {part} ELSE 0 END")
    return f"SELECT event_id, role, member, phpr, subphpr, subdist, CAST({' + '.join(tests)} AS INT) AS points FROM role_scores WINDOW w AS (PARTITION BY event_id)"


@operator("role_votes", "role_points")
def _(d: SparkDialect) -> str:
    """Points of each of the three sequences for being the recombinant."""
    return "SELECT event_id, CAST(role AS INT) AS role, member, phpr, subphpr, subdist, points FROM role_points"


@operator("role_decision", "role_points")
def _(d: SparkDialect) -> str:
    """The sequence with the most points, the last of equals; a tie of all three goes to the lowest profile correlation."""
    return """SELECT event_id, CAST(role AS INT) AS role, member, points, ambiguous FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY points DESC, CASE WHEN least_points = most_points THEN phpr ELSE CAST(0 AS DOUBLE) END, role DESC) AS k, (winners > 1) AS ambiguous FROM (
SELECT *, sum(CASE WHEN points = most_points THEN 1 ELSE 0 END) OVER (PARTITION BY event_id) AS winners FROM (SELECT *, max(points) OVER (PARTITION BY event_id) AS most_points, min(points) OVER (PARTITION BY event_id) AS least_points FROM role_points) a) b) c WHERE k = 1"""


@operator("parent_preference", "role_profiles", "role_members")
def _(d: SparkDialect) -> str:
    """For each role as recombinant, which of the other two is the major parent: nearer outside the tract and farther inside."""
    signal = "(a.inside_p - b.inside_p) + (b.outside_p - a.outside_p)"
    return f"""SELECT event_id, CAST(role AS INT) AS role, recombinant, CASE WHEN affinity < 0 THEN second_id ELSE first_id END AS major, CASE WHEN affinity < 0 THEN first_id ELSE second_id END AS minor, abs(affinity) AS affinity_switch FROM (
SELECT a.event_id, a.role, a.member AS recombinant, a.other AS first_id, b.other AS second_id, round(coalesce({signal}, CAST(0 AS DOUBLE)), 9) AS affinity FROM role_profiles a JOIN role_members x ON x.event_id = a.event_id AND x.member = a.other JOIN role_profiles b ON b.event_id = a.event_id AND b.role = a.role JOIN role_members y ON y.event_id = b.event_id AND y.member = b.other WHERE x.role < y.role) z"""


@operator("distance_tie_break", "role_profiles", "role_members")
def _(d: SparkDialect) -> str:
    """The role that leaves the closest pair: closest outside the tract first, then closer to the third inside; ties to the earlier pair."""
    return """SELECT event_id, CAST(CASE WHEN f01 <= f02 AND f01 <= f12 THEN CASE WHEN s02 <= s12 THEN 0 ELSE 1 END WHEN f02 <= f01 AND f02 <= f12 THEN CASE WHEN s01 <= s12 THEN 0 ELSE 2 END ELSE CASE WHEN s01 <= s02 THEN 1 ELSE 2 END END AS INT) AS role FROM (
SELECT event_id, """ + ", ".join(f"min(CASE WHEN x = {x} AND y = {y} THEN {v} END) AS {n}{x}{y}" for n, v in (("f", "f"), ("s", "s")) for x, y in ((0, 1), (0, 2), (1, 2))) + """ FROM (
SELECT p.event_id, p.role AS x, m.role AS y, round(coalesce(p.outside_p, CAST(9 AS DOUBLE)), 9) AS f, round(coalesce(p.inside_p, CAST(9 AS DOUBLE)), 9) AS s FROM role_profiles p JOIN role_members m ON m.event_id = p.event_id AND m.member = p.other AND m.role > p.role) q GROUP BY event_id) z"""


@operator("role_trials", "role_profiles", "role_members")
def _(d: SparkDialect) -> str:
    """Three assignments of the roles, each scored by how identity switches between the parents at the tract."""
    i = lambda a, b, where: f"coalesce(1 - max(CASE WHEN x = {a} AND y = {b} THEN {where} END), CAST(0 AS DOUBLE))"
    keys = (("current", 0, 1, 2), ("swap-major", 1, 0, 2), ("swap-minor", 2, 1, 0))
    each = "\nUNION ALL ".join(f"SELECT event_id, '{k}' AS trial, ({i(r, b, 'inside_p')} - {i(r, a, 'inside_p')} + {i(r, a, 'outside_p')} - {i(r, b, 'outside_p')}) / 2 AS signal FROM ends GROUP BY event_id" for k, r, a, b in keys)
    ends = "(SELECT p.event_id, p.role AS x, m.role AS y, p.inside_p, p.outside_p FROM role_profiles p JOIN role_members m ON m.event_id = p.event_id AND m.member = p.other) ends"
    return f"SELECT event_id, trial, round(signal, 9) AS switch_signal, CAST(floor(greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), 50 + 250 * round(signal, 9))) + 0.5) AS INT) AS score FROM ({each.replace('FROM ends', 'FROM ' + ends)}) t"


@operator("region_distances", "role_profiles", "role_members")
def _(d: SparkDialect) -> str:
    """Distances between an event's three sequences in the tract and in the background; 10 where no site is shared."""
    return "SELECT p.event_id, CAST(p.role AS INT) AS first_role, CAST(m.role AS INT) AS second_role, round(coalesce(p.inside_p, CAST(10 AS DOUBLE)), 9) AS tract_p, round(coalesce(p.outside_p, CAST(10 AS DOUBLE)), 9) AS background_p FROM role_profiles p JOIN role_members m ON m.event_id = p.event_id AND m.member = p.other AND m.role > p.role"


@view("category_cells", "accepted", "sites")
def _(d: SparkDialect) -> str:
    """How each sequence divides, in the tract and outside, into like the major parent, like the minor and odd one out; 10 in all cells without any such site."""
    like = ("v.base = a.base AND v.base <> b.base", "v.base = b.base AND v.base <> a.base", "a.base = b.base AND v.base <> a.base")
    n = lambda k, inside: f"sum(CASE WHEN {like[k]} AND {'' if inside else 'NOT '}(r.site >= e.tract_start AND r.site < e.tract_end) THEN 1 ELSE 0 END)"
    counts = ", ".join(f"{n(k, inside)} AS {'t' if inside else 'b'}{k}" for inside in (True, False) for k in range(3))
    cells = ", ".join(f"CASE WHEN {r}0 + {r}1 + {r}2 = 0 THEN CAST(10 AS DOUBLE) ELSE CAST({r}{k} AS DOUBLE) / ({r}0 + {r}1 + {r}2) END AS {name}_{what}" for r, name in (("t", "tract"), ("b", "background")) for k, what in enumerate(("major", "minor", "odd")))
    return f"""SELECT event_id, recombinant, candidate, {cells} FROM (SELECT e.event_id, e.recombinant, v.seq_id AS candidate, {counts} FROM accepted e JOIN sites r ON r.seq_id = e.recombinant JOIN sites a ON a.seq_id = e.major AND a.site = r.site JOIN sites b ON b.seq_id = e.minor AND b.site = r.site JOIN sites v ON v.site = r.site
WHERE r.base < 4 AND a.base < 4 AND b.base < 4 AND v.base < 4 AND v.seq_id <> e.major AND v.seq_id <> e.minor GROUP BY e.event_id, e.recombinant, v.seq_id) c"""


CELLS = tuple(f"{r}_{k}" for r in ("tract", "background") for k in ("major", "minor", "odd"))


@operator("region_category_vector", "category_cells")
def _(d: SparkDialect) -> str:
    """Category shares of every sequence outside the parents, by event and region."""
    return f"SELECT event_id, candidate, {', '.join(f'round({c}, 9) AS {c}' for c in CELLS)} FROM category_cells"


@operator("distance_correlation", "category_cells")
def _(d: SparkDialect) -> str:
    """Correlation of each sequence's six cells with the recombinant's own; 0 with a region without sites, 1 where one side is constant."""
    total = lambda f: "(" + " + ".join(f(c) for c in CELLS) + ")"
    sx, sy = total(lambda c: f"x.{c}"), total(lambda c: f"y.{c}")
    vx, vy = (f"(6 * {total(lambda c, t=t: f'{t}.{c} * {t}.{c}')} - {s} * {s})" for t, s in (("x", sx), ("y", sy)))
    cov = f"(6 * {total(lambda c: f'x.{c} * y.{c}')} - {sx} * {sy})"
    odd = " OR ".join(f"x.{c} > 4 OR y.{c} > 4" for c in CELLS)
    limit = "CAST(0.999999999 AS DOUBLE)"
    return f"""SELECT y.event_id, y.candidate, round(CASE WHEN {odd} THEN CAST(0 AS DOUBLE) WHEN {vx} <= 1E-12 OR {vy} <= 1E-12 THEN CAST(1 AS DOUBLE) ELSE greatest(-{limit}, least({limit}, {cov} / sqrt(greatest(CAST(1E-300 AS DOUBLE), {vx} * {vy})))) END, 9) AS r
FROM category_cells y JOIN category_cells x ON x.event_id = y.event_id AND x.candidate = x.recombinant WHERE y.candidate <> y.recombinant"""


@operator("event_regions", "accepted", "sites")
def _(d: SparkDialect) -> str:
    """The flanks of both breakpoints, each up to 60 sites at which the event's three sequences are known and not all equal."""
    ends = (("start_left", "site < tract_start", "site DESC"), ("start_right", "site >= tract_start", "site"), ("end_left", "site < tract_end", "site DESC"), ("end_right", "site >= tract_end", "site"))
    rows = "\nUNION ALL ".join(f"SELECT event_id, '{name}' AS region, site, row_number() OVER (PARTITION BY event_id ORDER BY {order}) AS k FROM variable WHERE {where}" for name, where, order in ends)
    variable = """(SELECT e.event_id, e.tract_start, e.tract_end, r.site FROM accepted e JOIN sites r ON r.seq_id = e.recombinant JOIN sites a ON a.seq_id = e.major AND a.site = r.site JOIN sites b ON b.seq_id = e.minor AND b.site = r.site WHERE r.base < 4 AND a.base < 4 AND b.base < 4 AND NOT (r.base = a.base AND a.base = b.base)) variable"""
    return f"SELECT event_id, region, CAST(min(site) AS INT) AS first_site, CAST(max(site) AS INT) AS last_site, count(*) AS n_sites FROM ({rows.replace('FROM variable', 'FROM ' + variable)}) x WHERE k <= {FLANK} GROUP BY event_id, region"


@view("variation", "sites")
def _(d: SparkDialect) -> str:
    """Of each site, how many variable sites there are before it and up to it, and in all."""
    return """SELECT site, variable, sum(variable) OVER (ORDER BY site ROWS UNBOUNDED PRECEDING) AS upto, sum(variable) OVER () AS total, max(site) OVER () + 1 AS len FROM (SELECT site, CASE WHEN count(DISTINCT CASE WHEN base < 4 THEN base END) > 1 THEN 1 ELSE 0 END AS variable FROM sites GROUP BY site) v"""


@view("diagnostics", "best_events", "variation", "sites")
def _(d: SparkDialect) -> str:
    """Density of variable sites in the tract and around it, and how often the recombinant has neither parent's base."""
    told = "r.base < 4 AND a.base < 4 AND b.base < 4 AND a.base <> b.base"
    return f"""SELECT event_id, tract_start, tract_end, len, CAST(within AS DOUBLE) / greatest(1, tract_end - tract_start) AS tract_density, CAST(total - within AS DOUBLE) / greatest(1, len - tract_end + tract_start) AS density, discriminating, CAST(conflicts AS DOUBLE) / greatest(1, discriminating) AS conflict_rate FROM (
SELECT e.event_id, e.tract_start, e.tract_end, x.len, x.total, y.upto - x.upto + x.variable AS within, sum(CASE WHEN {told} THEN 1 ELSE 0 END) AS discriminating, sum(CASE WHEN {told} AND r.base <> a.base AND r.base <> b.base THEN 1 ELSE 0 END) AS conflicts
FROM best_events e JOIN variation x ON x.site = e.tract_start JOIN variation y ON y.site = e.tract_end - 1 LEFT JOIN sites r ON r.seq_id = e.recombinant AND r.site >= e.tract_start AND r.site < e.tract_end LEFT JOIN sites a ON a.seq_id = e.major AND a.site = r.site LEFT JOIN sites b ON b.seq_id = e.minor AND b.site = r.site
GROUP BY e.event_id, e.tract_start, e.tract_end, x.len, x.total, y.upto, x.upto, x.variable) g"""


RATE = "tract_density / greatest(CAST(1 AS DOUBLE) / greatest(1, len), density)"


@operator("candidate_diagnostics", "diagnostics")
def _(d: SparkDialect) -> str:
    """Rate ratio of the tract and conflict rate with the parents."""
    return f"SELECT event_id, round(tract_density, 9) AS tract_density, round(density, 9) AS background_density, round({RATE}, 9) AS rate_ratio, round(conflict_rate, 9) AS conflict_rate, CAST(discriminating AS BIGINT) AS discriminating_sites FROM diagnostics"


@operator("event_warnings", "diagnostics")
def _(d: SparkDialect) -> str:
    """Codes of what a reviewer should look at: few sites, a boundary of the alignment nearby, a rate shift, conflicts with both parents."""
    tests = (("few_sites", "discriminating < 25"), ("near_boundary", "tract_start < 60 OR len - tract_end < 60"), ("rate_shift", f"{RATE} >= 4 OR {RATE} <= 0.25"), ("parent_conflict", "conflict_rate > 0.15"))
    return f"SELECT event_id, rtrim(concat({', '.join(f'''CASE WHEN {test} THEN '{name} ' ELSE '' END''' for name, test in tests)})) AS warnings FROM diagnostics"


@operator("orientation_choice", "best_events", "sites")
def _(d: SparkDialect) -> str:
    """Both orders of the parents tried: the effect is the minor parent's share of the contrasting sites inside less outside, and the larger is kept if there are four such sites."""
    inside = "(r.site >= e.tract_start AND r.site < e.tract_end)"
    n = lambda what: f"sum(CASE WHEN {what} THEN 1 ELSE 0 END)"
    share = lambda where: f"CAST({n(f'{where} AND r.base = b.base')} AS DOUBLE) / greatest(1, {n(where)})"
    return f"""SELECT event_id, CASE WHEN effect < 0 THEN minor ELSE major END AS major, CASE WHEN effect < 0 THEN major ELSE minor END AS minor, informative, abs(effect) AS effect FROM (
SELECT e.event_id, e.major, e.minor, count(*) AS informative, round(CASE WHEN {n(inside)} = 0 OR {n('NOT ' + inside)} = 0 THEN CAST(0 AS DOUBLE) ELSE {share(inside)} - {share('NOT ' + inside)} END, 9) AS effect
FROM best_events e JOIN sites r ON r.seq_id = e.recombinant JOIN sites a ON a.seq_id = e.major AND a.site = r.site JOIN sites b ON b.seq_id = e.minor AND b.site = r.site WHERE r.base < 4 AND a.base < 4 AND b.base < 4 AND a.base <> b.base AND (r.base = a.base OR r.base = b.base) GROUP BY e.event_id, e.major, e.minor) x WHERE informative >= 4 AND abs(effect) > 0"""


@operator("signal_match", "accepted", "signals")
def _(d: SparkDialect) -> str:
    """For each accepted event and sequence the signal with the largest overlap, over 0.3 of the shorter tract, whose triplet has that sequence and two or more of the event's."""
    members = lambda t: f"(SELECT event_id, least(x, y) AS low, greatest(x, y) AS high FROM (SELECT event_id, recombinant AS x, major AS y FROM {t} UNION ALL SELECT event_id, recombinant, minor FROM {t} UNION ALL SELECT event_id, major, minor FROM {t}) u)"
    share = "CAST(least(e.tract_end, s.tract_end) - greatest(e.tract_start, s.tract_start) AS DOUBLE) / greatest(1, least(e.tract_end - e.tract_start, s.tract_end - s.tract_start))"
    return f"""SELECT event_id, candidate, signal_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY event_id, candidate ORDER BY overlap DESC, signal_id) AS k FROM (
SELECT m.event_id, m.signal_id, round({share}, 9) AS overlap, CASE c.slot WHEN 0 THEN s.recombinant WHEN 1 THEN s.major ELSE s.minor END AS candidate FROM (SELECT DISTINCT f.event_id, g.event_id AS signal_id FROM {members('accepted')} f JOIN {members('signals')} g ON g.low = f.low AND g.high = f.high) m
JOIN accepted e ON e.event_id = m.event_id JOIN signals s ON s.event_id = m.signal_id CROSS JOIN (SELECT 0 AS slot UNION ALL SELECT 1 UNION ALL SELECT 2) c WHERE {share} > 0.3) x) y WHERE k = 1"""


@operator("resolved_duplicates", "best_events", "accepted", "sites")
def _(d: SparkDialect) -> str:
    """Candidates left after those are dropped that repeat an accepted event: the same parents, with boundaries within a hundredth of the length or almost the same tract."""
    near = lambda end: f"least(abs(x.{end} - e.{end}), l.len - abs(x.{end} - e.{end})) <= greatest(4, floor(l.len * 0.01 + 0.5))"
    a, b = "(x.tract_end - x.tract_start)", "(e.tract_end - e.tract_start)"
    shared = "greatest(0, least(x.tract_end, e.tract_end) - greatest(x.tract_start, e.tract_start))"
    return f"""SELECT c.event_id, c.recombinant, c.tract_start, c.tract_end FROM best_events c LEFT JOIN (SELECT DISTINCT x.event_id FROM best_events x JOIN accepted e ON e.recombinant = x.recombinant AND least(e.major, e.minor) = least(x.major, x.minor) AND greatest(e.major, e.minor) = greatest(x.major, x.minor) CROSS JOIN (SELECT max(site) + 1 AS len FROM sites) l
WHERE ({near('tract_start')} AND {near('tract_end')}) OR (least({a}, {b}) >= 0.7 * greatest(1, {a}, {b}) AND {shared} >= 0.85 * greatest(1, {a}, {b}))) again ON again.event_id = c.event_id WHERE again.event_id IS NULL"""


@operator("parent_shortlist", "pairs")
def _(d: SparkDialect) -> str:
    """Eight candidate parents of each sequence: two places are reserved for the nearest of groups (here ids by residue of five) not among the others, the rest go to the nearest."""
    both = "(SELECT left_id AS target, right_id AS parent, round(CAST(differences AS DOUBLE) / valid_sites, 12) AS p FROM pairs UNION ALL SELECT right_id, left_id, round(CAST(differences AS DOUBLE) / valid_sites, 12) FROM pairs)"
    return f"""SELECT target, parent, CAST(place AS INT) AS place FROM (SELECT target, parent, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN near <= 6 THEN 0 WHEN reserve <= 2 THEN 1 ELSE 2 END, near) AS place FROM (
SELECT *, CASE WHEN near > 6 AND of_group = 1 THEN row_number() OVER (PARTITION BY target, CASE WHEN near > 6 AND of_group = 1 THEN 1 ELSE 0 END ORDER BY near) ELSE 99 END AS reserve FROM (
SELECT *, row_number() OVER (PARTITION BY target ORDER BY p, parent) AS near, row_number() OVER (PARTITION BY target, parent % 5 ORDER BY p, parent) AS of_group FROM {both} b) x) y) z WHERE place <= 8"""


@view("cds", "sites")
def _(d: SparkDialect) -> str:
    """Coding features of the test alignment: one in every 48 sites, strands and phases in turn."""
    return f"SELECT CAST(k AS INT) AS feature, CAST(48 * k + 3 AS INT) AS cds_start, CAST(48 * k + 45 AS INT) AS cds_end, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(k % 3 AS INT) AS phase, len FROM (SELECT len, {d.each('0', d.idiv('len', '48'))} AS k FROM (SELECT CAST(max(site) + 1 AS INT) AS len FROM sites) l) f"


@operator("codon_mask", "accepted", "cds")
def _(d: SparkDialect) -> str:
    """Tracts widened to whole codons of the first coding feature they overlap, in its phase and strand; from the origin where there is none."""
    low, high = "floor(CAST(tract_start - origin AS DOUBLE) / 3)", "ceil(CAST(tract_end - origin AS DOUBLE) / 3)"
    return f"""SELECT event_id, recombinant, CAST(greatest(0, origin + {low} * 3) AS INT) AS mask_start, CAST(least(len, origin + {high} * 3) AS INT) AS mask_end FROM (
SELECT e.event_id, e.recombinant, e.tract_start, e.tract_end, l.len, coalesce(o.origin, 0) AS origin FROM accepted e CROSS JOIN (SELECT max(len) AS len FROM cds) l LEFT JOIN (SELECT event_id, origin FROM (SELECT e.event_id, CASE WHEN c.strand = '-' THEN c.cds_end - c.phase ELSE c.cds_start + c.phase END AS origin, row_number() OVER (PARTITION BY e.event_id ORDER BY c.feature) AS k FROM accepted e JOIN cds c ON c.cds_start < e.tract_end AND c.cds_end > e.tract_start) x WHERE k = 1) o ON o.event_id = e.event_id) y"""


@operator("position_coverage", "best_events", "sites")
def _(d: SparkDialect) -> str:
    """Events whose tract, seen on the circle with its origin half a turn away, contains the middle of each bin of 20 sites; tracts may wrap."""
    h = d.idiv("len", "2")
    tracts = f"SELECT len, (tract_start - {h} + len) % len AS s, CASE WHEN (tract_end - {h} + len) % len = 0 THEN len ELSE (tract_end - {h} + len) % len END AS e FROM best_events CROSS JOIN (SELECT CAST(max(site) + 1 AS INT) AS len FROM sites) l"
    bins = f"SELECT {d.each('0', d.idiv('len', '20') + ' - 1')} AS bin FROM (SELECT CAST(max(site) + 1 AS INT) AS len FROM sites) l"
    at = "(b.bin * 20 + 10)"
    return f"SELECT CAST(b.bin AS INT) AS bin, CAST(sum(CASE WHEN (s < e AND {at} >= s AND {at} < e) OR (s >= e AND ({at} >= s OR {at} < e)) THEN 1 ELSE 0 END) AS BIGINT) AS n_events FROM ({bins}) b CROSS JOIN ({tracts}) t GROUP BY b.bin"
