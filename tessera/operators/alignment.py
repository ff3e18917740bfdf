"""Alignment views, encoding, packing, distances and per-site analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.statistics import erfc, jukes_cantor
from tessera.operators import tiles
from tessera.plans.operator import OPERATORS, VIEWS, Operator, SparkDialect, operator, shortened, view

VALID = "base < 4"


@view("embed_sites", "embeddings")
def _(d: SparkDialect) -> str:
    return f"""SELECT seq_id, CAST(i - 1 AS INT) AS site, CAST(CASE WHEN v < -0.15 THEN 0 WHEN v < 0 THEN 1 WHEN v < 0.15 THEN 2 WHEN v < 0.35 THEN 3 ELSE 4 END AS INT) AS base
FROM (SELECT seq_id, i, CAST({d.at('embedding', 'i')} AS DOUBLE) AS v FROM (SELECT vec_id AS seq_id, embedding, {d.each('1', 'CAST(' + ('size' if d.name == 'spark' else 'len') + '(embedding) AS INT)')} AS i FROM embeddings) e) x"""


@view("sites", "lineitem", "supplier")
def _(d: SparkDialect) -> str:
    """25 sequences (nations of suppliers) by ship weeks; the base is a checksum of the week's lines, 4 where there are none."""
    return f"""SELECT CAST(g.seq_id AS BIGINT) AS seq_id, CAST(g.site AS INT) AS site, CAST(coalesce(c.base, 4) AS INT) AS base
FROM (SELECT q.seq_id, s.site FROM (SELECT DISTINCT s_nationkey AS seq_id FROM supplier) q CROSS JOIN (SELECT DISTINCT {d.idiv(d.days('1995-01-01', 'l_shipdate'), '7')} AS site FROM lineitem) s) g
LEFT JOIN (SELECT s_nationkey AS seq_id, {d.idiv(d.days('1995-01-01', 'l_shipdate'), '7')} AS site, CAST(sum(l_linenumber) AS BIGINT) % 4 AS base FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) c
ON g.seq_id = c.seq_id AND g.site = c.site"""


@view("event_sites", "events")
def _(d: SparkDialect) -> str:
    """Users by day of month: the last event type of the day, 5 for errors; absent days have no row."""
    day = "CAST(extract(DAY FROM ts) AS INT)"
    return f"""SELECT user_id AS seq_id, {day} - 1 AS site, CAST(CASE max_by(event_type, event_id) WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 5 END AS INT) AS base FROM events GROUP BY 1, 2"""


@view("words", "embed_sites")
def _(d: SparkDialect) -> str:
    lane = "CAST(power(4, site % 16) AS BIGINT)"
    return f"""SELECT seq_id, {d.idiv('site', '16')} AS word, CAST(sum(CASE WHEN {VALID} THEN base ELSE 0 END * {lane}) AS BIGINT) AS bases, CAST(sum(CASE WHEN {VALID} THEN 1 ELSE 0 END * {lane}) AS BIGINT) AS valid FROM embed_sites GROUP BY 1, 2"""


@view("packed_pairs", "words")
def _(d: SparkDialect) -> str:
    x, v = d.xor("l.bases", "r.bases"), "(l.valid & r.valid)"
    return f"""SELECT l.seq_id AS left_id, r.seq_id AS right_id, CAST(sum({d.bits(v)}) AS BIGINT) AS valid_sites, CAST(sum({d.bits(f'(({x} | {d.shr(x, 1)}) & {v})')}) AS BIGINT) AS differences
FROM words l JOIN words r ON l.word = r.word AND l.seq_id < r.seq_id GROUP BY 1, 2"""


def _by_rows(name: str, needed: DataFrame) -> DataFrame:
    """A view of pairs as its SQL says, for rows that do not fit into tiles."""
    return Operator(name, VIEWS[name].needs, VIEWS[name].text, "").run(needed.sparkSession, **{VIEWS[name].needs[0]: needed})


@shortened("packed_pairs", "words")
def packed_tiles(words: DataFrame) -> DataFrame:
    t = tiles.tiling(words)
    return tiles.pairs(words, t) if t else _by_rows("packed_pairs", words)


@view("pairs", "sites")
def _(d: SparkDialect) -> str:
    return """SELECT l.seq_id AS left_id, r.seq_id AS right_id, count(*) AS valid_sites, CAST(sum(CASE WHEN l.base <> r.base THEN 1 ELSE 0 END) AS BIGINT) AS differences
FROM sites l JOIN sites r ON l.site = r.site AND l.seq_id < r.seq_id WHERE l.base < 4 AND r.base < 4 GROUP BY 1, 2"""


@operator("encode_sites", "embed_sites")
def _(d: SparkDialect) -> str:
    """Characters to base codes: 0 to 3, 4 missing."""
    return "SELECT seq_id, site, base FROM embed_sites"


@operator("encode_event_sites", "event_sites")
def _(d: SparkDialect) -> str:
    """An alignment with real gaps: last event type of each user and day."""
    return "SELECT seq_id, site, base FROM event_sites"


@operator("pack_words", "words")
def _(d: SparkDialect) -> str:
    """16 sites a word: two bits a base, and a validity bit in the low bit of each lane."""
    return "SELECT seq_id, CAST(word AS INT) AS word, bases, valid FROM words"


@operator("unpack_words", "words")
def _(d: SparkDialect) -> str:
    """Bases of packed words, lane by lane."""
    lane = "CAST(power(4, lane) AS BIGINT)"
    return f"""SELECT seq_id, CAST(word * 16 + lane AS INT) AS site, CAST(CASE WHEN {d.idiv('valid', lane)} % 2 = 1 THEN {d.idiv('bases', lane)} % 4 ELSE 4 END AS INT) AS base FROM (SELECT seq_id, word, bases, valid, {d.each('0', '15')} AS lane FROM words) w"""


@operator("rotate_sites", "sites")
def _(d: SparkDialect) -> str:
    """The circular second-origin view: sites moved left by half the length."""
    return f"""SELECT seq_id, CAST((site - {d.idiv('len', '2')} + len) % len AS INT) AS site, base FROM (SELECT seq_id, site - low AS site, base, high - low + 1 AS len FROM sites CROSS JOIN (SELECT min(site) AS low, max(site) AS high FROM sites) l) s"""


@operator("pair_distance", "pairs")
def _(d: SparkDialect) -> str:
    """Share of differing sites among those valid in both sequences."""
    return "SELECT left_id, right_id, valid_sites, differences, round(CAST(differences AS DOUBLE) / valid_sites, 9) AS p_distance FROM pairs"


@operator("packed_pair_distance", "packed_pairs")
def _(d: SparkDialect) -> str:
    """The same from packed words of all vectors: exclusive or, folded lanes, population count."""
    return "SELECT left_id, right_id, valid_sites, differences, round(CASE WHEN valid_sites = 0 THEN 1 ELSE CAST(differences AS DOUBLE) / greatest(1, valid_sites) END, 9) AS p_distance FROM packed_pairs"


@operator("jc_distance", "pairs")
def _(d: SparkDialect) -> str:
    """Jukes-Cantor distance; 3 beyond saturation."""
    return f"SELECT left_id, right_id, round({jukes_cantor('p')}, 9) AS jc FROM (SELECT left_id, right_id, CAST(differences AS DOUBLE) / valid_sites AS p FROM pairs) x"


@operator("quantised_jc", "pairs")
def _(d: SparkDialect) -> str:
    """Jukes-Cantor distance as a 16-bit whole number of 1/3200."""
    return f"SELECT left_id, right_id, CAST(least(32000, floor(3200 * CASE WHEN 1 - p <= 0.25 THEN CAST(10 AS DOUBLE) ELSE {jukes_cantor('p')} END + 0.5)) AS INT) AS q FROM (SELECT left_id, right_id, CAST(differences AS DOUBLE) / valid_sites AS p FROM pairs) x"


@operator("max_distance", "packed_pairs")
def _(d: SparkDialect) -> str:
    """The largest distance of all pairs of vectors."""
    return "SELECT round(max(CAST(differences AS DOUBLE) / greatest(1, valid_sites)), 9) AS max_p, count(*) AS n_pairs FROM packed_pairs"


@shortened("max_distance", "words")
def largest_of_tiles(words: DataFrame) -> DataFrame:
    t = tiles.tiling(words)
    return tiles.extremes(words, t) if t else OPERATORS["max_distance"].run(words.sparkSession, packed_pairs=_by_rows("packed_pairs", words))


def _ranked(source: str) -> str:
    return f"""SELECT target, neighbour, round(p, 9) AS p_distance, CAST(rank AS INT) AS rank FROM (SELECT target, neighbour, p, row_number() OVER (PARTITION BY target ORDER BY p, neighbour) AS rank
FROM (SELECT left_id AS target, right_id AS neighbour, CAST(differences AS DOUBLE) / greatest(1, valid_sites) AS p FROM {source} UNION ALL SELECT right_id, left_id, CAST(differences AS DOUBLE) / greatest(1, valid_sites) FROM {source}) u) r WHERE rank <= 8"""


@operator("nearest_parents", "packed_pairs")
def _(d: SparkDialect) -> str:
    """The eight closest relatives of every sequence; ties to the smaller id."""
    return _ranked("packed_pairs")


@shortened("nearest_parents", "words")
def nearest_of_tiles(words: DataFrame) -> DataFrame:
    t = tiles.tiling(words)
    return tiles.nearest(words, t) if t else OPERATORS["nearest_parents"].run(words.sparkSession, packed_pairs=_by_rows("packed_pairs", words))


@view("sketch_pairs", "embed_sites")
def _(d: SparkDialect) -> str:
    """Pair counts on 16 evenly spaced sites of 64."""
    s = f"(SELECT seq_id, site, base FROM embed_sites WHERE site IN (SELECT {d.idiv('i * 63', '15')} FROM (SELECT {d.each('0', '15')} AS i) k) AND base < 4)"
    return f"SELECT l.seq_id AS left_id, r.seq_id AS right_id, count(*) AS valid_sites, CAST(sum(CASE WHEN l.base <> r.base THEN 1 ELSE 0 END) AS BIGINT) AS differences FROM {s} l JOIN {s} r ON l.site = r.site AND l.seq_id < r.seq_id GROUP BY 1, 2"


@operator("sampled_nearest", "sketch_pairs")
def _(d: SparkDialect) -> str:
    """Approximate relatives from an evenly spaced sketch of sites."""
    return _ranked("sketch_pairs")


@shortened("sampled_nearest", "embed_sites")
def nearest_of_sketches(embed_sites: DataFrame) -> DataFrame:
    """The sketch is a word of 16 lanes; only a site that is there once fits into one."""
    taken = [i * 63 // 15 for i in range(16)]
    lane = F.pow(F.lit(4), F.array_position(F.array(*map(F.lit, taken)), F.col("site")) - 1).cast("long")
    rows = embed_sites.where(F.col("site").isin(taken) & (F.col("base") < 4)).groupBy("seq_id", "site").agg(F.count("base").alias("n"), F.min("base").alias("base"))
    words = rows.groupBy("seq_id").agg(F.lit(0).alias("word"), F.sum(F.col("base") * lane).alias("bases"), F.sum(F.when((F.col("n") == 1) & (F.col("base") >= 0), lane).otherwise(2)).alias("valid"))
    t = tiles.tiling(words, by_site=True)
    return tiles.nearest(words, t) if t else OPERATORS["sampled_nearest"].run(embed_sites.sparkSession, sketch_pairs=_by_rows("sketch_pairs", embed_sites))


@operator("variable_sites", "sites")
def _(d: SparkDialect) -> str:
    """States, majority share and variability of each site."""
    return """SELECT site, CAST(count(DISTINCT CASE WHEN base < 4 THEN base END) AS INT) AS states, CAST(sum(CASE WHEN base < 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, CAST(sum(CASE WHEN base = 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, count(DISTINCT CASE WHEN base < 4 THEN base END) > 1 AS variable FROM sites GROUP BY site"""


@operator("alignment_stats", "sites", "pairs")
def _(d: SparkDialect) -> str:
    """Variable sites, missing share and mean identity of the alignment."""
    return """SELECT a.n_sequences, a.n_sites, a.n_missing, v.n_variable, round(p.identity, 9) AS mean_identity FROM (SELECT count(DISTINCT seq_id) AS n_sequences, count(DISTINCT site) AS n_sites, CAST(sum(CASE WHEN base >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM sites) a
CROSS JOIN (SELECT count(*) AS n_variable FROM (SELECT site FROM sites WHERE base < 4 GROUP BY site HAVING count(DISTINCT base) > 1) x) v
CROSS JOIN (SELECT avg(1 - CAST(differences AS DOUBLE) / valid_sites) AS identity FROM pairs) p"""


@operator("parent_informative_sites", "sites")
def _(d: SparkDialect) -> str:
    """Sites at which at least two sequences have different bases, each base twice or more."""
    return """SELECT site, CAST(count(*) AS INT) AS states, CAST(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS INT) AS repeated FROM (SELECT site, base, count(*) AS n FROM sites WHERE base < 4 GROUP BY site, base) x GROUP BY site HAVING count(*) > 1"""


@operator("parent_affinity", "sites")
def _(d: SparkDialect) -> str:
    """How each base of a sequence relates to the rest of its site: missing, novel, unique (one other) or shared."""
    return """SELECT seq_id, affinity, count(*) AS n FROM (SELECT s.seq_id, CASE WHEN s.base >= 4 THEN 'missing' WHEN c.n = 1 THEN 'novel' WHEN c.n = 2 THEN 'unique' ELSE 'shared' END AS affinity FROM sites s LEFT JOIN (SELECT site, base, count(*) AS n FROM sites GROUP BY site, base) c ON s.site = c.site AND s.base = c.base) x GROUP BY seq_id, affinity"""


@operator("identity_profile", "sites")
def _(d: SparkDialect) -> str:
    """Identity of every pair in windows of 41 sites."""
    return """SELECT left_id, right_id, site, round(CAST(same AS DOUBLE) / n, 9) AS identity FROM (SELECT l.seq_id AS left_id, r.seq_id AS right_id, l.site, sum(CASE WHEN l.base = r.base THEN 1 ELSE 0 END) OVER w AS same, count(*) OVER w AS n
FROM sites l JOIN sites r ON l.site = r.site AND l.seq_id < r.seq_id WHERE l.base < 4 AND r.base < 4 WINDOW w AS (PARTITION BY l.seq_id, r.seq_id ORDER BY l.site ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)) x"""


@operator("local_discordance", "sites")
def _(d: SparkDialect) -> str:
    """Root mean square difference of pair distances between windows of 40 sites."""
    w = f"(SELECT l.seq_id AS left_id, r.seq_id AS right_id, {d.idiv('l.site', '40')} AS win, avg(CAST(CASE WHEN l.base <> r.base THEN 1 ELSE 0 END AS DOUBLE)) AS p FROM sites l JOIN sites r ON l.site = r.site AND l.seq_id < r.seq_id WHERE l.base < 4 AND r.base < 4 GROUP BY 1, 2, 3)"
    return f"SELECT CAST(a.win AS INT) AS win_a, CAST(b.win AS INT) AS win_b, round(sqrt(avg((a.p - b.p) * (a.p - b.p))), 9) AS rms FROM {w} a JOIN {w} b ON a.left_id = b.left_id AND a.right_id = b.right_id AND a.win < b.win GROUP BY 1, 2"


@operator("four_gamete", "sites")
def _(d: SparkDialect) -> str:
    """Pairs of sites at most 30 apart, each split into its smallest state and the rest, and whether all four combinations occur."""
    two = "(SELECT s.seq_id, s.site, CASE WHEN s.base = m.low THEN 0 ELSE 1 END AS allele FROM sites s JOIN (SELECT site, min(base) AS low FROM sites WHERE base < 4 GROUP BY site HAVING count(DISTINCT base) <= 4) m ON s.site = m.site WHERE s.base < 4)"
    return f"SELECT a.site AS site_a, b.site AS site_b, CAST(count(DISTINCT a.allele * 2 + b.allele) AS INT) AS gametes, count(DISTINCT a.allele * 2 + b.allele) = 4 AS incompatible FROM {two} a JOIN {two} b ON a.seq_id = b.seq_id AND b.site > a.site AND b.site <= a.site + 30 GROUP BY 1, 2"


PHI_SITES = "(SELECT site, row_number() OVER (ORDER BY site) AS rank FROM (SELECT site FROM (SELECT site, base, count(*) AS n FROM sites WHERE base < 4 GROUP BY site, base) x GROUP BY site HAVING count(*) >= 2 AND sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) >= 2) y)"


@operator("phi_informative_sites", "sites")
def _(d: SparkDialect) -> str:
    """Sites with two states or more of which two occur twice or more."""
    return f"SELECT site, CAST(rank AS INT) AS rank FROM {PHI_SITES} p"


@view("phi_shape", "sites")
def _(d: SparkDialect) -> str:
    """How many informative sites there are, and how many neighbours of a site count as near: its share of a window of 100 sites, ten at least."""
    n, k = "CAST(n AS DOUBLE)", d.round_even("CAST(n AS DOUBLE) / len * 100")
    fits = f"CASE WHEN greatest(10, {k}) > n THEN {d.round_even(f'{n} / 2')} - 1 ELSE greatest(10, {k}) END"
    return f"SELECT n, CAST(greatest(1, least({fits}, n - 1)) AS BIGINT) AS k FROM (SELECT (SELECT count(*) FROM {PHI_SITES} p) AS n, (SELECT max(site) + 1 FROM sites) AS len) x"


def _merged(source: str) -> str:
    """Left states of a pair of sites that share a right state take over each other's right states."""
    return f"SELECT l.ra, l.rb, l.x, max(l.n) AS n, bit_or(r.mask) AS mask FROM {source} l JOIN {source} r ON l.ra = r.ra AND l.rb = r.rb AND (l.mask & r.mask) <> 0 GROUP BY l.ra, l.rb, l.x"


@view("phi_edges", "sites")
def _(d: SparkDialect) -> str:
    """For each pair of informative sites and each state at the left one: the states at the right one that occur with it, as a mask, and how many."""
    of = f"(SELECT s.seq_id, p.rank, s.base FROM sites s JOIN {PHI_SITES} p ON s.site = p.site WHERE s.base < 4)"
    return f"SELECT ra, rb, x, count(*) AS n, CAST(sum(CAST(power(2, y) AS BIGINT)) AS BIGINT) AS mask FROM (SELECT DISTINCT a.rank AS ra, b.rank AS rb, a.base AS x, b.base AS y FROM {of} a JOIN {of} b ON a.seq_id = b.seq_id AND a.rank < b.rank) e GROUP BY ra, rb, x"


@view("phi_once", "phi_edges")
def _(d: SparkDialect) -> str:
    return _merged("phi_edges")


@view("phi_components", "phi_once")
def _(d: SparkDialect) -> str:
    """Merged twice, which reaches all of at most four left states."""
    return _merged("phi_once")


@view("phi_pairs", "phi_components")
def _(d: SparkDialect) -> str:
    """Incompatibility of each pair of informative sites: edges less vertices plus components of the graph of states that occur together."""
    return f"SELECT ra, rb, CAST(greatest(0, sum(n) - count(*) - {d.bits('bit_or(mask)')} + count(DISTINCT mask)) AS BIGINT) AS score FROM phi_components GROUP BY ra, rb"


@operator("phi_incompatibility", "phi_pairs")
def _(d: SparkDialect) -> str:
    """Incompatibility of every pair of informative sites."""
    return "SELECT CAST(ra AS INT) AS left_rank, CAST(rb AS INT) AS right_rank, score FROM phi_pairs"


@view("phi_moments", "phi_pairs", "phi_shape")
def _(d: SparkDialect) -> str:
    """The summed incompatibility of near pairs and of all, and the sums over sites that its variance takes: one pass over the pairs, each told to both of its sites."""
    sides = f"(SELECT CASE WHEN side = 0 THEN ra ELSE rb END AS rank, rb - ra AS gap, score FROM phi_pairs CROSS JOIN (SELECT {d.each('0', '1')} AS side) b)"
    by_site = f"(SELECT u.rank, s.k, CAST(sum(u.score) AS DOUBLE) AS f, CAST(sum(u.score * u.score) AS DOUBLE) AS g, CAST(sum(CASE WHEN u.gap <= s.k THEN u.score ELSE 0 END) AS DOUBLE) AS near FROM {sides} u CROSS JOIN phi_shape s GROUP BY u.rank, s.k)"
    return f"""SELECT s.n, s.k, t.near / 2 AS near, t.total / 2 AS total, t.squares, t.row_squares FROM phi_shape s CROSS JOIN (SELECT coalesce(sum(near), 0) AS near, coalesce(sum(f), 0) AS total, coalesce(sum(g), 0) AS squares, coalesce(sum(f * f), 0) AS row_squares FROM {by_site} r) t"""


def _phi_variance() -> str:
    """The variance of the mean over near sites when sites are in random order: a polynomial in the number of sites n and of neighbours k."""
    n, k = "CAST(n AS DOUBLE)", "CAST(k AS DOUBLE)"
    # For each of the three sums, coefficients by powers of k and n, and what they are divided by.
    tops = (
        {(1, 1): 27, (2, 0): -18, (2, 1): 28, (1, 2): -21, (1, 0): -9, (0, 1): 5, (3, 0): -9, (0, 2): -11, (0, 3): 6, (3, 1): 6, (2, 2): -4},
        {(2, 1): 8, (2, 0): -14, (1, 1): 39, (0, 1): 19, (1, 0): -21, (3, 0): 3, (1, 2): -15, (0, 3): 6, (0, 2): -21, (0, 0): -4},
        {(1, 1): -18, (2, 1): -2, (2, 0): 16, (0, 2): 6, (0, 1): -10, (0, 0): 2, (1, 0): 15, (3, 0): 3},
    )
    poly = ["(" + " + ".join(f"{c} * power({k}, {i}) * power({n}, {j})" for (i, j), c in top.items()) + ")" for top in tops]
    near = f"{k} * power(2 * {n} - {k} - 1, 2) * ({n} - 1) * ({n} - 2) * ({n} - 3) * {n}"
    return f"(2 * {poly[0]} / (3 * {near} * ({n} - 1) * {n}) * 4 * CAST(total AS DOUBLE) * total + 2 * {poly[1]} / (3 * {near}) * squares - 4 * {poly[2]} / (3 * {near}) * row_squares)"


@operator("phi_statistic", "phi_moments")
def _(d: SparkDialect) -> str:
    """Mean pairwise incompatibility of near informative sites and of all."""
    return "SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(2 * CAST(total AS DOUBLE) / greatest(1, n * (n - 1)), 9) AS mean_all, round(2 * CAST(near AS DOUBLE) / greatest(1, k * (2 * n - k - 1)), 9) AS phi FROM phi_moments"


@operator("phi_test", "phi_moments")
def _(d: SparkDialect) -> str:
    """Whether near sites are less incompatible than sites in random order: statistic, mean, variance, z and the lower tail; 1 where the normal approximation does not hold."""
    tail = erfc("abs(z) / sqrt(CAST(2 AS DOUBLE))")
    return f"""SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(phi, 9) AS phi, round(mean_all, 9) AS mean_all, round(variance, 12) AS variance, round(z, 6) AS z, valid, round(CASE WHEN NOT valid THEN CAST(1 AS DOUBLE) WHEN z < 0 THEN {tail} / 2 ELSE 1 - {tail} / 2 END, 9) AS p FROM (
SELECT *, CASE WHEN valid THEN (phi - mean_all) / sqrt(variance) ELSE CAST(0 AS DOUBLE) END AS z FROM (SELECT *, n > 2 * k AND n > 3 AND variance > 0 AS valid FROM (
SELECT n, k, 2 * CAST(near AS DOUBLE) / greatest(1, k * (2 * n - k - 1)) AS phi, 2 * CAST(total AS DOUBLE) / greatest(1, n * (n - 1)) AS mean_all, CASE WHEN n > 3 THEN greatest(CAST(0 AS DOUBLE), {_phi_variance()}) ELSE CAST(0 AS DOUBLE) END AS variance FROM phi_moments) v) x) y"""
