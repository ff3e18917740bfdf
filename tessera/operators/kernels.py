"""Detectors and trees whose sequential parts run as Arrow functions on groups that Spark partitions:
one triplet, one window or one distinct key a group, so no group grows with the number of sequences' pairs or triplets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fragments, scans
from tessera.plans.operator import Operator

SEED = 1511506142


def frame(spark: SparkSession, name: str, **frames: DataFrame) -> DataFrame:
    """A view as a DataFrame."""
    return Operator(name, (name,), lambda _: f"SELECT * FROM {name}", "").run(spark, **frames)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over a fixed number of partitions: groups are few bytes but much work, so they must not be gathered by size."""
    spark = rows.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *keys)


def walk_tail(up: int, down: int, descent: int) -> float:
    """Probability that a random order of up steps of +1 and down of -1 descends by at least ``descent`` somewhere."""
    if descent <= 0:
        return 1.0
    if descent > down:
        return 0.0
    ups = np.arange(up + 1)
    now, tail = np.zeros((up + 1, descent)), 0.0
    now[0, 0] = 1.0
    for step in range(up + down):
        left = up + down - step
        rise = now * ((up - ups) / left)[:, None]
        fall = now * (np.clip(down - (step - ups), 0, None) / left)[:, None]
        tail += fall[:, -1].sum()
        now = np.zeros_like(now)
        now[1:, :-1] += rise[:-1, 1:]
        now[1:, 0] += rise[:-1, 0]
        now[:, 1:] += fall[:, :-1]
    return float(min(1.0, tail))


def three_seq_exact(signals: DataFrame) -> DataFrame:
    """Detections with exact tail probabilities; each distinct (up, down, descent) is worked out once."""

    def run(batches):
        for b in batches:
            yield b.assign(exact_p=[walk_tail(u, d, k) for u, d, k in zip(b.up, b.down, b.descent, strict=True)])

    keys = spread(signals.select("up", "down", "descent").distinct(), "up", "down", "descent")
    exact = keys.mapInPandas(run, "up int, down int, descent int, exact_p double")
    return signals.join(exact, ["up", "down", "descent"]).select("event_id", "recombinant", "up", "down", "descent", F.round("exact_p", 9).alias("exact_p"))


def neighbour_joining(names: list[str], distance: np.ndarray) -> tuple[str, list[frozenset[str]]]:
    """Newick text and the splits of inner edges; negative lengths count as 0, the first of equal minima is joined."""
    d, label = distance.astype(float).copy(), list(names)
    inside = [frozenset([n]) for n in names]
    splits: list[frozenset[str]] = []
    while len(label) > 2:
        n, total = len(label), d.sum(axis=1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        q[np.tril_indices(n)] = np.inf
        i, j = np.unravel_index(int(np.argmin(np.round(q, 12))), q.shape)
        li = max(0.0, d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2)))
        lj = max(0.0, d[i, j] - li)
        row = np.maximum(0.0, (d[i] + d[j] - d[i, j]) / 2)
        keep = [k for k in range(n) if k not in (i, j)]
        merged = inside[i] | inside[j]
        if 1 < len(merged) < len(names) - 1:
            splits.append(min(merged, frozenset(names) - merged, key=lambda s: (len(s), sorted(s))))
        label = [label[k] for k in keep] + [f"({label[i]}:{li:.8f},{label[j]}:{lj:.8f})"]
        inside = [inside[k] for k in keep] + [merged]
        small = np.zeros((n - 1, n - 1))
        small[:-1, :-1] = d[np.ix_(keep, keep)]
        small[-1, :-1] = small[:-1, -1] = row[keep]
        d = small
    return f"({label[0]}:{d[0, 1] / 2:.8f},{label[1]}:{d[0, 1] / 2:.8f});", splits


def jukes_cantor_matrix(bases: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted distances between the rows of a base matrix; sites missing in either do not count."""
    fine = bases < 4
    both = (fine * weights) @ fine.T.astype(float)
    same = sum(((bases == b) * weights) @ (bases == b).T.astype(float) for b in range(4))
    p = np.where(both > 0, 1 - same / np.maximum(both, 1e-300), 1.0)
    out = np.where(p >= 0.749999, 3.0, -0.75 * np.log(np.maximum(1e-300, 1 - 4 * p / 3)))
    np.fill_diagonal(out, 0.0)
    return np.maximum(out, 0.0)


def _matrix(rows: pd.DataFrame) -> tuple[list[int], np.ndarray]:
    table = rows.pivot(index="seq_id", columns="site", values="base").fillna(4).astype(int).sort_index()
    return table.index.tolist(), table.to_numpy()


def window_trees(sites: DataFrame, width: int = 60, replicates: int = 0) -> DataFrame:
    """A neighbour-joining tree of each window of sites; with replicates, the bootstrap support of its splits."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        ids, bases = _matrix(rows)
        names = [f"nation_{i}" for i in ids]
        newick, splits = neighbour_joining(names, jukes_cantor_matrix(bases, np.ones(bases.shape[1])))
        if not replicates:
            return pd.DataFrame({"win": [key[0]], "newick": [newick], "members": [None], "support": [None]})
        rng = np.random.default_rng([SEED, int(key[0])])
        seen: dict[frozenset[str], int] = {}
        for _ in range(replicates):
            weights = np.bincount(rng.integers(0, bases.shape[1], bases.shape[1]), minlength=bases.shape[1])
            for s in set(neighbour_joining(names, jukes_cantor_matrix(bases, weights))[1]):
                seen[s] = seen.get(s, 0) + 1
        own = sorted(set(splits), key=lambda s: (len(s), sorted(s)))
        return pd.DataFrame({"win": key[0], "newick": newick, "members": [",".join(sorted(s)) for s in own], "support": [seen.get(s, 0) / replicates for s in own]})

    return sites.withColumn("win", F.floor(F.col("site") / width).cast("int")).groupBy("win").applyInPandas(lambda key, rows: run(key, rows), "win int, newick string, members string, support double")


def hidden_states(informative: DataFrame, switch: float = 0.01, rounds: int = 8) -> DataFrame:
    """Two-parent ancestry along each triplet: Viterbi paths of a three-state model trained on them, as runs of one state."""

    def viterbi(obs: np.ndarray, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
        score, back = np.log(emit[:, obs[0]]), np.zeros((len(obs), 3), int)
        for t in range(1, len(obs)):
            step = score[:, None] + move
            back[t] = step.argmax(axis=0)
            score = step.max(axis=0) + np.log(emit[:, obs[t]])
        path = np.zeros(len(obs), int)
        path[-1] = int(score.argmax())
        for t in range(len(obs) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        obs, site = rows.category.to_numpy(), rows.site.to_numpy()
        emit = np.full((3, 3), 0.2) + np.eye(3) * 0.4
        move = np.log(np.full((3, 3), switch / 2) + np.eye(3) * (1 - 1.5 * switch))
        path = viterbi(obs, emit, move)
        for _ in range(rounds):
            count = np.full((3, 3), 0.25)
            np.add.at(count, (path, obs), 1)
            emit = count / count.sum(axis=1, keepdims=True)
            new = viterbi(obs, emit, move)
            if (new == path).all():
                break
            path = new
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
        return pd.DataFrame({"a": rows.a.iat[0], "b": rows.b.iat[0], "c": rows.c.iat[0], "state": [int(path[s]) for s in cuts[:-1]], "start": [int(site[s]) for s in cuts[:-1]], "end": [int(site[e - 1]) + 1 for e in cuts[1:]], "sites": np.diff(cuts)})

    return spread(informative, "a", "b", "c").groupBy("a", "b", "c").applyInPandas(run, "a long, b long, c long, state int, start int, end int, sites int")


def window_starts(low: int, high: int, width: int, step: int) -> list[int]:
    """Starts of the windows over sites from low to below high: every step, and a last one that ends with the sites if the steps stop short."""
    last = max(low, high - width)
    starts = list(range(low, last + 1, step))
    return starts if starts[-1] == last else [*starts, last]


def bootscan_support(columns: DataFrame, width: int = 100, step: int = 20, replicates: int = 100) -> DataFrame:
    """Bootstrap votes for the closest pair of each triplet in sliding windows; a tie for the best votes for none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("site")
        site, category, out = rows.site.to_numpy(), rows.category.to_numpy(), []
        low, high = int(site.min()), int(site.max()) + 1
        hit = np.stack([(category == k) for k in range(3)]).astype(float)
        for start in window_starts(low, high, width, step):
            a, e = np.searchsorted(site, [start, start + width])
            if e - a < 5:
                continue
            weights = np.random.default_rng([SEED, start]).multinomial(e - a, np.full(e - a, 1 / (e - a)), replicates)
            agree = weights @ hit[:, a:e].T
            best = agree.max(axis=1, keepdims=True)
            alone = (agree == best) & ((agree == best).sum(axis=1, keepdims=True) == 1)
            out.append((int(rows.a.iat[0]), int(rows.b.iat[0]), int(rows.c.iat[0]), start, *(float(x) for x in alone.mean(axis=0))))
        return pd.DataFrame(out, columns=["a", "b", "c", "start", "support_0", "support_1", "support_2"])

    return spread(columns, "a", "b", "c").groupBy("a", "b", "c").applyInPandas(run, "a long, b long, c long, start int, support_0 double, support_1 double, support_2 double")


def window_z(columns: DataFrame, width: int = 100, step: int = 20, permutations: int = 1000) -> DataFrame:
    """How far each pair's agreement in a window is from that of permuted columns, in standard deviations."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("site")
        site, category, out = rows.site.to_numpy(), rows.category.to_numpy(), []
        low, high = int(site.min()), int(site.max()) + 1
        share = np.array([(category == k).mean() for k in range(3)])
        share = np.append(share, max(0.0, 1 - share.sum()))
        for start in window_starts(low, high, width, step):
            a, e = np.searchsorted(site, [start, start + width])
            null = np.random.default_rng([SEED, start]).multinomial(e - a, share / share.sum(), permutations)[:, :3]
            seen = np.array([(category[a:e] == k).sum() for k in range(3)])
            sd = null.std(axis=0)
            z = np.where(sd > 0, (seen - null.mean(axis=0)) / np.where(sd > 0, sd, 1), 0.0)
            out.append((int(rows.a.iat[0]), int(rows.b.iat[0]), int(rows.c.iat[0]), start, *map(float, z)))
        return pd.DataFrame(out, columns=["a", "b", "c", "start", "z_0", "z_1", "z_2"])

    return spread(columns, "a", "b", "c").groupBy("a", "b", "c").applyInPandas(run, "a long, b long, c long, start int, z_0 double, z_1 double, z_2 double")


def hotspot_p(events: DataFrame, length: int, bins: int = 8, replicates: int = 499) -> DataFrame:
    """The largest count of breakpoints in a bin against breakpoints placed at random, drawn in parallel."""
    points = events.select(F.explode(F.array("tract_start", F.col("tract_end") - 1)).alias("x"))
    width = math.ceil(length / bins)
    counts = points.groupBy(F.floor(F.col("x") / width).alias("bin")).count().agg(F.max("count").alias("observed"), F.sum("count").alias("n"))

    def draw(batches):
        for b in batches:
            most = [int(np.bincount(np.random.default_rng([SEED, int(i)]).integers(0, bins, int(n))).max()) for i, n in zip(b.id, b.n, strict=True)]
            yield b.assign(most=most)

    null = events.sparkSession.range(replicates).join(F.broadcast(counts)).select("id", "n", "observed").mapInPandas(draw, "id long, n long, observed long, most long")
    return null.groupBy("n", "observed").agg(F.round((F.sum(F.when(F.col("most") >= F.col("observed"), 1).otherwise(0)) + 1) / (replicates + 1), 9).alias("p"))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier")}


def alignment_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "sites", **_tables(spark, sf_dir))


def alignment_length(sites: DataFrame) -> int:
    last = sites.agg(F.max("site")).first()[0]
    return 1 if last is None else last + 1


QUERIES = {
    "three_seq_exact": lambda spark, sf_dir: three_seq_exact(frame(spark, "signals", **_tables(spark, sf_dir))),
    "nj_newick": lambda spark, sf_dir: window_trees(frame(spark, "sites", **_tables(spark, sf_dir))).select("win", "newick"),
    "bootstrap_trees": lambda spark, sf_dir: window_trees(frame(spark, "sites", **_tables(spark, sf_dir)), replicates=100),
    "geneconv_fragments": lambda spark, sf_dir: fragments.fragments(alignment_of(spark, sf_dir)),
    "hmm_states": lambda spark, sf_dir: hidden_states(frame(spark, "informative", **_tables(spark, sf_dir))),
    "bootscan_support": lambda spark, sf_dir: bootscan_support(frame(spark, "columns", **_tables(spark, sf_dir))),
    "siscan_z": lambda spark, sf_dir: window_z(frame(spark, "columns", **_tables(spark, sf_dir))),
    "hotspot_p": lambda spark, sf_dir: hotspot_p(frame(spark, "best_events", **_tables(spark, sf_dir)), alignment_length(alignment_of(spark, sf_dir))),
    "chi_events": lambda spark, sf_dir: scans.chi_events(alignment_of(spark, sf_dir)),
    "quartet_shift": lambda spark, sf_dir: scans.quartet_shift(alignment_of(spark, sf_dir), frame(spark, "accepted", **_tables(spark, sf_dir))),
}

