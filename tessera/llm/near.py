"""Operator 6: near-duplicate documents by a chosen-path set-similarity join.

A document is the set of its ``width``-word shingles.  Documents with equal sets form one class, which
one representative stands for.  Representatives are branched in TREES independent trees: at each level
a node picks BRANCHES minwise coordinates, and a member goes to the child named by its minimum there, so
that two sets of similarity s share a child with probability 1 - (1 - s) ** BRANCHES.  Nodes of at
most SMALL members are compared exhaustively; larger ones are branched again, up to LEVELS deep.  At 85 %
similarity a pair misses every tree with probability under 2e-5.

A node still large at the last level is dealt into parts of NODE_PART members, every two of which are compared in a
task of their own.  Inside a node members are compared by sketches, and a node tells only a spanning forest of the pairs
that may be similar, never all pairs.  Connected members of these forests are a neighbourhood; a
true link lies inside one.  A neighbourhood is then verified on full shingle sets: shared-shingle
counts of all its pairs come from one product of its incidence matrix (large neighbourhoods in blocks
of PART members by PART members), and again a spanning forest of the links is told.  So a group of m near
copies costs about m rows at each step, and no link between different texts is lost to a cap.
A pair whose sketches agree in fewer than LEAST_AGREEING of SKETCH places is not compared further; at the
threshold of 80 % that happens to fewer than one pair in 10**5.

Components are found by alternating large and small stars, each a grouped minimum and a join.

Results of odd input: null, empty and blank texts have no shingles and are linked with nothing; texts of fewer
words than a shingle are one shingle, their whole sequence; rows that share a doc_id are one document of
the graph, each reported; rows without a doc_id are linked with nothing and have no component;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import cut_lineage
from tessera.llm.kernel import SPACED, U, Words, mix, ngrams, portions

TREES, LEVELS, BRANCHES = 4, 3, 2
PATHS = TREES * LEVELS * BRANCHES
SKETCH = 96
SMALL = 128
LEAST_AGREEING = 60
PART = 1024
NODE_PART = 1024
COLUMNS = 4096
COPIES = 1 << 16
MOST_BROADCAST_ROWS = 100_000
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**64, SKETCH, dtype=U)
_ODD = _rng.integers(0, 2**64, SKETCH, dtype=U) | U(1)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, SPACED, lower=True)
    hashes, at = ngrams(w.hash, w.doc, width)
    bounds = np.searchsorted(w.doc[at], np.arange(len(w.count) + 1))
    out = [np.unique(hashes[a:e]) for a, e in zip(bounds[:-1], bounds[1:], strict=True)]
    for short in range(1, width):
        for d in np.flatnonzero(w.count == short):
            h, _ = ngrams(w.hash[w.first[d] : w.first[d + 1]], np.zeros(short, np.int64), short)
            out[d] = mix(h + U(short))
    return out


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """SKETCH minima of each set, none of which is empty."""
    every = np.concatenate(sets)
    first = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), SKETCH), U)
    for k in range(SKETCH):
        v = (every ^ _XOR[k]) * _ODD[k]
        out[:, k] = np.minimum.reduceat(v ^ (v >> U(32)), first)
    return out


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), set_a and set_b (the set's identity), paths (minima for the trees) and sketch (a byte for each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e in portions(batch.column("text"), 1 << 19):
                part = batch.slice(a, e - a)
                sets = shingle_sets(part.column("text"), width)
                some = [i for i, s in enumerate(sets) if len(s)]
                both, paths, sketch = np.zeros((len(sets), 2), U), [None] * len(sets), [None] * len(sets)
                if some:
                    minima = _minima([sets[i] for i in some])
                    low = minima.astype(np.uint8)
                    for row, i in enumerate(some):
                        both[i] = sets[i].sum(dtype=U), (sets[i] * U(0x9E3779B97F4A7C15) ^ (sets[i] >> U(29))).sum(dtype=U)
                        paths[i], sketch[i] = minima[row, :PATHS].view(np.int64), low[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64)), pa.array(paths, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["doc_id", "n", "set_a", "set_b", "paths", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, set_a long, set_b long, paths array<long>, sketch binary")


def _nodes(reps: DataFrame) -> DataFrame:
    """The nodes to compare (node, doc, n, sketch): small ones, and those still large at the last level in pairs of parts."""

    def branch(level: int):
        first = F.lit(level * BRANCHES) + F.col("tree") * (LEVELS * BRANCHES)
        return F.explode(F.array(*(F.xxhash64("node", F.lit(b), F.col("paths")[first + b]) for b in range(BRANCHES))))

    rows = reps.select("doc", "n", "sketch", "paths", F.explode(F.array(*(F.lit(t) for t in range(TREES)))).alias("tree")).withColumn("node", F.col("tree").cast("long"))
    done = None
    for level in range(LEVELS):
        rows = rows.withColumn("node", branch(level))
        several = cut_lineage(rows.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
        rows = cut_lineage(rows.join(several, "node"))
        if level + 1 < LEVELS:
            ready = rows.where(F.col("members") <= SMALL)
        else:  # every two parts of a large node meet once, in a node of their own
            parts = F.ceil(F.col("members") / NODE_PART).cast("int")
            met = rows.withColumn("mine", F.pmod(F.xxhash64("doc"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            ready = met.withColumn("node", F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")))
        ready = ready.select("node", "doc", "n", "sketch")
        done = ready if done is None else done.unionByName(ready)
        rows = rows.where(F.col("members") > SMALL).drop("members")
    return done


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The nodes of a partition sorted by node, as arrays (doc, n, sketch)."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        node = table.column("node").to_numpy()
        last = int(np.flatnonzero(node != node[-1])[-1]) + 1 if node[0] != node[-1] else 0
        rest = table.slice(last)
        yield from _cut(table.slice(0, last))
    if rest is not None:
        yield from _cut(rest)


def _cut(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    if not table.num_rows:
        return
    node, doc, n = (table.column(c).to_numpy() for c in ("node", "doc", "n"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]])
    for a, e in zip(cuts[:-1], cuts[1:], strict=True):
        if e - a > 1:
            yield doc[a:e], n[a:e], sketch[a:e]


def _forest(size: int, alike) -> Iterator[tuple[int, int]]:
    """A spanning forest of a graph by breadth-first search; ``alike(i, left)`` picks i's neighbours among left.

    A vertex is compared only with those not reached yet."""
    left = np.arange(1, size)
    queue = [0]
    while queue or len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        i = queue.pop()
        if len(left):
            hit = alike(i, left)
            if hit.any():
                for j in left[hit]:
                    yield i, int(j)
                queue += left[hit].tolist()
                left = left[~hit]


def _neighbours(nodes: DataFrame, percent: int) -> DataFrame:
    """Edges a < b that span, in each node, the members whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for doc, n, sketch in _grouped(batches):

            def alike(i: int, left: np.ndarray, n=n, sketch=sketch, doc=doc) -> np.ndarray:
                ok = (100 * np.minimum(n[left], n[i]) >= percent * np.maximum(n[left], n[i])) & (doc[left] != doc[i])
                at = np.flatnonzero(ok)
                ok[at] = (sketch[left[at]] == sketch[i]).sum(axis=1) >= LEAST_AGREEING
                return ok

            found += [(doc[i], doc[j]) for i, j in _forest(len(doc), alike)]
            if len(found) > 10_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    dealt = nodes.repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x.min(axis=1)), pa.array(x.max(axis=1))], names=["a", "b"])


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share: the product of the incidence matrix with itself, in strips of columns."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    distinct, column, count = np.unique(every, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1  # a shingle of one set is shared with none
    some = count[column] > 1
    owner, column = owner[some], place[column[some]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, e = np.searchsorted(column, [start, start + COLUMNS])
        strip = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - start)), np.float32)
        strip[owner[a:e], column[a:e] - start] = 1
        out += strip @ strip.T
    return out


def _links(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges a < b that span the links inside each neighbourhood (doc, comp), confirmed on full shingle sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e in portions(batch.column("text"), 1 << 19):
                part = batch.slice(a, e - a)
                yield pa.RecordBatch.from_arrays([part.column("comp"), part.column("parts"), part.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), width)], pa.binary())], names=["comp", "parts", "doc", "set"])

    def verify(table: pa.Table) -> pa.Table:
        doc = table.column("doc").to_numpy()
        own = [np.frombuffer(s, U) for s in table.column("set").to_pylist()]
        shared, n = _shared_counts(own), np.array([len(s) for s in own])

        def alike(i: int, left: np.ndarray) -> np.ndarray:
            return (100 * shared[i, left].astype(np.int64) >= percent * (n[left] + n[i] - shared[i, left].astype(np.int64))) & (doc[left] != doc[i])

        return pa.Table.from_batches([_edges([(doc[i], doc[j]) for i, j in _forest(len(doc), alike)])])

    sizes = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    placed = cut_lineage(members.join(sizes, "comp").select(F.col("doc").alias("doc_id"), "comp", "parts"))
    full = docs.where("doc_id is not null").join(placed, "doc_id").select("comp", "parts", "doc_id", "text").mapInArrow(sets, "comp long, parts int, doc long, set binary")
    # every two parts of a large neighbourhood meet once, in the task named by both
    mine = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = full.withColumn("mine", mine).withColumn("other", other).withColumn("task", F.struct(F.least("mine", "other"), F.greatest("mine", "other")))
    return met.select("comp", "task", "doc", "set").groupBy("comp", "task").applyInArrow(lambda t: verify(t), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """doc and comp (the smallest doc reachable) of every doc on an edge."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        around = around.union(around.select("v", "u")) if large else around.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = around.join(least, "u")
        moved = moved.where("v > u").select("v", "m") if large else moved.select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
        return moved.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()

    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    edges = cut_lineage(edges)
    before = mark(edges)
    while before[0]:
        edges = cut_lineage(star(star(edges, True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.groupBy("b").agg(F.min("a").alias("comp")).withColumnRenamed("b", "doc").union(edges.select("a", "a").distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id linked to it) and kept."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = cut_lineage(fingerprints(docs, width))
    usable = prints.where("n > 0 and doc_id is not null")
    classes = cut_lineage(usable.groupBy("set_a", "set_b").agg(F.min_by(F.struct("n", "paths", "sketch"), "doc_id").alias("p"), F.min("doc_id").alias("doc"), F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("salts")))
    near = components(_neighbours(_nodes(classes.select("doc", "p.*")), percent))
    comps = cut_lineage(components(_links(near, docs, width, percent)))
    by_class = classes.select("set_a", "set_b", "doc", "salts").join(comps, "doc", "left").select("set_a", "set_b", "salts", F.coalesce("comp", "doc").alias("class_comp"))
    linked, alone = usable.select("doc_id", "n", "set_a", "set_b"), prints.where("n = 0 or doc_id is null").select("doc_id", "n", F.lit(None).cast("long").alias("class_comp"))
    # the copies of one text are dealt over as many keys as COPIES of them make, so that no task has them all
    large = classes.where("salts > 1").select("set_a", "set_b", "salts")
    n_large = large.count()
    if n_large:
        small = F.broadcast if n_large <= MOST_BROADCAST_ROWS else (lambda table: table)
        linked = linked.join(small(large), ["set_a", "set_b"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        by_class = by_class.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    joined = linked.join(by_class.drop("salts"), ["set_a", "set_b", *(["salt"] if n_large else [])])
    out = joined.select("doc_id", "n", "class_comp").unionByName(alone)
    component = F.coalesce("class_comp", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=3, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh FROM w),
x AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k) UNION ALL SELECT b, a FROM p WHERE 100 * k >= 85 * (na + nb - k)),
c AS (SELECT DISTINCT a AS doc_id, a AS m FROM e UNION SELECT e.b, c.m FROM c JOIN e ON e.a = c.doc_id WHERE c.m < e.b),
m AS (SELECT doc_id, min(m) AS m FROM c GROUP BY doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(least(m.m, s.doc_id), s.doc_id) AS component_id, coalesce(least(m.m, s.doc_id), s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN m USING (doc_id)
"""
