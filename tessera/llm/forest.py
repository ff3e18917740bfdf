"""Operator 5: approximate nearest neighbours by a forest of hash prefixes.

Every row is indexed in each of TREES trees.  A tree's string for a vector is the sides of 64 random hyperplanes;
a tree is the array of its strings in order, cut into nodes by their first bits and spread over the cluster, hashes and
ids only.  A query is sent to the node of its own prefix in every tree; there it descends to its longest matching prefix by
binary search, and tells how many rows match it to each depth.  All trees then ascend together: a query's
depth is the greatest at which they hold ``least`` rows in all, the last step being taken by as many trees only as it
needs.  A query that has too few at the depth of a node goes
on in rounds to shorter prefixes, that is to neighbouring nodes.  The rows under its prefixes are its candidates; each
is scored exactly, in the block of vectors it lies in, and the best of all blocks are merged.

``least`` is LEAST * rows ** GROWTH, FEW at least, unless given: what random vectors of 64 dimensions need for a recall of 0.9, a share of
the rows that falls as they grow.  Clustered vectors need far less, and so may be asked with a constant.

Rows with equal vectors have equal scores and ties go to the smaller id, so of any number of copies only
the k + 1 smallest ids can be found; the others are left out of the index (exactly, not by a cap),
though each may still be a query.  Nodes of more than NODE_ROWS rows (near copies) are kept in parts.  Rows that
share all 64 bits with a query in a tree are its candidates, however many they are.

Results of odd input: vectors that are null or empty, hold null or non-finite components, have no length
(norm zero) or another dimension than most, and rows without an id take no part; rows of one id are one row, that with the
smallest vector; with fewer candidates than k all of them are found; further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.kernel import U, mix

TREES = 64
BITS = 64
LEAST, GROWTH, FEW = 5.2, 0.755, 400
NODE_ROWS = 1 << 16
BLOCK_ROWS = 1 << 14
#: Candidates of a group of queries that one task scores against a block.
GROUP_CANDIDATES = 1 << 22
SEED = 20240229
STEP = 2
PACKED = "tree int, node long, n long, hashes binary, ids binary"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def planes_of(trees: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees, width, BITS))


def hash_strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Trees by vectors: the sides of the hyperplanes, the first in the top bit."""
    return np.stack([np.packbits(vectors @ p > 0, axis=1).view(">u8").ravel().astype(U) for p in planes])


def matching(keys: np.ndarray, node: int, depth: int, asked: np.ndarray, to: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of a node's sorted strings that share their first ``to`` bits with each asked string; the node holds one prefix of ``depth`` bits."""
    if to <= depth:
        own = np.full(len(asked), node >> (depth - to) if to else 0, U)
        same = (asked >> U(BITS - to) if to else np.zeros(len(asked), U)) == own
        return np.zeros(len(asked), np.int64), np.where(same, len(keys), 0)
    prefix, want = keys >> U(BITS - to), asked >> U(BITS - to)
    return np.searchsorted(prefix, want, "left"), np.searchsorted(prefix, want, "right")


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Strings in order, and their ids."""
    keys = np.concatenate([np.zeros(0, U), *(np.frombuffer(x.as_py(), U) for x in table.column("hashes"))])
    ids = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_py(), np.int64) for x in table.column("ids"))])
    order = np.argsort(keys, kind="stable")
    return keys[order], ids[order]


def valid_vectors(rows: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """vec_id and vector of the rows that take part, one a vec_id, and their dimension."""
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    v = v.where("vec_id is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    widths = v.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = widths[0]["width"] if widths else 0
    return v.where(F.size("vector") == width).groupBy("vec_id").agg(F.min("vector").alias("vector")), width


def _strings(vectors: DataFrame, width: int, trees: int, seed: int, depth: int) -> DataFrame:
    """The strings of vectors with their ids, packed by tree and node as far as an Arrow batch goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = planes_of(trees, width, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("vec_id").to_numpy()
            for tree, keys in enumerate(hash_strings(_matrix(batch.column("vector"), width), planes)):
                order = np.argsort(keys, kind="stable")
                node = (keys[order] >> U(BITS - depth)).astype(np.int64) if depth else np.zeros(len(keys), np.int64)
                first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                cuts = list(zip(first, [*first[1:], len(node)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(cuts), pa.int32()), pa.array(node[first]), pa.array([e - a for a, e in cuts], pa.int64()), pa.array([keys[order[a:e]].tobytes() for a, e in cuts], pa.binary()), pa.array([ids[order[a:e]].tobytes() for a, e in cuts], pa.binary())],
                    names=["tree", "node", "n", "hashes", "ids"],
                )

    return vectors.mapInArrow(run, PACKED)


def _depths(index: DataFrame, asked: DataFrame, depth: int, to: int, least: int, last: bool, groups: int) -> DataFrame:
    """Of each asked string: query_id, the share of trees that ascend to it, and the greatest depth from ``to`` bits on at which all trees hold ``least`` rows; null if none does, or 0 in the last round."""

    def count(own: pa.Table, queries: pa.Table) -> pa.Table:
        q, ids = _unpacked(queries)
        held = np.zeros((len(q), BITS + 1), np.int64)
        if own.num_rows and len(q):
            keys, node = _unpacked(own)[0], own.column("node")[0].as_py()
            for d in range(to, BITS + 1):
                low, high = matching(keys, node, depth, q, d)
                held[:, d] = high - low
                if not held[:, d].any():
                    break
        group = (mix(ids.view(U)) % U(groups)).astype(np.int64)
        parts = [g for g in np.unique(group)]
        return pa.table({"group": pa.array(parts, pa.int64()), "ids": pa.array([ids[group == g].tobytes() for g in parts], pa.binary()), "held": pa.array([held[group == g].tobytes() for g in parts], pa.binary())})

    def decide(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("ids")])
        held = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, BITS + 1) for x in table.column("held")])
        distinct, place = np.unique(ids, return_inverse=True)
        total = np.zeros((len(distinct), BITS + 1), np.int64)
        np.add.at(total, place, held)
        enough = total >= least
        enough[:, :to] = False
        best = BITS - np.argmax(enough[:, ::-1], axis=1)
        # the share of the trees that take the step from best + 1 to best bits
        here, deeper = (np.take_along_axis(total, np.minimum(best + more, BITS)[:, None], axis=1)[:, 0] for more in (0, 1))
        share = np.where(best < BITS, (least - deeper) / np.maximum(1, here - deeper), 1.0)
        return pa.table({"query_id": distinct, "depth": pa.array(np.where(enough.any(axis=1), best, 0), pa.int32(), mask=~enough.any(axis=1) & (not last)), "share": np.where(enough.any(axis=1), share, 1.0)})

    counted = index.groupBy("tree", "node", "part").cogroup(asked.groupBy("tree", "node", "part")).applyInArrow(count, "group long, ids binary, held binary")
    return counted.groupBy("group").applyInArrow(decide, "query_id long, depth int, share double")


def _visits(strings: DataFrame, depth: int, to: int, parts: DataFrame) -> DataFrame:
    """Asked strings sent to every node under their first ``to`` bits, and to all parts of a node."""
    nodes = strings
    if to < depth:
        low = F.shiftleft(F.shiftright("node", depth - to), depth - to)
        nodes = strings.withColumn("node", F.explode(F.sequence(low, low + F.lit((1 << (depth - to)) - 1))))
    nodes = nodes.join(parts, ["tree", "node"], "left")
    return nodes.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def nearest(rows: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, trees: int = TREES, least: int | None = None, node_rows: int = NODE_ROWS, block_rows: int = BLOCK_ROWS, seed: int = SEED, scored: bool = False) -> DataFrame:
    """query_id, rank, vec_id and cosine of the k nearest rows found for each query row, and with ``scored`` how many were scored; queries are rows of the same table."""
    index, width = valid_vectors(rows, vec_id, embedding)
    asked, _ = valid_vectors(queries, vec_id, embedding)
    asked = blocks.cut_lineage(asked.where(F.size("vector") == width))
    copies = Window.partitionBy("vector").orderBy("vec_id")
    index = blocks.cut_lineage(index.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"))
    n_rows, n_queries = index.count(), asked.count()
    if least is None:
        least = max(FEW, math.ceil(LEAST * n_rows**GROWTH))
    # the query's own row is under its prefix in every tree; a table of no more rows than asked for is scored whole
    least = (least if least < n_rows else n_rows * trees) + trees if n_rows > 1 else trees
    least = min(least, n_rows * trees)
    # at the depth of a node all trees hold about four times as many rows
    depth = max(0, min(40, int(math.log2(max(1.0, n_rows * trees / (4 * max(1, least)))))))
    strings = blocks.cut_lineage(_strings(index, width, trees, seed, depth))
    parts = blocks.cut_lineage(strings.groupBy("tree", "node").agg(F.ceil(F.sum("n") / node_rows).cast("int").alias("parts")).where("parts > 1"))
    placed = strings.join(parts, ["tree", "node"], "left").withColumn("part", F.pmod(F.xxhash64("ids"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    sent = blocks.cut_lineage(_strings(asked, width, trees, seed, depth))
    groups = max(1, math.ceil(n_queries / 4096))

    to, todo, found = depth, sent, None
    while True:
        told = blocks.cut_lineage(_depths(placed, _visits(todo, depth, to, parts), depth, to, least, to == 0, groups))
        done = told.where("depth is not null")
        found = done if found is None else found.unionByName(done)
        left = told.where("depth is null").select(F.col("query_id").alias("vec_id"))
        if to == 0 or not left.take(1):
            break
        to = max(0, to - STEP)
        todo = _strings(asked.join(left, "vec_id", "left_semi"), width, trees, seed, depth)

    n_blocks = max(1, math.ceil(n_rows / block_rows))
    n_parts = max(1, math.ceil(n_queries * least / n_blocks / GROUP_CANDIDATES))

    def block_of(ids: np.ndarray) -> np.ndarray:
        return (mix(ids.view(U)) % U(n_blocks)).astype(np.int64)

    def collect(own: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if own.num_rows and queries.num_rows:
            (keys, ids), node = _unpacked(own), own.column("node")[0].as_py()
            q_ids, q, depths = (queries.column(c).to_numpy() for c in ("query_id", "hash", "depth"))
            block = block_of(ids)
            for d in np.unique(depths):
                at = np.flatnonzero(depths == d)
                for i, low, high in zip(at, *matching(keys, node, depth, q[at].view(U), int(d)), strict=True):
                    for b in np.unique(block[low:high]):
                        out.append((int(q_ids[i]), int(b), ids[low:high][block[low:high] == b].tobytes()))
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([x[1] for x in out], pa.int64()), "ids": pa.array([x[2] for x in out], pa.binary())})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, node, hashes, ids in zip(*(b.column(c).to_pylist() for c in ("tree", "node", "hashes", "ids")), strict=True):
                n = len(ids) // 8
                yield pa.RecordBatch.from_arrays([pa.array([tree] * n, pa.int32()), pa.array([node] * n, pa.int64()), pa.array(np.frombuffer(hashes, np.int64)), pa.array(np.frombuffer(ids, np.int64))], names=["tree", "node", "hash", "query_id"])

    one_each = sent.mapInArrow(split, "tree int, node long, hash long, query_id long").join(found, "query_id").withColumn("depth", F.when(F.col("tree") < F.ceil(F.col("share") * trees), F.col("depth")).otherwise(F.col("depth") + 1).cast("int")).drop("share")
    if depth and found.where(F.col("depth") < depth).take(1):  # prefixes shorter than a node's are in several nodes
        own = F.greatest(F.lit(0), depth - F.col("depth"))
        low = F.expr(f"(node div cast(pow(2, greatest(0, {depth} - depth)) as bigint)) * cast(pow(2, greatest(0, {depth} - depth)) as bigint)")
        one_each = one_each.withColumn("node", F.explode(F.sequence(low, low + F.pow(F.lit(2), own).cast("long") - 1)))
    one_each = _visits(one_each, depth, depth, parts)
    candidates = placed.groupBy("tree", "node", "part").cogroup(one_each.groupBy("tree", "node", "part")).applyInArrow(collect, "query_id long, block long, ids binary")
    grouped = candidates.groupBy("query_id", "block").agg(F.collect_list("ids").alias("ids"))
    asked_rows = grouped.join(asked.withColumnRenamed("vec_id", "query_id"), "query_id").withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(n_parts).cast("long")))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("block", pa.array(block_of(b.column("vec_id").to_numpy())))

    vectors = index.mapInArrow(dealt, "vec_id long, vector array<double>, block long").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))))

    def score(own: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if own.num_rows and wanted.num_rows:
            ids, m = own.column("vec_id").to_numpy(), _matrix(own.column("vector"), width)
            order = np.argsort(ids)
            ids, m = ids[order], m[order]
            norms = np.sqrt((m * m).sum(axis=1))
            for q, q_vector, lists in zip(wanted.column("query_id").to_pylist(), _matrix(wanted.column("vector"), width), wanted.column("ids").to_pylist(), strict=True):
                near = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in lists]))
                near = np.searchsorted(ids, near[near != q])
                # each row's sum is taken alike, so that equal vectors get equal scores
                s = (m[near] * q_vector).sum(axis=1) / (norms[near] * math.sqrt((q_vector * q_vector).sum()))
                best = np.lexsort((ids[near], -s))[:k]
                out.append((np.full(len(best), q), ids[near][best], s[best], np.full(len(best), len(near))))
        cat = lambda j, kind: np.concatenate([x[j] for x in out]).astype(kind) if out else np.zeros(0, kind)
        return pa.table({"query_id": cat(0, np.int64), "vec_id": cat(1, np.int64), "score": cat(2, np.float64), "block_scored": cat(3, np.int64), "block": np.full(sum(len(x[0]) for x in out), own.column("block")[0].as_py() if own.num_rows else 0)})

    best = vectors.groupBy("block", "group").cogroup(asked_rows.groupBy("block", "group")).applyInArrow(score, "query_id long, vec_id long, score double, block_scored long, block long")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(by_query).cast("int"))
    if scored:
        sums = best.select("query_id", "block", "block_scored").distinct().groupBy("query_id").agg(F.sum("block_scored").alias("scored"))
        return ranked.where(F.col("rank") <= k).join(sums, "query_id").select("query_id", "rank", "vec_id", "score", "scored")
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
