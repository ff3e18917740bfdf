"""The fix-point of detection: take the best event, take its tract out as a component of its own, scan again what that has changed."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import components, detectors, scans
from tessera.session import shared_dir

#: The reference's cap on events; a scan that reaches it warns.
MOST = 250
POOL = "event_id string, recombinant long, major long, minor long, recombinant_origin long, major_origin long, minor_origin long, tract_start int, tract_end int, descent int, p double"
EVENTS = "pass int, event_id string, recombinant long, major long, minor long, recombinant_origin long, major_origin long, minor_origin long, recombinant_kind string, recombinant_lineage string, tract_start int, tract_end int, p double, corrected_p double, scanned long"


def disassemble(sites: DataFrame, row: int, start: int, end: int, component: int) -> DataFrame:
    """The alignment with a tract taken out of a row: the row has gaps there, and a row of its own, named ``component``, has the tract and gaps elsewhere."""
    inside = (F.col("site") >= start) & (F.col("site") < end)
    left = sites.withColumn("base", F.when((F.col("seq_id") == row) & inside, F.lit(4)).otherwise(F.col("base")).cast("int"))
    tract = sites.where((F.col("seq_id") == row) & inside).select(F.lit(component).cast("long").alias("seq_id"), "site", "base")
    return left.select("seq_id", "site", "base").unionByName(tract.withColumn("base", F.col("base").cast("int")))


def candidates(rows: DataFrame, n: int, length: int, affected: int, least_p: float) -> DataFrame:
    """Descents with p of at most ``least_p`` in the triplets that have one of the last ``affected`` rows."""
    found = scans.touching(rows, n, length, affected, scans.walks, scans.WALKS).where("descent >= 4").withColumn("p", F.round(F.expr(detectors.descent_p()), 9)).where(F.col("p") <= least_p)
    role = {"recombinant": "cab", "major": "abc", "minor": "bca"}
    named = {k: F.when(F.col("target") == 0, F.col(x[0])).when(F.col("target") == 1, F.col(x[1])).otherwise(F.col(x[2])) for k, x in role.items()}
    found = found.select(F.concat_ws("-", "a", "b", "c", "target").alias("event_id"), *(v.alias(k) for k, v in named.items()), "tract_start", "tract_end", "descent", "p")
    return components.provenance(found, rows).select(*(c.split()[0] for c in POOL.split(", ")))


def cyclic_events(spark: SparkSession, sites: DataFrame, most: int = MOST, alpha: float = 0.05, extract: bool = True, incremental: bool = True, correct: bool = False) -> DataFrame:
    """Events in the order of their acceptance, until none is at or under ``alpha``; each pass looks at the alignment as the tracts accepted so far have left it.

    A tract taken out of a sequence goes on as a component (a row of its own, numbered from the largest seq_id on) that can be a parent or recombinant
    in later passes, unless ``extract`` is off; three rows of which two come from one sequence are no detection.  Events name the
    rows they were found in, the sequences these come from, and the component of the recombinant.  With ``correct``, p is multiplied by the number of triplets of
    the alignment before it is compared with alpha.

    Candidates stay in a pool between passes.  An accepted event changes the rows of one sequence, so candidates that touch it are dropped from the
    pool and only triplets with one of its rows are scanned again; ``scanned`` counts the triplets of the pass.  Without ``incremental``
    every pass scans everything; the events are the same.

    One row a pass reaches the driver, the best candidate.  The sequences, and the pool after each pass, are written to the folder that the
    session names for checkpoints; without one a local session takes a folder of its own."""
    shared_dir(spark)
    whole, n, length = scans.sequences(sites)
    whole = whole.checkpoint()
    last = whole.agg(F.max("seq_id")).first()[0]
    if last is None:
        return spark.createDataFrame([], EVENTS)
    times = math.comb(n, 3) if correct else 1
    state = components.Components(length, last + 1)
    pool = spark.createDataFrame([], POOL)
    taken: list[tuple] = []
    changed: int | None = None

    while True:
        rows = components.rows_of(whole, state)
        if not extract:
            rows = rows.where(F.col("kind") == components.REMAINDER)
        is_new = F.lit(True) if changed is None or not incremental else F.col("origin") == changed
        many, affected = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_new.cast("int")), F.lit(0))).first()
        # only ids are numbered in one place, the changed ones last
        numbers = rows.select("row_id", is_new.alias("new")).select("row_id", (F.row_number().over(Window.orderBy("new", "row_id")) - 1).alias("number"))
        numbered = rows.join(numbers, "row_id")
        found = candidates(numbered, many, length, affected, alpha / times)
        if changed is not None and incremental:
            # the wildcard anti join: what has a role in the changed sequence is no longer known
            touched = spark.createDataFrame([(changed,)], "changed long")
            for role in ("recombinant", "major", "minor"):
                pool = pool.join(F.broadcast(touched), F.col(f"{role}_origin") == F.col("changed"), "left_anti")
            found = pool.unionByName(found)
        pool = found.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))).checkpoint()
        best = pool.orderBy("p", F.desc("descent"), "event_id").limit(1).collect()
        if not best:
            break
        if len(taken) == most:
            warnings.warn(f"cyclic_events stopped at its cap of {most} events with significant events left", RuntimeWarning, stacklevel=2)
            break
        e = best[0]
        where = next((a for a, (row, _) in state.parts.items() if row == e.recombinant), components.Address(e.recombinant_origin))
        scanned = math.comb(many, 3) - math.comb(many - affected, 3)
        taken.append((len(taken) + 1, e.event_id, e.recombinant, e.major, e.minor, e.recombinant_origin, e.major_origin, e.minor_origin, where.kind, "/".join(where.lineage), e.tract_start, e.tract_end, e.p, min(1.0, e.p * times), scanned))
        state.apply(components.Event(f"e{len(taken)}", (where,), e.tract_start, e.tract_end))
        changed = e.recombinant_origin
    return spark.createDataFrame(taken, EVENTS)
