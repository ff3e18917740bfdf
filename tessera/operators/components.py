"""Sequences taken apart by accepted events: which parts of which sequence go on as rows of their own.

A component is addressed by its origin (the sequence it comes from), its kind (``remainder`` or ``tract``) and its lineage, the events
that made it, in order.  It shows some segments of the origin and gaps elsewhere, so a component is a list of segments, and the rows of all
components are one projection of the sequences, whatever the number of events.

Events are applied in their order.  An event names the component its tract is taken from for the recombinant and
for each further member (sequences that share the event); the component keeps what lies outside the tract and a new one gets what lies
inside.  If any component an event names is not there, the whole event is held: nothing of it is applied."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMAINDER, TRACT = "remainder", "tract"
Segments = list[tuple[int, int]]
ADDRESS = "origin long, kind string, lineage array<string>"
PARTS = f"row_id long, {ADDRESS}, segments array<struct<first:int,last:int>>"


@dataclass(frozen=True)
class Address:
    origin: int
    kind: str = REMAINDER
    lineage: tuple[str, ...] = ()


@dataclass(frozen=True)
class Event:
    """A tract [start, end), around the origin of a circle if start is not before end, of the components it is found in."""

    event_id: str
    members: tuple[Address, ...]
    start: int
    end: int

    def tract(self, length: int) -> Segments:
        return [(self.start, self.end)] if self.start < self.end else [s for s in ((0, self.end), (self.start, length)) if s[0] < s[1]]


def inside(segments: Segments, tract: Segments) -> Segments:
    return sorted((max(a, c), min(b, d)) for a, b in segments for c, d in tract if max(a, c) < min(b, d))


def outside(segments: Segments, tract: Segments) -> Segments:
    left = segments
    for first, last in tract:
        left = [s for a, b in left for s in ((a, min(b, first)), (max(a, last), b)) if s[0] < s[1]]
    return sorted(left)


@dataclass
class Components:
    """The components of the sequences that events have touched, as numbered rows, and the events held.  A sequence without events is its own remainder, with its own number."""

    length: int
    next_row: int
    parts: dict[Address, tuple[int, Segments]] = field(default_factory=dict)
    touched: set[int] = field(default_factory=set)
    held: list[str] = field(default_factory=list)

    def find(self, address: Address) -> tuple[int, Segments] | None:
        if address.origin not in self.touched:
            return (address.origin, [(0, self.length)]) if address == Address(address.origin) else None
        return self.parts.get(address)

    def apply(self, event: Event) -> bool:
        """Takes the tract out of every member, or holds the event."""
        found = {m: self.find(m) for m in event.members}
        if not found or any(x is None for x in found.values()):
            self.held.append(event.event_id)
            return False
        tract = event.tract(self.length)
        for member, (row, segments) in found.items():
            self.parts.pop(member, None)
            self.touched.add(member.origin)
            lineage = (*member.lineage, event.event_id)
            self.parts[Address(member.origin, member.kind, lineage)] = row, outside(segments, tract)
            self.parts[Address(member.origin, TRACT, (*lineage, "inside"))] = self.next_row, inside(segments, tract)
            self.next_row += 1
        return True

    def table(self) -> list[tuple]:
        return [(row, a.origin, a.kind, list(a.lineage), segments) for a, (row, segments) in self.parts.items()]


def fold(events: Iterable[Event], length: int, next_row: int) -> Components:
    """All events in their order."""
    out = Components(length, next_row)
    for e in events:
        out.apply(e)
    return out


def rows_of(sequences: DataFrame, components: Components) -> DataFrame:
    """row_id, origin, kind, lineage and bases of every component: one projection of the sequences (seq_id, bases); the table of components, a few rows an event, is sent to them."""
    spark, length = sequences.sparkSession, components.length
    parts = spark.createDataFrame(components.table(), PARTS)
    whole = F.array(F.struct(F.lit(0).alias("first"), F.lit(length).alias("last")))
    rows = sequences.select("seq_id", "bases").join(F.broadcast(parts), F.col("seq_id") == F.col("origin"), "left")
    rows = rows.select(F.coalesce("row_id", "seq_id").alias("row_id"), F.col("seq_id").alias("origin"), F.coalesce("kind", F.lit(REMAINDER)).alias("kind"), F.coalesce("lineage", F.array().cast("array<string>")).alias("lineage"), F.coalesce("segments", whole).alias("segments"), "bases")

    def masked(batches):
        for batch in batches:
            out = []
            for bases, segments in zip(batch.column("bases").to_pylist(), batch.column("segments").to_pylist(), strict=True):
                shown = np.full(length, 4, np.uint8)
                for s in segments:
                    shown[s["first"] : s["last"]] = np.frombuffer(bases, np.uint8)[s["first"] : s["last"]]
                out.append(shown.tobytes())
            kept = [c for c in batch.schema.names if c not in ("bases", "segments")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], names=[*kept, "bases"])

    return rows.mapInArrow(masked, f"row_id long, {ADDRESS}, bases binary")


def provenance(candidates: DataFrame, rows: DataFrame, roles: tuple[str, ...] = ("recombinant", "major", "minor")) -> DataFrame:
    """Candidates (row ids by role) with the address of the component behind each role: <role>_origin, <role>_kind, <role>_lineage (joined by slashes)."""
    for role in roles:
        own = rows.select(F.col("row_id").alias(role), F.col("origin").alias(f"{role}_origin"), F.col("kind").alias(f"{role}_kind"), F.array_join("lineage", "/").alias(f"{role}_lineage"))
        candidates = candidates.join(own, role)
    return candidates
