"""All registered queries of the recombination engine with their SQL equivalents."""

from __future__ import annotations

from tessera.operators import alignment, detectors, identity, intervals, kernels, planning, review, roles, switches
from tessera.plans.cyclic import cyclic_events
from tessera.plans.operator import OPERATORS
from tessera.sources import formats, roundtrips

__all__ = ["OPERATORS", "ORACLE_SQL", "QUERIES", "alignment", "detectors", "formats", "identity", "intervals", "kernels", "planning", "review", "roles", "switches"]
QUERIES = {name: op.query() for name, op in OPERATORS.items()}
QUERIES |= kernels.QUERIES | roundtrips.QUERIES | identity.QUERIES | switches.QUERIES
QUERIES["identity_events"] = lambda spark, sf_dir: identity.identity_events(kernels.alignment_of(spark, sf_dir))
QUERIES["cyclic_events"] = lambda spark, sf_dir: cyclic_events(spark, kernels.alignment_of(spark, sf_dir), alpha=0.001)
ORACLE_SQL = {name: op.duckdb() for name, op in OPERATORS.items()}
ORACLE_SQL |= {name: roundtrips.READ_BACK.duckdb() for name in roundtrips.QUERIES}
ORACLE_SQL |= identity.ORACLE_SQL
