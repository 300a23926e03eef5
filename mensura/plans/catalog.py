"""The queries over the driver tables and their DuckDB twins, by name."""

from __future__ import annotations

from mensura.plans import core, geometry, measures, tabular

QUERIES = {}
ORACLES = {}
for part in (core, tabular, geometry, measures):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
