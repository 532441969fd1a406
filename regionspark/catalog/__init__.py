"""All queries of the library and their SQL twins, by operator id."""

from __future__ import annotations

from regionspark.catalog import batch_routing, checks, evaluation, registry, text_geometry, units_streams

_MODULES = (text_geometry, checks, units_streams, batch_routing, registry, evaluation)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
