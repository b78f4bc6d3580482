"""All queries of the engine and their SQL."""

from __future__ import annotations

from chronoloom.plans import behavior, blocks, correlation, registry, store, streams

MODULES = (behavior, blocks, correlation, store, streams)
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
