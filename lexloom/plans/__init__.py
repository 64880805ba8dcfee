"""Named plans: every query with, where SQL can express it, its oracle."""

from __future__ import annotations

from lexloom.plans import documents, records, runs, verification, workflows

_MODULES = (documents, records, verification, workflows, runs)
QUERIES = {name: f for m in _MODULES for name, f in m.REGISTRY.queries.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.REGISTRY.oracles.items()}
FLAGSHIP = "identity_resolve"
