"""Every query of the engine proper and its SQL twin, gathered from the query modules."""

from __future__ import annotations

from importlib import import_module

from stowage.queries.registry import COVERS, QUERIES, SQL

for _module in ("scans", "filters", "scalars", "reconciliation", "planning", "jobs", "chunks", "links", "trees", "streams", "stores", "extras"):
    import_module(f"stowage.queries.{_module}")

__all__ = ["COVERS", "QUERIES", "SQL"]
