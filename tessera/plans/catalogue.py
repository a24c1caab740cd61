"""All queries of the library, by name; importing the modules registers them."""

from __future__ import annotations

from tessera.plans import analysis, numerics, streams, tables  # noqa: F401
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
