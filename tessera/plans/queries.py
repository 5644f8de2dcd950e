"""All queries of the library but those of its optional subpackage."""

from __future__ import annotations

from tessera.plans import image_queries, map_queries, name_queries  # noqa: F401  (they register theirs)
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
