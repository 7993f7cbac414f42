"""All queries of the engine's own operators, by name, with their DuckDB twins."""

from __future__ import annotations

from lakeloom.plans import content, files, formats, graphs, layout, rules, scalars, series, streams, tabular, web  # noqa: F401  (they register themselves)
from lakeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
