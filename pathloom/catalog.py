"""All registered queries of the path engine and their SQL forms."""

from __future__ import annotations

from .queries import abstraction, analytics, directed, formulas, graphs, grid, hierarchies, layouts, paths, sources, streams, visibility

_MODULES = (grid, analytics, formulas, paths, hierarchies, abstraction, directed, graphs, sources, layouts, streams, visibility)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
