"""Queries of the engine's own operators, and the SQL each must agree with."""

from __future__ import annotations

from . import artifacts, audits, city, contracts, details, evidence, frontage, grids, joins, polygons, pyramid, raster, scalars, sky, surfaces, views, windows

MODULES = (evidence, city, polygons, surfaces, artifacts, details, sky, audits, views, joins, grids, pyramid, raster, windows, scalars, frontage, contracts)
FLAGSHIP = "height_evidence"
QUERIES = {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
