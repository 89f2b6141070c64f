"""Every registered query of the engine with its SQL counterpart."""

from __future__ import annotations

from priorline.plans import coverage, feeds, flows, forms, joins, models, tables

MODULES = (forms, joins, tables, models, flows, coverage, feeds)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
