"""All queries over the library's own operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from chronofold.queries import asof, decisions, domain, evaluation, families, market, statistics

_MODULES = [asof, families, statistics, domain, market, decisions, evaluation]
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
