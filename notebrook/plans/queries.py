"""Queries of the reference's own operators and of the general training-data operator, with their SQL."""

from __future__ import annotations

from notebrook.plans import boundaries, codequeries, files, ingest, order, relational, tokens, vectors

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (ingest, order, relational, codequeries, vectors, boundaries, tokens, files):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
