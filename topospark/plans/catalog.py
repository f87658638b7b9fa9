"""The registered queries of the core and their SQL oracles."""

from __future__ import annotations

from topospark.plans import clouds, complexes, descriptors, drift, sequences, streams

_PARTS = (clouds, complexes, sequences, descriptors, drift, streams)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
