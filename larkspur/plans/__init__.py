"""Registered queries and their SQL counterparts."""

from . import catalogue_queries, matching_queries, ordered_queries, source_queries

_PARTS = (catalogue_queries, matching_queries, ordered_queries, source_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
#: The flagship: noisy readings resolved through lattice and catalogue.
ENTRY = QUERIES["lattice_match_core"]
