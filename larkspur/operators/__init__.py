"""Lookups, aggregations, ordered-list and similarity operators."""
