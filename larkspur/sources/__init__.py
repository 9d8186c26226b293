"""Readers and writers for catalogues, image indexes, text and delimited files."""
