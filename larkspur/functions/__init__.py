"""Scalar column functions: identifier handling, numeric helpers and scoring."""
