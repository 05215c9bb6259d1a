"""Compositions of operators that a user calls."""
