"""Operators over DataFrames: criteria, lookups, dynamic arrays, formatting rules."""
