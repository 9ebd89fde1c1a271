"""Spreadsheet functions as Column expressions and aggregates."""
