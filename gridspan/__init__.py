"""Spreadsheet-style analytics as typed, distributed operations over Spark DataFrames."""
