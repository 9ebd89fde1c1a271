"""Registered queries by family, with their SQL twins."""
