"""Helpers for values by group that keep groups whose key is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(df: DataFrame, summary: DataFrame, by) -> DataFrame:
    """``df`` with the other columns of ``summary``, a row for each group; without groups, its one row."""
    by = list(by)
    if not by:
        return df.crossJoin(F.broadcast(summary))
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    right = summary.withColumnsRenamed(names)
    return df.join(right, reduce(lambda a, b: a & b, [df[c].eqNullSafe(right[n]) for c, n in names.items()]), "left").drop(*names.values())
