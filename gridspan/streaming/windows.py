"""Streaming variants: conditional aggregates by event-time window, sessions, deduplication, lookups, running folds.

Each function takes and returns a DataFrame and works alike on a stream
(``readStream``) and on a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.criteria import AVERAGEIFS, COUNTIFS, MAXIFS, MINIFS, SUMIFS


def windowed(events: DataFrame, time: str, size: str, value: str, *where, slide: str | None = None, late: str = "1 hour", by=()) -> DataFrame:
    """The conditional aggregates of each window; rows later than ``late`` are left out on a stream."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(
        COUNTIFS(*where).alias("n"), SUMIFS(value, *where).alias("total"), AVERAGEIFS(value, *where).alias("mean"), MINIFS(value, *where).alias("least"), MAXIFS(value, *where).alias("most")
    )
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total", "mean", "least", "most")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], value: str, late: str = "1 hour") -> DataFrame:
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """UNIQUE on a stream: rows whose keys weren't seen within the delay."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def lookup(events: DataFrame, value: str, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """XLOOKUP of a stream in a table."""
    from ..operators.lookup import one_per_key

    found = one_per_key(table, key, columns)
    kind = dict(events.dtypes)[value]
    return events.join(found, (F.upper(F.col(value)) if kind == "string" else F.col(value)) == F.col("_key"), "left").drop("_key")


def running_total(events: DataFrame, by: str, value: str) -> DataFrame:
    """SCAN with a sum on a stream: each batch's rows and total of a key, added to the key's state."""
    kind = dict(events.dtypes)[by]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf[value].sum())
        state.update((n, total))
        yield pd.DataFrame({by: [key[0]], "n": [n], "total": [total]})

    return events.groupBy(by).applyInPandasWithState(step, f"`{by}` {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
