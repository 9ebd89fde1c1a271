"""Conditional formatting rules as flag and value columns over a table.

Rules over a whole column use one aggregate, broadcast as its single row, or
counts by value; nothing is sorted into one partition but distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cells import cell
from .criteria import criterion


def cell_is(column: Column, kind: str, op: str, a, b=None) -> Column:
    if op in ("between", "not between"):
        held = F.coalesce(column.between(a, b), F.lit(False))
        return held if op == "between" else ~held & column.isNotNull()
    return criterion(column, kind, f"{op}{a}")


def text_rule(column: Column, how: str, text: str) -> Column:
    low, t = F.lower(column), text.lower()
    held = {"contains": low.contains(t), "not contains": ~low.contains(t), "begins": low.startswith(t), "ends": low.endswith(t), "equals": low == t}[how]
    return F.coalesce(held, F.lit(how == "not contains"))


def errors(value, present: bool = True) -> Column:
    """Errors and NoErrors: whether a cell has an error."""
    held = cell(value).error.isNotNull()
    return held if present else ~held


def blanks(column: Column) -> Column:
    return column.isNull() | (column.cast("string") == "")


def time_period(column: Column, period: str, today: Column | None = None) -> Column:
    """Whether a date is in a period around today."""
    d, now = column.cast("date"), today if today is not None else F.current_date()
    day = lambda lo, hi: d.between(F.date_add(now, lo), F.date_add(now, hi))
    unit = lambda u, k: F.trunc(d, u) == F.trunc(F.add_months(now, k) if u != "week" else F.date_add(now, 7 * k), u)
    table = {
        "yesterday": lambda: day(-1, -1), "today": lambda: day(0, 0), "tomorrow": lambda: day(1, 1), "last7Days": lambda: day(-6, 0), "last30Days": lambda: day(-29, 0), "next7Days": lambda: day(0, 6), "next30Days": lambda: day(0, 29),
        "lastWeek": lambda: unit("week", -1), "thisWeek": lambda: unit("week", 0), "nextWeek": lambda: unit("week", 1),
        "lastMonth": lambda: unit("month", -1), "thisMonth": lambda: unit("month", 0), "nextMonth": lambda: unit("month", 1),
        "lastYear": lambda: unit("year", -12), "thisYear": lambda: unit("year", 0), "nextYear": lambda: unit("year", 12),
        "lastQuarter": lambda: unit("quarter", -3), "thisQuarter": lambda: unit("quarter", 0), "nextQuarter": lambda: unit("quarter", 3),
    }
    return F.coalesce(table[period](), F.lit(False))


def duplicates(df: DataFrame, column: str, name: str = "flag", unique: bool = False) -> DataFrame:
    """Values seen more than once (or once), text in any case; counts are joined back."""
    key = F.lower(F.col(column).cast("string"))
    counts = df.where(F.col(column).isNotNull()).groupBy(key.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    out = df.join(counts, key == F.col("_v"), "left")
    return out.withColumn(name, F.coalesce(F.col("_n") == 1 if unique else F.col("_n") > 1, F.lit(False))).drop("_v", "_n")


def _facts(df: DataFrame, *aggregates: Column) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(*aggregates)))  # one row


def average_rule(df: DataFrame, column: str, above: bool = True, name: str = "flag") -> DataFrame:
    out = _facts(df, F.avg(column).alias("_mean"))
    return out.withColumn(name, F.coalesce(F.col(column) > F.col("_mean") if above else F.col(column) < F.col("_mean"), F.lit(False))).drop("_mean")


def top_rule(df: DataFrame, column: str, n: int, percent: bool = False, bottom: bool = False, name: str = "flag") -> DataFrame:
    """The n largest or smallest values, with ties: the n-th value is found from counts, then compared."""
    rank = n
    if percent:
        rank = max(1, df.where(F.col(column).isNotNull()).count() * n // 100)
    from ..functions.stats import order_statistic

    edge = order_statistic(df, column, rank, largest=not bottom).select(F.col("value").alias("_edge"))
    edge = edge.unionByName(df.agg((F.max(column) if bottom else F.min(column)).cast("double").alias("_edge"))).agg((F.min("_edge") if bottom else F.max("_edge")).alias("_edge"))
    out = df.crossJoin(F.broadcast(edge))
    return out.withColumn(name, F.coalesce(F.col(column) <= F.col("_edge") if bottom else F.col(column) >= F.col("_edge"), F.lit(False))).drop("_edge")


def _threshold(column: str, kind: str, value=None) -> Column:
    """A threshold as an aggregate over the whole column.

    Its kinds are a number, a share of the range in percent, a percentile, the
    ends of the values, with "low" and "high" those of the values and zero, or
    a formula, which is an aggregate Column.
    """
    c = F.col(column).cast("double")
    if kind == "percent":
        return F.min(c) + (F.max(c) - F.min(c)) * (value / 100)
    if kind == "percentile":
        return F.percentile(c, value / 100)
    if kind == "formula":
        return value.cast("double")
    ends = {"min": F.min(c), "max": F.max(c), "low": F.least(F.min(c), F.lit(0.0)), "high": F.greatest(F.max(c), F.lit(0.0))}
    return F.max(F.lit(value).cast("double")) if kind == "num" else ends[kind]


def _thresholds(df: DataFrame, column: str, points) -> tuple[DataFrame, list[str]]:
    """``df`` with each threshold as a column: (kind, value), or (kind,) for the ends."""
    names = [f"_p{i}" for i in range(len(points))]
    return _facts(df, *[_threshold(column, *p).alias(n) for n, p in zip(names, points)]), names


def data_bar(df: DataFrame, column: str, name: str = "bar", low=("low",), high=("high",)) -> DataFrame:
    """The share of the way from one threshold to the other, from 0 to 1; null where they are equal."""
    out, names = _thresholds(df, column, [low, high])
    share = F.try_divide(F.col(column) - F.col("_p0"), F.col("_p1") - F.col("_p0"))
    return out.withColumn(name, F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))).drop(*names)


def color_scale(df: DataFrame, column: str, colors: list[str], name: str = "color", points=None) -> DataFrame:
    """Between colors (rrggbb) at thresholds, in rising order whatever order they are given in: by default the least value, with three colors the median, and the largest."""
    points = points or [("min",), *([("percentile", 50)] if len(colors) == 3 else []), ("max",)]
    out, names = _thresholds(df, column, points)
    rising = F.array_sort(F.array(*names))
    v = F.col(column).cast("double")

    def channel(i: int) -> Column:
        at = [int(c[2 * i : 2 * i + 2], 16) for c in colors]
        value = F.lit(float(at[-1]))
        for j in reversed(range(len(colors) - 1)):
            lo, hi = F.get(rising, j), F.get(rising, j + 1)
            share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0))))
            value = F.when(v <= hi, at[j] + share * (at[j + 1] - at[j])).otherwise(value)
        return F.lpad(F.lower(F.hex(F.floor(value + 0.5).cast("int"))), 2, "0")

    return out.withColumn(name, F.when(v.isNotNull(), F.concat(*map(channel, range(3))))).drop(*names)


def _reached(df: DataFrame, column: str, points: list) -> tuple[DataFrame, list[str], list[Column]]:
    """Whether each threshold is reached: a plain number is a percentage of the range, (kind, value, False) has to be exceeded."""
    points = [p if isinstance(p, tuple) else ("percent", p) for p in points]
    out, names = _thresholds(df, column, [p[:2] for p in points])
    v = F.col(column).cast("double")
    return out, names, [v > F.col(n) if p[2:] == (False,) else v >= F.col(n) for n, p in zip(names, points)]


def icon_set(df: DataFrame, column: str, percents: list, name: str = "icon") -> DataFrame:
    """The icon of each value: the number of the last threshold above the lowest that it reaches, or 0."""
    out, names, reached = _reached(df, column, percents)
    icon = F.greatest(F.lit(0), F.lit(0), *[F.when(r, i).otherwise(0) for i, r in enumerate(reached, 1)])
    return out.withColumn(name, F.when(F.col(column).isNotNull(), icon)).drop(*names)


def icon_rating(df: DataFrame, column: str, points: list, name: str = "rating") -> DataFrame:
    """How many of a row of icons are filled: the number of thresholds that a value reaches."""
    out, names, reached = _reached(df, column, points)
    filled = F.size(F.filter(F.array(*reached), lambda r: r))
    return out.withColumn(name, F.when(F.col(column).isNotNull(), filled)).drop(*names)


def prioritised(rules: list[tuple[int, Column, object]]) -> Column:
    """The style of the rule with the highest priority number among those that hold."""
    out = F.lit(None).cast("string")
    for _, test, style in sorted(rules, key=lambda r: r[0]):
        out = F.when(test, F.lit(style)).otherwise(out)
    return out
