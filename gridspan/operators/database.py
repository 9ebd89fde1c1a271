"""Database functions: aggregates under a criteria table. Rows of the table are alternatives; cells of a row hold together."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cells import NUM, VALUE
from .criteria import predicate

KINDS = {"string": "str", "boolean": "bool", "date": "date", "timestamp": "date"}


def matching(df: DataFrame, table: list[dict]) -> Column:
    """The predicate of a criteria table. Headers are found in any case; an unknown one matches nothing, plain text means "begins with"."""
    kinds = {c.lower(): (c, KINDS.get(t, "num")) for c, t in df.dtypes}

    def one(header: str, test) -> Column | None:
        if test is None or test == "":
            return None
        if header.lower() not in kinds:
            return F.lit(False)
        name, kind = kinds[header.lower()]
        if kind == "str" and isinstance(test, str) and not re.match(r"[<>=]", test):
            test = test + "*"
        return predicate(F.col(f"`{name}`"), kind, test)

    rows = [[p for h, t in row.items() if (p := one(h, t)) is not None] or [F.lit(True)] for row in table]
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, row) for row in rows]) if rows else F.lit(True)


def field(df: DataFrame, name) -> str:
    """A column by its header in any case, or by its place from 1."""
    return df.columns[name - 1] if isinstance(name, int) else next(c for c in df.columns if c.lower() == name.lower())


def _aggregate(f):
    def run(df: DataFrame, name, table: list[dict]) -> DataFrame:
        return df.where(matching(df, table)).agg(f(F.col(f"`{field(df, name)}`")).alias("value"))

    return run


DSUM = _aggregate(lambda c: F.coalesce(F.sum(c), F.lit(0)))
DAVERAGE, DPRODUCT = _aggregate(F.avg), _aggregate(lambda c: F.product(c))
DCOUNT, DCOUNTA = _aggregate(lambda c: F.count(c.try_cast("double"))), _aggregate(F.count)
DMAX, DMIN = _aggregate(lambda c: F.coalesce(F.max(c), F.lit(0))), _aggregate(lambda c: F.coalesce(F.min(c), F.lit(0)))
DSTDEV, DSTDEVP, DVAR, DVARP = _aggregate(F.stddev_samp), _aggregate(F.stddev_pop), _aggregate(F.var_samp), _aggregate(F.var_pop)


def DGET(df: DataFrame, name, table: list[dict]) -> DataFrame:
    """The only match; none is #VALUE!, several are #NUM!."""
    c = F.col(f"`{field(df, name)}`")
    got = df.where(matching(df, table)).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("v"))
    return got.select(F.when(F.col("n") == 1, F.col("v")).alias("value"), F.when(F.col("n") == 0, VALUE).when(F.col("n") > 1, NUM).alias("error"))


def subtotal(df: DataFrame, code: int, name: str, by=(), filtered: str | None = None, hidden: str | None = None) -> DataFrame:
    """SUBTOTAL and its nesting: codes 1 to 11 skip filtered rows, 101 to 111 hidden ones too; with ``by`` a roll-up of all levels."""
    from ..functions import math as M
    from ..functions import stats as S

    c = F.col(name)
    aggregates = {1: S.AVERAGE, 2: S.COUNT, 3: S.COUNTA, 4: M.MAX, 5: M.MIN, 6: M.PRODUCT, 7: S.STDEV_S, 8: S.STDEV_P, 9: M.SUM, 10: S.VAR_S, 11: S.VAR_P}
    if filtered:
        df = df.where(~F.coalesce(F.col(filtered), F.lit(False)))
    if hidden and code > 100:
        df = df.where(~F.coalesce(F.col(hidden), F.lit(False)))
    out = aggregates[code % 100](c).alias("value")
    return df.rollup(*by).agg(F.grouping_id().alias("level"), out) if by else df.agg(out)
