"""Logical functions, type tests and functions over arrays.

LET is a Python variable, LAMBDA a Python function over Columns: both are
inlined into the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cells import CALC, NA, REF, VALUE, DIV, NUM, NAME, ERROR, NIMPL, SPILL, CIRC, NULL, Cell, cell, constant_error, made, num, raw


def TRUE():
    return cell(True)


def FALSE():
    return cell(False)


def AND(*tests):
    return made(reduce(lambda a, b: a & b, map(raw, tests)), tests)


def OR(*tests):
    return made(reduce(lambda a, b: a | b, map(raw, tests)), tests)


def XOR(*tests):
    return made(reduce(lambda a, b: a != b, map(raw, tests)), tests)


def NOT(test):
    return made(~raw(test), [test])


def AND_ALL(c):
    """Aggregates over a column."""
    return F.bool_and(raw(c))


def OR_ALL(c):
    return F.bool_or(raw(c))


def XOR_ALL(c):
    return F.count_if(raw(c)) % 2 == 1


def IF(test, then, other=False):
    """Only the chosen branch's error counts."""
    t, a, b = cell(test), cell(then), cell(other)
    return Cell(F.when(t.raw, a.value).otherwise(b.value), F.coalesce(t.error, F.when(t.raw, a.error).otherwise(b.error)))


def IFS(*pairs):
    """The value of the first test that holds; #N/A where none does."""
    out = Cell(F.when(F.lit(False), raw(pairs[1])), F.lit(NA))
    for test, value in reversed(list(zip(pairs[::2], pairs[1::2]))):
        out = IF(test, value, out)
    return out


def SWITCH(x, *cases):
    """Pairs of a case and its value, and a default at an odd end; without a match and default #N/A."""
    pairs = cases[: len(cases) // 2 * 2]
    out = cell(cases[-1]) if len(cases) % 2 else Cell(F.when(F.lit(False), raw(cases[1])), F.lit(NA))
    for case, value in reversed(list(zip(pairs[::2], pairs[1::2]))):
        out = IF(made(raw(x).eqNullSafe(raw(case)), [x, case]), value, out)
    return out


def IFERROR(x, other):
    c, o = cell(x), cell(other)
    return Cell(F.when(c.error.isNull(), c.raw).otherwise(o.value), F.when(c.error.isNotNull(), o.error))


def IFNA(x, other):
    c, o = cell(x), cell(other)
    missing = c.error.eqNullSafe(F.lit(NA))
    return Cell(F.when(missing, o.value).otherwise(c.value), F.when(missing, o.error).otherwise(c.error))


def LET(*steps):
    """LET(v1, v2, ..., body): a value may be a function of those before it, and body is one of all."""
    *values, body = steps
    known: list[Cell] = []
    for v in values:
        known.append(cell(v(*known) if callable(v) and not isinstance(v, (Column, Cell)) else v))
    return body(*known)


def LAMBDA(f):
    return f


# type tests


def ISBLANK(x):
    return Cell(raw(x).isNull() & cell(x).error.isNull())


def ISERROR(x):
    return Cell(cell(x).error.isNotNull())


def ISNA(x):
    return Cell(cell(x).error.eqNullSafe(F.lit(NA)))


def ISERR(x):
    return Cell(cell(x).error.isNotNull() & (cell(x).error != NA))


def _kind(c: Column) -> Column:
    return F.typeof(c)


def ISNUMBER(x):
    return Cell(_kind(raw(x)).rlike("int|double|float|decimal|date|timestamp") & cell(x).value.isNotNull())


def ISTEXT(x):
    return Cell((_kind(raw(x)) == "string") & cell(x).value.isNotNull())


def ISNONTEXT(x):
    return Cell(~ISTEXT(x).raw)


def ISLOGICAL(x):
    return Cell((_kind(raw(x)) == "boolean") & cell(x).value.isNotNull())


def ISEVEN(n):
    return made(F.floor(F.abs(num(n))) % 2 == 0, [n])


def ISODD(n):
    return made(F.floor(F.abs(num(n))) % 2 == 1, [n])


def ISREF(x):
    """Whether the argument is a column rather than a constant; known when the plan is made."""
    return isinstance(x, (Column, Cell))


def ISOMITTED(x):
    return x is None


def NA_():
    return constant_error(NA)


def N(x, kind: str = "num"):
    c = raw(x)
    return made({"num": c.cast("double"), "bool": c.cast("int").cast("double")}.get(kind, F.lit(0.0)), [x])


#: TYPE codes by kind.
TYPES = {"num": 1, "str": 2, "bool": 4, "err": 16, "range": 64}


def TYPE(x):
    c = cell(x)
    return Cell(F.when(c.error.isNotNull(), TYPES["err"]).when(_kind(c.raw) == "string", TYPES["str"]).when(_kind(c.raw) == "boolean", TYPES["bool"]).when(_kind(c.raw).startswith("array"), TYPES["range"]).otherwise(TYPES["num"]))


#: ERROR.TYPE numbers.
ERROR_NUMBERS = {NULL: 1, DIV: 2, VALUE: 3, REF: 4, NAME: 5, NUM: 6, NA: 7, SPILL: 9, CALC: 14, ERROR: 101, NIMPL: 102, CIRC: 104}


def ERROR_TYPE(x):
    table = F.create_map(*[F.lit(v) for pair in ERROR_NUMBERS.items() for v in pair])
    found = F.try_element_at(table, cell(x).error)
    return Cell(found, F.when(found.isNull(), F.lit(NA)))


def CELL(df: DataFrame, column: str, what: str):
    """Facts about a column: its address, number, type or name."""
    at = df.columns.index(column) + 1
    kind = dict(df.dtypes)[column]
    return {"col": at, "address": f"${_letters(at)}$1", "type": "l" if kind == "string" else "v", "contents": column}[what]


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def INFO(df: DataFrame, what: str):
    spark = df.sparkSession
    return {"release": spark.version, "system": "spark", "numfile": len(spark.catalog.listTables()), "directory": spark.conf.get("spark.sql.warehouse.dir")}[what]


def SHEETS(spark) -> int:
    return len(spark.catalog.listTables())


def SHEET(spark, name: str) -> int:
    return [t.name for t in spark.catalog.listTables()].index(name) + 1


# over arrays and rows


def MAP(f, *arrays):
    if len(arrays) == 1:
        return made(F.transform(raw(arrays[0]), f), arrays)
    if len(arrays) == 2:
        return made(F.zip_with(raw(arrays[0]), raw(arrays[1]), f), arrays)
    zipped = F.arrays_zip(*[raw(a).alias(f"a{i}") for i, a in enumerate(arrays)])
    return made(F.transform(zipped, lambda x: f(*[x[f"a{i}"] for i in range(len(arrays))])), arrays)


def REDUCE(initial, array, f):
    a = raw(array)
    if initial is None:
        return made(F.aggregate(F.slice(a, F.lit(2), F.size(a)), F.get(a, 0), f), [array], (F.size(a) == 0, CALC))
    return made(F.aggregate(a, raw(initial), f), [array])


def SCAN(initial, array, f):
    """Every step of a fold."""
    a = raw(array)
    first = F.get(a, 0) if initial is None else raw(initial)
    rest = F.slice(a, F.lit(2), F.size(a)) if initial is None else a
    start = F.array(first) if initial is None else F.filter(F.array(first), lambda _: F.lit(False))
    step = lambda acc, x: F.struct(f(acc.last, x).alias("last"), F.concat(acc.all, F.array(f(acc.last, x))).alias("all"))
    return made(F.aggregate(rest, F.struct(first.alias("last"), start.alias("all")), step, lambda acc: acc.all), [array])


def BYROW(columns, f):
    """f over the array of a row's columns."""
    return f(F.array(*map(num, columns)))


def BYCOL(df: DataFrame, columns, f) -> DataFrame:
    """One row with f, an aggregate, of each column."""
    return df.agg(*[f(F.col(c)).alias(c) for c in columns])


def MAKEARRAY(spark, rows: int, columns: int, f) -> DataFrame:
    """r, c and value for each place of a grid."""
    grid = spark.range(rows * columns).select((F.col("id") / columns).cast("long").alias("r0"), (F.col("id") % columns).alias("c0"))
    return grid.select((F.col("r0") + 1).alias("r"), (F.col("c0") + 1).alias("c")).withColumn("value", f(F.col("r"), F.col("c")))
