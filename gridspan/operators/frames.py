"""Dynamic arrays over DataFrames: positions, FILTER, SORT, UNIQUE, TAKE, DROP, stacking and reshaping.

A position is dense and starts at 0. Numbering a table sorts it by range over
all partitions, and adds each partition's offset to the rows' places in it, so
no partition ever holds the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouped import beside
from .shared import checkpointed

POS = "_pos"


def with_pos(df: DataFrame, *order: Column | str, name: str = POS) -> DataFrame:
    """``df`` with a dense position in the given order."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_from"))  # a row for each partition
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_from") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_from")


def prefix_sum(df: DataFrame, value: str, *order: Column | str, by=(), name: str = "_upto", total: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row of an order without ties, in each group, and the group's ``total``.

    Rows are range-partitioned by group and order, so a large group lies in
    many partitions. Only a partition's first and last group can go on in
    another one: what such groups have in other partitions is at most two
    rows a partition, and broadcast.
    """
    by = list(by)
    ranged = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    placed = checkpointed(ranged)
    group = Window.partitionBy(*by)
    sizes = placed.groupBy("_part", *by).agg(F.sum(value).alias("_n_part"))
    sums = [
        (F.sum("_n_part").over(group.orderBy("_part")) - F.col("_n_part")).alias("_from"),
        F.sum("_n_part").over(group).alias("_all"),
        F.count(F.lit(1)).over(group).alias("_parts"),
    ]
    spread = F.broadcast(sizes.select("_part", *by, *sums).where("_parts > 1").drop("_parts"))
    inside = Window.partitionBy("_part", *by)
    out = placed.withColumn(name, F.sum(value).over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    if total is not None:
        out = out.withColumn(total, F.sum(value).over(inside))
    out = beside(out, spread, ["_part", *by]).withColumn(name, F.col(name) + F.coalesce("_from", F.lit(0)))
    if total is not None:
        out = out.withColumn(total, F.coalesce("_all", total))
    return out.drop("_part", "_from", "_all")


def shifted(df: DataFrame, column: str, rows: int, *order: Column | str, by=(), name: str = "_shifted") -> DataFrame:
    """OFFSET over groups of any size: the value some rows further down in an order without ties, met by position."""
    by = list(by)
    placed = checkpointed(prefix_sum(df.withColumn("_one", F.lit(1)), "_one", *order, by=by, name="_at").drop("_one"))
    return beside(placed, placed.select(*by, (F.col("_at") - rows).alias("_at"), F.col(column).alias(name)), [*by, "_at"]).drop("_at")


def FILTER(df: DataFrame, include: Column, if_empty: dict | None = None) -> DataFrame:
    """Rows where ``include`` holds; the ``if_empty`` row where there are none."""
    kept = df.where(include)
    if if_empty is None:
        return kept
    spare = df.sparkSession.range(1).select(*[F.lit(if_empty.get(c)).cast(t).alias(c) for c, t in df.dtypes])
    found = kept.limit(1).agg(F.count(F.lit(1)).alias("_found"))
    return kept.unionByName(spare.join(F.broadcast(found), F.col("_found") == 0).drop("_found"))


def sort_key(column: str, kind: str, descending: bool = False) -> list[Column]:
    """Blanks last either way; text in any case."""
    key = F.lower(F.col(column)) if kind == "string" else F.col(column)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last()]


def SORT(df: DataFrame, index=1, order: int = 1, pos: str | None = None) -> DataFrame:
    """By a column's name or place; equal rows in the order of ``pos``."""
    return SORTBY(df, (df.columns[index - 1] if isinstance(index, int) else index, order), pos=pos)


def SORTBY(df: DataFrame, *keys, pos: str | None = None) -> DataFrame:
    kinds = dict(df.dtypes)
    columns = [k for c, o in ((k if isinstance(k, tuple) else (k, 1)) for k in keys) for k in sort_key(c, kinds[c], o < 0)]
    return df.orderBy(*columns, *([F.col(pos)] if pos else []))


def UNIQUE(df: DataFrame, *columns: str, pos: str | None = None, exactly_once: bool = False) -> DataFrame:
    """Distinct rows of the columns, text in any case: of each group the row first seen; or only groups of one row."""
    columns = columns or tuple(c for c in df.columns if c != pos)
    kinds = dict(df.dtypes)
    keys = [(F.upper(F.col(c)) if kinds[c] == "string" else F.col(c)).alias(f"_k{i}") for i, c in enumerate(columns)]
    row = F.struct(*[F.col(c) for c in columns])
    first = F.min_by(row, F.col(pos)) if pos else F.min(row)
    got = df.groupBy(*keys).agg(first.alias("_row"), F.count(F.lit(1)).alias("_n"), *([F.min(pos).alias(pos)] if pos else []))
    got = got.where("_n = 1") if exactly_once else got
    return got.select(*[F.col(f"_row.{c}").alias(c) for c in columns], *([F.col(pos)] if pos else []))


def TAKE(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of an order, or the last for a negative n."""
    if n >= 0:
        return df.orderBy(*order).limit(n)
    return df.orderBy(*[_turned(o) for o in order]).limit(-n)


def _turned(o) -> Column:
    return (F.col(o) if isinstance(o, str) else o).desc()


def DROP(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Without the first n rows, or the last for a negative n."""
    placed = with_pos(df, *order)
    if n >= 0:
        return placed.where(F.col(POS) >= n).drop(POS)
    return placed.join(F.broadcast(placed.agg(F.count(F.lit(1)).alias("_rows"))), F.col(POS) < F.col("_rows") + n).drop(POS, "_rows")


def CHOOSECOLS(df: DataFrame, *places: int) -> DataFrame:
    return df.select(*[df.columns[p - 1 if p > 0 else p] for p in places])


def CHOOSEROWS(df: DataFrame, *places: int, pos: str = POS) -> DataFrame:
    """Rows by place from 1, or from the end; they may repeat and come in the order asked, in column ``out``."""
    n = df.agg(F.max(pos)).first()[0]
    wanted = [(i, p - 1 if p > 0 else (n or 0) + 1 + p) for i, p in enumerate(places)]
    asked = df.sparkSession.createDataFrame(wanted, "out int, _want long")
    return df.join(F.broadcast(asked), F.col(pos) == F.col("_want")).drop("_want")


def INDEX(df: DataFrame, row: int, column: int = 0, pos: str = POS) -> DataFrame:
    """A row (0: all) and a column (0: all) by place."""
    rows = df if row == 0 else df.where(F.col(pos) == row - 1)
    own = [c for c in df.columns if c != pos]
    return rows.select(*own) if column == 0 else rows.select(own[column - 1])


def OFFSET(column: str, rows: int, order: str, by=()) -> Column:
    """The value some rows further down, in each group, which one task orders; ``shifted`` is the form for large groups."""
    return F.lead(column, rows).over(Window.partitionBy(*by).orderBy(order))


def running(column: Column, order: str, by=()) -> Column:
    """SCAN with a sum; ``prefix_sum`` is the form for large groups."""
    return F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def VSTACK(*frames: DataFrame) -> DataFrame:
    """Columns by place, the widest table's names; what is missing is null."""
    widest = max(frames, key=lambda f: len(f.columns))
    names = widest.columns
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.toDF(*names[: len(f.columns)]) for f in frames])


def HSTACK(*frames: DataFrame, pos: str = POS) -> DataFrame:
    """Side by side by position; shorter tables are padded with null."""
    return reduce(lambda a, b: a.join(b, pos, "full"), frames)


def EXPAND(df: DataFrame, rows: int, pad=None, pos: str = POS) -> DataFrame:
    """At least so many rows, the added ones holding ``pad``."""
    grid = df.sparkSession.range(rows).select(F.col("id").alias(pos))
    own = [c for c in df.columns if c != pos]
    out = df.withColumn("_own", F.lit(True)).join(grid, pos, "full")
    kinds = dict(df.dtypes)
    added = lambda c: F.when(F.col("_own"), F.col(c)).otherwise(F.lit(pad).cast(kinds[c])).alias(c)
    return out.select(pos, *[F.col(c) if pad is None else added(c) for c in own])


def TOCOL(df: DataFrame, *columns: str, ignore_blanks: bool = False, pos: str = POS) -> DataFrame:
    """All values in one column, row by row: position, column number and value as text or number."""
    items = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).alias("value")) for i, c in enumerate(columns, 1)])
    out = df.select(pos, F.explode(items).alias("x")).select(pos, "x.column", "x.value")
    return out.where(F.col("value").isNotNull()) if ignore_blanks else out


def TOROW(df: DataFrame, column: str, pos: str = POS) -> DataFrame:
    """One row with an array of a small column's values in order."""
    return df.agg(F.transform(F.sort_array(F.collect_list(F.struct(pos, column))), lambda x: x[column]).alias("row"))


def WRAPROWS(df: DataFrame, column: str, n: int, pad=None, pos: str = POS) -> DataFrame:
    """A column cut into rows of n values."""
    places = [F.max(F.when(F.col(pos) % n == i, F.col(column))) for i in range(n)]
    places = [F.coalesce(p, F.lit(pad)) if pad is not None else p for p in places]
    return df.groupBy(F.floor(F.col(pos) / n).alias("r")).agg(*[p.alias(f"c{i + 1}") for i, p in enumerate(places)])


def WRAPCOLS(df: DataFrame, column: str, n: int, width: int, pos: str = POS) -> DataFrame:
    """A column cut into columns of n values; ``width`` columns."""
    return df.groupBy((F.col(pos) % n).alias("r")).agg(*[F.max(F.when(F.floor(F.col(pos) / n) == i, F.col(column))).alias(f"c{i + 1}") for i in range(width)])


def TRANSPOSE(df: DataFrame, index: str) -> DataFrame:
    """Rows of a small table as columns named by ``index``."""
    return df.transpose(index)


def TRIMRANGE(df: DataFrame, *columns: str, pos: str = POS) -> DataFrame:
    """Without blank rows at the edges."""
    full = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
    edges = df.where(full).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    return df.join(F.broadcast(edges), F.col(pos).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def SEQUENCE(spark, rows: int, columns: int = 1, start: float = 1, step: float = 1) -> DataFrame:
    cells = spark.range(rows * columns)
    return cells.select(F.floor(F.col("id") / columns).alias("r"), (F.col("id") % columns).alias("c"), (F.lit(float(start)) + F.col("id") * step).alias("value"))


def RANDARRAY(spark, rows: int, columns: int = 1, low: float = 0, high: float = 1, whole: bool = False, seed: int | None = None) -> DataFrame:
    value = F.floor(F.rand(seed) * (high - low + 1)) + low if whole else F.rand(seed) * (high - low) + low
    return SEQUENCE(spark, rows, columns).withColumn("value", value.cast("double"))


def MUNIT(spark, n: int) -> DataFrame:
    return spark.range(n * n).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c")).withColumn("value", (F.col("r") == F.col("c")).cast("double"))


def MMULT(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices in r, c, value form."""
    left = a.select(F.col("r"), F.col("c").alias("k"), F.col("value").alias("v"))
    right = b.select(F.col("r").alias("k"), F.col("c"), F.col("value").alias("w"))
    return left.join(right, "k").groupBy("r", "c").agg(F.sum(F.col("v") * F.col("w")).alias("value"))


def MDETERM(matrices: DataFrame, by: list[str]) -> DataFrame:
    """Determinant of each group's small square matrix (r, c, value)."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="r", columns="c", values="value").to_numpy()
        return pdf[by].head(1).assign(value=np.linalg.det(grid))

    kinds = dict(matrices.dtypes)
    return matrices.groupBy(*by).applyInPandas(one, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", value double")


def MINVERSE(matrices: DataFrame, by: list[str]) -> DataFrame:
    """Inverse of each group's small square matrix; singular ones give no rows."""
    import numpy as np
    import pandas as pd

    kinds = dict(matrices.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="r", columns="c", values="value")
        try:
            inverse = np.linalg.inv(grid.to_numpy())
        except np.linalg.LinAlgError:
            return pdf.head(0)[[*by, "r", "c", "value"]]
        out = pd.DataFrame(inverse, index=grid.index, columns=grid.columns).stack().rename("value").reset_index()
        return pdf[by].head(1).merge(out, how="cross")[[*by, "r", "c", "value"]]

    return matrices.groupBy(*by).applyInPandas(one, ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "r", "c"]) + ", value double")


def ADDRESS(row: int, column: int, absolute: int = 1, sheet: str | None = None) -> str:
    from ..functions.logical import _letters

    c, r = ("$" if absolute in (1, 3) else "") + _letters(column), ("$" if absolute in (1, 2) else "") + str(row)
    return (f"{sheet}!" if sheet else "") + c + r


