"""Functions about references and tables: places, sizes, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cells import made, raw
from ..operators.frames import ADDRESS, CHOOSECOLS, CHOOSEROWS, DROP, EXPAND, FILTER, HSTACK, INDEX, MDETERM, MINVERSE, MMULT, MUNIT, OFFSET, RANDARRAY, SEQUENCE, SORT, SORTBY, TAKE, TOCOL, TOROW, TRANSPOSE, TRIMRANGE, UNIQUE, VSTACK, WRAPCOLS, WRAPROWS  # noqa: F401
from ..operators.lookup import HLOOKUP, LOOKUP, MATCH, VLOOKUP, XLOOKUP, XMATCH  # noqa: F401


def ROW(order: str, by=()):
    """Row number from 1 in a group's order."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(order))


def ROWS(df: DataFrame) -> int:
    return df.count()


def COLUMN(df: DataFrame, name: str) -> int:
    return df.columns.index(name) + 1


def COLUMNS(df: DataFrame) -> int:
    return len(df.columns)


def AREAS(df: DataFrame) -> int:
    return 1


def INDIRECT(spark: SparkSession, name: str) -> DataFrame:
    """A table by its name at run time."""
    return spark.table(name)


def HYPERLINK(url, name=None):
    """A link: its url and the name it shows."""
    return made(F.struct(raw(url).alias("url"), raw(url if name is None else name).alias("name")), [url])


def FORMULATEXT(cells: DataFrame) -> DataFrame:
    """The formulas of a table of cells as read from workbooks."""
    return cells.where("formula IS NOT NULL").select("path", "sheet", "row", "col", F.concat(F.lit("="), "formula").alias("formula"))


def ISFORMULA(formula):
    return made(raw(formula).isNotNull(), [])
