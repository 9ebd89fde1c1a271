"""Tables and rounding shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cells import Cell


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores, for work that is large beside a row's bytes: a small file would leave it to one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def r(x: Cell | Column, digits: int = 4) -> Column:
    """A number rounded for comparison."""
    c = x.value if isinstance(x, Cell) else x
    return F.round(c.cast("double"), digits)


def select(df: DataFrame, keys: list[str], **cells) -> DataFrame:
    """Keys and, for each cell, its value, or its text where it isn't a number."""
    return df.select(*keys, *[(c.value if isinstance(c, Cell) else c).alias(n) for n, c in cells.items()])


def half_up(x: Cell | Column, digits: int = 3) -> Column:
    """A number rounded with ties up, where what is within a millionth of a unit of a tie is one: amounts in cents have many, and sums of doubles miss them by a hair."""
    c = x.value if isinstance(x, Cell) else x
    return F.floor(c.cast("double") * 10.0**digits + 0.500001) / 10.0**digits


def half_up_sql(x: str, digits: int = 3) -> str:
    """As half_up(), in SQL."""
    unit = f"{10**digits}.0::DOUBLE"
    return f"floor(({x}) * {unit} + 0.500001::DOUBLE) / {unit}"
