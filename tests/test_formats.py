"""Formats by id and by locale."""

import pytest
from pyspark.sql import functions as F

from gridspan.functions import formats as FM


@pytest.mark.parametrize("cell,expected", [
    (lambda: FM.format_number(1234.5, 4), "1,234.50"), (lambda: FM.format_number(1234.5, 4, "de"), "1.234,50"), (lambda: FM.format_number(0.256, 9), "26%"), (lambda: FM.format_number(-1234.0, 37), "(1,234)"), (lambda: FM.format_number(12345.678, 11), "1.23E+04"),
    (lambda: FM.format_number(45138, 15), "31-Jul-23"), (lambda: FM.format_number(0.5, 20), "12:00"), (lambda: FM.format_number(7.0, 0), "7"),
    (lambda: FM.parse_number(F.lit("1.234,5"), "de"), 1234.5), (lambda: FM.parse_number(F.lit("12,5 %"), "it"), 0.125), (lambda: FM.parse_number(F.lit("-$1,000"), "en"), -1000.0), (lambda: FM.parse_number(F.lit("3 €"), "fr"), 3.0), (lambda: FM.parse_number(F.lit("x")), None),
    (lambda: FM.parse_date(F.lit("07/31/2023")), 45138.0), (lambda: FM.parse_date(F.lit("31.7.2023"), "de"), 45138.0), (lambda: FM.parse_date(F.lit("2023-07-31"), "en-GB"), 45138.0), (lambda: FM.parse_date(F.lit("31/07/2023")), None),
])
def test_format(spark, cell, expected):
    assert spark.range(1).select(cell().value).first()[0] == expected


def test_precision(spark):
    assert spark.range(1).select(FM.to_precision(F.lit(0.1) + 0.2), FM.to_precision(F.lit(123456.0), 2)).first() == (0.3, 120000.0)
