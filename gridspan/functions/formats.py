"""Number formats by id, and numbers and dates by locale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cells import VALUE, Cell, cell, made, raw
from .dates import serial
from .text import TEXT

#: Built-in formats of the file format by their ids; fixed values.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0;(#,##0)", 38: "#,##0;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
#: Decimal mark, group mark and order of the date of each locale; fixed values.
LOCALES = {
    "en": (".", ",", "mdy"),
    "en-GB": (".", ",", "dmy"),
    "de": (",", ".", "dmy"),
    "es": (",", ".", "dmy"),
    "fr": (",", " ", "dmy"),
    "it": (",", ".", "dmy"),
}


def format_number(value, pattern: str | int, locale: str = "en") -> Cell:
    """A number through a pattern or a built-in format's id, with the locale's marks."""
    pattern = BUILT_IN[pattern] if isinstance(pattern, int) else pattern
    if pattern in ("General", "@"):
        shown = made(F.regexp_replace(raw(value).cast("string"), r"\.0$", ""), [value])
    else:
        shown = TEXT(value, pattern)
    decimal, group, _ = LOCALES[locale]
    if (decimal, group) == (".", ","):
        return shown
    return Cell(F.translate(shown.raw, ".,", decimal + group), cell(shown).error)


def parse_number(text, locale: str = "en") -> Cell:
    """A number from text with the locale's marks: plain, percent, currency before or after."""
    decimal, group, _ = LOCALES[locale]
    bare = F.regexp_replace(F.trim(raw(text)), r"^([-+]?)\s*[$€£]\s*|\s*[$€£]$", "$1")
    percent = bare.endswith("%")
    digits = F.replace(F.replace(F.rtrim(bare, F.lit("% ")), F.lit(group), F.lit("")), F.lit(decimal), F.lit("."))
    value = F.when(digits.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), digits.try_cast("double"))
    out = F.when(percent, value / 100).otherwise(value)
    return made(out, [text], (out.isNull(), VALUE))


def parse_date(text, locale: str = "en") -> Cell:
    """The serial of a date in the locale's order, or with the year first."""
    order = LOCALES[locale][2]
    t = F.regexp_replace(F.trim(raw(text)), r"[-.]", "/")
    layout = "M/d/y" if order == "mdy" else "d/M/y"
    day = F.coalesce(F.when(t.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), F.try_to_timestamp(t, F.lit("y/M/d")).cast("date")), F.when(t.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_timestamp(t, F.lit(layout)).cast("date")))
    return made(serial(day), [text], (day.isNull(), VALUE))


def to_precision(x: Column, digits: int = 15) -> Column:
    """A number cut to so many significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.rint(x * scale) / scale)
