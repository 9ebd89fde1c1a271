"""Criteria: the text mini-language of conditional aggregates and database functions, as predicates.

``kind`` says what a column holds: num, str, bool,
date (criteria on dates may be written m/d/yyyy or yyyy-mm-dd) or err, the
error codes beside a value, which only an error's code or a cell without one
can equal.
"""

from __future__ import annotations

import datetime
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cells import ERRORS
from ..functions.text import pattern_of

Where = tuple  #: (column, kind, criterion)


def _number(t: str):
    m = re.fullmatch(r"\s*[$€£]?([-+]?[0-9][0-9,]*\.?[0-9]*(?:[eE][-+]?[0-9]+)?|[-+]?\.[0-9]+)(%?)\s*", t)
    return float(m[1].replace(",", "")) / (100 if m[2] else 1) if m else None


def _date(t: str):
    for layout in ("%m/%d/%Y", "%Y-%m-%d"):
        try:
            return datetime.datetime.strptime(t.strip(), layout).date()
        except ValueError:
            pass
    return None


def _compare(a: Column, op: str, b) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def criterion(column: Column, kind: str, test) -> Column:
    """The predicate of one criterion as a flag, never null: a value, or text with an operator, a wildcard or neither."""
    return F.coalesce(predicate(column, kind, test), F.lit(False))


def predicate(c: Column, kind: str, test) -> Column:
    """As criterion(), but null may stand for false: in filters and conditional aggregates, so that scans can push it down."""
    if test is None:  # an empty criterion is 0
        return c == 0 if kind == "num" else F.lit(False)
    if isinstance(test, bool):
        return c == test if kind == "bool" else F.lit(False)
    if isinstance(test, (int, float)):
        test = f"={test!r}"
    if isinstance(test, (datetime.date, datetime.datetime)):
        test = f"={test:%Y-%m-%d}"
    op, rest = re.match(r"(?s)(<=|>=|<>|<|>|=|)(.*)", test).groups()
    bare, op = not op, op or "="
    if rest == "":
        if bare:
            return c == 0 if kind == "num" else F.lit(False)
        return c.isNull() if op == "=" else c.isNotNull() if op == "<>" else F.lit(False)
    if kind == "err":
        same = F.coalesce(c == rest.upper(), F.lit(False)) if rest.upper() in ERRORS else F.lit(False)
        return ~same if op == "<>" else same if op == "=" else F.lit(False)
    if rest.upper() in ERRORS:  # a value is no error
        return F.lit(op == "<>")
    day, value = _date(rest), _number(rest)
    if day is not None and kind == "date":
        return F.coalesce(c.cast("date") != F.lit(day), F.lit(True)) if op == "<>" else _compare(c.cast("date"), op, F.lit(day))
    if day is not None:
        value = float((day - datetime.date(1899, 12, 30)).days)
    if value is not None:
        if kind == "num":
            return ~F.coalesce(c == value, F.lit(False)) if op == "<>" else _compare(c, op, value)
        if kind == "str" and op in ("=", "<>"):
            same = F.coalesce(c.try_cast("double") == value, F.lit(False))
            return ~same if op == "<>" else same
        return F.lit(op == "<>")
    if rest.upper() in ("TRUE", "FALSE") and kind == "bool":
        same = F.coalesce(c == (rest.upper() == "TRUE"), F.lit(False))
        return ~same if op == "<>" else same if op == "=" else F.lit(False)
    if kind != "str":
        return F.lit(False)
    low = F.lower(c)
    if op in ("=", "<>"):
        plain = not re.search(r"[*?~]", rest)
        same = low == rest.lower() if plain else low.rlike(f"(?s)^{pattern_of(rest.lower())}$")
        if op == "=":
            return same
        return ~same if plain else ~F.coalesce(same, F.lit(False))  # an empty cell differs from a wildcard, but not from a text
    return _compare(low, op, rest.lower())


def all_of(*where: Where) -> Column:
    """All criteria together; null may stand for false."""
    tests = [predicate(c if isinstance(c, Column) else F.col(c), kind, test) for c, kind, test in where]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def SUMIFS(value, *where: Where) -> Column:
    return F.coalesce(F.sum(F.when(all_of(*where), F.col(value) if isinstance(value, str) else value)), F.lit(0.0))


def AVERAGEIFS(value, *where: Where) -> Column:
    """Null (a division by zero) where nothing matches."""
    return F.avg(F.when(all_of(*where), F.col(value) if isinstance(value, str) else value))


def COUNTIFS(*where: Where) -> Column:
    return F.count_if(all_of(*where))


def MAXIFS(value, *where: Where) -> Column:
    return F.coalesce(F.max(F.when(all_of(*where), F.col(value) if isinstance(value, str) else value)), F.lit(0.0))


def MINIFS(value, *where: Where) -> Column:
    return F.coalesce(F.min(F.when(all_of(*where), F.col(value) if isinstance(value, str) else value)), F.lit(0.0))


def SUMIF(column, kind, test, value=None) -> Column:
    return SUMIFS(value or column, (column, kind, test))


def COUNTIF(column, kind, test) -> Column:
    return COUNTIFS((column, kind, test))


def AVERAGEIF(column, kind, test, value=None) -> Column:
    return AVERAGEIFS(value or column, (column, kind, test))
