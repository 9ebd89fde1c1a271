"""Cells: a value Column and, beside it, the error that took its place.

Functions return a ``Cell``. Its ``value`` is null where there is an error and
its ``error`` is the error's code or null, so errors travel as data and never
stop a job. A plain Column or a number given as an argument has no error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REF, NAME, VALUE, DIV, NA, NUM, ERROR = "#REF!", "#NAME?", "#VALUE!", "#DIV/0!", "#N/A", "#NUM!", "#ERROR!"
NIMPL, SPILL, CALC, CIRC, NULL = "#N/IMPL!", "#SPILL!", "#CALC!", "#CIRC!", "#NULL!"
#: All codes; fixed values.
ERRORS = (REF, NAME, VALUE, DIV, NA, NUM, ERROR, NIMPL, SPILL, CALC, CIRC, NULL)


class Cell:
    """A typed value with an error code beside it.

    Operators are those of formulas: ``+ - * / **`` on numbers, ``&`` joins
    texts, ``< <= > >=`` and the methods ``eq`` and ``ne`` compare as cells do
    (numbers before texts before booleans, texts in any case). The first error
    of the two sides is the result's. An empty cell counts as 0 or "".
    """

    def __init__(self, raw: Column, error: Column | None = None):
        self.raw, self._error = raw, error

    @property
    def error(self) -> Column:
        return F.lit(None).cast("string") if self._error is None else self._error

    @property
    def value(self) -> Column:
        return self.raw if self._error is None else F.when(self._error.isNull(), self.raw)

    def named(self, name: str) -> list[Column]:
        """The value and the error as two columns of a select."""
        return [self.value.alias(name), self.error.alias(f"{name}_error")]

    def shown(self) -> Column:
        """The value as text, or the error's code."""
        return F.coalesce(self.error, self.raw.cast("string"))

    def __add__(self, other):
        return _arithmetic(self, other, lambda a, b: a + b)

    def __radd__(self, other):
        return cell(other) + self

    def __sub__(self, other):
        return _arithmetic(self, other, lambda a, b: a - b)

    def __rsub__(self, other):
        return cell(other) - self

    def __mul__(self, other):
        return _arithmetic(self, other, lambda a, b: a * b)

    def __rmul__(self, other):
        return cell(other) * self

    def __truediv__(self, other):
        return _arithmetic(self, other, lambda a, b: a / b, lambda a, b: (b == 0, DIV))

    def __rtruediv__(self, other):
        return cell(other) / self

    def __pow__(self, other):
        return _arithmetic(self, other, F.pow, lambda a, b: ((a == 0) & (b == 0), NUM), lambda a, b: ((a == 0) & (b < 0), DIV))

    def __rpow__(self, other):
        return cell(other) ** self

    def __neg__(self):
        return _arithmetic(0, self, lambda a, b: a - b)

    def percent(self):
        return _arithmetic(self, 100, lambda a, b: a / b)

    def __and__(self, other):
        return made(F.concat(_joined(self), _joined(other)), [self, other])

    def __rand__(self, other):
        return cell(other) & self

    def __lt__(self, other):
        return _compared(self, other, lambda a, b: a < b)

    def __le__(self, other):
        return _compared(self, other, lambda a, b: a <= b)

    def __gt__(self, other):
        return _compared(self, other, lambda a, b: a > b)

    def __ge__(self, other):
        return _compared(self, other, lambda a, b: a >= b)

    def eq(self, other):
        return _compared(self, other, lambda a, b: a == b)

    def ne(self, other):
        return _compared(self, other, lambda a, b: a != b)


def _arithmetic(a, b, f, *rules) -> Cell:
    """A number from two; a text that isn't one is #VALUE!."""
    sides = [F.coalesce(raw(x).try_cast("double"), F.when(raw(x).isNull(), 0.0)) for x in (a, b)]
    return number(f(*sides), [a, b], *[(x.isNull(), VALUE) for x in sides], *[rule(*sides) for rule in rules])


def _joined(x) -> Column:
    """A cell as text: a number without a trailing point, TRUE or FALSE, nothing for an empty one."""
    t = raw(x).cast("string")
    plain = F.when(F.typeof(raw(x)).isin("double", "float"), F.regexp_replace(t, r"\.0$", "")).when(F.typeof(raw(x)) == "boolean", F.upper(t)).otherwise(t)
    return F.coalesce(plain, F.lit(""))


def _compared(a, b, f) -> Cell:
    """``f`` of the two sides' kinds where they differ, else of their values; an empty side takes the other's kind."""

    def kind(x) -> Column:
        t = F.typeof(raw(x))
        return F.when(raw(x).isNull(), 0).when(t == "string", 2).when(t == "boolean", 3).otherwise(1)

    text = lambda x: F.coalesce(F.upper(raw(x).cast("string")), F.lit(""))
    value = lambda x: F.coalesce(raw(x).try_cast("double"), F.lit(0.0))
    like = (kind(a) == kind(b)) | (kind(a) == 0) | (kind(b) == 0)
    return made(F.when(~like, f(kind(a), kind(b))).when(F.greatest(kind(a), kind(b)) == 2, f(text(a), text(b))).otherwise(f(value(a), value(b))), [a, b])


def cell(x) -> Cell:
    return x if isinstance(x, Cell) else Cell(x if isinstance(x, Column) else F.lit(x))


def raw(x) -> Column:
    return cell(x).raw


def num(x) -> Column:
    return raw(x).cast("double")


def made(value: Column, args=(), *rules: tuple[Column, str]) -> Cell:
    """A result: the first error of its arguments, else that of the first rule that holds, else the value."""
    errors = [c._error for c in map(cell, args) if c._error is not None] + [F.when(test, F.lit(code)) for test, code in rules]
    return Cell(value, F.coalesce(*errors) if errors else None)


def number(value: Column, args=(), *rules: tuple[Column, str]) -> Cell:
    """As made(); a result that is no finite number is #NUM!. Rules keep the value from being computed."""
    held = F.when(~reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t, _ in rules]), value) if rules else value
    return made(held, args, *rules, (F.abs(held) >= float("inf"), NUM))  # NaN is above all numbers


def constant_error(code: str) -> Cell:
    return Cell(F.lit(None).cast("double"), F.lit(code))


def output(x) -> Column:
    """A number as a cell stores it: an empty one becomes 0."""
    return F.coalesce(cell(x).value, F.lit(0.0))


def bound(x: Column, f) -> Column:
    """f of x, with x computed once for a row however often f mentions it."""
    return F.get(F.transform(F.array(x), f), 0)
