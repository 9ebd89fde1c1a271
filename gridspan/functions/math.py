"""Mathematical and trigonometric functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cells import CALC, DIV, NUM, VALUE, Cell, cell, made, num, number, raw

_sign, _abs, _pow = F.signum, F.abs, F.pow
TWO_53 = float(2**53)


def clean(x: Column) -> Column:
    """Absorbs the error of decimal fractions, as cutting to 15 digits does."""
    return F.when(_abs(x) < 1e9, F.round(x, 6)).otherwise(x)


def _one(f):
    return lambda x: number(f(num(x)), [x])


ABS, COS, SIN, TAN = _one(F.abs), _one(F.cos), _one(F.sin), _one(F.tan)
COSH, SINH, TANH, EXP = _one(F.cosh), _one(F.sinh), _one(F.tanh), _one(F.exp)
ASIN, ACOS, ATAN = _one(F.asin), _one(F.acos), _one(F.atan)
ASINH, ACOSH, ATANH = _one(F.asinh), _one(F.acosh), _one(F.atanh)
RADIANS, DEGREES = _one(F.radians), _one(F.degrees)
SIGN, INT = _one(F.signum), _one(lambda x: F.floor(x).cast("double"))


def _over(f):
    return lambda x: number(1 / f(num(x)), [x], (f(num(x)) == 0, DIV))


SEC, SECH, CSC, CSCH = _over(F.cos), _over(F.cosh), _over(F.sin), _over(F.sinh)


def COT(x):
    return number(F.cos(num(x)) / F.sin(num(x)), [x], (F.sin(num(x)) == 0, DIV))


def COTH(x):
    return number(1 / F.tanh(num(x)), [x], (num(x) == 0, DIV))


def ACOT(x):
    return number(math.pi / 2 - F.atan(num(x)), [x])


def ACOTH(x):
    return number(0.5 * F.ln((num(x) + 1) / (num(x) - 1)), [x], (_abs(num(x)) <= 1, NUM))


def ATAN2(x, y):
    """Angle of the point (x, y), x first."""
    return number(F.atan2(num(y), num(x)), [x, y], ((num(x) == 0) & (num(y) == 0), DIV))


def PI():
    return cell(math.pi)


def LN(x):
    return number(F.ln(num(x)), [x], (num(x) <= 0, NUM))


def LOG10(x):
    return number(F.log10(num(x)), [x], (num(x) <= 0, NUM))


def LOG(x, base=10):
    return number(F.ln(num(x)) / F.ln(num(base)), [x, base], ((num(x) <= 0) | (num(base) <= 0), NUM), (num(base) == 1, DIV))


def SQRT(x):
    return number(F.sqrt(num(x)), [x], (num(x) < 0, NUM))


def SQRTPI(x):
    return number(F.sqrt(num(x) * math.pi), [x], (num(x) < 0, NUM))


def POWER(x, y):
    a, b = num(x), num(y)
    out = _pow(a, b)
    return made(out, [x, y], ((a == 0) & (b == 0), NUM), (_abs(out) == float("inf"), DIV), (F.isnan(out), NUM))


def _scaled(x, d, step) -> Column:
    a, scale = num(x), _pow(F.lit(10.0), F.floor(num(d)).cast("double"))
    return _sign(a) * step(clean(_abs(a) * scale)).cast("double") / scale


def ROUND(x, digits=0):
    """Half away from zero."""
    return number(_scaled(x, digits, lambda v: F.floor(v + 0.5)), [x, digits])


def ROUNDUP(x, digits=0):
    return number(_scaled(x, digits, F.ceil), [x, digits])


def ROUNDDOWN(x, digits=0):
    return number(_scaled(x, digits, F.floor), [x, digits])


def TRUNC(x, digits=0):
    return number(F.when(_abs(num(digits)) > 15, num(x)).otherwise(_scaled(x, digits, F.floor)), [x, digits])


def EVEN(x):
    return number(_sign(num(x)) * F.ceil(_abs(num(x)) / 2) * 2, [x])


def ODD(x):
    a = num(x)
    return number(F.when(a == 0, 1.0).otherwise(_sign(a) * (F.greatest(F.ceil((_abs(a) - 1) / 2), F.lit(0)) * 2 + 1)), [x])


def _multiple(x, m, step) -> Column:
    return step(clean(num(x) / num(m))).cast("double") * num(m)


def CEILING(x, significance):
    a, s = num(x), num(significance)
    return number(F.when(s == 0, 0.0).otherwise(_multiple(x, significance, F.ceil)), [x, significance], ((a > 0) & (s < 0), NUM))


def FLOOR(x, significance):
    a, s = num(x), num(significance)
    return number(_multiple(x, significance, F.floor), [x, significance], ((s == 0) & (a != 0), DIV), ((a > 0) & (s < 0), NUM))


def _math_multiple(x, significance, mode, up: bool) -> Cell:
    a, s = num(x), _abs(num(significance))
    far = F.when((a < 0) & (num(mode) != 0), F.floor(clean(a / s)) if up else F.ceil(clean(a / s))).otherwise(F.ceil(clean(a / s)) if up else F.floor(clean(a / s)))
    return number(F.when(s == 0, 0.0).otherwise(far.cast("double") * s), [x, significance, mode])


def CEILING_MATH(x, significance=1, mode=0):
    return _math_multiple(x, significance, mode, True)


def FLOOR_MATH(x, significance=1, mode=0):
    return _math_multiple(x, significance, mode, False)


def CEILING_PRECISE(x, significance=1):
    return _math_multiple(x, significance, 0, True)


def FLOOR_PRECISE(x, significance=1):
    return _math_multiple(x, significance, 0, False)


ISO_CEILING = CEILING_PRECISE


def MOD(n, d):
    """Remainder with the sign of the divisor."""
    return number(num(n) - num(d) * F.floor(num(n) / num(d)), [n, d], (num(d) == 0, DIV))


def QUOTIENT(n, d):
    q = num(n) / num(d)
    return number(_sign(q) * F.floor(_abs(q)), [n, d], (num(d) == 0, DIV))


def MROUND(x, multiple):
    a, m = num(x), num(multiple)
    return number(F.when(m == 0, 0.0).otherwise(F.floor(clean(_abs(a / m)) + 0.5).cast("double") * _abs(m) * _sign(a)), [x, multiple], (a * m < 0, NUM))


def _product(lo: Column, hi: Column, step: int = 1) -> Column:
    """Product of the whole numbers from lo to hi; 1 where there are none."""
    return F.when(hi >= lo, F.aggregate(F.sequence(lo.cast("long"), F.greatest(lo, hi).cast("long"), F.lit(step).cast("long")), F.lit(1.0), lambda acc, i: acc * i)).otherwise(1.0)


def FACT(n):
    k = F.floor(num(n))
    return number(_product(F.lit(1), k), [n], ((k < 0) | (k > 170), NUM))


def FACTDOUBLE(n):
    k = F.floor(num(n))
    return number(_product(F.when(k % 2 == 0, 2).otherwise(1), k, 2), [n], ((k < -1) | (k > 300), NUM))


def choose(n: Column, k: Column) -> Column:
    """n over k, for whole numbers 0 <= k <= n."""
    low = F.least(k, n - k)
    return F.when(low <= 0, 1.0).otherwise(F.round(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(low, F.lit(1)).cast("long")), F.lit(1.0), lambda acc, i: acc * (n - low + i) / i), 0))


def COMBIN(n, k):
    a, b = F.floor(num(n)), F.floor(num(k))
    return number(choose(a, b), [n, k], ((a < 0) | (b < 0) | (a < b), NUM))


def COMBINA(n, k):
    a, b = F.floor(num(n)), F.floor(num(k))
    return number(choose(a + b - 1, b), [n, k], ((a < 0) | (b < 0) | ((a == 0) & (b > 0)), NUM))


def MULTINOMIAL(*ns):
    """(sum of all)! over the product of each one's factorial, as a product of binomials."""
    out, total = F.lit(1.0), F.lit(0)
    for n in ns:
        total = total + F.floor(num(n))
        out = out * choose(total, F.floor(num(n)))
    return number(out, ns, (F.least(*[num(n) for n in ns], F.lit(0.0)) < 0, NUM))


def GCD(*ns):
    """Greatest common divisor of the arguments, by Euclid's steps."""
    out = F.floor(num(ns[0]))
    for n in ns[1:]:
        out = _gcd(out, F.floor(num(n)))
    return number(out.cast("double"), ns, *[((num(n) < 0) | (num(n) >= TWO_53), NUM) for n in ns])


def _gcd(a: Column, b: Column) -> Column:
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), F.try_mod(s.a, s.b).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda s: s.a)


def LCM(*ns):
    out = F.floor(num(ns[0])).cast("double")
    for n in ns[1:]:
        b = F.floor(num(n)).cast("double")
        out = F.when((out == 0) | (b == 0), 0.0).otherwise(out / _gcd(out, b) * b)
    return number(out, ns, *[((num(n) < 0) | (num(n) >= TWO_53), NUM) for n in ns])


def BASE(n, radix, min_length=0):
    """Digits of a whole number in a radix from 2 to 36 (a number, not a column)."""
    text = F.conv(F.floor(num(n)).cast("long").cast("string"), 10, int(radix))
    return made(F.when(F.length(text) < int(min_length), F.lpad(text, int(min_length), "0")).otherwise(text), [n], ((num(n) < 0) | (num(n) >= TWO_53), NUM))


def DECIMAL(text, radix):
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[: int(radix)]
    low = F.lower(F.trim(raw(text).cast("string")))
    return made(F.conv(low, int(radix), 10).cast("double"), [text], (~low.rlike(f"^[{digits}]*$"), NUM))


#: Roman numerals of the classic form.
ROMAN_DIGITS = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
#: Further subtractive pairs that each more concise form allows.
ROMAN_CONCISE = (
    (),
    ((950, "LM"), (450, "LD"), (95, "VC"), (45, "VL")),
    ((990, "XM"), (490, "XD"), (99, "IC"), (49, "IL")),
    ((995, "VM"), (495, "VD")),
    ((999, "IM"), (499, "ID")),
)


def ROMAN(n, form=0):
    left, out = F.floor(num(n)).cast("int"), F.lit("")
    pairs = sorted(ROMAN_DIGITS + tuple(p for more in ROMAN_CONCISE[: int(form) + 1] for p in more), reverse=True)
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in pairs])
    step = lambda acc, d: F.struct((acc.n % d.v).alias("n"), F.concat(acc.t, F.repeat(d.s, F.floor(acc.n / d.v).cast("int"))).alias("t"))
    return made(F.aggregate(table, F.struct(left.alias("n"), out.alias("t")), step, lambda acc: acc.t), [n], ((left < 0) | (left > 3999), VALUE))


def ARABIC(text):
    low = F.upper(F.trim(raw(text)))
    sign, digits = F.when(low.startswith("-"), -1.0).otherwise(1.0), F.ltrim(low, F.lit("-"))
    worth = F.create_map(*[F.lit(x) for v, s in ROMAN_DIGITS if len(s) == 1 for x in (s, v)])
    values = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: worth[c])
    step = lambda acc, v: F.struct(F.when(v > acc.last, acc.sum - 2 * acc.last + v).otherwise(acc.sum + v).alias("sum"), v.alias("last"))
    total = F.aggregate(values, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), step, lambda acc: acc.sum)
    return made(sign * total, [text], (~digits.rlike("^[MDCLXVI]*$"), VALUE))


def SERIESSUM(x, n, m, coefficients: list):
    out = F.lit(0.0)
    for i, a in enumerate(coefficients):
        out = out + num(a) * _pow(num(x), num(n) + i * num(m))
    return number(out, [x, n, m, *coefficients])


def RAND(seed: int | None = None):
    return Cell(F.rand(seed))


def RANDBETWEEN(low, high, seed: int | None = None):
    lo, hi = F.floor(num(low)), F.ceil(num(high))
    return number(F.floor(F.rand(seed) * (hi - lo + 1)) + lo, [low, high], (lo > hi, NUM))


def CHOOSE(index, *values):
    """The index-th value."""
    i = F.floor(num(index)).cast("int")
    pick = lambda of: _case(i, [of(v) for v in values])
    return made(pick(lambda v: cell(v).value), [index], ((i < 1) | (i > len(values)), VALUE), *([(pick(lambda v: cell(v).error).isNotNull(), CALC)] if any(isinstance(v, Cell) for v in values) else []))


def _case(i: Column, values: list[Column]) -> Column:
    out = F.when(i == 1, values[0])
    for k, v in enumerate(values[1:], 2):
        out = out.when(i == k, v)
    return out


# aggregates over a column


def SUM(c):
    return F.coalesce(F.sum(num(c)), F.lit(0.0))


def SUMSQ(c):
    return F.coalesce(F.sum(num(c) * num(c)), F.lit(0.0))


def PRODUCT(c):
    return F.coalesce(F.product(num(c)), F.lit(0.0))


def MAX(c):
    return F.coalesce(F.max(num(c)), F.lit(0.0))


def MIN(c):
    return F.coalesce(F.min(num(c)), F.lit(0.0))


def SUMX2MY2(x, y):
    return F.sum(num(x) * num(x) - num(y) * num(y))


def SUMX2PY2(x, y):
    return F.sum(num(x) * num(x) + num(y) * num(y))


def SUMXMY2(x, y):
    return F.sum((num(x) - num(y)) * (num(x) - num(y)))


def SUMPRODUCT(*columns):
    """Sum of the columns' products; a missing number counts as 0."""
    out = F.lit(1.0)
    for c in columns:
        out = out * F.coalesce(num(c), F.lit(0.0))
    return F.coalesce(F.sum(out), F.lit(0.0))


def PERCENTOF(part, total):
    return F.try_divide(F.sum(num(part)), F.sum(num(total)))
