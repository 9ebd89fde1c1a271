"""Engineering functions: number bases, bits, complex numbers, units, Bessel functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special as sp
from ..cells import NA, NUM, VALUE, Cell, bound, made, num, number, raw
from .distributions import _floor, _made, _udf

_j, _i, _k, _y = (_udf(f, once=True) for f in (lambda x, n: sp.bessel_j(x, n), lambda x, n: sp.bessel_i(x, n), lambda x, n: sp.bessel_k(x, n), lambda x, n: sp.bessel_y(x, n)))


def BESSELJ(x, n):
    return _made(_j, [x, _floor(n)], (_floor(n) < 0, NUM))


def BESSELI(x, n):
    return _made(_i, [x, _floor(n)], (_floor(n) < 0, NUM))


def BESSELK(x, n):
    return _made(_k, [x, _floor(n)], ((_floor(n) < 0) | (num(x) <= 0), NUM))


def BESSELY(x, n):
    return _made(_y, [x, _floor(n)], ((_floor(n) < 0) | (num(x) <= 0), NUM))


# number bases: ten digits, two's complement

DIGITS = {2: "01", 8: "01234567", 16: "0123456789ABCDEF"}
#: Bits of ten digits.
WIDTH = {2: 10, 8: 30, 16: 40}


def _to_number(t: Column, base: int) -> Column:
    value = F.conv(t, base, 10).cast("double")
    return F.when(value >= float(1 << (WIDTH[base] - 1)), value - float(1 << WIDTH[base])).otherwise(value)


def _as_text(x) -> Column:
    return F.upper(F.trim(raw(x).cast("string")))


def _bad(t: Column, base: int):
    return (~t.rlike(f"^[{DIGITS[base]}]{{0,10}}$"), NUM)


def _digits(v: Column, base: int, places, args, *rules) -> Cell:
    low, high = -(1 << (WIDTH[base] - 1)), (1 << (WIDTH[base] - 1)) - 1
    whole = F.floor(v).cast("long")
    text = F.conv(F.when(whole < 0, whole + (1 << WIDTH[base])).otherwise(whole).cast("string"), 10, base)
    range_rule = ((v < low) | (v > high), NUM)
    if places is None:
        return made(text, args, *rules, range_rule)
    k = F.floor(num(places)).cast("int")
    return made(F.when(whole < 0, text).otherwise(F.lpad(text, k, F.lit("0"))), [*args, places], *rules, range_rule, ((k < 1) | (k > 10) | ((whole >= 0) & (F.length(text) > k)), NUM))


def _converter(source: int, target: int):
    def convert(x, places=None):
        t = _as_text(x)
        return _digits(_to_number(t, source), target, places, [x], _bad(t, source))

    return convert


def _decoder(source: int):
    return lambda x: made(_to_number(_as_text(x), source), [x], _bad(_as_text(x), source))


def _encoder(target: int):
    return lambda n, places=None: _digits(num(n), target, places, [n])


BIN2DEC, OCT2DEC, HEX2DEC = map(_decoder, (2, 8, 16))
DEC2BIN, DEC2OCT, DEC2HEX = map(_encoder, (2, 8, 16))
BIN2OCT, BIN2HEX, OCT2BIN, OCT2HEX, HEX2BIN, HEX2OCT = (_converter(a, b) for a, b in ((2, 8), (2, 16), (8, 2), (8, 16), (16, 2), (16, 8)))

# bits of whole numbers below 2^48

LIMIT = float(1 << 48)


def _bits(op):
    def run(a, b):
        rules = [((num(x) < 0) | (num(x) >= LIMIT) | (num(x) != F.floor(num(x))), NUM) for x in (a, b)]
        return made(op(num(a).cast("long"), num(b).cast("long")).cast("double"), [a, b], *rules)

    return run


BITAND, BITOR, BITXOR = _bits(lambda a, b: a.bitwiseAND(b)), _bits(lambda a, b: a.bitwiseOR(b)), _bits(lambda a, b: a.bitwiseXOR(b))


def BITLSHIFT(n, shift):
    s = F.signum(num(shift)) * F.floor(F.abs(num(shift)))
    out = F.floor(num(n) * F.pow(F.lit(2.0), s)).cast("double")
    return number(out, [n, shift], ((num(n) < 0) | (num(n) >= LIMIT) | (F.abs(s) > 53) | (out >= LIMIT), NUM))


def BITRSHIFT(n, shift):
    return BITLSHIFT(n, -num(shift))


def DELTA(a, b=0):
    return made((num(a) == num(b)).cast("int"), [a, b])


def GESTEP(n, step=0):
    return made((num(n) >= num(step)).cast("int"), [n, step])


# complex numbers: text at the edges, a struct of re and im inside


class Complex:
    """A complex number as two Columns and an error."""

    def __init__(self, re: Column, im: Column, error: Column | None = None):
        self.re, self.im, self._error = re, im, error

    @classmethod
    def of(cls, numbers: Column) -> Complex:
        return cls(numbers["re"], numbers["im"], numbers["error"])

    def struct(self) -> Column:
        return F.struct(self.re.alias("re"), self.im.alias("im"), (F.lit(None).cast("string") if self._error is None else self._error).alias("error"))

    def text(self) -> Cell:
        return made(shown(self.re, self.im), [Cell(self.re, self._error)], (F.isnan(self.re) | F.isnan(self.im) | (F.abs(self.re) == float("inf")) | (F.abs(self.im) == float("inf")), NUM))

    def part(self, value: Column, *rules) -> Cell:
        return number(value, [Cell(self.re, self._error)], *rules)


class _Held(Cell):
    """A cell out of a struct that is made once for a row: its value is null already where there is an error."""

    def __init__(self, x: Column, f):
        held = bound(x, lambda v: F.struct(f(v).value.alias("value"), f(v).error.alias("error")))
        super().__init__(held["value"], held["error"])

    @property
    def value(self) -> Column:
        return self.raw


def complex_cell(numbers: Column) -> Cell:
    """The text of a struct as ``parse`` makes it; functions that get this cell go on with the numbers."""
    out = _Held(numbers, lambda v: Complex.of(v).text())
    out.numbers = numbers
    return out


_NUMBER = r"[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def parse(z) -> Column:
    """Real and imaginary part and error, as a struct: from a+bi or a+bj text, a number, or the cell of another of these functions. As a column of its own it is read once for many functions."""
    if isinstance(z, Cell) and (numbers := getattr(z, "numbers", None)) is not None:
        return numbers
    shape = rf"^([-+]?{_NUMBER})??([-+]?(?:{_NUMBER})?)[ij]$"

    def parts(t: Column) -> Column:
        real_only = t.rlike(rf"^[-+]?{_NUMBER}$")
        front, part = F.regexp_extract(t, shape, 1), F.regexp_extract(t, shape, 2)
        re = F.when(real_only, t.try_cast("double")).otherwise(F.coalesce(F.nullif(front, F.lit("")).try_cast("double"), F.lit(0.0)))
        im = F.when(real_only, 0.0).when(part.isin("", "+"), 1.0).when(part == "-", -1.0).otherwise(part.try_cast("double"))
        ok = real_only | (t.rlike(shape) & ((front == "") | part.rlike("^[-+]")))
        return F.struct(re.alias("re"), im.alias("im"), F.when(~ok, F.lit(NUM)).alias("error"))

    return bound(F.trim(raw(z).cast("string")), parts)


def plain(x: Column) -> Column:
    """A double as a cell shows it: no trailing .0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def shown(re: Column, im: Column, suffix: str = "i") -> Column:
    def text(z: Column) -> Column:
        a, b = F.round(z["re"], 12) + 0.0, F.round(z["im"], 12) + 0.0
        imag = F.when(b == 1, suffix).when(b == -1, f"-{suffix}").otherwise(F.concat(plain(b), F.lit(suffix)))
        return F.when(b == 0, plain(a)).when(a == 0, imag).otherwise(F.concat(plain(a), F.when(b > 0, "+").otherwise(""), imag))

    return bound(F.struct(re.alias("re"), im.alias("im")), text)


def COMPLEX(re, im, suffix: str = "i"):
    out = made(shown(num(re), num(im), suffix), [re, im], *([] if suffix in "ij" else [(F.lit(True), VALUE)]))
    out.numbers = Complex(num(re), num(im), out.error).struct()
    return out


def _real(f):
    """A function from a complex number to a cell; the number is read once for a row."""
    return lambda z: _Held(parse(z), lambda v: f(Complex.of(v)))


def _complex(f):
    """A function from complex numbers to one; each is read once for a row."""

    def run(*zs) -> Cell:
        given = F.struct(*[parse(z).alias(f"z{i}") for i, z in enumerate(zs)])
        return complex_cell(bound(given, lambda v: f(*[Complex.of(v[f"z{i}"]) for i in range(len(zs))]).struct()))

    return run


def _both(a: Complex, b: Complex) -> Column:
    return F.coalesce(a._error, b._error)


IMREAL, IMAGINARY = _real(lambda z: z.part(z.re)), _real(lambda z: z.part(z.im))
IMABS = _real(lambda z: z.part(F.hypot(z.re, z.im)))
IMARGUMENT = _real(lambda z: z.part(F.atan2(z.im, z.re), ((z.re == 0) & (z.im == 0), "#DIV/0!")))
IMCONJUGATE = _complex(lambda z: Complex(z.re, -z.im, z._error))


def _cos(z: Complex) -> Complex:
    return Complex(F.cos(z.re) * F.cosh(z.im), -F.sin(z.re) * F.sinh(z.im), z._error)


def _sin(z: Complex) -> Complex:
    return Complex(F.sin(z.re) * F.cosh(z.im), F.cos(z.re) * F.sinh(z.im), z._error)


def _cosh(z: Complex) -> Complex:
    return Complex(F.cosh(z.re) * F.cos(z.im), F.sinh(z.re) * F.sin(z.im), z._error)


def _sinh(z: Complex) -> Complex:
    return Complex(F.sinh(z.re) * F.cos(z.im), F.cosh(z.re) * F.sin(z.im), z._error)


def _times(a: Complex, b: Complex) -> Complex:
    return Complex(a.re * b.re - a.im * b.im, a.re * b.im + a.im * b.re, _both(a, b))


def _over(a: Complex, b: Complex) -> Complex:
    size = b.re * b.re + b.im * b.im
    divide = lambda x: F.when(size != 0, x / size)
    return Complex(divide(a.re * b.re + a.im * b.im), divide(a.im * b.re - a.re * b.im), F.coalesce(_both(a, b), F.when(size == 0, F.lit(NUM))))


def _one() -> Complex:
    return Complex(F.lit(1.0), F.lit(0.0), F.lit(None).cast("string"))


def _log(z: Complex, scale: float = 1.0) -> Complex:
    zero = (z.re == 0) & (z.im == 0)
    return Complex(F.when(~zero, F.ln(F.hypot(z.re, z.im)) * scale), F.when(~zero, F.atan2(z.im, z.re) * scale), F.coalesce(z._error, F.when(zero, F.lit(NUM))))


IMCOS, IMSIN, IMCOSH, IMSINH = map(_complex, (_cos, _sin, _cosh, _sinh))
IMTAN, IMCOT = _complex(lambda z: _over(_sin(z), _cos(z))), _complex(lambda z: _over(_cos(z), _sin(z)))
IMSEC, IMCSC = _complex(lambda z: _over(_one(), _cos(z))), _complex(lambda z: _over(_one(), _sin(z)))
IMSECH, IMCSCH = _complex(lambda z: _over(_one(), _cosh(z))), _complex(lambda z: _over(_one(), _sinh(z)))
IMEXP = _complex(lambda z: Complex(F.exp(z.re) * F.cos(z.im), F.exp(z.re) * F.sin(z.im), z._error))
IMLN, IMLOG10, IMLOG2 = _complex(_log), _complex(lambda z: _log(z, 1 / math.log(10))), _complex(lambda z: _log(z, 1 / math.log(2)))


def _power(z: Complex, n: Column) -> Complex:
    size, angle = F.pow(F.hypot(z.re, z.im), n), F.atan2(z.im, z.re) * n
    return Complex(size * F.cos(angle), size * F.sin(angle), z._error)


IMSQRT = _complex(lambda z: _power(z, F.lit(0.5)))


def IMPOWER(z, n):
    return _complex(lambda v: _power(v, num(n)))(z)


IMSUM = _complex(lambda a, b: Complex(a.re + b.re, a.im + b.im, _both(a, b)))
IMSUB = _complex(lambda a, b: Complex(a.re - b.re, a.im - b.im, _both(a, b)))
IMPRODUCT, IMDIV = _complex(_times), _complex(_over)

# units: fixed factors to the first unit of each kind

UNITS = {
    "mass": {"g": 1.0, "sg": 14593.9029372064, "lbm": 453.59237, "u": 1.660538782e-24, "ozm": 28.349523125, "grain": 0.06479891, "cwt": 45359.237, "uk_cwt": 50802.34544, "stone": 6350.29318, "ton": 907184.74, "uk_ton": 1016046.9088},
    "distance": {"m": 1.0, "mi": 1609.344, "Nmi": 1852.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "ang": 1e-10, "ell": 1.143, "ly": 9.46073047258e15, "parsec": 3.08567758128155e16, "Picapt": 0.0254 / 72, "pica": 0.0254 / 6, "survey_mi": 1609.347218694},
    "time": {"sec": 1.0, "s": 1.0, "min": 60.0, "mn": 60.0, "hr": 3600.0, "day": 86400.0, "d": 86400.0, "yr": 31557600.0},
    "pressure": {"Pa": 1.0, "p": 1.0, "atm": 101325.0, "at": 101325.0, "mmHg": 133.322, "psi": 6894.757293168, "Torr": 101325 / 760},
    "force": {"N": 1.0, "dyn": 1e-5, "dy": 1e-5, "lbf": 4.4482216152605, "pond": 0.00980665},
    "energy": {"J": 1.0, "e": 1e-7, "c": 4.184, "cal": 4.1868, "eV": 1.602176487e-19, "ev": 1.602176487e-19, "HPh": 2684519.53769617, "hh": 2684519.53769617, "Wh": 3600.0, "wh": 3600.0, "flb": 1.3558179483314, "BTU": 1055.05585262, "btu": 1055.05585262},
    "power": {"W": 1.0, "w": 1.0, "HP": 745.69987158227, "h": 745.69987158227, "PS": 735.49875},
    "magnetism": {"T": 1.0, "ga": 1e-4},
    "volume": {"l": 1.0, "L": 1.0, "lt": 1.0, "tsp": 0.00492892159375, "tspm": 0.005, "tbs": 0.01478676478125, "oz": 0.0295735295625, "cup": 0.2365882365, "pt": 0.473176473, "us_pt": 0.473176473, "uk_pt": 0.56826125, "qt": 0.946352946, "uk_qt": 1.1365225, "gal": 3.785411784, "uk_gal": 4.54609, "m3": 1000.0, "in3": 0.016387064, "ft3": 28.316846592, "yd3": 764.554857984, "barrel": 158.987294928, "bushel": 35.23907016688},
    "area": {"m2": 1.0, "uk_acre": 4046.8564224, "us_acre": 4046.87260987425, "ha": 10000.0, "ar": 100.0, "ft2": 0.09290304, "in2": 0.00064516, "yd2": 0.83612736, "mi2": 2589988.110336, "Morgen": 2500.0},
    "information": {"bit": 1.0, "byte": 8.0},
    "speed": {"m/s": 1.0, "m/sec": 1.0, "m/h": 1 / 3600, "m/hr": 1 / 3600, "mph": 0.44704, "kn": 1852 / 3600, "admkn": 0.514773333333333},
}
PREFIXES = {"Y": 24, "Z": 21, "E": 18, "P": 15, "T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "da": 1, "e": 1, "d": -1, "c": -2, "m": -3, "u": -6, "n": -9, "p": -12, "f": -15, "a": -18, "z": -21, "y": -24}
BINARY = {"ki": 10, "Mi": 20, "Gi": 30, "Ti": 40, "Pi": 50, "Ei": 60, "Zi": 70, "Yi": 80}
#: Units that take a decimal prefix.
METRIC = frozenset("g u m ang ly parsec sec s Pa p atm at mmHg N dyn dy pond J e c cal eV ev Wh wh W w T ga l L lt m2 ar m3 bit byte m/s m/sec m/h m/hr".split())
TEMPERATURES = {"C": (1.0, 273.15), "cel": (1.0, 273.15), "F": (5 / 9, 459.67 * 5 / 9), "fah": (5 / 9, 459.67 * 5 / 9), "K": (1.0, 0.0), "kel": (1.0, 0.0), "Rank": (5 / 9, 0.0), "Reau": (1.25, 273.15)}


def unit(name: str) -> tuple[str, float] | None:
    for kind, units in UNITS.items():
        if name in units:
            return kind, units[name]
    for prefix, power in sorted(PREFIXES.items(), key=lambda p: -len(p[0])):
        rest = name[len(prefix) :]
        if name.startswith(prefix) and rest in METRIC:
            kind = next(k for k, u in UNITS.items() if rest in u)
            return kind, 10.0 ** (power * {"m2": 2, "m3": 3}.get(rest, 1)) * UNITS[kind][rest]
    for prefix, power in BINARY.items():
        if name.startswith(prefix) and name[2:] in UNITS["information"]:
            return "information", 2.0**power * UNITS["information"][name[2:]]
    return None


def CONVERT(n, source: str, target: str):
    """Between two units of a kind, given as constants; #N/A where they are of different kinds or unknown."""
    if source in TEMPERATURES and target in TEMPERATURES:
        (a, b), (c, d) = TEMPERATURES[source], TEMPERATURES[target]
        return number((num(n) * a + b - d) / c, [n])
    one, two = unit(source), unit(target)
    if not one or not two or one[0] != two[0]:
        return made(F.lit(None).cast("double"), [n], (F.lit(True), NA))
    return number(num(n) * one[1] / two[1], [n])
