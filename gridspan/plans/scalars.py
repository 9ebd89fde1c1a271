"""Scalar families, one select each: mathematics, text, dates, logic, number bases, bits, complex numbers, units."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import engineering as E
from ..functions import logical as L
from ..functions import math as M
from ..functions import text as X
from .common import r, select, spread, table


def math_basic(spark, sf):
    p = table(spark, sf, "part")
    x, a = F.col("p_size").cast("double"), F.col("p_retailprice")
    unit = x / 60
    one = {n: f(x / 10) for n, f in (("abs", M.ABS), ("cos", M.COS), ("sin", M.SIN), ("tan", M.TAN), ("cosh", M.COSH), ("sinh", M.SINH), ("tanh", M.TANH), ("exp", M.EXP), ("atan", M.ATAN), ("asinh", M.ASINH), ("radians", M.RADIANS), ("degrees", M.DEGREES), ("sign", M.SIGN), ("int", M.INT), ("ln", M.LN), ("log10", M.LOG10), ("sqrt", M.SQRT), ("sqrtpi", M.SQRTPI), ("sec", M.SEC), ("csc", M.CSC), ("sech", M.SECH), ("csch", M.CSCH), ("cot", M.COT), ("coth", M.COTH), ("acot", M.ACOT))}
    one |= {"asin": M.ASIN(unit), "acos": M.ACOS(unit), "atanh": M.ATANH(unit), "acosh": M.ACOSH(x + 1), "acoth": M.ACOTH(x + 1), "atan2": M.ATAN2(x, a), "log": M.LOG(a, 3), "power": M.POWER(x, 1.5)}
    return p.select("p_partkey", *[r(c, 6).alias(n) for n, c in one.items()])


def math_rounding(spark, sf):
    p = table(spark, sf, "part")
    v = (F.col("p_retailprice") - 1400) * 1.37
    s = F.col("p_size").cast("double")
    cells = {
        "round": M.ROUND(v, 1), "round_neg": M.ROUND(v, -2), "roundup": M.ROUNDUP(v, 0), "rounddown": M.ROUNDDOWN(v, 1), "trunc": M.TRUNC(v), "even": M.EVEN(v), "odd": M.ODD(v),
        "ceiling": M.CEILING(F.abs(v), 7), "floor": M.FLOOR(F.abs(v), 7), "ceiling_math": M.CEILING_MATH(v, 5), "ceiling_mode": M.CEILING_MATH(v, 5, 1), "floor_math": M.FLOOR_MATH(v, 5), "floor_mode": M.FLOOR_MATH(v, 5, 1),
        "ceiling_precise": M.CEILING_PRECISE(v, 3), "floor_precise": M.FLOOR_PRECISE(v, 3), "mod": M.MOD(F.floor(v), 7), "mod_neg": M.MOD(F.floor(v), -7), "quotient": M.QUOTIENT(F.floor(v), s + 1), "mround": M.MROUND(F.floor(v), F.signum(F.floor(v)) * 4),
    }
    return p.select("p_partkey", *[r(c).alias(n) for n, c in cells.items()])


def math_whole(spark, sf):
    p = table(spark, sf, "part")
    n = F.col("p_size")
    cells = {
        "fact": M.FACT(n % 15), "factdouble": M.FACTDOUBLE(n % 15), "combin": M.COMBIN(n, F.lit(3)), "combina": M.COMBINA(n, F.lit(2)), "gcd": M.GCD(n * 6, F.lit(84)), "lcm": M.LCM(n + 1, F.lit(12)),
        "multinomial": M.MULTINOMIAL(n % 4, F.lit(2), F.lit(3)), "seriessum": M.SERIESSUM(F.lit(0.5), F.lit(0), F.lit(2), [1, -0.5, n / 100]), "decimal": M.DECIMAL(F.concat(F.lit("1"), (n % 8).cast("string")), 8), "arabic": M.ARABIC(M.ROMAN(n + 400).raw),
    }
    return p.select("p_partkey", *[r(c).alias(k) for k, c in cells.items()], M.BASE(n, 2, 8).value.alias("base"), M.CHOOSE(n % 3 + 1, "a", "b", "c").value.alias("choose"))


def math_errors(spark, sf):
    n = table(spark, sf, "part").select("p_partkey", (F.col("p_size") - 25).cast("double").alias("v"))
    v = F.col("v")
    errors = {"sqrt": M.SQRT(v), "ln": M.LN(v), "mod": M.MOD(F.lit(3.0), v), "fact": M.FACT(v), "nested": M.SQRT(M.LN(v)), "acos": M.ACOS(v), "power": M.POWER(v, v)}
    return n.select("p_partkey", *[c.error.alias(k) for k, c in errors.items()], F.round(L.IFERROR(M.SQRT(v), -1.0).value, 6).alias("iferror"), L.ERROR_TYPE(M.LN(v)).value.alias("error_type"))


def text_basic(spark, sf):
    p = table(spark, sf, "part")
    t = F.col("p_name")
    return select(
        p, ["p_partkey"], concat=X.CONCAT(t, "-", F.col("p_brand")), len=X.LEN(t), lower=X.LOWER(t), upper=X.UPPER(t), left=X.LEFT(t, 3), right=X.RIGHT(t, 4), mid=X.MID(t, 2, 3), rept=X.REPT(F.left(t, F.lit(2)), 3),
        trim=X.TRIM(F.concat(F.lit("  "), t, F.lit("  x "))), exact=X.EXACT(t, F.lower(t)), find=X.FIND("a", t), search=X.SEARCH("A", t), substitute=X.SUBSTITUTE(t, "a", "_"), second=X.SUBSTITUTE(t, "a", "_", 2), replace=X.REPLACE(t, 2, 3, "##"),
        test=X.REGEXTEST(t, "^[a-m]"), extract=X.REGEXEXTRACT(t, "([a-z]+)$"), regexreplace=X.REGEXREPLACE(t, "[aeiou]", ""), before=X.TEXTBEFORE(t, " "), after=X.TEXTAFTER(t, " "), join=X.TEXTJOIN("/", True, t, "", F.col("p_type")), code=X.CODE(t), clean=X.CLEAN(F.concat(t, F.lit("\x07\n"))),
        fixed=X.FIXED(F.col("p_retailprice"), 1), dollar=X.DOLLAR(F.col("p_retailprice") - 1000, 2), unichar=X.UNICHAR(F.col("p_size") + 960), value=X.VALUE_(F.concat(F.lit("$1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(".5"))), numbervalue=X.NUMBERVALUE(F.concat(F.col("p_size").cast("string"), F.lit(",5%")), ",", "."),
    )


def text_formats(spark, sf):
    p = table(spark, sf, "part")
    v = F.col("p_retailprice") - 1000
    return select(
        p, ["p_partkey"], plain=X.TEXT(v, "0.00"), grouped=X.TEXT(v * 1000, "#,##0"), percent=X.TEXT(F.col("p_size") / 80, "0.0%"), padded=X.TEXT(F.col("p_size"), "00000"), sections=X.TEXT(F.col("p_size") - 25, '0"+";0"-";"zero"'), optional=X.TEXT(F.col("p_size") / 4, "0.##"),
        day=X.TEXT(F.col("p_size") + 45000, "yyyy-mm-dd"), month=X.TEXT(F.col("p_size") * 11 + 45000, "d mmm yy"),
    )


def text_split(spark, sf):
    d = table(spark, sf, "pages")
    parts = d.select("page_id", F.posexplode(X.TEXTSPLIT(F.col("url"), "/", ignore_empty=True).raw).alias("place", "part"))
    return parts.select("page_id", F.col("place").cast("long").alias("place"), "part")


def text_join_groups(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(X.TEXTJOIN_ALL(F.col("n_name"), F.col("n_nationkey"), ", ").alias("names"))


def date_parts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), (F.col("o_custkey") % 40 - 20).cast("int").alias("k"))
    d, k = F.col("d"), F.col("k")
    return select(
        o, ["o_orderkey"], day=D.DAY(d), month=D.MONTH(d), year=D.YEAR(d), edate=D.EDATE(d, k).value.cast("string"), eomonth=D.EOMONTH(d, k).value.cast("string"), serial=F.datediff(d, F.expr("DATE'1899-12-30'")), weekday=D.WEEKDAY(d), weekday2=D.WEEKDAY(d, 2), weekday3=D.WEEKDAY(d, 3), weekday12=D.WEEKDAY(d, 12),
        weeknum=D.WEEKNUM(d), weeknum2=D.WEEKNUM(d, 2), iso=D.ISOWEEKNUM(d), days=D.DAYS(d, F.expr("DATE'1995-01-01'")), date=D.DATE(F.year(d), F.month(d) + 14, F.dayofmonth(d) - 40).value.cast("string"), value=D.DATEVALUE(F.date_format(d, "MM/dd/yyyy")), time=F.round(D.TIME(k + 30, 90, 15).value, 8), timevalue=F.round(D.TIMEVALUE(F.lit("6:45 PM")).value, 8),
    )


HOLIDAYS = (datetime.date(1995, 1, 2), datetime.date(1995, 7, 4), datetime.date(1995, 7, 8), datetime.date(1996, 12, 25))


def date_workdays(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.expr("DATE'1995-06-15'").alias("e"))
    return select(
        o, ["o_orderkey"], networkdays=D.NETWORKDAYS(F.col("d"), F.col("e"), HOLIDAYS), masked=D.NETWORKDAYS_INTL(F.col("d"), F.col("e"), 7, HOLIDAYS), days360=D.DAYS360(F.col("d"), F.col("e")), european=D.DAYS360(F.col("d"), F.col("e"), True),
        workday=D.WORKDAY(F.col("d"), 10, HOLIDAYS).value.cast("string"), workday_back=D.WORKDAY(F.col("d"), -7, HOLIDAYS).value.cast("string"), years=D.DATEDIF(F.least("d", "e"), F.greatest("d", "e"), "Y"), months=D.DATEDIF(F.least("d", "e"), F.greatest("d", "e"), "M"),
        basis2=F.round(D.YEARFRAC(F.col("d"), F.col("e"), 2).value, 8), basis3=F.round(D.YEARFRAC(F.col("d"), F.col("e"), 3).value, 8),
    )


def logic(spark, sf):
    p = table(spark, sf, "part")
    n, big = F.col("p_size"), F.col("p_retailprice") > 1400
    return select(
        p, ["p_partkey"], **{"and": L.AND(n > 10, big)}, **{"or": L.OR(n > 40, big)}, xor=L.XOR(n > 25, big), **{"not": L.NOT(big)}, **{"if": L.IF(big, "high", "low")}, ifs=L.IFERROR(L.IFS(n > 40, "a", n > 20, "b"), "none"), switch=L.SWITCH(n % 4, 0, "zero", 1, "one", "many"),
        ifna=L.IFNA(L.IFS(n > 40, 1), 0), let=L.LET(M.MOD(n, 7), lambda m: M.POWER(m, 2)), even=L.ISEVEN(n), odd=L.ISODD(n), number=L.ISNUMBER(n), text=L.ISTEXT(F.col("p_name")), error=L.ISERROR(M.SQRT(n - 25)), na=L.ISNA(L.IFS(n > 40, 1)), type=L.TYPE(F.col("p_name")),
    )


def logic_aggregates(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(L.AND_ALL(F.col("p_size") > 1).alias("all"), L.OR_ALL(F.col("p_size") > 49).alias("any"), L.XOR_ALL(F.col("p_size") > 25).alias("odd"))


def higher_order(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    a = F.col("a")
    return e.select(
        "vec_id", F.round(L.REDUCE(F.lit(0.0), a, lambda s, x: s + x * x).value, 5).alias("reduce"), F.transform(L.SCAN(F.lit(0.0), a, lambda s, x: s + x).value, lambda x: F.round(x, 5)).alias("scan"),
        F.transform(L.MAP(lambda x, y: x * y, a, F.reverse(a)).value, lambda x: F.round(x, 5)).alias("map"), F.round(L.BYROW([F.get(a, 0), F.get(a, 1)], lambda row: F.array_max(row)), 5).alias("byrow"),
    )


def number_bases(spark, sf):
    p = table(spark, sf, "part")
    n = F.col("p_size") - 20
    return select(
        p, ["p_partkey"], bin=E.DEC2BIN(n), bin8=E.DEC2BIN(F.abs(n), 8), oct=E.DEC2OCT(n), hex=E.DEC2HEX(n), back=E.BIN2DEC(E.DEC2BIN(n).raw), hexback=E.HEX2DEC(E.DEC2HEX(n).raw), octhex=E.OCT2HEX(E.DEC2OCT(F.abs(n)).raw), binoct=E.BIN2OCT(E.DEC2BIN(F.abs(n)).raw),
        bitand=E.BITAND(F.col("p_size"), 12), bitor=E.BITOR(F.col("p_size"), 12), bitxor=E.BITXOR(F.col("p_size"), 12), lshift=E.BITLSHIFT(F.col("p_size"), 3), rshift=E.BITRSHIFT(F.col("p_size"), 2), delta=E.DELTA(n, 5), gestep=E.GESTEP(n, 5),
    )


def complex_numbers(spark, sf):
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size")).select("p_partkey", E.COMPLEX(F.col("p_size") - 25, F.col("p_size") % 7 - 3).value.alias("z"))
    p = p.select("p_partkey", "z", E.parse(F.col("z")).alias("numbers"), E.parse(F.lit("3+4i")).alias("other"))
    z, other = E.complex_cell(F.col("numbers")), E.complex_cell(F.col("other"))
    six = lambda c: F.round(c.value, 6)
    return select(
        p, ["p_partkey", "z"], re=E.IMREAL(z), im=E.IMAGINARY(z), abs=six(E.IMABS(z)), conj=E.IMCONJUGATE(z), sum=E.IMSUM(z, other), sub=E.IMSUB(z, other), product=E.IMPRODUCT(z, other),
        div_re=six(E.IMREAL(E.IMDIV(z, other))), square=six(E.IMREAL(E.IMPOWER(z, 2))), root=six(E.IMABS(E.IMSQRT(z))), exp=six(E.IMREAL(E.IMEXP(F.lit("1+i")))),
    )


def unit_conversion(spark, sf):
    p = table(spark, sf, "part")
    x = F.col("p_size")
    pairs = (("mi", "km"), ("lbm", "kg"), ("F", "C"), ("hr", "mn"), ("gal", "l"), ("J", "cal"), ("ha", "m2"), ("kibyte", "bit"), ("mph", "m/s"), ("psi", "Pa"))
    return p.select("p_partkey", *[F.round(E.CONVERT(x, a, b).value, 5).alias(f"{a}_{b}".replace("/", "_")) for a, b in pairs], E.CONVERT(x, "mi", "kg").error.alias("wrong"))


QUERIES = {f.__name__: f for f in (math_basic, math_rounding, math_whole, math_errors, text_basic, text_formats, text_split, text_join_groups, date_parts, date_workdays, logic, logic_aggregates, higher_order, number_bases, complex_numbers, unit_conversion)}

_V = "((p_retailprice - 1400) * 1.37)"
_UP = lambda x, s: f"ceil(round(({x}) / {s}, 6)) * {s}"
_DOWN = lambda x, s: f"floor(round(({x}) / {s}, 6)) * {s}"
_FREE = "('1995-01-02'), ('1995-07-04'), ('1996-12-25')"
ORACLES = {
    "math_basic": """WITH t AS (SELECT p_partkey, p_size::DOUBLE AS x, p_size / 10.0::DOUBLE AS y, p_size / 60.0::DOUBLE AS u, p_retailprice AS a FROM part) SELECT p_partkey, round(abs(y), 6) AS abs, round(cos(y), 6) AS cos, round(sin(y), 6) AS sin, round(tan(y), 6) AS tan,
        round(cosh(y), 6) AS cosh, round(sinh(y), 6) AS sinh, round(tanh(y), 6) AS tanh, round(exp(y), 6) AS exp, round(atan(y), 6) AS atan, round(asinh(y), 6) AS asinh, round(radians(y), 6) AS radians, round(degrees(y), 6) AS degrees, sign(y)::DOUBLE AS sign, floor(y) AS int,
        round(ln(y), 6) AS ln, round(log10(y), 6) AS log10, round(sqrt(y), 6) AS sqrt, round(sqrt(y * pi()), 6) AS sqrtpi, round(1 / cos(y), 6) AS sec, round(1 / sin(y), 6) AS csc, round(1 / cosh(y), 6) AS sech, round(1 / sinh(y), 6) AS csch, round(cos(y) / sin(y), 6) AS cot, round(1 / tanh(y), 6) AS coth,
        round(pi() / 2 - atan(y), 6) AS acot, round(asin(u), 6) AS asin, round(acos(u), 6) AS acos, round(atanh(u), 6) AS atanh, round(acosh(x + 1), 6) AS acosh, round(0.5 * ln((x + 2) / x), 6) AS acoth, round(atan2(a, x), 6) AS atan2, round(ln(a) / ln(3), 6) AS log, round(pow(x, 1.5), 6) AS power FROM t""",
    "math_rounding": f"""WITH t AS (SELECT p_partkey, {_V} AS v, floor({_V}) AS w, p_size::DOUBLE AS s FROM part) SELECT p_partkey, round(sign(v) * floor(round(abs(v) * 10, 6) + 0.5) / 10, 4) AS round, round(sign(v) * floor(round(abs(v) / 100, 6) + 0.5) * 100, 4) AS round_neg,
        sign(v) * ceil(round(abs(v), 6)) AS roundup, round(sign(v) * floor(round(abs(v) * 10, 6)) / 10, 4) AS rounddown, sign(v) * floor(round(abs(v), 6)) AS trunc, sign(v) * ceil(abs(v) / 2) * 2 AS even, CASE WHEN v = 0 THEN 1 ELSE sign(v) * (greatest(ceil((abs(v) - 1) / 2), 0) * 2 + 1) END AS odd,
        {_UP('abs(v)', 7)} AS ceiling, {_DOWN('abs(v)', 7)} AS floor, {_UP('v', 5)} AS ceiling_math, CASE WHEN v < 0 THEN {_DOWN('v', 5)} ELSE {_UP('v', 5)} END AS ceiling_mode, {_DOWN('v', 5)} AS floor_math, CASE WHEN v < 0 THEN {_UP('v', 5)} ELSE {_DOWN('v', 5)} END AS floor_mode,
        {_UP('v', 3)} AS ceiling_precise, {_DOWN('v', 3)} AS floor_precise, w - 7 * floor(w / 7) AS mod, w + 7 * floor(w / -7) AS mod_neg, sign(w) * floor(abs(w / (s + 1))) AS quotient, floor(round(abs(w) / 4, 6) + 0.5) * 4 * sign(w) AS mround FROM t""",
    "math_whole": """SELECT p_partkey, factorial(p_size % 15)::DOUBLE AS fact, (SELECT coalesce(product(i), 1) FROM range(0, 16) r(i) WHERE i <= p_size % 15 AND i > 0 AND i % 2 = (p_size % 15) % 2)::DOUBLE AS factdouble, CASE WHEN p_size >= 3 THEN p_size * (p_size - 1) * (p_size - 2) / 6 END::DOUBLE AS combin,
        (p_size + 1) * p_size / 2::DOUBLE AS combina, gcd(p_size * 6, 84)::DOUBLE AS gcd, lcm(p_size + 1, 12)::DOUBLE AS lcm, round(factorial(p_size % 4 + 5)::DOUBLE / factorial(p_size % 4)::DOUBLE / 12, 4) AS multinomial, round(1 - 0.125 + p_size / 1600.0::DOUBLE, 4) AS seriessum, (8 + p_size % 8)::DOUBLE AS decimal, (p_size + 400)::DOUBLE AS arabic,
        lpad(bin(p_size), greatest(8, length(bin(p_size)))::INTEGER, '0') AS base, ['a', 'b', 'c'][p_size % 3 + 1] AS choose FROM part""",
    "math_errors": """WITH t AS (SELECT p_partkey, p_size - 25.0::DOUBLE AS v FROM part) SELECT p_partkey, CASE WHEN v < 0 THEN '#NUM!' END AS sqrt, CASE WHEN v <= 0 THEN '#NUM!' END AS ln, CASE WHEN v = 0 THEN '#DIV/0!' END AS mod, CASE WHEN v < 0 THEN '#NUM!' END AS fact,
        CASE WHEN v <= 0 THEN '#NUM!' END AS nested, CASE WHEN abs(v) > 1 THEN '#NUM!' END AS acos, CASE WHEN v = 0 THEN '#NUM!' END AS power, CASE WHEN v < 0 THEN -1 ELSE round(sqrt(v), 6) END AS iferror, CASE WHEN v <= 0 THEN 6 END::INTEGER AS error_type FROM t""".replace("sqrt(v), 6)", "sqrt(abs(v)), 6)"),
    "text_basic": """WITH t AS (SELECT *, p_name AS t, string_split(p_name, 'a') AS s FROM part) SELECT p_partkey, t || '-' || p_brand AS concat, length(t)::INTEGER AS len, lower(t) AS lower, upper(t) AS upper, left(t, 3) AS left, right(t, 4) AS right, substr(t, 2, 3) AS mid, repeat(left(t, 2), 3) AS rept, t || ' x' AS trim, t = lower(t) AS exact,
        nullif(instr(t, 'a'), 0)::INTEGER AS find, nullif(instr(lower(t), 'a'), 0)::INTEGER AS search, replace(t, 'a', '_') AS substitute, CASE WHEN len(s) > 2 THEN s[1] || 'a' || s[2] || '_' || array_to_string(s[3:], 'a') ELSE t END AS second, left(t, 1) || '##' || substr(t, 5) AS replace,
        regexp_matches(t, '^[a-m]') AS test, nullif(regexp_extract(t, '([a-z]+)$', 1), '') AS extract, regexp_replace(t, '[aeiou]', '', 'g') AS regexreplace, CASE WHEN contains(t, ' ') THEN split_part(t, ' ', 1) END AS before, CASE WHEN contains(t, ' ') THEN substr(t, instr(t, ' ') + 1) END AS after, t || '/' || p_type AS join, unicode(t)::INTEGER AS code, t AS clean,
        printf('%,.1f', p_retailprice) AS fixed, CASE WHEN p_retailprice < 1000 THEN printf('($%,.2f)', 1000 - p_retailprice) ELSE printf('$%,.2f', p_retailprice - 1000) END AS dollar, chr(p_size + 960) AS unichar, 1000.5 + p_size::DOUBLE AS value, (p_size + 0.5)::DOUBLE / 100 AS numbervalue FROM t""",
    "text_formats": """SELECT p_partkey, printf('%.2f', p_retailprice - 1000) AS plain, printf('%,.0f', (p_retailprice - 1000) * 1000) AS grouped, printf('%.1f%%', round(p_size * 100 / 80.0::DOUBLE, 1)) AS percent, lpad(p_size::VARCHAR, 5, '0') AS padded, CASE WHEN p_size > 25 THEN (p_size - 25) || '+' WHEN p_size < 25 THEN (25 - p_size) || '-' ELSE 'zero' END AS sections,
        rtrim(rtrim(printf('%.2f', p_size / 4.0::DOUBLE), '0'), '.') AS optional, strftime(DATE '1899-12-30' + p_size + 45000, '%Y-%m-%d') AS day, strftime(DATE '1899-12-30' + p_size * 11 + 45000, '%-d %b %y') AS month FROM part""",
    "text_split": "SELECT page_id, unnest(range(len(s))) AS place, unnest(s) AS part FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS s FROM pages)",
    "text_join_groups": "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1",
    "date_parts": """WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, (o_custkey % 40 - 20)::INTEGER AS k FROM orders), u AS (SELECT *, (date_trunc('month', d) + to_months(k))::DATE AS m, date_trunc('year', d)::DATE AS y FROM t)
        SELECT o_orderkey, day(d)::INTEGER AS day, month(d)::INTEGER AS month, year(d)::INTEGER AS year, (d + to_months(k))::DATE::VARCHAR AS edate, last_day(m)::VARCHAR AS eomonth, (d - DATE '1899-12-30')::INTEGER AS serial, (isodow(d) % 7 + 1)::INTEGER AS weekday, isodow(d)::INTEGER AS weekday2, (isodow(d) - 1)::INTEGER AS weekday3, ((isodow(d) + 5) % 7 + 1)::INTEGER AS weekday12,
        (((d - y) + isodow(y) % 7) // 7 + 1)::INTEGER AS weeknum, (((d - y) + isodow(y) - 1) // 7 + 1)::INTEGER AS weeknum2, weekofyear(d)::INTEGER AS iso, (d - DATE '1995-01-01')::INTEGER AS days, ((y + to_months(month(d)::INTEGER + 13))::DATE + (day(d)::INTEGER - 41))::VARCHAR AS date, (d - DATE '1899-12-30')::DOUBLE AS value,
        round((((k + 30) * 3600 + 5415) % 86400) / 86400.0::DOUBLE, 8) AS time, 0.78125::DOUBLE AS timevalue FROM u""",
    "date_workdays": f"""WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, DATE '1995-06-15' AS e, least(o_orderdate::DATE, DATE '1995-06-15') AS a, greatest(o_orderdate::DATE, DATE '1995-06-15') AS b FROM orders),
        c AS (SELECT (DATE '1985-01-01' + i::INTEGER) AS x, isodow(DATE '1985-01-01' + i::INTEGER) AS w FROM range(0, 9000) r(i)), f AS (SELECT h::DATE AS h FROM (VALUES {_FREE}, ('1995-07-08')) v(h)),
        n AS (SELECT x, (w <= 5 AND x NOT IN (SELECT h FROM f))::INTEGER AS w1, (w NOT IN (5, 6) AND x NOT IN (SELECT h FROM f))::INTEGER AS w7 FROM c),
        s AS (SELECT x, w1, sum(w1) OVER (ORDER BY x) AS c1, sum(w7) OVER (ORDER BY x) AS c7 FROM n), k AS (SELECT x, c1 FROM s WHERE w1 = 1)
        SELECT o_orderkey, (CASE WHEN d <= e THEN 1 ELSE -1 END * (sb.c1 - sa.c1))::BIGINT AS networkdays, (CASE WHEN d <= e THEN 1 ELSE -1 END * (sb.c7 - sa.c7))::BIGINT AS masked,
        ((year(e) - year(d)) * 360 + (month(e) - month(d)) * 30 + 15 - CASE WHEN last_day(d) = d THEN 30 ELSE day(d) END)::INTEGER AS days360, ((year(e) - year(d)) * 360 + (month(e) - month(d)) * 30 + 15 - least(day(d), 30))::INTEGER AS european,
        k1.x::VARCHAR AS workday, k2.x::VARCHAR AS workday_back, datesub('year', a, b) AS years, datesub('month', a, b) AS months, round((b - a) / 360.0::DOUBLE, 8) AS basis2, round((b - a) / 365.0::DOUBLE, 8) AS basis3
        FROM t JOIN s sa ON sa.x = a - 1 JOIN s sb ON sb.x = b JOIN s sd ON sd.x = d JOIN s sp ON sp.x = d - 1 JOIN k k1 ON k1.c1 = sd.c1 + 10 JOIN k k2 ON k2.c1 = sp.c1 - 6""",
    "logic": """SELECT p_partkey, p_size > 10 AND b AS "and", p_size > 40 OR b AS "or", (p_size > 25) <> b AS xor, NOT b AS "not", CASE WHEN b THEN 'high' ELSE 'low' END AS "if", CASE WHEN p_size > 40 THEN 'a' WHEN p_size > 20 THEN 'b' ELSE 'none' END AS ifs, CASE p_size % 4 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'many' END AS switch,
        (p_size > 40)::INTEGER AS ifna, CASE WHEN p_size % 7 = 0 THEN 0 ELSE pow(p_size % 7, 2) END AS let, p_size % 2 = 0 AS even, p_size % 2 = 1 AS odd, true AS number, true AS text, p_size < 25 AS error, p_size <= 40 AS na, 2 AS type FROM (SELECT *, p_retailprice > 1400 AS b FROM part)""",
    "logic_aggregates": """SELECT p_brand, bool_and(p_size > 1) AS "all", bool_or(p_size > 49) AS "any", count(*) FILTER (WHERE p_size > 25) % 2 = 1 AS odd FROM part GROUP BY 1""",
    "higher_order": "WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings) SELECT vec_id, round(list_sum(list_transform(a, lambda x: x * x)), 5) AS reduce, list_transform(range(1, len(a) + 1), lambda k: round(list_sum(a[1:k]), 5) + 0.0) AS scan, list_transform(range(1, len(a) + 1), lambda k: round(a[k] * a[len(a) + 1 - k], 5) + 0.0) AS map, round(greatest(a[1], a[2]), 5) AS byrow FROM t",
    "number_bases": """SELECT p_partkey, CASE WHEN n < 0 THEN bin(1024 + n) ELSE bin(n) END AS bin, lpad(bin(abs(n)), 8, '0') AS bin8, CASE WHEN n < 0 THEN printf('%o', 1073741824 + n) ELSE printf('%o', n) END AS oct, CASE WHEN n < 0 THEN hex(1099511627776 + n) ELSE hex(n) END AS hex, n::DOUBLE AS back, n::DOUBLE AS hexback, hex(abs(n)) AS octhex, printf('%o', abs(n)) AS binoct,
        (p_size & 12)::DOUBLE AS bitand, (p_size | 12)::DOUBLE AS bitor, xor(p_size, 12)::DOUBLE AS bitxor, (p_size << 3)::DOUBLE AS lshift, (p_size >> 2)::DOUBLE AS rshift, (n = 5)::INTEGER AS delta, (n >= 5)::INTEGER AS gestep FROM (SELECT *, (p_size - 20)::BIGINT AS n FROM part)""",
    "complex_numbers": """WITH t AS (SELECT p_partkey, (p_size - 25)::BIGINT AS a, (p_size % 7 - 3)::BIGINT AS b FROM part), f AS (SELECT *, [[a, b], [a, -b], [a + 3, b + 4], [a - 3, b - 4], [3 * a - 4 * b, 4 * a + 3 * b]] AS z FROM t),
        g AS (SELECT *, list_transform(z, lambda v: CASE WHEN v[2] = 0 THEN v[1]::VARCHAR ELSE CASE WHEN v[1] = 0 THEN '' ELSE v[1]::VARCHAR || CASE WHEN v[2] > 0 THEN '+' ELSE '' END END || CASE v[2] WHEN 1 THEN '' WHEN -1 THEN '-' ELSE v[2]::VARCHAR END || 'i' END) AS s FROM f)
        SELECT p_partkey, s[1] AS z, a::DOUBLE AS re, b::DOUBLE AS im, round(sqrt(a * a + b * b), 6) AS abs, s[2] AS conj, s[3] AS sum, s[4] AS sub, s[5] AS product, round((3 * a + 4 * b) / 25.0::DOUBLE, 6) AS div_re, round((a * a - b * b)::DOUBLE, 6) AS square, round(sqrt(sqrt(a * a + b * b)), 6) AS root, round(exp(1) * cos(1), 6) AS exp FROM g""",
    "unit_conversion": """SELECT p_partkey, round(x * 1.609344, 5) AS mi_km, round(x * 0.45359237, 5) AS lbm_kg, round((x - 32) * 5 / 9, 5) AS F_C, x * 60 AS hr_mn, round(x * 3.785411784, 5) AS gal_l, round(x / 4.1868, 5) AS J_cal, x * 10000 AS ha_m2, x * 8192 AS kibyte_bit, round(x * 0.44704, 5) AS mph_m_s, round(x * 6894.757293168, 5) AS psi_Pa, '#N/A' AS wrong FROM (SELECT p_partkey, p_size::DOUBLE AS x FROM part)""",
}
