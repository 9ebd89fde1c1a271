"""Operators on cells, error criteria, times as serials, rates beyond the usual, null groups."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridspan.cells import DIV, NA, NIMPL, NUM, VALUE, Cell, cell, constant_error
from gridspan.functions import dates as DT
from gridspan.functions import engineering as E
from gridspan.functions import financial as FI
from gridspan.functions import logical as L
from gridspan.functions import math as M
from gridspan.functions import stats as S
from gridspan.functions import text as X
from gridspan.operators import criteria as C
from gridspan.operators import formatting as CF


def shown(spark, *cells):
    row = spark.range(1).select(*[c.shown().alias(f"c{i}") for i, c in enumerate(map(cell, cells))]).first()
    return list(row)


def test_operators_on_cells(spark):
    a, b, zero, text, err, empty = cell(6), cell(4.0), cell(0), cell(F.lit("x")), constant_error(NA), cell(F.lit(None).cast("string"))
    assert shown(spark, a + b, a - 1, 2 * b, a / b, a / zero, a**2, zero ** cell(0), -a, a.percent()) == ["10.0", "5.0", "8.0", "1.5", DIV, "36.0", NUM, "-6.0", "0.06"]
    assert shown(spark, a + text, cell(F.lit("3")) + 1, a + err, err / zero, (a / zero) + err, empty + 2, 1 - a, 12 / a) == [VALUE, "4.0", NA, NA, DIV, "2.0", "-5.0", "2.0"]
    assert shown(spark, a & b, text & a & cell(True), empty & "z", err & a) == ["64", "x6TRUE", "z", NA]
    assert shown(spark, a < b, a >= b, cell(99) < text, text < cell(True), cell(F.lit("A")).eq("a"), cell(F.lit("A")).ne("b"), err < a, a > zero / zero) == ["false", "true", "true", "true", "true", "true", NA, DIV]
    assert shown(spark, empty.eq(0), empty.eq(""), cell(F.lit("5")).eq(5)) == ["true", "true", "false"]


def test_error_criteria_and_rules(spark):
    df = spark.createDataFrame([(1.0, None), (None, "#N/A"), (None, "#DIV/0!"), (2.0, None)], "v double, e string")
    count = lambda *w: df.agg(C.COUNTIFS(*w)).first()[0]
    assert count(("e", "err", "#N/A")) == 1 and count(("e", "err", "#n/a")) == 1 and count(("e", "err", "<>#N/A")) == 3 and count(("e", "err", "x")) == 0
    assert count(("v", "num", "#N/A")) == 0 and count(("v", "num", "<>#N/A")) == 4
    found = df.select(CF.errors(Cell(F.col("v"), F.col("e"))).alias("a"), CF.errors(Cell(F.col("v"), F.col("e")), False).alias("b")).collect()
    assert [r.a for r in found] == [False, True, True, False] and all(r.a != r.b for r in found)
    assert shown(spark, L.ERROR_TYPE(S.FORECAST_ETS()), L.ERROR_TYPE(cell(1))) == ["102", NA] and shown(spark, S.FORECAST_ETS()) == [NIMPL]


def test_times_as_serials_and_texts(spark):
    at = F.lit(datetime.datetime(2024, 5, 6, 13, 14, 15)).cast("timestamp_ntz")
    assert shown(spark, DT.HOUR(0.75), DT.MINUTE(0.75), DT.SECOND(0.75), DT.HOUR(45000.999988426), DT.SECOND(45000.999988426)) == ["18", "0", "0", "23", "59"]
    assert shown(spark, DT.HOUR(at), DT.MINUTE(at), DT.SECOND(at), DT.HOUR(-1.5), DT.MINUTE(F.lit("2011-07-18 06:45:10")), DT.SECOND(F.lit("no time"))) == ["13", "14", "15", NUM, "45", VALUE]
    assert shown(spark, DT.HOUR(F.lit(datetime.date(2024, 1, 1))), DT.HOUR(45000), DT.HOUR(F.lit(None).cast("double"))) == ["0", "0", None]


def test_asc_and_let(spark):
    assert shown(spark, X.ASC(F.lit("ＡＢｃ　１２～！é漢"))) == ["ABc 12~!é漢"]
    assert shown(spark, L.LET(3, lambda x: x * 2, lambda x, y: x + y), L.LET(5, lambda x: M.SQRT(x - 9), lambda x, y: y + x)) == ["9.0", NUM]


def test_rate_of_annuities(spark):
    got = shown(spark, FI.RATE(10, -2000, 1000), FI.RATE(48, -200, 8000), FI.RATE(1, 0, -1, 20), FI.RATE(12, 100, 100), FI.RATE(10, -100, 1000, 0, 0, -1.0), FI.RATE(10, -100, 1000), FI.RATE(5, 0, -100, 1e6))
    assert float(got[0]) == pytest.approx(1.99996612, abs=1e-6) and float(got[1]) == pytest.approx(0.0077014725, abs=1e-8) and float(got[2]) == pytest.approx(19.0, rel=1e-6)
    assert got[3] == NUM and got[4] == VALUE and float(got[5]) == pytest.approx(0, abs=1e-6) and float(got[6]) == pytest.approx(1e4 ** 0.2 - 1, rel=1e-6)


def test_rates_of_return_anywhere_and_null_groups(spark):
    flows = [("big", 0, -1.0), ("big", 1, 20.0), ("lost", 0, -100.0), ("lost", 1, 0.001), ("none", 0, 5.0), ("none", 1, 5.0), (None, 0, -100.0), (None, 1, 110.0)]
    flows += [("long", i, -1000.0 if i == 0 else 10.0) for i in range(361)] + [("late", i + 30, v) for i, v in enumerate((-100.0, 60.0, 60.0))] + [("zero", 0, 0.0)]
    df = spark.createDataFrame(flows, "g string, i int, v double")
    irr = {r.g: r.rate for r in FI.IRR(df, "v", "i", ["g"]).collect()}
    assert irr["big"] == pytest.approx(19) and irr["lost"] == pytest.approx(-0.99999) and irr["none"] is None and irr["zero"] is None and irr[None] == pytest.approx(0.1)
    assert irr["late"] == pytest.approx(0.1306623863) and irr["long"] == pytest.approx(0.0097, abs=2e-4)
    dated = df.withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i") * 365))
    xirr = {r.g: r.rate for r in FI.XIRR(dated, "v", "d", ["g"]).collect()}
    assert xirr[None] == pytest.approx(0.1) and set(xirr) == set(irr)
    dev = {r.g: r.avedev for r in S.avedev(df, "v", ["g"]).collect()}
    assert dev[None] == 105 and dev["none"] == 0


def test_regression_keeps_its_digits_and_reports_dependent_terms(spark):
    rows = [(1e8 + x, 3.0 * x - 2 * z + 7 + e, float(z), 2.0 * z) for x, z, e in ((1, 4, 0.5), (2, 2, -0.5), (3, 9, 0.25), (4, 1, 0.0), (5, 5, -0.25), (6, 2, 0.125))]
    df = spark.createDataFrame(rows, "x double, y double, z double, w double")
    far, near = S.linest(df, "y", ["x", "z"]), S.linest(df.withColumn("x", F.col("x") - 1e8), "y", ["x", "z"])
    for name in ("x", "z"):
        assert far["coefficients"][name] == pytest.approx(near["coefficients"][name], rel=1e-9) and far["errors"][name] == pytest.approx(near["errors"][name], rel=1e-9)
    assert near["f"] == pytest.approx(near["ss_reg"] / 2 / (near["ss_resid"] / 3)) and near["df"] == 3 and near["error"] is None
    through = S.linest(df, "y", ["z"], constant=False)
    assert through["coefficients"]["z"] == pytest.approx(sum(r[1] * r[2] for r in rows) / sum(r[2] ** 2 for r in rows)) and through["df"] == 5
    assert S.linest(df, "y", ["z", "w"])["error"] == NUM and S.linest(df.where("x < 0"), "y", ["x"])["error"] == NUM
    assert S.trend(df, "y", ["z", "w"], df.select("z", "w")).where("y IS NOT NULL").count() == 0


def test_coupons_and_yields_of_many_bonds(spark):
    """Dates by stepping back from maturity, also from a month's end; yields at rates that prices were made of, without a loop of expressions for each row."""
    import calendar

    def back(m, months):
        y, k = divmod(m.year * 12 + m.month - 1 - months, 12)
        last = calendar.monthrange(y, k + 1)[1]
        return datetime.date(y, k + 1, last if m.day == calendar.monthrange(m.year, m.month)[1] else min(m.day, last))

    matures = [datetime.date(2024, 2, 29), datetime.date(2025, 2, 28), datetime.date(2026, 8, 31), datetime.date(2025, 8, 30), datetime.date(2025, 3, 15)]
    rows = [(m - datetime.timedelta(days=k), m, y / 50) for m in matures for y, k in enumerate(range(1, 1500, 37))]
    df = spark.createDataFrame(rows, "s date, m date, y double")
    for frequency in (1, 2, 4):
        price = FI.PRICE(F.col("s"), F.col("m"), 0.05, F.col("y"), 100, frequency, 3).value
        cells = {"n": FI.COUPNUM(F.col("s"), F.col("m"), frequency), "p": FI.COUPPCD(F.col("s"), F.col("m"), frequency), "q": FI.COUPNCD(F.col("s"), F.col("m"), frequency), "yield": FI.YIELD(F.col("s"), F.col("m"), 0.05, price, 100, frequency, 3)}
        out = df.select("s", "m", "y", *[c.value.alias(k) for k, c in cells.items()])
        assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
        for r in out.collect():
            n = next(k for k in range(1, 999) if back(r.m, k * 12 // frequency) <= r.s)
            assert (r.n, r.p, r.q) == (n, back(r.m, n * 12 // frequency), back(r.m, (n - 1) * 12 // frequency)) and r["yield"] == pytest.approx(r.y, abs=1e-9)
    assert shown(spark, FI.YIELD(F.lit("2008-02-15"), F.lit("2016-11-15"), 0.05, F.lit(None).cast("double"))) == [None]


def test_complex_numbers_are_read_once(spark):
    """A chain of functions mentions its text once or twice, not once for each use of a part; errors and values stay."""
    z = F.col("z")
    df = spark.createDataFrame([("3+4i",), ("-i",), ("x",), ("0",), (None,), ("1e308+1e308i",)], "z string")
    cells = {"product": E.IMPRODUCT(z, F.lit("1+i")), "over": E.IMREAL(E.IMDIV(E.IMSUM(z, z), z)), "root": E.IMABS(E.IMSQRT(E.IMPOWER(z, 2))), "ln": E.IMLN(z), "squared": E.IMPRODUCT(z, z)}
    out = df.select(*[c.shown().alias(k) for k, c in cells.items()])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("trim(z") <= 18
    got = {k: [r[k] for r in out.collect()] for k in cells}
    assert got["product"] == ["-1+7i", "1-i", NUM, "0", None, NUM]
    assert [g if g in (NUM, None) else round(float(g), 9) for g in got["over"][:5]] == [2, 2, NUM, NUM, None]
    assert [g if g in (NUM, None) else round(float(g), 9) for g in got["root"][:5]] == [5, 1, NUM, 0, None]
    assert got["ln"][2:5] == [NUM, NUM, None] and got["squared"][5] == NUM
