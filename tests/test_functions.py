"""Literal results of functions that SQL doesn't have."""

import datetime
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspan.cells import Cell
from gridspan.functions import distributions as D
from gridspan.functions import engineering as E
from gridspan.functions import financial as FI
from gridspan.functions import logical as L
from gridspan.functions import math as M
from gridspan.functions import text as X
from gridspan.functions.text import pattern_of

d = datetime.date


def values(spark, cells):
    row = spark.range(1).select(*[(c.value if isinstance(c, Cell) else c).alias(f"c{i}") for i, c in enumerate(cells)]).first()
    return list(row)


def check(spark, pairs, tolerance=1e-6):
    got = values(spark, [c for c, _ in pairs])
    for (_, expected), value in zip(pairs, got):
        if isinstance(expected, float):
            assert value == pytest.approx(expected, rel=tolerance, abs=tolerance)
        else:
            assert value == expected


def test_distributions(spark):
    check(spark, [
        (D.NORM_S_DIST(1.333333), 0.908788726), (D.NORM_DIST(42, 40, 1.5), 0.908788780), (D.NORM_INV(0.908789, 40, 1.5), 42.000002), (D.NORM_S_INV(0.975), 1.959963985), (D.T_DIST(60, 1), 0.994695326), (D.T_DIST_2T(1.959999998, 60), 0.054644930),
        (D.T_INV_2T(0.054645, 60), 1.959997), (D.F_DIST(15.20686486, 6, 4), 0.99), (D.F_INV(0.01, 6, 4), 0.10930991), (D.F_INV_RT(0.01, 6, 4), 15.20686486), (D.CHISQ_DIST(0.5, 1), 0.520499878), (D.CHISQ_DIST_RT(18.307, 10), 0.0500006), (D.CHISQ_INV_RT(0.050001, 10), 18.306973),
        (D.GAMMA_DIST(10.00001131, 9, 2), 0.068094), (D.GAMMA_INV(0.068094, 9, 2), 10.0000112), (D.BETA_DIST(2, 8, 10, True, 1, 3), 0.6854706), (D.BETA_INV(0.685470581, 8, 10, 1, 3), 2.0), (D.BINOM_DIST(6, 10, 0.5, False), 0.205078125), (D.BINOM_INV(6, 0.5, 0.75), 4.0),
        (D.NEGBINOM_DIST(10, 5, 0.25), 0.313514058), (D.POISSON_DIST(2, 5), 0.124652), (D.HYPGEOM_DIST(1, 4, 8, 20), 0.363261), (D.HYPGEOM_DIST(1, 4, 8, 20, True), 0.465428), (D.LOGNORM_DIST(4, 3.5, 1.2), 0.0390836), (D.LOGNORM_INV(0.039084, 3.5, 1.2), 4.0000252),
        (D.WEIBULL_DIST(105, 20, 100), 0.929581), (D.EXPON_DIST(0.2, 10), 0.864664717), (D.CONFIDENCE_NORM(0.05, 2.5, 50), 0.692951912), (D.CONFIDENCE_T(0.05, 1, 50), 0.284196855), (D.GAMMA(2.5), 1.329340388), (D.GAMMALN(4), 1.791759469), (D.ERF(0.745), 0.707928920), (D.ERFC(1), 0.157299207),
    ], 2e-5)


def test_bessel(spark):
    check(spark, [(E.BESSELJ(1.9, 2), 0.329925829), (E.BESSELI(1.5, 1), 0.981666428), (E.BESSELK(1.5, 1), 0.277387804), (E.BESSELY(2.5, 1), 0.145918138)])


def test_finance(spark):
    check(spark, [
        (FI.RATE(48, -200, 8000), 0.0077014725), (FI.NPER(0.01, -100, -1000, 10000, 1), 59.6738656743), (FI.PMT(0.08 / 12, 10, 10000), -1037.0320893592), (FI.CUMIPMT(0.09 / 12, 360, 125000, 13, 24), -11135.2321307), (FI.CUMPRINC(0.09 / 12, 360, 125000, 13, 24), -934.1071234),
        (FI.DB(1000000, 100000, 6, 1, 7), 186083.3333333), (FI.DB(1000000, 100000, 6, 7, 7), 15845.0984738), (FI.DDB(2400, 300, 10, 10), 22.1225472), (FI.VDB(2400, 300, 10, 0, 0.875, 1.5), 315.0), (FI.DOLLARDE(1.02, 16), 1.125), (FI.DOLLARFR(1.125, 16), 1.02),
        (FI.PRICE(d(2008, 2, 15), d(2017, 11, 15), 0.0575, 0.065, 100, 2, 0), 94.6343616), (FI.YIELD(d(2008, 2, 15), d(2016, 11, 15), 0.0575, 95.04287, 100, 2, 0), 0.065), (FI.DURATION(d(2018, 7, 1), d(2048, 1, 1), 0.08, 0.09, 2, 1), 10.9191453), (FI.MDURATION(d(2008, 1, 1), d(2016, 1, 1), 0.08, 0.09, 2, 1), 5.7356698),
        (FI.COUPNUM(d(2007, 1, 25), d(2008, 11, 15), 2, 1), 4), (FI.COUPDAYBS(d(2011, 1, 25), d(2011, 11, 15), 2, 1), 71.0), (FI.COUPDAYS(d(2011, 1, 25), d(2011, 11, 15), 2, 1), 181.0), (FI.COUPDAYSNC(d(2011, 1, 25), d(2011, 11, 15), 2, 1), 110.0), (FI.COUPNCD(d(2011, 1, 25), d(2011, 11, 15), 2, 1), d(2011, 5, 15)),
        (FI.AMORLINC(2400, d(2008, 8, 19), d(2008, 12, 31), 300, 1, 0.15, 1), 360.0), (FI.AMORDEGRC(2400, d(2008, 8, 19), d(2008, 12, 31), 300, 1, 0.15, 1), 776.0), (FI.TBILLEQ(d(2008, 3, 31), d(2008, 6, 1), 0.0914), 0.0941514936), (FI.ODDLPRICE(d(2008, 2, 7), d(2008, 6, 15), d(2007, 10, 15), 0.0375, 0.0405, 100, 2, 0), 99.8782860),
    ], 1e-5)


def test_cash_flow_tables(spark):
    flows = [(g, i, v, dt) for g in ("a", "b") for i, (v, dt) in enumerate(zip((-10000.0, 2750.0, 4250.0, 3250.0, 2750.0), (d(2008, 1, 1), d(2008, 3, 1), d(2008, 10, 30), d(2009, 2, 15), d(2009, 4, 1))))] + [("none", 0, 5.0, d(2008, 1, 1))]
    df = spark.createDataFrame(flows, "g string, i int, v double, dt date")
    x = {r.g: r.rate for r in FI.XIRR(df, "v", "dt", ["g"]).collect()}
    assert x["a"] == pytest.approx(0.3733625335, abs=1e-7) and x["b"] == x["a"] and x["none"] is None
    irr = {r.g: r.rate for r in FI.IRR(df, "v", "i", ["g"]).collect()}
    assert sum(v / (1 + irr["a"]) ** i for g, i, v, _ in flows if g == "a") == pytest.approx(0, abs=1e-4)


def test_complex_and_bases(spark):
    check(spark, [
        (E.IMSUM(F.lit("3+4i"), F.lit("5-3i")), "8+i"), (E.IMPRODUCT(F.lit("3+4i"), F.lit("5-3i")), "27+11i"), (E.IMDIV(F.lit("-238+240i"), F.lit("10+24i")), "5+12i"), (E.IMABS(F.lit("5+12i")), 13.0), (E.IMREAL(F.lit("-i")), 0.0), (E.IMAGINARY(F.lit("-i")), -1.0), (E.IMCONJUGATE(F.lit("3+4j")), "3-4i"),
        (E.IMAGINARY(F.lit("2.5e2i")), 250.0), (E.IMREAL(F.lit("1e3-2i")), 1000.0), (E.IMREAL(F.lit("x")), None), (E.IMREAL(F.lit("34i")), 0.0), (E.DEC2HEX(-54), "FFFFFFFFCA"), (E.HEX2BIN("B7"), "10110111"), (E.BIN2DEC("1111111111"), -1.0), (E.DEC2BIN(9, 4), "1001"), (E.DEC2BIN(512), None), (E.CONVERT(68, "F", "C"), 20.0),
    ])


def test_text_and_errors(spark):
    check(spark, [
        (X.TEXT(1234.567, "#,##0.00"), "1,234.57"), (X.TEXT(0.285, "0.0%"), "28.5%"), (X.TEXT(12200000, "0.00E+00"), "1.22E+07"), (X.TEXT(-5, '0;"minus "0'), "minus 5"), (X.PROPER(F.lit("2-way street's")), "2-Way Street'S"), (X.TEXTBEFORE(F.lit("a-b-c"), "-", -1), "a-b"), (X.TEXTAFTER(F.lit("a-b-c"), "-", 2), "c"),
        (X.TEXTAFTER(F.lit("abc"), "-"), None), (X.CHAR(128), "€"), (X.CODE(F.lit("€")), 128), (X.UNICHAR(128512), "😀"), (X.VALUE_(F.lit("12%")), 0.12), (X.VALUE_(F.lit("7/31/2023")), 45138.0), (X.DOLLAR(-1234.567), "($1,234.57)"), (M.ROMAN(499), "CDXCIX"), (M.ROMAN(499, 4), "ID"), (M.ARABIC(F.lit("MCMXCIV")), 1994.0),
        (L.IFERROR(M.SQRT(-1), 5.0), 5.0), (M.SQRT(-1).error, "#NUM!"), (M.MOD(1, 0).error, "#DIV/0!"), (M.POWER(0, 0).error, "#NUM!"), (L.IFS(False, 1).error, "#N/A"), (L.ERROR_TYPE(M.SQRT(-1)), 6), (M.ATAN2(0, 0).error, "#DIV/0!"), (M.ROUND(2.5), 3.0), (M.ROUND(-2.5), -3.0), (M.ROUND(1.005, 2), 1.01),
    ])


@settings(max_examples=200, deadline=None)
@given(st.text("ab.*?~", max_size=8), st.text("ab.*?~", max_size=8))
def test_wildcards_match_like_a_plain_matcher(pattern, text):
    import re

    def fits(p, t):
        if not p:
            return not t
        if p[0] == "~" and len(p) > 1 and p[1] in "*?~":
            return bool(t) and t[0] == p[1] and fits(p[2:], t[1:])
        if p[0] == "*":
            return any(fits(p[1:], t[i:]) for i in range(len(t) + 1))
        return bool(t) and p[0] in ("?", t[0]) and fits(p[1:], t[1:]) if p[0] == "?" else bool(t) and p[0] == t[0] and fits(p[1:], t[1:])

    assert bool(re.fullmatch("(?s)" + pattern_of(pattern), text)) == fits(pattern, text)


def test_special_functions_against_sums():
    import numpy as np

    from gridspan.functions import special as sp

    n, p = 30, 0.37
    pmf = np.array([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    k = np.arange(n)
    assert np.allclose(sp.betainc(n - k.astype(float), k + 1.0, np.full(n, 1 - p)), np.cumsum(pmf)[:-1])
    m = 7.3
    pois = np.cumsum([math.exp(-m) * m**i / math.factorial(i) for i in range(40)])
    assert np.allclose(1 - sp.gammainc(np.arange(40) + 1.0, np.full(40, m)), pois)


def test_quantiles_invert_and_repeat_nothing():
    """Quantiles against their distribution functions, in few evaluations for each row, and once for equal arguments."""
    import numpy as np

    from gridspan.functions import special as sp

    rng = np.random.default_rng(3)
    p, a, b = rng.random(500), np.exp(rng.uniform(-1, 3, 500)), np.exp(rng.uniform(-1, 3, 500))
    seen = []

    def counted(x, a, b):
        seen.append(len(x))
        return sp.betainc(a, b, x)

    x = sp.quantile(counted, p, 0.0, 1.0, a, b)
    assert np.allclose(sp.betainc(a, b, x), p, atol=1e-12) and sum(seen) < 30 * 500
    assert np.allclose(sp.gammainc(a, sp.quantile(lambda x, a: sp.gammainc(a, x), p, 0.0, 1000.0, a)), p, atol=1e-12)
    assert list(sp.quantile(lambda x, a: x * a, np.array([0.0, 5.0, 0.5]), 0.0, 1.0, np.ones(3))) == [0.0, 1.0, 0.5]
    n, q = np.floor(np.exp(rng.uniform(0, 6, 500))), rng.uniform(0.01, 0.99, 500)
    k = sp.binomial_quantile(n, q, p)
    reach = lambda k: np.where(k >= n, 1.0, np.where(k < 0, 0.0, sp.betainc(np.maximum(n - k, 1e-9), np.maximum(k, 0) + 1, 1 - q)))
    assert (reach(k) >= p).all() and (reach(k - 1) < p).all()
    rows = []
    run = D._udf(lambda x, y: rows.append(len(x)) or x + y, once=True).func
    import pandas as pd

    out = run(pd.Series([1.0, 2.0, None, 1.0] * 100), pd.Series([5.0, 6.0, 7.0, 8.0] * 100))
    assert rows == [3] and out[:4].fillna(-1).tolist() == [6.0, 8.0, -1.0, 9.0] and len(out) == 400


def test_bessel_functions_against_identities():
    import numpy as np

    from gridspan.functions import special as sp

    x = np.concatenate([np.exp(np.linspace(-3, 5.5, 300)), [700.0]])
    for n in (0.0, 1.0, 5.0):
        k = np.full(len(x), n)
        own = x > n
        assert np.allclose((sp.bessel_j(x, k + 1) * sp.bessel_y(x, k) - sp.bessel_j(x, k) * sp.bessel_y(x, k + 1))[own], (2 / np.pi / x)[own], rtol=1e-9)
        few = (x < 300) & (x > n + 0.5)
        assert np.allclose((sp.bessel_i(x, k) * sp.bessel_k(x, k + 1) + sp.bessel_i(x, k + 1) * sp.bessel_k(x, k))[few], 1 / x[few], rtol=1e-6)
    assert np.isnan(sp.bessel_y(np.array([0.0, -1.0]), np.zeros(2))).all() and np.isnan(sp.bessel_k(np.array([0.0, -1.0]), np.zeros(2))).all()
    assert sp.bessel_y(np.array([1e-8, 1e-310]), np.zeros(2))[0] == pytest.approx(-11.800773877179531) and sp.bessel_k(np.array([1e-8]), np.zeros(1))[0] == pytest.approx(18.53661225961078)
