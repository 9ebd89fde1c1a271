"""Statistics, distributions and finance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import engineering as E
from ..functions import financial as FI
from ..functions import stats as S
from .common import half_up, half_up_sql, r, spread, table


def moments(spark, sf):
    q = F.col("p_retailprice")
    return table(spark, sf, "part").groupBy("p_brand").agg(
        r(S.STDEV_S(q)).alias("stdev_s"), r(S.STDEV_P(q)).alias("stdev_p"), r(S.VAR_S(q), 2).alias("var_s"), r(S.VAR_P(q), 2).alias("var_p"), r(S.DEVSQ(q), 1).alias("devsq"), r(S.GEOMEAN(q), 3).alias("geomean"), r(S.HARMEAN(q), 3).alias("harmean"),
        r(S.SKEW(q), 5).alias("skew"), r(S.SKEW_P(q), 5).alias("skew_p"), r(S.KURT(q), 5).alias("kurt"), r(S.MEDIAN(q), 3).alias("median"),
    )


def percentiles(spark, sf):
    p = table(spark, sf, "part")
    q = F.col("p_retailprice")
    ordered = S.tally(p, "p_retailprice", ["p_brand"]).groupBy("p_brand").agg(
        r(S.percentile_of(0.9), 3).alias("p90"), r(S.percentile_of(0.25, True), 3).alias("exc25"), r(S.percentile_of(0.75), 3).alias("q3"),
        r(S.percentile_of(0.5, True), 3).alias("exc50"), r(S.trimmean_of(0.2), 3).alias("trimmean"), r(S.large_of(2), 2).alias("large"), r(S.small_of(3), 2).alias("small"),
    )
    placed = p.groupBy("p_brand").agg(S.percentrank_inc(q, 1400.0).alias("rank_inc"), S.percentrank_exc(q, 1400.0).alias("rank_exc"))
    return ordered.join(placed, "p_brand")


def percentile_columns(spark, sf):
    """The same statistics as aggregate functions, for groups that fit in memory."""
    q = F.col("p_retailprice")
    return table(spark, sf, "part").groupBy("p_brand").agg(
        r(S.PERCENTILE_INC(q, 0.9), 3).alias("p90"), r(S.PERCENTILE_EXC(q, 0.25), 3).alias("exc25"), r(S.QUARTILE_INC(q, 3), 3).alias("q3"), r(S.QUARTILE_EXC(q, 2), 3).alias("exc50"), r(S.TRIMMEAN(q, 0.2), 3).alias("trimmean"),
        S.percentrank_inc(q, 1400.0).alias("rank_inc"), S.percentrank_exc(q, 1400.0).alias("rank_exc"), r(S.LARGE(q, 2), 2).alias("large"), r(S.SMALL(q, 3), 2).alias("small"),
    )


def average_deviation(spark, sf):
    out = S.avedev(table(spark, sf, "part"), "p_retailprice", ["p_brand"])
    return out.select("p_brand", r(F.col("avedev"), 3).alias("avedev"))


def regression(spark, sf):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        r(S.SLOPE(y, x)).alias("slope"), r(S.INTERCEPT(y, x), 2).alias("intercept"), r(S.RSQ(y, x), 6).alias("rsq"), r(S.CORREL(y, x), 6).alias("correl"), r(S.COVARIANCE_P(y, x), 1).alias("cov_p"), r(S.COVARIANCE_S(y, x), 1).alias("cov_s"),
        r(S.STEYX(y, x), 2).alias("steyx"), r(S.FORECAST(30.0, y, x), 2).alias("forecast"), r(S.PROB(x, F.lit(0.0), 1, 2)).alias("prob"),
    )


def multiple_regression(spark, sf):
    li = table(spark, sf, "lineitem")
    fit = S.linest(li, "l_extendedprice", ["l_quantity", "l_discount"])
    rows = [(k, round(v, 2)) for k, v in fit["coefficients"].items()] + [("r2", round(fit["r2"], 6)), ("df", float(fit["df"]))]
    return spark.createDataFrame(rows, "term string, value double")


def trend_line(spark, sf):
    li, n = table(spark, sf, "lineitem"), spark.range(1, 6).select(F.col("id").cast("double").alias("l_quantity"))
    return S.trend(li, "l_extendedprice", ["l_quantity"], n).select("l_quantity", r(F.col("l_extendedprice"), 2).alias("l_extendedprice"))


def permutations(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", r(S.PERMUT(F.col("p_size"), F.lit(2))).alias("permut"), r(S.PERMUTATIONA(F.col("p_size"), F.lit(3))).alias("permutationa"), r(S.STANDARDIZE(F.col("p_retailprice"), 1400, 300)).alias("z"))


def densities(spark, sf):
    """Distributions with elementary forms."""
    p = table(spark, sf, "part")
    x = F.col("p_size") / 10
    cells = {"expon": D.EXPON_DIST(x, 0.7), "expon_pdf": D.EXPON_DIST(x, 0.7, False), "weibull": D.WEIBULL_DIST(x, 1.5, 2), "weibull_pdf": D.WEIBULL_DIST(x, 1.5, 2, False), "phi": D.PHI(x), "norm_pdf": D.NORM_DIST(x, 2, 1.5, False), "fisher": D.FISHER(x / 6), "fisherinv": D.FISHERINV(x)}
    return p.select("p_partkey", *[r(c, 6).alias(n) for n, c in cells.items()])


def discrete(spark, sf):
    """Discrete distributions against sums of binomials."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 11).alias("k"))
    k = F.col("k")
    cells = {"binom": D.BINOM_DIST(k, 10, 0.3), "binom_pmf": D.BINOM_DIST(k, 10, 0.3, False), "poisson": D.POISSON_DIST(k, 2.5), "poisson_pmf": D.POISSON_DIST(k, 2.5, False), "negbinom_pmf": D.NEGBINOM_DIST(k, 3, 0.4, False), "negbinom": D.NEGBINOM_DIST(k, 3, 0.4)}
    return p.select("p_partkey", "k", *[r(c, 6).alias(n) for n, c in cells.items()])


def distributions(spark, sf):
    """Continuous distributions and their quantiles, which SQL has not."""
    p = spread(table(spark, sf, "supplier").select("s_suppkey"))
    x, u = (F.col("s_suppkey") % 40 + 1) / 10, (F.col("s_suppkey") % 97 + 1) / 100
    cells = {
        "norm": D.NORM_S_DIST(x), "norm_inv": D.NORM_INV(u, 10, 2), "gauss": D.GAUSS(x), "lognorm": D.LOGNORM_DIST(x, 0.5, 1), "lognorm_inv": D.LOGNORM_INV(u, 0.5, 1), "gamma": D.GAMMA(x), "gammaln": D.GAMMALN(x), "gamma_dist": D.GAMMA_DIST(x, 2, 1.5), "gamma_inv": D.GAMMA_INV(u, 2, 1.5),
        "chisq": D.CHISQ_DIST(x, 3), "chisq_rt": D.CHISQ_DIST_RT(x, 3), "chisq_inv": D.CHISQ_INV(u, 3), "beta": D.BETA_DIST(u, 2, 3), "beta_inv": D.BETA_INV(u, 2, 3), "t": D.T_DIST(x, 5), "t_2t": D.T_DIST_2T(x, 5), "t_inv": D.T_INV(u, 5), "f": D.F_DIST(x, 4, 6), "f_inv": D.F_INV(u, 4, 6),
        "binom_inv": D.BINOM_INV(20, 0.3, u), "hypgeom": D.HYPGEOM_DIST(F.floor(x), 8, 10, 40, True), "confidence": D.CONFIDENCE_NORM(u, 2.5, 50), "confidence_t": D.CONFIDENCE_T(u, 2.5, 50), "erf": D.ERF(x), "erfc": D.ERFC(x),
        "bessel_j": E.BESSELJ(x, 1), "bessel_i": E.BESSELI(x, 1), "bessel_k": E.BESSELK(x, 1), "bessel_y": E.BESSELY(x, 1),
    }
    return p.select("s_suppkey", *[r(c, 6).alias(n) for n, c in cells.items()])


def _loans(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 9 + 1).cast("double").alias("n"), (F.col("o_custkey") % 12 / 100.0 + 0.01).alias("i"), F.col("o_totalprice").alias("pv"))


def annuities(spark, sf):
    n, i, pv = F.col("n"), F.col("i"), F.col("pv")
    cells = {"fv": FI.FV(i, n, -100, -pv), "pv": FI.PV(i, n, -100), "pmt": FI.PMT(i, n, pv), "pmt_due": FI.PMT(i, n, pv, 0, 1), "ipmt": FI.IPMT(i, 1, n, pv), "ppmt": FI.PPMT(i, 1, n, pv), "nper": FI.NPER(i, -pv, pv)}
    return _loans(spark, sf).select("o_orderkey", *[half_up(c).alias(k) for k, c in cells.items()], F.round(FI.RATE(n, FI.PMT(i, n, pv).value, pv).value, 5).alias("rate"))


def loan_terms(spark, sf):
    n, i, pv = F.col("n"), F.col("i"), F.col("pv")
    cells = {
        "effect": FI.EFFECT(i, 12), "nominal": FI.NOMINAL(i, 12), "rri": FI.RRI(n, pv, pv * 2), "pduration": FI.PDURATION(i, pv, pv * 2), "sln": FI.SLN(pv, 100, n), "syd": FI.SYD(pv, 100, n, 1),
        "ispmt": FI.ISPMT(i, 1, n, pv), "dollarde": FI.DOLLARDE(1.02, 16), "dollarfr": FI.DOLLARFR(1.125, 16),
    }
    return _loans(spark, sf).select("o_orderkey", *[half_up(c).alias(k) for k, c in cells.items()])


def discount_papers(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.date_add(F.col("o_orderdate").cast("date"), 90).alias("m"))
    d, m = F.col("d"), F.col("m")
    cells = {"disc": FI.DISC(d, m, 97.5, 100, 2), "intrate": FI.INTRATE(d, m, 97.5, 100, 3), "received": FI.RECEIVED(d, m, 1000, 0.05, 2), "pricedisc": FI.PRICEDISC(d, m, 0.05, 100, 3), "yielddisc": FI.YIELDDISC(d, m, 97.5, 100, 2), "tbillprice": FI.TBILLPRICE(d, m, 0.05), "tbillyield": FI.TBILLYIELD(d, m, 98.5), "tbilleq": FI.TBILLEQ(d, m, 0.05), "accrintm": FI.ACCRINTM(d, m, 0.06, 1000, 3)}
    return o.select("o_orderkey", *[r(c, 6).alias(k) for k, c in cells.items()])


def bonds(spark, sf):
    """Coupon bonds: the yield of the price is the yield the price was made of."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.expr("DATE'2005-03-15'").alias("m"), (F.col("o_custkey") % 8 / 100.0 + 0.02).alias("y"))
    d, m, y = F.col("d"), F.col("m"), F.col("y")
    o = o.withColumn("price", FI.PRICE(d, m, 0.05, y, 100, 2, 3).value)
    price = F.col("price")
    return o.select(
        "o_orderkey", FI.COUPNUM(d, m, 2).value.alias("coupnum"), FI.COUPPCD(d, m, 2).value.cast("string").alias("previous"), FI.COUPNCD(d, m, 2).value.cast("string").alias("next"), FI.COUPDAYBS(d, m, 2, 1).value.cast("long").alias("daybs"), FI.COUPDAYSNC(d, m, 2, 1).value.cast("long").alias("daysnc"),
        r(FI.YIELD(d, m, 0.05, price, 100, 2, 3), 6).alias("yield"), F.round(F.col("y"), 6).alias("y"), 
    )


def depreciation(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("c"), (F.col("o_custkey") % 5 + 1).cast("double").alias("p"))
    c, p = F.col("c"), F.col("p")
    return o.select("o_orderkey", half_up(FI.DDB(c, 100, 10, p)).alias("ddb"), half_up(FI.VDB(c, 100, 10, p - 1, p, 2, True)).alias("vdb"), half_up(FI.DB(c, c / 10, 6, p)).alias("db"))


def net_present_values(spark, sf):
    """NPV, XNPV and FVSCHEDULE of each order's lines."""
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(r(FI.NPV(F.lit(0.08), F.col("l_extendedprice"), F.col("l_linenumber")), 2).alias("npv"), r(FI.XNPV(F.lit(0.08), F.col("l_extendedprice"), F.col("l_shipdate"), F.expr("DATE'1992-01-01'")), 2).alias("xnpv"), r(FI.FVSCHEDULE(F.lit(100.0), F.col("l_tax")), 3).alias("fvschedule"))


def rates_of_return(spark, sf):
    """IRR of a loan paid back in level rates, for each customer."""
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 10 + 1).cast("double").alias("i"))
    flows = c.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("t"), "i")
    flows = flows.select("c_custkey", "t", F.when(F.col("t") == 0, -1000.0).otherwise(FI.PMT(F.col("i") / 100, 5, -1000.0).value).alias("v"))
    return FI.IRR(flows, "v", "t", ["c_custkey"]).select("c_custkey", r(F.col("rate"), 6).alias("rate"))


QUERIES = {f.__name__: f for f in (moments, percentiles, percentile_columns, average_deviation, regression, multiple_regression, trend_line, permutations, densities, discrete, distributions, annuities, loan_terms, discount_papers, bonds, depreciation, net_present_values, rates_of_return)}

_LOANS = """WITH t AS (SELECT o_orderkey, (o_custkey % 9 + 1)::DOUBLE AS n, o_custkey % 12 / 100.0::DOUBLE + 0.01::DOUBLE AS i, o_totalprice AS v FROM orders), u AS (SELECT *, pow(1 + i, n) AS g, (pow(1 + i, n) - 1) / i AS s FROM t)"""
h = half_up_sql
ORACLES = {
    "moments": """SELECT p_brand, round(stddev_samp(x), 4) AS stdev_s, round(stddev_pop(x), 4) AS stdev_p, round(var_samp(x), 2) AS var_s, round(var_pop(x), 2) AS var_p, round(var_pop(x) * count(x), 1) AS devsq, round(exp(avg(ln(x))), 3) AS geomean, round(count(x) / sum(1 / x), 3) AS harmean,
        round(skewness(x), 5) AS skew, round(skewness(x) * (count(x) - 2) / sqrt(count(x) * (count(x) - 1.0)), 5) AS skew_p, round(kurtosis(x), 5) AS kurt, round(median(x), 3) AS median FROM (SELECT p_brand, p_retailprice AS x FROM part) GROUP BY 1""",
    "percentiles": """WITH t AS (SELECT p_brand, list_sort(list(p_retailprice)) AS s, count(*)::DOUBLE AS n FROM part GROUP BY 1), a AS (SELECT *, 0.25 * (n + 1) AS r1, 0.5 * (n + 1) AS r2, floor(n * 0.1)::BIGINT AS cut, list_filter(s, lambda v: v <= 1400) AS low, list_filter(s, lambda v: v > 1400) AS high FROM t)
        SELECT a.p_brand, round(q.p90, 3) AS p90, round(s[floor(r1)::BIGINT] + (r1 - floor(r1)) * (s[floor(r1)::BIGINT + 1] - s[floor(r1)::BIGINT]), 3) AS exc25, round(q.q3, 3) AS q3, round(s[floor(r2)::BIGINT] + (r2 - floor(r2)) * (s[floor(r2)::BIGINT + 1] - s[floor(r2)::BIGINT]), 3) AS exc50,
        round(list_avg(s[cut + 1:n::BIGINT - cut]), 3) AS trimmean, CASE WHEN s[1] <= 1400 AND s[-1] >= 1400 THEN floor((len(low) - 1 + coalesce((1400 - low[-1]) / (high[1] - low[-1]), 0)) / (n - 1) * 1000 + 1e-9) / 1000 END AS rank_inc,
        CASE WHEN s[1] <= 1400 AND s[-1] >= 1400 THEN floor((len(low) + coalesce((1400 - low[-1]) / (high[1] - low[-1]), 0)) / (n + 1) * 1000 + 1e-9) / 1000 END AS rank_exc, round(s[-2], 2) AS large, round(s[3], 2) AS small
        FROM a JOIN (SELECT p_brand, quantile_cont(p_retailprice, 0.9) AS p90, quantile_cont(p_retailprice, 0.75) AS q3 FROM part GROUP BY 1) q ON a.p_brand = q.p_brand""",
    "average_deviation": "SELECT p_brand, round(avg(abs(p_retailprice - m)), 3) AS avedev FROM (SELECT *, avg(p_retailprice) OVER (PARTITION BY p_brand) AS m FROM part) GROUP BY 1",
    "regression": """SELECT l_returnflag, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, round(regr_r2(y, x), 6) AS rsq, round(corr(y, x), 6) AS correl, round(covar_pop(y, x), 1) AS cov_p, round(covar_samp(y, x), 1) AS cov_s,
        round(sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2)), 2) AS steyx, round(regr_intercept(y, x) + 30 * regr_slope(y, x), 2) AS forecast, NULL::DOUBLE AS prob FROM (SELECT l_returnflag, l_extendedprice AS y, l_quantity AS x FROM lineitem) GROUP BY 1""",
    "trend_line": "SELECT i::DOUBLE AS l_quantity, round(a + b * i, 2) AS l_extendedprice FROM range(1, 6) r(i), (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)",
    "permutations": "SELECT p_partkey, CASE WHEN p_size >= 2 THEN p_size * (p_size - 1) END::DOUBLE AS permut, pow(p_size, 3) AS permutationa, round((p_retailprice - 1400) / 300, 4) AS z FROM part",
    "densities": """SELECT p_partkey, round(1 - exp(-0.7 * x), 6) AS expon, round(0.7 * exp(-0.7 * x), 6) AS expon_pdf, round(1 - exp(-pow(x / 2, 1.5)), 6) AS weibull, round(0.75 * sqrt(x / 2) * exp(-pow(x / 2, 1.5)), 6) AS weibull_pdf, round(exp(-x * x / 2) / sqrt(2 * pi()), 6) AS phi,
        round(exp(-pow((x - 2) / 1.5, 2) / 2) / sqrt(2 * pi()) / 1.5, 6) AS norm_pdf, round(atanh(x / 6), 6) AS fisher, round(tanh(x), 6) AS fisherinv FROM (SELECT p_partkey, p_size::DOUBLE / 10 AS x FROM part)""",
    "discrete": """WITH b AS (SELECT i, factorial(10)::DOUBLE / factorial(i)::DOUBLE / factorial(10 - i)::DOUBLE * pow(0.3, i) * pow(0.7, 10 - i) AS b, exp(-2.5) * pow(2.5, i) / factorial(i)::DOUBLE AS p, (i + 2) * (i + 1) / 2 * pow(0.4, 3) * pow(0.6, i) AS n FROM (SELECT range::INTEGER AS i FROM range(11))),
        s AS (SELECT i, b, p, n, sum(b) OVER (ORDER BY i) AS bs, sum(p) OVER (ORDER BY i) AS ps, sum(n) OVER (ORDER BY i) AS ns FROM b)
        SELECT p_partkey, i AS k, round(bs, 6) AS binom, round(b, 6) AS binom_pmf, round(ps, 6) AS poisson, round(p, 6) AS poisson_pmf, round(n, 6) AS negbinom_pmf, round(ns, 6) AS negbinom FROM part JOIN s ON p_size % 11 = i""",
    "annuities": f"""{_LOANS} SELECT o_orderkey, {h('v * g + 100 * s')} AS fv, {h('100 * s / g')} AS pv, {h('-v * g / s')} AS pmt, {h('-v * g / s / (1 + i)')} AS pmt_due, {h('-v * i')} AS ipmt, {h('-v * g / s + v * i')} AS ppmt, {h('ln(1 / (1 - i)) / ln(1 + i)')} AS nper, round(i, 5) AS rate FROM u""",
    "loan_terms": f"""{_LOANS} SELECT o_orderkey, {h('pow(1 + i / 12, 12) - 1')} AS effect, {h('(pow(1 + i, 1 / 12.0::DOUBLE) - 1) * 12')} AS nominal, {h('pow(2, 1 / n) - 1')} AS rri, {h('ln(2) / ln(1 + i)')} AS pduration, {h('(v - 100) / n')} AS sln, {h('(v - 100) * 2 / (n + 1)')} AS syd,
        {h('v * i * (1 / n - 1)')} AS ispmt, 1.125::DOUBLE AS dollarde, 1.02::DOUBLE AS dollarfr FROM u""",
    "discount_papers": """SELECT o_orderkey, round(2.5 / 100 * 4, 6) AS disc, round(2.5 / 97.5 * 365 / 90, 6) AS intrate, round(1000 / (1 - 0.05 / 4), 6) AS received, round(100 * (1 - 0.05 * 90 / 365), 6) AS pricedisc, round((100 / 97.5 - 1) * 4, 6) AS yielddisc, round(100 * (1 - 0.05 * 90 / 360), 6) AS tbillprice,
        round(1.5 / 98.5 * 4, 6) AS tbillyield, round(365 * 0.05 / (360 - 0.05 * 90), 6) AS tbilleq, round(1000 * 0.06 * 90 / 365, 6) AS accrintm FROM orders""".replace("2.5 / 100", "2.5::DOUBLE / 100").replace("2.5 / 97.5", "2.5::DOUBLE / 97.5").replace("1000 / (", "1000::DOUBLE / (").replace("0.05 * 90", "0.05::DOUBLE * 90").replace("100 / 97.5", "100::DOUBLE / 97.5").replace("1.5 / 98.5", "1.5::DOUBLE / 98.5").replace("0.06 * 90", "0.06::DOUBLE * 90").replace("0.05 / 4", "0.05::DOUBLE / 4"),
    "bonds": """WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_custkey % 8 / 100.0::DOUBLE + 0.02 AS y FROM orders), c AS (SELECT (DATE '2005-03-15' - to_months(6 * i::INTEGER))::DATE AS x, i FROM range(0, 60) r(i)),
        n AS (SELECT t.o_orderkey, t.d, t.y, max(c.x) AS previous, min(c.i) AS coupnum FROM t JOIN c ON c.x <= t.d GROUP BY ALL)
        SELECT o_orderkey, coupnum::INTEGER AS coupnum, previous::VARCHAR AS previous, (previous + to_months(6))::DATE::VARCHAR AS next, (d - previous)::BIGINT AS daybs, ((previous + to_months(6))::DATE - d)::BIGINT AS daysnc, round(y, 6) AS yield, round(y, 6) AS y FROM n""",
    "depreciation": f"""SELECT o_orderkey, {h('d')} AS ddb, {h('d')} AS vdb, {h('CASE p WHEN 1 THEN c * q ELSE c * (1 - q) * pow(1 - q, p - 2) * q END')} AS db FROM (SELECT *, greatest(least(c * 0.2 * pow(0.8, p - 1), c * pow(0.8, p - 1) - 100), 0) AS d, round(1 - pow(0.1, 1 / 6.0::DOUBLE), 3) AS q FROM (SELECT o_orderkey, o_totalprice AS c, (o_custkey % 5 + 1)::DOUBLE AS p FROM orders))""",
    "net_present_values": """SELECT l_orderkey, round(sum(l_extendedprice / pow(1.08, l_linenumber)), 2) AS npv, round(sum(l_extendedprice / pow(1.08, (l_shipdate::DATE - DATE '1992-01-01') / 365.0::DOUBLE)), 2) AS xnpv, round(100 * product(1 + l_tax), 3) AS fvschedule FROM lineitem GROUP BY 1""",
    "rates_of_return": "SELECT c_custkey, (c_custkey % 10 + 1) / 100.0::DOUBLE AS rate FROM customer",
}
ORACLES["percentile_columns"] = ORACLES["percentiles"]
ORACLES["multiple_regression"] = """WITH s AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, var_pop(y) AS vy, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS cy
        FROM (SELECT l_extendedprice AS y, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b FROM lineitem)),
        c AS (SELECT *, (ay * vb - cy * ab) / (va * vb - ab * ab) AS p, (cy * va - ay * ab) / (va * vb - ab * ab) AS q FROM s)
    SELECT 'l_quantity' AS term, round(p, 2) AS value FROM c UNION ALL SELECT 'l_discount', round(q, 2) FROM c UNION ALL SELECT 'const', round(my - p * ma - q * mb, 2) FROM c
    UNION ALL SELECT 'r2', round((p * ay + q * cy) / vy, 6) FROM c UNION ALL SELECT 'df', n - 3.0::DOUBLE FROM c"""
