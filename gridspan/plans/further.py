"""Queries of functions with closed forms that SQL has too: clock times, distributions, complex numbers, bases, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cells import Cell, cell
from ..functions import dates as DT
from ..functions import distributions as D
from ..functions import engineering as E
from ..functions import financial as FI
from ..functions import logical as L
from ..functions import math as M
from ..functions import text as X
from ..operators import criteria as C
from ..operators import frames as FR
from ..operators import lookup as LK
from .common import r, select, spread, table


def clock_times(spark, sf):
    """Times of timestamps and of serial numbers."""
    e = table(spark, sf, "events")
    share = F.pmod(F.col("event_id"), F.lit(86400)) / F.lit(86400.0) + 40000
    parts = {"hour": DT.HOUR, "minute": DT.MINUTE, "second": DT.SECOND}
    return select(e, ["event_id"], **{n: f(F.col("ts")) for n, f in parts.items()}, **{f"serial_{n}": f(share) for n, f in parts.items()})


def workdays_of_other_weeks(spark, sf):
    """The fifth working day after each order where only Sundays are free."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return o.select("o_orderkey", DT.WORKDAY_INTL(F.col("d"), 5, 11).value.cast("string").alias("day"))


def cell_arithmetic(spark, sf):
    """Formulas over cells: errors go through operators, and kinds compare as cells do."""
    p = table(spark, sf, "part")
    n, price, brand = cell(F.col("p_size").cast("double")), cell(F.col("p_retailprice")), cell(F.col("p_brand"))
    share = price / (n - 25)
    cells = {"share": share, "twice": share * 2 + 1, "label": brand & "/" & cell(F.col("p_size")), "square": (n - 25) ** 2, "above": share > 100, "mixed": n < brand, "same": brand.eq(F.lower(F.col("p_brand")))}
    return p.select("p_partkey", *[(r(c, 3) if k in ("share", "twice") else c.value).alias(k) for k, c in cells.items()], share.error.alias("share_error"), (share * 2 + 1).error.alias("twice_error"))


def error_criteria(spark, sf):
    """Counts of error codes in a computed column."""
    share = cell(F.col("p_retailprice")) / (F.col("p_size") - 25)
    p = table(spark, sf, "part").select("p_brand", *share.named("share"))
    return p.groupBy("p_brand").agg(
        C.COUNTIFS(("share_error", "err", "#DIV/0!")).alias("divided"), C.COUNTIFS(("share_error", "err", "<>#DIV/0!")).alias("others"), C.COUNTIFS(("share", "num", ">0")).alias("positive"), C.COUNTIFS(("share", "num", "#N/A")).alias("none"),
    )


def let_values(spark, sf):
    p = table(spark, sf, "part")
    out = L.LET(F.col("p_size").cast("double"), lambda a: M.MOD(a, 7), lambda a, b: M.SQRT(a - b), lambda a, b, c: a * 100 + b * 10 + c)
    return p.select("p_partkey", r(out, 6).alias("value"))


def lookup_text_sorted(spark, sf):
    """Approximate matches on texts: the names at or before, and at or after, each part's name."""
    n = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("pos"))
    s = table(spark, sf, "part").select("p_partkey", F.upper(F.substring("p_name", 1, 3)).alias("v"))
    below = LK.XLOOKUP(s, "v", n, "n_name", ["n_name"], match=-1, pos="pos").select("p_partkey", F.col("n_name").alias("below"), "lookup_error")
    above = LK.XLOOKUP(s, "v", n, "n_name", ["n_name"], {"n_name": "none"}, match=1, pos="pos").select("p_partkey", F.col("n_name").alias("above"))
    return below.join(above, "p_partkey")


def lookup_large_keys(spark, sf):
    """Keys above 2^53 stay apart."""
    shift = 9007199254740992
    c = table(spark, sf, "customer").select((F.col("c_custkey") * 3 + shift).alias("k"), "c_name")
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") * 2 + shift).alias("v"))
    return LK.XLOOKUP(o, "v", c, "k", ["c_name", "k"], match=-1).select("o_orderkey", "c_name", "k")


def match_descending(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_acctbal").agg(F.min("c_custkey").alias("pos"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return LK.MATCH(s, "s_acctbal", c, "c_acctbal", "pos", -1).select("s_suppkey", "match")


def wildcard_default(spark, sf):
    """Patterns of customers' segments among the parts' types, with a default."""
    t = table(spark, sf, "part").select("p_type", "p_partkey")
    v = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("*"), F.substring("c_mktsegment", 1, 2), F.lit("*")).alias("v"))
    return LK.XLOOKUP(v, "v", t, "p_type", ["p_partkey"], {"p_partkey": -1}, match=2, pos="p_partkey", last=True).select("c_custkey", "p_partkey")


def more_bases(spark, sf):
    p = table(spark, sf, "part")
    n = F.col("p_size").cast("double")
    binary, octal, hexa = E.DEC2BIN(n).raw, E.DEC2OCT(n).raw, E.DEC2HEX(n).raw
    return select(p, ["p_partkey"], bin2hex=E.BIN2HEX(binary), hex2bin=E.HEX2BIN(hexa), hex2oct=E.HEX2OCT(hexa), oct2bin=E.OCT2BIN(octal), oct2dec=r(E.OCT2DEC(octal), 0), padded=E.BIN2HEX(binary, 4))


_COMPLEX = {
    "cos": E.IMCOS, "sin": E.IMSIN, "tan": E.IMTAN, "cosh": E.IMCOSH, "sinh": E.IMSINH, "sec": E.IMSEC, "csc": E.IMCSC, "cot": E.IMCOT, "sech": E.IMSECH, "csch": E.IMCSCH, "ln": E.IMLN, "log10": E.IMLOG10, "log2": E.IMLOG2,
}


def complex_functions(spark, sf):
    """Real and imaginary parts of functions of complex numbers."""
    z = E.COMPLEX(F.col("p_size") / 25.0 - 1.01, F.col("p_size") % 7 / 5.0 + 0.1).value
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size")).select("p_partkey", E.parse(z).alias("numbers"))
    z = E.complex_cell(F.col("numbers"))
    parts = {n: f(z) for n, f in _COMPLEX.items()}
    return p.select("p_partkey", *[F.round(part(c).value, 6).alias(f"{n}_{k}") for n, c in parts.items() for k, part in (("re", E.IMREAL), ("im", E.IMAGINARY))], F.round(E.IMARGUMENT(z).value, 6).alias("argument"))


def information(spark, sf):
    p = table(spark, sf, "part")
    n, empty = F.col("p_size"), F.when(F.col("p_size") > 25, F.col("p_name"))
    gap = M.SQRT(n - 25)
    cells = {
        "blank": L.ISBLANK(empty), "err": L.ISERR(gap), "err_na": L.ISERR(L.IFS(n > 40, 1)), "nontext": L.ISNONTEXT(n), "logical": L.ISLOGICAL(n > 3), "ref": cell(L.ISREF(n)), "omitted": cell(L.ISOMITTED(None)), "n": L.N(n > 25, "bool"),
        "t": X.T(F.col("p_name")), "na": cell(L.ISNA(L.NA_()).raw), "pi": r(M.PI(), 9), "true": cell(L.TRUE().raw), "shown": X.VALUETOTEXT(F.col("p_name"), True), "error_type": L.ERROR_TYPE(gap),
    }
    return p.select("p_partkey", *[(c.value if isinstance(c, Cell) else c).alias(k) for k, c in cells.items()])


def more_texts(spark, sf):
    p = table(spark, sf, "part")
    name, wide = F.col("p_name"), F.translate(F.upper(F.col("p_name")), "ABC ", "ＡＢＣ　")
    return select(p, ["p_partkey"], code=X.UNICODE(name), sign=X.CHAR(F.col("p_size") + 64), proper=X.PROPER(name), asc=X.ASC(wide), listed=X.ARRAYTOTEXT(F.split(name, " ")))


def distribution_closed_forms(spark, sf):
    """Distributions at parameters for which they have closed forms."""
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size")).select("p_partkey", (F.col("p_size") / 10.0).alias("x"), (F.col("p_size") / 51.0).alias("q"), F.col("p_size").cast("double").alias("n"))
    x, q, n = F.col("x"), F.col("q"), F.col("n")
    cells = {
        "t1": D.T_DIST(x, 1), "t1_rt": D.T_DIST_RT(x, 1), "t1_2t": D.T_DIST_2T(x, 1), "t2": D.T_DIST(x, 2), "t1_inv": D.T_INV(q, 1), "t1_inv2": D.T_INV_2T(q, 1), "tdist": D.TDIST(x, 1, 1),
        "chi2": D.CHISQ_DIST(x, 2), "chi2_rt": D.CHISQ_DIST_RT(x, 2), "chi2_pdf": D.CHISQ_DIST(x, 2, False), "chi2_inv": D.CHISQ_INV(q, 2), "chi2_inv_rt": D.CHISQ_INV_RT(q, 2),
        "f22": D.F_DIST(x, 2, 2), "f22_rt": D.F_DIST_RT(x, 2, 2), "f22_inv": D.F_INV(q, 2, 2), "f22_inv_rt": D.F_INV_RT(q, 2, 2),
        "gamma1": D.GAMMA_DIST(x, 1, 2), "gamma2": D.GAMMA_DIST(x, 2, 1), "gamma_pdf": D.GAMMA_DIST(x, 2, 1, False), "gamma_inv": D.GAMMA_INV(q, 1, 2), "gamma": D.GAMMA(x + 0.5), "gammaln": D.GAMMALN(n),
        "beta": D.BETA_DIST(q, 1, 3), "beta_pdf": D.BETA_DIST(q, 2, 2, False), "beta_inv": D.BETA_INV(q, 1, 3), "betadist": D.BETADIST(q, 3, 1),
        "hypergeometric": D.HYPGEOM_DIST(0, 2, n, 60), "binomial_range": D.BINOM_DIST_RANGE(n, q, 0, 1), "binom_inv": D.BINOM_INV(1, q, 0.5), "expon_like": D.NORM_INV(0.975, x, 2), "confidence": D.CONFIDENCE_NORM(0.05, x, n), "norm_mid": D.NORM_S_DIST(x - x),
    }
    return p.select("p_partkey", *[r(c, 6).alias(k) for k, c in cells.items()])


def papers_at_maturity(spark, sf):
    """Papers that pay at maturity, accrued interest and modified returns, over 365-day years."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), (F.col("o_custkey") % 8 / 100.0 + 0.02).alias("y"))
    d, y = F.col("d"), F.col("y")
    on = lambda days: F.date_add(d, days)
    price = FI.PRICEMAT(on(100), on(400), d, 0.05, y, 3)
    return o.select("o_orderkey", r(price, 6).alias("pricemat"), r(FI.YIELDMAT(on(100), on(400), d, 0.05, price.value, 3), 6).alias("yieldmat"), r(FI.ACCRINT(d, on(180), on(90), 0.06, 1000, 2, 3), 6).alias("accrint"))


def modified_returns(spark, sf):
    """MIRR and PRODUCT of each order's lines: the first price is paid, the others come back."""
    li = table(spark, sf, "lineitem")
    size = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("first"))
    rows = li.join(size, "l_orderkey").where("n > 1 AND first = 1")
    flow = F.when(F.col("l_linenumber") == 1, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return rows.groupBy("l_orderkey").agg(r(FI.MIRR(flow, F.col("l_linenumber") - 1, F.col("n"), 0.1, 0.12), 6).alias("mirr"), M.PRODUCT(F.col("l_quantity")).alias("product"))


def grids(spark, sf):
    """Arrays made from nothing: rows, columns and values."""
    return FR.SEQUENCE(spark, 20, 3, 5, 2).toDF("r", "c", "value").select("r", "c", F.col("value").cast("double").alias("value"))


def loan_sums(spark, sf):
    """Interest and principal of the first year of a monthly loan."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 12 / 1200.0 + 0.001).alias("i"))
    pv, i = F.col("o_totalprice"), F.col("i")
    interest, paid = FI.CUMIPMT(i, 24, pv, 1, 12), FI.CUMPRINC(i, 24, pv, 1, 12)
    return o.select("o_orderkey", r(interest.value / pv, 6).alias("interest"), r(paid.value / pv, 6).alias("paid"))


QUERIES = {
    f.__name__: f
    for f in (
        clock_times, workdays_of_other_weeks, cell_arithmetic, error_criteria, let_values, lookup_text_sorted, lookup_large_keys, match_descending, wildcard_default, more_bases, complex_functions, information, more_texts,
        distribution_closed_forms, papers_at_maturity, modified_returns, grids, loan_sums,
    )
}

_T = "(p_size / 10.0::DOUBLE)"
_Q = "(p_size / 51.0::DOUBLE)"
_A, _B = "(p_size / 25.0::DOUBLE - 1.01)", "(p_size % 7 / 5.0::DOUBLE + 0.1)"


def _complex_sql() -> str:
    """Each function as its real and imaginary part of a + bi."""
    over = lambda re, im: (f"({re}) / (pow({re}, 2) + pow({im}, 2))", f"-({im}) / (pow({re}, 2) + pow({im}, 2))")
    ratio = lambda x, y: (f"(({x[0]}) * ({y[0]}) + ({x[1]}) * ({y[1]})) / (pow({y[0]}, 2) + pow({y[1]}, 2))", f"(({x[1]}) * ({y[0]}) - ({x[0]}) * ({y[1]})) / (pow({y[0]}, 2) + pow({y[1]}, 2))")
    cos, sin = ("cos(a) * cosh(b)", "-sin(a) * sinh(b)"), ("sin(a) * cosh(b)", "cos(a) * sinh(b)")
    cosh, sinh = ("cosh(a) * cos(b)", "sinh(a) * sin(b)"), ("sinh(a) * cos(b)", "cosh(a) * sin(b)")
    ln = ("ln(sqrt(a * a + b * b))", "atan2(b, a)")
    parts = {
        "cos": cos, "sin": sin, "tan": ratio(sin, cos), "cosh": cosh, "sinh": sinh, "sec": over(*cos), "csc": over(*sin), "cot": ratio(cos, sin), "sech": over(*cosh), "csch": over(*sinh), "ln": ln,
        "log10": tuple(f"({x}) / ln(10)" for x in ln), "log2": tuple(f"({x}) / ln(2)" for x in ln),
    }
    shown = ", ".join(f"round({x}, 6) AS {n}_{k}" for n, pair in parts.items() for k, x in zip(("re", "im"), pair))
    return f"SELECT p_partkey, {shown}, round(atan2(b, a), 6) AS argument FROM (SELECT p_partkey, {_A} AS a, {_B} AS b FROM part)"


ORACLES = {
    "clock_times": """SELECT event_id, hour(ts)::INTEGER AS hour, minute(ts)::INTEGER AS minute, second(ts)::INTEGER AS second, (event_id % 86400 // 3600)::INTEGER AS serial_hour, (event_id % 86400 // 60 % 60)::INTEGER AS serial_minute, (event_id % 60)::INTEGER AS serial_second FROM events""",
    "workdays_of_other_weeks": "SELECT o_orderkey, (list_filter(list_transform(range(1, 12), lambda k: (o_orderdate::DATE + k::INTEGER)::DATE), lambda d: isodow(d) <> 7)[5])::VARCHAR AS day FROM orders",
    "cell_arithmetic": """SELECT p_partkey, round(s, 3) AS share, round(s * 2 + 1, 3) AS twice, p_brand || '/' || p_size AS label, pow(n - 25, 2) AS square, s > 100 AS above, true AS mixed, true AS same, CASE WHEN n = 25 THEN '#DIV/0!' END AS share_error, CASE WHEN n = 25 THEN '#DIV/0!' END AS twice_error
        FROM (SELECT *, p_size::DOUBLE AS n, p_retailprice / nullif(p_size - 25, 0) AS s FROM part)""",
    "error_criteria": "SELECT p_brand, count(*) FILTER (p_size = 25) AS divided, count(*) FILTER (p_size <> 25) AS others, count(*) FILTER (p_size > 25 AND p_retailprice > 0) AS positive, 0 AS \"none\" FROM part GROUP BY p_brand",
    "let_values": "SELECT p_partkey, round(p_size * 100 + p_size % 7 * 10 + sqrt(p_size - p_size % 7), 6) AS value FROM part",
    "lookup_text_sorted": """SELECT p_partkey, (SELECT max(n_name) FROM nation WHERE upper(n_name) <= v) AS below, CASE WHEN (SELECT max(n_name) FROM nation WHERE upper(n_name) <= v) IS NULL THEN '#N/A' END AS lookup_error,
        coalesce((SELECT min(n_name) FROM nation WHERE upper(n_name) >= v), 'none') AS above FROM (SELECT p_partkey, upper(left(p_name, 3)) AS v FROM part)""",
    "lookup_large_keys": "SELECT o_orderkey, c_name, k FROM (SELECT o_orderkey, o_custkey * 2 + 9007199254740992 AS v FROM orders) ASOF LEFT JOIN (SELECT c_custkey * 3 + 9007199254740992 AS k, c_name FROM customer) ON v >= k",
    "match_descending": "SELECT s_suppkey, pos + 1 AS match FROM supplier s ASOF LEFT JOIN (SELECT c_acctbal, min(c_custkey) AS pos FROM customer GROUP BY 1) c ON s.s_acctbal <= c.c_acctbal",
    "wildcard_default": "WITH v AS (SELECT DISTINCT left(c_mktsegment, 2) AS s FROM customer), h AS (SELECT s, (SELECT max(p_partkey) FROM part WHERE p_type ILIKE '%' || s || '%') AS k FROM v) SELECT c_custkey, coalesce(k, -1) AS p_partkey FROM customer JOIN h ON left(c_mktsegment, 2) = s",
    "more_bases": "SELECT p_partkey, hex(p_size) AS bin2hex, bin(p_size) AS hex2bin, printf('%o', p_size) AS hex2oct, bin(p_size) AS oct2bin, p_size::DOUBLE AS oct2dec, lpad(hex(p_size), 4, '0') AS padded FROM part",
    "complex_functions": _complex_sql(),
    "information": """SELECT p_partkey, p_size <= 25 AS blank, p_size < 25 AS err, false AS err_na, true AS nontext, true AS logical, true AS ref, true AS omitted, (p_size > 25)::INTEGER::DOUBLE AS n, p_name AS t, true AS na, round(pi(), 9) AS pi, true AS "true", '"' || p_name || '"' AS shown, CASE WHEN p_size < 25 THEN 6 END AS error_type FROM part""",
    "more_texts": """SELECT p_partkey, unicode(p_name) AS code, chr(p_size + 64) AS sign, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS proper, upper(p_name) AS asc, array_to_string(string_split(p_name, ' '), ', ') AS listed FROM part""",
    "distribution_closed_forms": f"""WITH t AS (SELECT p_partkey, {_T} AS x, {_Q} AS q, p_size::DOUBLE AS n FROM part)
        SELECT p_partkey, round(0.5 + atan(x) / pi(), 6) AS t1, round(0.5 - atan(x) / pi(), 6) AS t1_rt, round(1 - 2 * atan(x) / pi(), 6) AS t1_2t, round(0.5 + x / (2 * sqrt(2 + x * x)), 6) AS t2, round(tan(pi() * (q - 0.5)), 6) AS t1_inv, round(tan(pi() * (1 - q) / 2), 6) AS t1_inv2, round(0.5 - atan(x) / pi(), 6) AS tdist,
        round(1 - exp(-x / 2), 6) AS chi2, round(exp(-x / 2), 6) AS chi2_rt, round(exp(-x / 2) / 2, 6) AS chi2_pdf, round(-2 * ln(1 - q), 6) AS chi2_inv, round(-2 * ln(q), 6) AS chi2_inv_rt,
        round(x / (1 + x), 6) AS f22, round(1 / (1 + x), 6) AS f22_rt, round(q / (1 - q), 6) AS f22_inv, round((1 - q) / q, 6) AS f22_inv_rt,
        round(1 - exp(-x / 2), 6) AS gamma1, round(1 - exp(-x) * (1 + x), 6) AS gamma2, round(x * exp(-x), 6) AS gamma_pdf, round(-2 * ln(1 - q), 6) AS gamma_inv, round(gamma(x + 0.5), 6) AS gamma, round(lgamma(n), 6) AS gammaln,
        round(1 - pow(1 - q, 3), 6) AS beta, round(6 * q * (1 - q), 6) AS beta_pdf, round(1 - pow(1 - q, 1 / 3.0::DOUBLE), 6) AS beta_inv, round(pow(q, 3), 6) AS betadist,
        round((60 - n) * (59 - n) / (60 * 59), 6) AS hypergeometric, round(pow(1 - q, n) + n * q * pow(1 - q, n - 1), 6) AS binomial_range, CASE WHEN 1 - q >= 0.5 THEN 0.0::DOUBLE ELSE 1.0 END AS binom_inv, round(x + 2 * 1.959963984540054, 6) AS expon_like, round(1.959963984540054 * x / sqrt(n), 6) AS confidence, 0.5::DOUBLE AS norm_mid FROM t""",
    "papers_at_maturity": """WITH t AS (SELECT o_orderkey, o_custkey % 8 / 100.0::DOUBLE + 0.02 AS y FROM orders)
        SELECT o_orderkey, round((100 + 400 / 365.0::DOUBLE * 0.05 * 100) / (1 + 300 / 365.0::DOUBLE * y) - 100 / 365.0::DOUBLE * 0.05 * 100, 6) AS pricemat, round(y, 6) AS yieldmat, round(1000 * 0.06::DOUBLE * 90 / 365, 6) AS accrint FROM t""",
    "modified_returns": """WITH s AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND min(l_linenumber) = 1)
        SELECT l_orderkey, CASE WHEN max(l_linenumber) > 1 THEN round(pow(sum(CASE WHEN l_linenumber > 1 THEN l_extendedprice * pow(1.12, n - l_linenumber) ELSE 0 END) / sum(CASE WHEN l_linenumber = 1 THEN l_extendedprice ELSE 0 END), 1 / (max(n) - 1.0::DOUBLE)) - 1, 6) END AS mirr, product(l_quantity) AS product FROM lineitem JOIN s USING (l_orderkey) GROUP BY l_orderkey""",
    "grids": "SELECT i // 3 AS r, i % 3 AS c, (5 + 2 * i)::DOUBLE AS value FROM range(60) t(i)",
    "loan_sums": """WITH t AS (SELECT o_orderkey, o_custkey % 12 / 1200.0::DOUBLE + 0.001 AS i FROM orders), u AS (SELECT *, i / (1 - pow(1 + i, -24)) AS p FROM t)
        SELECT o_orderkey, round(-(12 * p - (1 - (pow(1 + i, 12) - p * (pow(1 + i, 12) - 1) / i))), 6) AS interest, round(-(1 - (pow(1 + i, 12) - p * (pow(1 + i, 12) - 1) / i)), 6) AS paid FROM u""",
}
