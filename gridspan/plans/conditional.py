"""Conditional aggregates, database functions, subtotals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import math as M
from ..functions import stats as S
from ..operators import criteria as C
from ..operators import database as DB
from .common import r, table


def sumifs_by_flag(spark, sf):
    """UNIQUE flags with SUMIFS, COUNTIFS and AVERAGEIFS of each, as one aggregation."""
    where = [("l_quantity", "num", "<=24"), ("l_shipdate", "date", ">=1/1/1995")]
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        r(C.SUMIFS("l_extendedprice", *where), 2).alias("total"), C.COUNTIFS(*where).alias("n"), r(C.AVERAGEIFS("l_discount", *where)).alias("mean"),
        r(C.MAXIFS("l_tax", *where)).alias("most"), r(C.MINIFS("l_extendedprice", *where)).alias("least"),
    )


def criteria_text(spark, sf):
    p = table(spark, sf, "part")
    tests = {"wild": "*a*e*", "start": "p*", "single": "?a*", "not_wild": "<>*a", "exact": "=Part 1", "after": ">m", "any": "<>", "empty": "="}
    return p.agg(*[C.COUNTIF("p_name", "str", t).alias(n) for n, t in tests.items()], C.COUNTIF("p_size", "num", "10").alias("num10"), C.COUNTIF("p_size", "num", "<>10").alias("not10"), C.COUNTIF("p_size", "num", "abc").alias("none"))


def criteria_dates(spark, sf):
    o = table(spark, sf, "orders")
    return o.agg(
        C.COUNTIF("o_orderdate", "date", "<7/31/1995").alias("before"), C.COUNTIF("o_orderdate", "date", ">=7/31/1995").alias("after"), C.COUNTIF("o_orderdate", "date", "<>1995-07-31").alias("other"),
        r(C.SUMIF("o_orderdate", "date", "=1995-07-31", "o_totalprice"), 2).alias("on_day"), r(C.AVERAGEIF("o_orderdate", "date", "<7/31/1995", "o_totalprice"), 2).alias("mean"),
    )


CRITERIA = [{"l_returnflag": "A", "l_quantity": ">40"}, {"l_returnflag": "R", "l_discount": "<0.02"}]


def database_functions(spark, sf):
    li = table(spark, sf, "lineitem")
    out = None
    for i, f in enumerate((DB.DSUM, DB.DAVERAGE, DB.DCOUNT, DB.DCOUNTA, DB.DMAX, DB.DMIN, DB.DSTDEV, DB.DSTDEVP, DB.DVAR, DB.DVARP)):
        one = f(li, "L_EXTENDEDPRICE", CRITERIA).select(F.lit(i).alias("i"), r(F.col("value"), 2).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def database_get(spark, sf):
    c = table(spark, sf, "customer")
    return DB.DGET(c, "c_name", [{"c_custkey": 7}]).unionByName(DB.DGET(c, "c_name", [{"c_custkey": -1}])).unionByName(DB.DGET(c, "c_name", [{"c_nationkey": 3}]))


def subtotal_rollup(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("hidden", F.col("l_linenumber") > 4)
    out = DB.subtotal(li, 109, "l_quantity", ["l_returnflag", "l_linestatus"], hidden="hidden")
    return out.select("l_returnflag", "l_linestatus", F.col("level").cast("int").alias("level"), r(F.col("value"), 2).alias("value"))


def subtotal_codes(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("hidden", F.col("l_linenumber") > 4).withColumn("filtered", F.col("l_returnflag") == "N")
    out = None
    for code in (1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 101, 102, 109, 110, 111):
        one = DB.subtotal(li, code, "l_quantity", filtered="filtered", hidden="hidden").select(F.lit(code).alias("code"), r(F.col("value")).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def aggregates(spark, sf):
    li = table(spark, sf, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return li.groupBy("l_returnflag").agg(
        r(M.SUM(q), 2).alias("sum"), r(M.SUMSQ(q), 2).alias("sumsq"), r(M.MAX(p), 2).alias("max"), r(M.MIN(p), 2).alias("min"), r(M.SUMPRODUCT(q, F.col("l_discount")), 2).alias("sumproduct"),
        r(M.SUMX2MY2(q, F.col("l_tax")), 2).alias("x2my2"), r(M.SUMX2PY2(q, F.col("l_tax")), 2).alias("x2py2"), r(M.SUMXMY2(q, F.col("l_tax")), 2).alias("xmy2"), r(M.PERCENTOF(F.when(q > 25, q), q)).alias("percentof"),
        S.COUNT(q).alias("count"), S.COUNTA(F.col("l_linestatus")).alias("counta"), S.COUNTBLANK(F.col("l_linestatus")).alias("blank"), r(S.AVERAGE(p), 2).alias("average"),
    )


def a_variants(spark, sf):
    o = table(spark, sf, "orders")
    late = F.when(F.col("o_totalprice") > 300000, None).otherwise(F.col("o_totalprice") > 100000)
    return o.groupBy("o_orderstatus").agg(
        r(S.AVERAGEA(late, "bool")).alias("averagea"), r(S.MAXA(late, "bool")).alias("maxa"), r(S.MINA(late, "bool")).alias("mina"), r(S.STDEVA(late, "bool")).alias("stdeva"),
        r(S.VARPA(late, "bool")).alias("varpa"), r(S.VARA(late, "bool")).alias("vara"), r(S.STDEVPA(late, "bool")).alias("stdevpa"), r(S.AVERAGEA(F.col("o_orderpriority"), "str")).alias("text"),
    )


QUERIES = {f.__name__: f for f in (sumifs_by_flag, criteria_text, criteria_dates, database_functions, database_get, subtotal_rollup, subtotal_codes, aggregates, a_variants)}

_W = "l_quantity <= 24 AND l_shipdate::DATE >= DATE '1995-01-01'"
_D = "((l_returnflag ILIKE 'A%' AND l_quantity > 40) OR (l_returnflag ILIKE 'R%' AND l_discount < 0.02))"
ORACLES = {
    "sumifs_by_flag": f"""SELECT l_returnflag, round(coalesce(sum(l_extendedprice) FILTER (WHERE {_W}), 0), 2) AS total, count(*) FILTER (WHERE {_W}) AS n, round(avg(l_discount) FILTER (WHERE {_W}), 4) AS mean,
        round(coalesce(max(l_tax) FILTER (WHERE {_W}), 0), 4) AS most, round(coalesce(min(l_extendedprice) FILTER (WHERE {_W}), 0), 4) AS least FROM lineitem GROUP BY 1""",
    "criteria_text": """SELECT count(*) FILTER (WHERE p_name ILIKE '%a%e%') AS wild, count(*) FILTER (WHERE p_name ILIKE 'p%') AS start, count(*) FILTER (WHERE p_name ILIKE '_a%') AS single, count(*) FILTER (WHERE NOT coalesce(p_name ILIKE '%a', false)) AS not_wild,
        count(*) FILTER (WHERE lower(p_name) = 'part 1') AS exact, count(*) FILTER (WHERE lower(p_name) > 'm') AS after, count(p_name) AS any, count(*) FILTER (WHERE p_name IS NULL) AS empty,
        count(*) FILTER (WHERE p_size = 10) AS num10, count(*) FILTER (WHERE p_size IS DISTINCT FROM 10) AS not10, 0::BIGINT AS none FROM part""",
    "criteria_dates": """SELECT count(*) FILTER (WHERE d < DATE '1995-07-31') AS before, count(*) FILTER (WHERE d >= DATE '1995-07-31') AS after, count(*) FILTER (WHERE d <> DATE '1995-07-31') AS other,
        round(coalesce(sum(o_totalprice) FILTER (WHERE d = DATE '1995-07-31'), 0), 2) AS on_day, round(avg(o_totalprice) FILTER (WHERE d < DATE '1995-07-31'), 2) AS mean FROM (SELECT *, o_orderdate::DATE AS d FROM orders)""",
    "database_functions": f"""WITH m AS (SELECT l_extendedprice AS x FROM lineitem WHERE {_D}) SELECT i::INTEGER AS i, round(value, 2) AS value FROM (
        SELECT 0 AS i, sum(x) AS value FROM m UNION ALL SELECT 1, avg(x) FROM m UNION ALL SELECT 2, count(x) FROM m UNION ALL SELECT 3, count(x) FROM m UNION ALL SELECT 4, max(x) FROM m UNION ALL SELECT 5, min(x) FROM m
        UNION ALL SELECT 6, stddev_samp(x) FROM m UNION ALL SELECT 7, stddev_pop(x) FROM m UNION ALL SELECT 8, var_samp(x) FROM m UNION ALL SELECT 9, var_pop(x) FROM m)""",
    "database_get": """SELECT c_name AS value, NULL::VARCHAR AS error FROM customer WHERE c_custkey = 7 UNION ALL SELECT NULL, '#VALUE!' UNION ALL SELECT NULL, '#NUM!'""",
    "subtotal_rollup": """SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::INTEGER AS level, round(sum(l_quantity), 2) AS value FROM lineitem WHERE l_linenumber <= 4 GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "subtotal_codes": """WITH f AS (SELECT l_quantity AS q FROM lineitem WHERE l_returnflag <> 'N'), h AS (SELECT l_quantity AS q FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <= 4)
        SELECT code::INTEGER AS code, round(value, 4) AS value FROM (SELECT 1 AS code, avg(q) AS value FROM f UNION ALL SELECT 2, count(q) FROM f UNION ALL SELECT 3, count(q) FROM f UNION ALL SELECT 4, max(q) FROM f UNION ALL SELECT 5, min(q) FROM f
        UNION ALL SELECT 7, stddev_samp(q) FROM f UNION ALL SELECT 8, stddev_pop(q) FROM f UNION ALL SELECT 9, sum(q) FROM f UNION ALL SELECT 10, var_samp(q) FROM f UNION ALL SELECT 11, var_pop(q) FROM f
        UNION ALL SELECT 101, avg(q) FROM h UNION ALL SELECT 102, count(q) FROM h UNION ALL SELECT 109, sum(q) FROM h UNION ALL SELECT 110, var_samp(q) FROM h UNION ALL SELECT 111, var_pop(q) FROM h)""",
    "aggregates": """SELECT l_returnflag, round(sum(l_quantity), 2) AS sum, round(sum(l_quantity * l_quantity), 2) AS sumsq, round(max(l_extendedprice), 2) AS max, round(min(l_extendedprice), 2) AS min, round(sum(l_quantity * l_discount), 2) AS sumproduct,
        round(sum(l_quantity * l_quantity - l_tax * l_tax), 2) AS x2my2, round(sum(l_quantity * l_quantity + l_tax * l_tax), 2) AS x2py2, round(sum((l_quantity - l_tax) * (l_quantity - l_tax)), 2) AS xmy2,
        round(sum(l_quantity) FILTER (WHERE l_quantity > 25) / sum(l_quantity), 4) AS percentof, count(l_quantity) AS count, count(l_linestatus) AS counta, count(*) FILTER (WHERE l_linestatus IS NULL OR l_linestatus = '') AS blank, round(avg(l_extendedprice), 2) AS average FROM lineitem GROUP BY 1""",
    "a_variants": """WITH t AS (SELECT o_orderstatus, CASE WHEN o_totalprice > 300000 THEN NULL ELSE (o_totalprice > 100000)::INTEGER::DOUBLE END AS x FROM orders)
        SELECT o_orderstatus, round(avg(x), 4) AS averagea, max(x) AS maxa, min(x) AS mina, round(stddev_samp(x), 4) AS stdeva, round(var_pop(x), 4) AS varpa, round(var_samp(x), 4) AS vara, round(stddev_pop(x), 4) AS stdevpa, 0.0::DOUBLE AS text FROM t GROUP BY 1""",
}
