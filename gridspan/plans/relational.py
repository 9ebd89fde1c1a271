"""Lookups, dynamic arrays, ranks, formatting rules, streaming shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import formatting as CF
from ..operators import frames as FR
from ..operators import lookup as L
from ..streaming import windows as W
from .common import r, table


def xlookup_exact(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return L.XLOOKUP(o.select("o_orderkey", "o_custkey"), "o_custkey", c, "c_custkey", ["c_name", "c_mktsegment"], pos="c_custkey")


def xlookup_default(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_acctbal > 0")
    return L.XLOOKUP(o.select("o_orderkey", "o_custkey"), "o_custkey", c, "c_custkey", ["c_name"], {"c_name": "none"}, pos="c_custkey").select("o_orderkey", "c_name")


def xlookup_last_text(spark, sf):
    n = table(spark, sf, "nation").select(F.lower("n_name").alias("name"))
    c = table(spark, sf, "nation").select("n_name", "n_nationkey")
    return L.XLOOKUP(n, "name", c, "n_name", ["n_nationkey"], pos="n_nationkey", last=True).select("name", "n_nationkey")


def lookup_chain(spark, sf):
    c, n, g = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    one = L.VLOOKUP(c.select("c_custkey", "c_nationkey"), "c_nationkey", n.select("n_nationkey", "n_regionkey"), 2, sorted_=False)
    return L.VLOOKUP(one.drop("lookup_error"), "n_regionkey", g, 2, sorted_=False).select("c_custkey", "r_name")


def lookup_sorted(spark, sf):
    s, c = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), table(spark, sf, "customer").groupBy("c_acctbal").agg(F.min("c_custkey").alias("key"))
    return L.LOOKUP(s, "s_acctbal", c, "c_acctbal", "key")


def xlookup_next_larger(spark, sf):
    s, c = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), table(spark, sf, "customer").groupBy("c_acctbal").agg(F.min("c_custkey").alias("key"))
    return L.XLOOKUP(s, "s_acctbal", c, "c_acctbal", ["key", "c_acctbal"], match=1)


def asof_events(spark, sf):
    """The last event of the user's at or before each purchase time plus a half day."""
    e = table(spark, sf, "events")
    seek = e.where("event_type = 'purchase'").select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("until"))
    last = e.groupBy("user_id", "ts").agg(F.max("event_id").alias("last_id"))
    return L.ASOF(seek, "until", last, "ts", ["last_id"], by=["user_id"]).select("event_id", "last_id")


def match_position(spark, sf):
    n = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("pos"))
    return L.MATCH(table(spark, sf, "nation").select(F.col("n_name").alias("v")), "v", n, "n_name", "pos", 0).select("v", "match")


def wildcard_lookup(spark, sf):
    want = table(spark, sf, "region").select(F.concat(F.left("r_name", F.lit(1)), F.lit("*a*")).alias("pattern"))
    return L.WILDCARD(want, "pattern", table(spark, sf, "nation"), "n_name", ["n_nationkey"], "n_nationkey").select("pattern", "n_nationkey")


def semi_lookup(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_acctbal > 5000")
    return L.SEMI(o, "o_custkey", c, "c_custkey").select("o_orderkey")


def anti_lookup(spark, sf):
    return L.SEMI(table(spark, sf, "documents"), "doc_id", table(spark, sf, "labels"), "doc_id", False).select("doc_id")


def filter_if_empty(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    none = FR.FILTER(p, F.col("p_size") > 1000, {"p_partkey": -1})
    return FR.FILTER(p, F.col("p_size") > 48, {"p_partkey": -1}).unionByName(none)


def sort_take(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return FR.TAKE(o, 25, F.col("o_totalprice").desc(), F.col("o_orderkey"))


def drop_rows(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return FR.DROP(FR.DROP(c, 100, "c_custkey"), -50, "c_custkey")


def unique_rows(spark, sf):
    p = table(spark, sf, "part")
    return FR.UNIQUE(p.select("p_brand", "p_size", "p_partkey"), "p_brand", "p_size", pos="p_partkey")


def unique_once(spark, sf):
    return FR.UNIQUE(table(spark, sf, "part").select("p_type", "p_size", "p_partkey"), "p_type", "p_size", pos="p_partkey", exactly_once=True).drop("p_partkey")


def positions(spark, sf):
    return FR.with_pos(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


def vstack_unique(spark, sf):
    c, s = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment"), table(spark, sf, "supplier").select("s_nationkey")
    return FR.VSTACK(c, s).distinct()


def hstack(spark, sf):
    a = FR.with_pos(table(spark, sf, "nation").select("n_name"), "n_name")
    b = FR.with_pos(table(spark, sf, "region").select("r_name"), "r_name")
    return FR.HSTACK(a, b)


def wrap_rows(spark, sf):
    return FR.WRAPROWS(FR.with_pos(table(spark, sf, "nation").select("n_name"), "n_name"), "n_name", 4, "-")


def to_column(spark, sf):
    n = FR.with_pos(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("a"), F.col("n_regionkey").cast("long").alias("b")), "a")
    return FR.TOCOL(n, "a", "b")


def choose_rows(spark, sf):
    n = FR.with_pos(table(spark, sf, "nation").select("n_name"), "n_name")
    return FR.CHOOSEROWS(n, 3, -1, 1, 3).select("out", "n_name")


def matrix_product(spark, sf):
    e = table(spark, sf, "embeddings")
    cells = e.select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "value"))
    cells = cells.select("r", F.col("c").cast("long").alias("c"), F.col("value").cast("double").alias("value"))
    weights = spark.range(8 * 2000).select((F.col("id") / 8).cast("long").alias("r"), (F.col("id") % 8).alias("c")).withColumn("value", ((F.col("r") * 7 + F.col("c") * 3) % 5).cast("double"))
    out = FR.MMULT(cells, weights)
    return out.select("r", "c", r(F.col("value"), 3).alias("value"))


def running_sum(spark, sf):
    """Running sums and following values of each user, however many events one has."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.round("value", 6).alias("v"))
    summed = FR.prefix_sum(e, "v", "event_id", by=["user_id"], name="running")
    out = FR.shifted(summed, "event_type", 1, "event_id", by=["user_id"], name="following")
    return out.select("event_id", "user_id", r(F.col("running"), 3).alias("running"), "following")


def running_window(spark, sf):
    """The same by window functions, for users whose events one task orders."""
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", r(FR.running(F.round("value", 6), "event_id", ["user_id"]), 3).alias("running"), FR.OFFSET("event_type", 1, "event_id", ["user_id"]).alias("following"))


def ranks(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return S.ranked(p, "p_size").select("p_partkey", "rank_eq", "rank_avg")


def rank_in_groups(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    out = S.ranked(S.ranked(p, "p_retailprice", True, ["p_brand"], avg="_avg"), "p_size", False, ["p_brand"], eq="_eq")
    return out.select("p_partkey", F.col("rank_eq").cast("int").alias("rank_eq"), "rank_avg")


def rank_window(spark, sf):
    """The same by window functions, for groups that one task orders."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.rank_eq(F.col("p_retailprice"), True, ["p_brand"]).alias("rank_eq"), S.rank_avg(F.col("p_size"), False, ["p_brand"]).alias("rank_avg"))


def large_small(spark, sf):
    p = table(spark, sf, "part")
    big = S.order_statistic(p, "p_retailprice", 5, ["p_brand"]).withColumnRenamed("value", "large5")
    return big.join(S.order_statistic(p, "p_retailprice", 5, ["p_brand"], largest=False).withColumnRenamed("value", "small5"), "p_brand")


def frequency(spark, sf):
    return S.frequency(table(spark, sf, "lineitem"), "l_quantity", [10, 40, 20, 30])


def mode_values(spark, sf):
    return S.modes(table(spark, sf, "part"), "p_size", "p_partkey")


def format_duplicates(spark, sf):
    return CF.duplicates(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type").select("p_partkey", "flag")


def format_average(spark, sf):
    return CF.average_rule(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "flag")


def format_top(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return CF.top_rule(CF.top_rule(c, "c_acctbal", 10, name="top10"), "c_acctbal", 5, percent=True, bottom=True, name="bottom5").select("c_custkey", "top10", "bottom5")


def format_scales(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out = CF.icon_set(CF.data_bar(c, "c_acctbal", low=("min",), high=("max",)), "c_acctbal", [33, 67])
    return out.select("c_custkey", r(F.col("bar"), 5).alias("bar"), F.col("icon").cast("int").alias("icon"))


def format_thresholds(spark, sf):
    """Bars that start at zero, colors, icons and ratings at thresholds of all kinds."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    out = CF.color_scale(CF.data_bar(s, "s_acctbal"), "s_acctbal", ["000000", "ff8000"], points=[("num", 6000), ("num", 1000)])
    out = CF.icon_set(out, "s_acctbal", [("percentile", 25), ("num", 5000, False), ("formula", F.avg("s_acctbal") + 2000)])
    out = CF.icon_rating(out, "s_acctbal", [("min", None, False), 25, ("percentile", 50), 75, ("max",)])
    return out.select("s_suppkey", r(F.col("bar"), 5).alias("bar"), "color", "icon", "rating")


def format_rules(spark, sf):
    o = table(spark, sf, "orders")
    today = F.expr("DATE'1996-05-15'")
    return o.select(
        "o_orderkey", CF.cell_is(F.col("o_totalprice"), "num", "between", 1000, 200000).alias("between"), CF.text_rule(F.col("o_orderpriority"), "contains", "URGENT").alias("urgent"),
        CF.time_period(F.col("o_orderdate"), "thisMonth", today).alias("this_month"), CF.time_period(F.col("o_orderdate"), "lastYear", today).alias("last_year"), CF.time_period(F.col("o_orderdate"), "last7Days", today).alias("last7"),
        CF.prioritised([(1, F.col("o_totalprice") > 100000, "red"), (2, F.col("o_totalprice") > 200000, "bold")]).alias("style"),
    )


def tumbling_windows(spark, sf):
    e = table(spark, sf, "events")
    return W.windowed(e, "ts", "1 day", "value", ("event_type", "str", "p*")).select(F.unix_timestamp("start").alias("start"), "n", r(F.col("total"), 2).alias("total"), r(F.col("mean"), 3).alias("mean"), r(F.col("most"), 3).alias("most"))


def session_windows(spark, sf):
    return W.sessions(table(spark, sf, "events"), "ts", "30 minutes", ["user_id"], "value").select("user_id", F.unix_timestamp("start").alias("start"), "n", r(F.col("total"), 2).alias("total"))


QUERIES = {f.__name__: f for f in (
    xlookup_exact, xlookup_default, xlookup_last_text, lookup_chain, lookup_sorted, xlookup_next_larger, asof_events, match_position, wildcard_lookup, semi_lookup, anti_lookup,
    filter_if_empty, sort_take, drop_rows, unique_rows, unique_once, positions, vstack_unique, hstack, wrap_rows, to_column, choose_rows, matrix_product, running_sum, running_window,
    ranks, rank_in_groups, rank_window, large_small, frequency, mode_values, format_duplicates, format_average, format_top, format_scales, format_thresholds, format_rules, tumbling_windows, session_windows,
)}

_ROWS = "(SELECT *, row_number() OVER (ORDER BY n_name) - 1 AS p FROM nation)"
ORACLES = {
    "xlookup_exact": "SELECT o_orderkey, o_custkey, c_name, c_mktsegment, CASE WHEN c_custkey IS NULL THEN '#N/A' END AS lookup_error FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "xlookup_default": "SELECT o_orderkey, coalesce(c_name, 'none') AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
    "xlookup_last_text": "SELECT lower(a.n_name) AS name, (SELECT max(b.n_nationkey) FROM nation b WHERE upper(b.n_name) = upper(a.n_name)) AS n_nationkey FROM nation a",
    "lookup_chain": "SELECT c_custkey, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "lookup_sorted": "SELECT s_suppkey, s_acctbal, key, CASE WHEN key IS NULL THEN '#N/A' END AS lookup_error FROM supplier s ASOF LEFT JOIN (SELECT c_acctbal, min(c_custkey) AS key FROM customer GROUP BY 1) c ON s.s_acctbal >= c.c_acctbal",
    "xlookup_next_larger": "SELECT s_suppkey, s_acctbal, key, c_acctbal, CASE WHEN key IS NULL THEN '#N/A' END AS lookup_error FROM supplier s ASOF LEFT JOIN (SELECT c_acctbal, min(c_custkey) AS key FROM customer GROUP BY 1) c ON s.s_acctbal <= c.c_acctbal",
    "asof_events": "SELECT s.event_id, l.last_id FROM (SELECT event_id, user_id, ts + INTERVAL 12 HOURS AS until FROM events WHERE event_type = 'purchase') s ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS last_id FROM events GROUP BY 1, 2) l ON s.user_id = l.user_id AND s.until >= l.ts",
    "match_position": "SELECT n_name AS v, n_nationkey::BIGINT + 1 AS match FROM nation",
    "wildcard_lookup": "SELECT left(r_name, 1) || '*a*' AS pattern, (SELECT min(n_nationkey) FROM nation WHERE n_name ILIKE left(r_name, 1) || '%a%') AS n_nationkey FROM region",
    "semi_lookup": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "anti_lookup": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "filter_if_empty": "SELECT p_partkey, p_size FROM part WHERE p_size > 48 UNION ALL SELECT -1, NULL",
    "sort_take": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "drop_rows": "SELECT c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS a, row_number() OVER (ORDER BY c_custkey DESC) AS b FROM customer) WHERE a > 100 AND b > 50",
    "unique_rows": "SELECT arg_min(p_brand, p_partkey) AS p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY upper(p_brand), p_size",
    "unique_once": "SELECT min(p_type) AS p_type, p_size FROM part GROUP BY upper(p_type), p_size HAVING count(*) = 1",
    "positions": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos FROM orders",
    "vstack_unique": "SELECT c_nationkey, c_mktsegment FROM customer UNION SELECT s_nationkey, NULL FROM supplier",
    "hstack": "SELECT coalesce(a.p, b.p) AS _pos, n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS p FROM nation) a FULL JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS p FROM region) b ON a.p = b.p",
    "wrap_rows": f"SELECT p // 4 AS r, coalesce(max(n_name) FILTER (WHERE p % 4 = 0), '-') AS c1, coalesce(max(n_name) FILTER (WHERE p % 4 = 1), '-') AS c2, coalesce(max(n_name) FILTER (WHERE p % 4 = 2), '-') AS c3, coalesce(max(n_name) FILTER (WHERE p % 4 = 3), '-') AS c4 FROM {_ROWS} GROUP BY 1",
    "to_column": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS _pos, 1 AS \"column\", n_nationkey::BIGINT AS value FROM nation UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey) - 1, 2, n_regionkey::BIGINT FROM nation",
    "choose_rows": f"SELECT o.i::BIGINT AS out, n_name FROM {_ROWS} JOIN (VALUES (0, 2), (1, (SELECT count(*) FROM nation) - 1), (2, 0), (3, 2)) o(i, p) USING (p)",
    "matrix_product": "SELECT r, w.c, round(sum(v * w.w), 3) AS value FROM (SELECT vec_id AS r, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) e JOIN (SELECT a.range AS k, b.range AS c, ((a.range * 7 + b.range * 3) % 5)::DOUBLE AS w FROM range(2000) a, range(8) b) w ON e.k = w.k GROUP BY 1, 2",
    "running_sum": "SELECT event_id, user_id, round(sum(round(value, 6)) OVER w, 3) AS running, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
    "ranks": "SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) AS rank_eq, rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS rank_avg FROM part",
    "rank_in_groups": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC)::INTEGER AS rank_eq, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS rank_avg FROM part",
    "large_small": "SELECT p_brand, list_sort(list(p_retailprice), 'DESC')[5] AS large5, list_sort(list(p_retailprice))[5] AS small5 FROM part GROUP BY 1",
    "frequency": "SELECT bin::INTEGER AS bin, upper::DOUBLE AS upper, (SELECT count(*) FROM lineitem WHERE l_quantity > lo AND (upper IS NULL OR l_quantity <= upper)) AS n FROM (VALUES (0, 10, -1e9), (1, 40, 30), (2, 20, 10), (3, 30, 20), (4, NULL, 40)) t(bin, upper, lo)",
    "mode_values": "WITH c AS (SELECT p_size AS value, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1) SELECT * FROM c WHERE n = (SELECT max(n) FROM c) AND n > 1",
    "format_duplicates": "SELECT p_partkey, coalesce(count(*) OVER (PARTITION BY lower(p_type)) > 1, false) AS flag FROM part",
    "format_average": "SELECT c_custkey, c_acctbal > avg(c_acctbal) OVER () AS flag FROM customer",
    "format_top": "SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC) <= 10 AS top10, rank() OVER (ORDER BY c_acctbal) <= greatest(count(*) OVER () * 5 // 100, 1) AS bottom5 FROM customer",
    "format_scales": "WITH b AS (SELECT c_custkey, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS bar FROM customer) SELECT c_custkey, round(bar, 5) AS bar, (CASE WHEN bar * 100 >= 33 THEN 1 ELSE 0 END + CASE WHEN bar * 100 >= 67 THEN 1 ELSE 0 END)::INTEGER AS icon FROM b",
    "format_thresholds": """WITH f AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi, quantile_cont(s_acctbal, 0.25) AS q1, quantile_cont(s_acctbal, 0.5) AS q2, avg(s_acctbal) + 2000 AS m FROM supplier),
        t AS (SELECT *, greatest(0, least(1, (s_acctbal - 1000) / 5000.0::DOUBLE)) AS w FROM supplier, f)
        SELECT s_suppkey, round((s_acctbal - least(lo, 0)) / (greatest(hi, 0) - least(lo, 0)), 5) AS bar, lower(printf('%02x%02x00', floor(255 * w + 0.5)::BIGINT, floor(128 * w + 0.5)::BIGINT)) AS color,
        CASE WHEN s_acctbal >= m THEN 3 WHEN s_acctbal > 5000 THEN 2 WHEN s_acctbal >= q1 THEN 1 ELSE 0 END AS icon,
        (s_acctbal > lo)::INTEGER + (s_acctbal >= lo + (hi - lo) * 0.25)::INTEGER + (s_acctbal >= q2)::INTEGER + (s_acctbal >= lo + (hi - lo) * 0.75)::INTEGER + (s_acctbal >= hi)::INTEGER AS rating FROM t""",
    "format_rules": """SELECT o_orderkey, o_totalprice BETWEEN 1000 AND 200000 AS between, contains(lower(o_orderpriority), 'urgent') AS urgent, date_trunc('month', o_orderdate) = TIMESTAMP '1996-05-01' AS this_month, year(o_orderdate) = 1995 AS last_year,
        o_orderdate::DATE BETWEEN DATE '1996-05-09' AND DATE '1996-05-15' AS last7, CASE WHEN o_totalprice > 200000 THEN 'bold' WHEN o_totalprice > 100000 THEN 'red' END AS style FROM orders""",
    "tumbling_windows": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, count(*) FILTER (WHERE event_type ILIKE 'p%') AS n, round(coalesce(sum(value) FILTER (WHERE event_type ILIKE 'p%'), 0), 2) AS total, round(avg(value) FILTER (WHERE event_type ILIKE 'p%'), 3) AS mean, round(coalesce(max(value) FILTER (WHERE event_type ILIKE 'p%'), 0), 3) AS most FROM events GROUP BY 1",
    "session_windows": "WITH a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS f FROM events), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, epoch(date_trunc('second', min(ts)))::BIGINT AS start, count(*) AS n, round(sum(value), 2) AS total FROM b GROUP BY user_id, s",
}
ORACLES |= {"running_window": ORACLES["running_sum"], "rank_window": ORACLES["rank_in_groups"]}
