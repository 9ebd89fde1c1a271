"""Statistical aggregates, ranks, regression and tests.

Aggregates are Columns for ``agg``; they skip what isn't a number. Exact order
statistics use Spark's percentile, whose buffer grows with the distinct values
of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cells import NIMPL, NUM, Cell, made, num, raw
from ..operators.frames import prefix_sum
from . import distributions as D
from .grouped import beside

n_of = lambda c: F.count(num(c))


def AVERAGE(c):
    return F.avg(num(c))


def a_view(c, kind: str = "num") -> Column:
    """A column as the A-variants see it: text is 0, booleans are 0 and 1."""
    c = raw(c)
    return F.when(c.isNotNull(), F.lit(0.0)) if kind == "str" else c.cast("int").cast("double") if kind == "bool" else c.cast("double")


def AVERAGEA(c, kind="num"):
    return F.avg(a_view(c, kind))


def MAXA(c, kind="num"):
    return F.coalesce(F.max(a_view(c, kind)), F.lit(0.0))


def MINA(c, kind="num"):
    return F.coalesce(F.min(a_view(c, kind)), F.lit(0.0))


def STDEVA(c, kind="num"):
    return F.stddev_samp(a_view(c, kind))


def STDEVPA(c, kind="num"):
    return F.stddev_pop(a_view(c, kind))


def VARA(c, kind="num"):
    return F.var_samp(a_view(c, kind))


def VARPA(c, kind="num"):
    return F.var_pop(a_view(c, kind))


def COUNT(c):
    return F.count(num(c))


def COUNTA(c):
    return F.count(raw(c))


def COUNTBLANK(c):
    return F.count_if(raw(c).isNull() | (raw(c).cast("string") == ""))


def GEOMEAN(c):
    return F.when(F.min(num(c)) > 0, F.exp(F.avg(F.when(num(c) > 0, F.ln(num(c))))))


def HARMEAN(c):
    return F.when(F.min(num(c)) > 0, F.count(num(c)) / F.sum(F.when(num(c) > 0, 1 / num(c))))


def DEVSQ(c):
    return F.var_pop(num(c)) * F.count(num(c))


def STDEV_S(c):
    return F.stddev_samp(num(c))


def STDEV_P(c):
    return F.stddev_pop(num(c))


def VAR_S(c):
    return F.var_samp(num(c))


def VAR_P(c):
    return F.var_pop(num(c))


def SKEW_P(c):
    return F.skewness(num(c))


def SKEW(c):
    n = n_of(c).cast("double")
    return F.when(n > 2, F.skewness(num(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def KURT(c):
    n = n_of(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(num(c)) + 6))


def MEDIAN(c):
    return F.median(num(c))


def PERCENTILE_INC(c, k: float):
    return F.percentile(num(c), k)


def PERCENTILE_EXC(c, k: float):
    """Interpolated at rank k(n + 1): the inclusive percentile at the share of the same rank."""
    n = n_of(c).cast("double")
    at = (k * (n + 1) - 1) / (n - 1)
    grid = F.sort_array(F.collect_list(num(c)))
    rank = k * (n + 1)
    low = F.floor(rank)
    value = F.get(grid, (low - 1).cast("int")) + (rank - low) * (F.coalesce(F.get(grid, low.cast("int")), F.lit(0.0)) - F.get(grid, (low - 1).cast("int")))
    return F.when((at >= 0) & (at <= 1), F.when(rank == n, F.max(num(c))).otherwise(value))


def QUARTILE_INC(c, q: int):
    return PERCENTILE_INC(c, q / 4)


def QUARTILE_EXC(c, q: int):
    return PERCENTILE_EXC(c, q / 4)


def tally(df: DataFrame, column: str, by=(), descending: bool = False) -> DataFrame:
    """A row for each distinct number of each group: _v, how often it is there (_n), how many are up to it (_upto) and in all (_total).

    The order statistics below are aggregates over it, grouped by ``by``. No
    group is gathered, however large it is.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return prefix_sum(counts, "_n", F.col("_v").desc() if descending else F.col("_v"), by=by, total="_total")


def at_rank(rank) -> Column:
    """The value at a rank from 1, between its neighbours where it is no whole one, of a tally; ``rank`` is a function of the count."""
    n = F.col("_total").cast("double")
    at = rank(n)
    low = F.floor(at)
    held = lambda k: F.max(F.when((F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k), F.col("_v")))
    value, above = held(low), held(low + 1)
    return F.when(F.max((at >= 1) & (at <= n)), value + F.max(at - low) * (F.coalesce(above, value) - value))


def percentile_of(k: float, exclusive: bool = False) -> Column:
    """PERCENTILE.INC or .EXC of a tally."""
    return at_rank((lambda n: k * (n + 1)) if exclusive else (lambda n: k * (n - 1) + 1))


def large_of(k: int) -> Column:
    """LARGE of a tally."""
    return at_rank(lambda n: n - k + 1)


def small_of(k: int) -> Column:
    """SMALL of a tally."""
    return at_rank(lambda n: F.lit(float(k)))


def trimmean_of(share: float) -> Column:
    """TRIMMEAN of a tally: of equal values those count that aren't cut off."""
    cut = F.floor(F.col("_total") * share / 2)
    end = F.col("_total") - cut
    left = F.least(F.col("_upto"), end) - F.greatest(F.col("_upto") - F.col("_n"), cut)
    return F.sum(F.when(left > 0, F.col("_v") * left)) / F.max(end - cut)


def order_statistic(df: DataFrame, column: str, k: int, by=(), largest: bool = True) -> DataFrame:
    """LARGE and SMALL of each group: the k-th value; null where a group has fewer."""
    return tally(df, column, by).groupBy(*by).agg((large_of(k) if largest else small_of(k)).alias("value"))


def LARGE(c, k: int):
    """The k-th largest, from all values of a group in memory; ``large_of`` a tally is the form for large groups."""
    return F.get(F.sort_array(F.collect_list(num(c)), False), k - 1)


def SMALL(c, k: int):
    """The k-th smallest; see LARGE."""
    return F.get(F.sort_array(F.collect_list(num(c))), k - 1)


def TRIMMEAN(c, share: float):
    values = F.sort_array(F.collect_list(num(c)))
    cut = F.floor(F.size(values) * share / 2).cast("int")
    kept = F.slice(values, cut + 1, F.size(values) - 2 * cut)
    return F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v) / F.size(kept)


def avedev(df: DataFrame, column: str, by=()) -> DataFrame:
    """AVEDEV: the mean first, then the mean distance to it."""
    joined = beside(df, df.groupBy(*by).agg(F.avg(column).alias("_mean")), by)
    return joined.groupBy(*by).agg(F.avg(F.abs(F.col(column) - F.col("_mean"))).alias("avedev"))


def modes(df: DataFrame, column: str, position: str) -> DataFrame:
    """MODE.MULT: the most frequent repeated values, by where they are seen first; the first is MODE.SNGL."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    most = counts.agg(F.max("n").alias("n"))
    return counts.where("n > 1").join(F.broadcast(most), "n").select("value", "n", "first")


def frequency(df: DataFrame, column: str, bins: list[float]) -> DataFrame:
    """FREQUENCY: how many values are in each bin (above the bin before, up to it), and above all bins, in the bins' own order."""
    ordered = sorted(set(bins))
    at = F.lit(len(ordered))
    for i, b in reversed(list(enumerate(ordered))):
        at = F.when(F.col(column) <= b, i).otherwise(at)
    counts = df.where(F.col(column).isNotNull()).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    rows = [(i, float(b), ordered.index(b) if bins.index(b) == i else -1) for i, b in enumerate(bins)] + [(len(bins), None, len(ordered))]
    wanted = df.sparkSession.createDataFrame(rows, "bin int, upper double, at int")
    return wanted.join(counts, "at", "left").select("bin", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def rank_eq(c, descending: bool = True, by=()) -> Column:
    """As a window, which orders a group in one task; ``ranked`` is the form for large groups and whole tables."""
    return F.rank().over(_ordered(c, descending, by))


def rank_avg(c, descending: bool = True, by=()) -> Column:
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, raw(c)))
    return rank_eq(c, descending, by) + (ties - 1) / 2


def _ordered(c, descending: bool, by):
    order = raw(c).desc() if descending else raw(c)
    return Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)


def ranked(df: DataFrame, column: str, descending: bool = True, by=(), eq: str = "rank_eq", avg: str = "rank_avg") -> DataFrame:
    """RANK.EQ and RANK.AVG over a whole table or groups of any size: ranks are summed over distinct values, and rows get theirs in a join."""
    by = list(by)
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    order = F.col("_v").desc() if descending else F.col("_v")
    before = F.col("_upto") - F.col("_n")
    ranks = prefix_sum(counts, "_n", order, by=by).select(*by, "_v", (before + 1).alias(eq), (before + 1 + (F.col("_n") - 1) / 2).alias(avg))
    return beside(df.withColumn("_v", F.col(column)), ranks, [*by, "_v"]).drop("_v")


def percentrank_inc(c, x: float, digits: int = 3) -> Column:
    """Share of the range of ranks at x, between its neighbours where it is no member, cut to the digits."""
    n, below, same = n_of(c).cast("double"), F.count_if(num(c) < x), F.count_if(num(c) == x)
    low, high = F.max(F.when(num(c) <= x, num(c))), F.min(F.when(num(c) > x, num(c)))
    at = F.when(same > 0, below.cast("double")).otherwise(below - 1 + (x - low) / (high - low))
    return F.when((F.min(num(c)) <= x) & (F.max(num(c)) >= x), F.floor(at / (n - 1) * 10**digits + 1e-9) / 10.0**digits)


def percentrank_exc(c, x: float, digits: int = 3) -> Column:
    n, below, same = n_of(c).cast("double"), F.count_if(num(c) < x), F.count_if(num(c) == x)
    low, high = F.max(F.when(num(c) <= x, num(c))), F.min(F.when(num(c) > x, num(c)))
    at = F.when(same > 0, below + 1.0).otherwise(below + (x - low) / (high - low))
    return F.when((F.min(num(c)) <= x) & (F.max(num(c)) >= x), F.floor(at / (n + 1) * 10**digits + 1e-9) / 10.0**digits)


def PROB(x, p, low: float, high: float | None = None):
    high = low if high is None else high
    return F.when(F.abs(F.sum(num(p)) - 1) < 1e-7, F.sum(F.when(num(x).between(low, high), num(p)).otherwise(0.0)))


def STANDARDIZE(x, mean, sd):
    return made((num(x) - num(mean)) / num(sd), [x, mean, sd], (num(sd) <= 0, NUM))


def PERMUT(n, k):
    a, b = F.floor(num(n)), F.floor(num(k))
    out = F.when(b == 0, 1.0).otherwise(F.aggregate(F.sequence((a - b + 1).cast("long"), F.greatest(a, a - b + 1).cast("long")), F.lit(1.0), lambda acc, i: acc * i))
    return made(F.when((a >= b) & (b >= 0), out), [n, k], ((a < 0) | (b < 0) | (a < b), NUM))


def PERMUTATIONA(n, k):
    a, b = F.floor(num(n)), F.floor(num(k))
    return made(F.pow(a.cast("double"), b.cast("double")), [n, k], ((a < 0) | (b < 0), NUM))


# pairs of columns; a pair without two numbers is left out


def _pairs(y, x):
    both = num(y).isNotNull() & num(x).isNotNull()
    return F.when(both, num(y)), F.when(both, num(x))


def COVARIANCE_P(x, y):
    return F.covar_pop(*_pairs(x, y))


def COVARIANCE_S(x, y):
    return F.covar_samp(*_pairs(x, y))


def CORREL(x, y):
    return F.corr(*_pairs(x, y))


PEARSON = CORREL


def RSQ(y, x):
    return F.regr_r2(num(y), num(x))


def SLOPE(y, x):
    return F.regr_slope(num(y), num(x))


def INTERCEPT(y, x):
    return F.regr_intercept(num(y), num(x))


def STEYX(y, x):
    a, b = num(y), num(x)
    return F.sqrt((F.regr_syy(a, b) - F.pow(F.regr_sxy(a, b), 2) / F.regr_sxx(a, b)) / (F.regr_count(a, b) - 2))


def FORECAST(at: float, y, x):
    return INTERCEPT(y, x) + SLOPE(y, x) * at


FORECAST_LINEAR = FORECAST


def linest(df: DataFrame, y: str, xs: list[str], constant: bool = True, log: bool = False) -> dict:
    """LINEST (LOGEST with ``log``): coefficients by name, standard errors, r2, se_y, f, df, ss_reg, ss_resid and error.

    One aggregation finds the means and one the products of what is left of
    them, so that large means cost no digits (without a constant the means
    stay in). Only those sums, whose number is that of the model's terms
    squared, come to the driver to be solved. A model whose terms depend on
    each other, or one without rows, has the error #NUM! and no numbers.
    """
    import numpy as np

    target = F.ln(F.col(y)) if log else F.col(y).cast("double")
    terms = [*[F.col(x).cast("double") for x in xs], target]
    rows = df.where(F.col(y).isNotNull() & ~F.greatest(*[F.col(x).isNull() for x in xs], F.lit(False), F.lit(False)))
    k = len(xs)
    found = rows.agg(F.count(F.lit(1)), *[F.avg(t) for t in terms]).first()
    n = found[0]
    mean = np.array(found[1:], float) if n and constant else np.zeros(k + 1)
    apart = [t - F.lit(float(m)) for t, m in zip(terms, mean)]
    places = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = rows.agg(*[F.sum(apart[i] * apart[j]) for i, j in places]).first()
    products = np.zeros((k + 1, k + 1))
    for (i, j), value in zip(places, sums):
        products[i, j] = products[j, i] = value or 0.0
    names = [*xs, *(["const"] if constant else [])]
    scale = np.sqrt(np.diag(products)[:k])
    alike = products[:k, :k] / np.outer(scale, scale) if (scale > 0).all() else np.zeros((k, k))
    if n < len(names) or np.linalg.matrix_rank(alike, tol=1e-12) < k:
        none = dict.fromkeys(names)
        return {"coefficients": none, "errors": dict(none), **dict.fromkeys(("r2", "se_y", "f", "df", "ss_reg", "ss_resid")), "error": NUM}
    inverse = np.linalg.inv(alike) / np.outer(scale, scale)
    beta, total = inverse @ products[:k, k], float(products[k, k])
    free = n - len(names)
    reg = float(beta @ products[:k, k])
    resid = max(total - reg, 0.0)
    sigma = resid / free if free > 0 else float("nan")
    variances = list(np.diag(inverse))
    if constant:
        beta = np.append(beta, mean[k] - mean[:k] @ beta)
        variances.append(1 / n + mean[:k] @ inverse @ mean[:k])
    shown = np.exp(beta) if log else beta
    return {
        "coefficients": dict(zip(names, map(float, shown))), "errors": dict(zip(names, map(float, np.sqrt(np.array(variances) * sigma)))), "r2": reg / total if total else 1.0,
        "se_y": sigma**0.5, "f": reg / max(k, 1) / sigma if sigma else float("inf"), "df": free, "ss_reg": reg, "ss_resid": resid, "error": None,
    }


def trend(df: DataFrame, y: str, xs: list[str], new: DataFrame, constant: bool = True, log: bool = False) -> DataFrame:
    """TREND (GROWTH with ``log``): ``new`` with the prediction in a column named like y; null where the model has an error."""
    beta = linest(df, y, xs, constant, log)["coefficients"]
    if None in beta.values():
        return new.withColumn(y, F.lit(None).cast("double"))
    if log:
        out = F.lit(beta.get("const", 1.0))
        for x in xs:
            out = out * F.pow(F.lit(beta[x]), F.col(x))
    else:
        out = F.lit(beta.get("const", 0.0))
        for x in xs:
            out = out + beta[x] * F.col(x)
    return new.withColumn(y, out)


# tests; the moments are aggregates, the distribution is applied to their result


def t_test(df: DataFrame, a: str, b: str, tails: int, kind: int) -> DataFrame:
    """T.TEST of two columns: kind 1 paired, 2 equal, 3 unequal variances. One row, column p."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    if kind == 1:
        d = x - y
        got = df.agg(F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.count(d).alias("n"))
        stat, free = F.col("m") / (F.col("s") / F.sqrt("n")), F.col("n") - 1
    else:
        got = df.agg(*[f(c).alias(n) for c, i in ((x, 1), (y, 2)) for f, n in ((F.avg, f"m{i}"), (F.var_samp, f"v{i}"), (F.count, f"n{i}"))])
        v1, v2, n1, n2 = (F.col(c) for c in ("v1", "v2", "n1", "n2"))
        if kind == 2:
            pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
            stat, free = (F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / n1 + 1 / n2)), n1 + n2 - 2
        else:
            w1, w2 = v1 / n1, v2 / n2
            stat = (F.col("m1") - F.col("m2")) / F.sqrt(w1 + w2)
            free = (w1 + w2) * (w1 + w2) / (w1 * w1 / (n1 - 1) + w2 * w2 / (n2 - 1))
    p = D._t_cdf(-F.abs(stat), free.cast("double")) * tails
    return got.select(p.alias("p"))


def f_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """F.TEST: two-tailed probability that two columns have the same variance."""
    got = df.agg(F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"), F.count(a).alias("n1"), F.count(b).alias("n2"))
    p = D._f_cdf(F.col("v1") / F.col("v2"), (F.col("n1") - 1).cast("double"), (F.col("n2") - 1).cast("double"))
    return got.select((2 * F.least(p, 1 - p)).alias("p"))


def z_test(df: DataFrame, a: str, x: float, sigma: float | None = None) -> DataFrame:
    got = df.agg(F.avg(a).alias("m"), F.stddev_samp(a).alias("s"), F.count(a).alias("n"))
    z = (F.col("m") - x) / ((F.lit(sigma) if sigma else F.col("s")) / F.sqrt("n"))
    return got.select((1 - D._norm(z)).alias("p"))


def chisq_test(df: DataFrame, actual: str, expected: str, degrees: int) -> DataFrame:
    got = df.agg(F.sum(F.pow(F.col(actual) - F.col(expected), 2) / F.col(expected)).alias("x"))
    return got.select((1 - D._gamma_cdf(F.col("x"), F.lit(degrees / 2), F.lit(2.0))).alias("p"))


FORECAST_ETS = FORECAST_ETS_CONFINT = FORECAST_ETS_SEASONALITY = FORECAST_ETS_STAT = lambda *args: Cell(F.lit(None).cast("double"), F.lit(NIMPL))

# legacy names
COVAR, PERCENTILE, PERCENTRANK, QUARTILE, RANK, STDEV, STDEVP, VAR, VARP = COVARIANCE_P, PERCENTILE_INC, percentrank_inc, QUARTILE_INC, rank_eq, STDEV_S, STDEV_P, VAR_S, VAR_P
CHITEST, FTEST, TTEST, ZTEST, MODE = chisq_test, f_test, t_test, z_test, modes
