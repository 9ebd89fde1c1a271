"""Distributions: densities as Columns where they are elementary, the rest as vectorised pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import special as sp
from ..cells import DIV, NUM, Cell, made, num, number


def _distinct(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct row of arguments occurs first, and which of these each row equals."""
    code = np.zeros(len(arrays[0]), np.int64)
    for a in arrays:
        own, values = pd.factorize(a)
        code = pd.factorize(code * len(values) + own)[0]
    return np.flatnonzero(~pd.Series(code).duplicated().to_numpy()), code


def _udf(f, once: bool = False):
    """A pandas UDF over double columns from a function over arrays; null and impossible arguments give null. ``once``: equal arguments of a batch are computed once, for functions that cost more than finding them."""

    def run(*series: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            arrays = [s.to_numpy(np.float64, na_value=np.nan) for s in series]
            out = np.full(len(series[0]), np.nan)
            full = ~np.isnan(np.column_stack(arrays)).any(axis=1)
            if full.any():
                given = [a[full] for a in arrays]
                if once:
                    first, code = _distinct(given)
                    out[full] = f(*[a[first] for a in given])[code]
                else:
                    out[full] = f(*given)
        return pd.Series(out).where(~np.isnan(out), None).astype("Float64")

    return F.pandas_udf(run, T.DoubleType())


def _made(f, args, *rules) -> Cell:
    """The UDF over the arguments, nulls in place of ones that a rule forbids."""
    bad = F.lit(False)
    for test, _ in rules:
        bad = bad | F.coalesce(test, F.lit(False))
    out = f(*[F.when(~bad, num(a)) for a in args])
    return made(out, args, *rules, (out.isNull() & ~bad, NUM))


def _floor(x) -> Column:
    return F.floor(num(x)).cast("double")


_norm = _udf(lambda z: sp.phi(z))
_norm_inv = _udf(lambda p: sp.normal_quantile(p))
_gamma_cdf = _udf(lambda x, a, b: sp.gammainc(a, x / b), once=True)
_gamma_inv = _udf(lambda p, a, b: b * sp.quantile(lambda x, a: sp.gammainc(a, x), p, 0 * a, 20 * np.maximum(a, 50), a), once=True)
_beta_cdf = _udf(lambda x, a, b: sp.betainc(a, b, x), once=True)
_beta_inv = _udf(lambda p, a, b: sp.quantile(lambda x, a, b: sp.betainc(a, b, x), p, 0.0, 1.0, a, b), once=True)
_t_cdf = _udf(lambda x, df: sp.t_cdf(x, df), once=True)
_t_inv = _udf(lambda p, df: sp.quantile(lambda u, df: sp.t_cdf(np.tan(u), df), p, -math.pi / 2, math.pi / 2, df), once=True)
_f_cdf = _udf(lambda x, a, b: sp.f_cdf(x, a, b), once=True)
_f_inv = _udf(lambda p, a, b: sp.quantile(lambda u, a, b: sp.f_cdf(u / (1 - u), a, b), p, 0.0, 1.0 - 1e-16, a, b), once=True)
_lgamma = _udf(lambda x: sp.gammaln(x))
_gamma = _udf(lambda x: sp.gamma(x))
_erf = _udf(lambda x: sp.erf(x))
_erfc = _udf(lambda x: sp.erfc(x))


def GAMMA(x):
    return _made(_gamma, [x], ((num(x) == 0) | ((num(x) < 0) & (num(x) == F.floor(num(x)))), NUM))


def GAMMALN(x):
    return _made(_lgamma, [x], (num(x) <= 0, NUM))


GAMMALN_PRECISE = GAMMALN


def ERF(low, high=None):
    if high is None:
        return _made(_erf, [low])
    a, b = ERF(low), ERF(high)
    return made(b.raw - a.raw, [a, b])


def ERFC(x):
    return _made(_erfc, [x])


ERF_PRECISE, ERFC_PRECISE = (lambda x: ERF(x)), ERFC


def NORM_S_DIST(z, cumulative: bool = True):
    return _made(_norm, [z]) if cumulative else PHI(z)


def PHI(z):
    return number(F.exp(-num(z) * num(z) / 2) / math.sqrt(2 * math.pi), [z])


def GAUSS(z):
    p = NORM_S_DIST(z)
    return made(p.raw - 0.5, [p])


def NORM_DIST(x, mean, sd, cumulative: bool = True):
    z = (num(x) - num(mean)) / num(sd)
    if not cumulative:
        return number(PHI(z).raw / num(sd), [x, mean, sd], (num(sd) <= 0, NUM))
    return made(_norm(F.when(num(sd) > 0, z)), [x, mean, sd], (num(sd) <= 0, NUM))


def NORM_S_INV(p):
    return _made(_norm_inv, [p], ((num(p) <= 0) | (num(p) >= 1), NUM))


def NORM_INV(p, mean, sd):
    z = NORM_S_INV(p)
    return made(num(mean) + num(sd) * z.raw, [z, mean, sd], (num(sd) <= 0, NUM))


def LOGNORM_DIST(x, mean, sd, cumulative: bool = True):
    rules = ((num(x) <= 0) | (num(sd) <= 0), NUM)
    log = F.when(num(x) > 0, F.ln(num(x)))
    if not cumulative:
        return number(NORM_DIST(log, mean, sd, False).raw / num(x), [x, mean, sd], rules)
    return made(NORM_DIST(log, mean, sd).raw, [x, mean, sd], rules)


def LOGNORM_INV(p, mean, sd):
    q = NORM_INV(p, mean, sd)
    return made(F.exp(q.raw), [q])


def EXPON_DIST(x, rate, cumulative: bool = True):
    out = 1 - F.exp(-num(rate) * num(x)) if cumulative else num(rate) * F.exp(-num(rate) * num(x))
    return number(out, [x, rate], ((num(x) < 0) | (num(rate) <= 0), NUM))


def WEIBULL_DIST(x, shape, scale, cumulative: bool = True):
    a, b = num(shape), num(scale)
    power = F.pow(num(x) / b, a)
    out = 1 - F.exp(-power) if cumulative else a / b * F.pow(num(x) / b, a - 1) * F.exp(-power)
    return number(out, [x, shape, scale], ((num(x) < 0) | (a <= 0) | (b <= 0), NUM))


def GAMMA_DIST(x, shape, scale, cumulative: bool = True):
    rules = ((num(x) < 0) | (num(shape) <= 0) | (num(scale) <= 0), NUM)
    if cumulative:
        return _made(_gamma_cdf, [x, shape, scale], rules)
    a, b, v = num(shape), num(scale), num(x)
    return number(F.exp((a - 1) * F.ln(v) - v / b - a * F.ln(b) - _lgamma(a)), [x, shape, scale], rules)


def GAMMA_INV(p, shape, scale):
    return _made(_gamma_inv, [p, shape, scale], ((num(p) < 0) | (num(p) >= 1) | (num(shape) <= 0) | (num(scale) <= 0), NUM))


def CHISQ_DIST(x, df, cumulative: bool = True):
    k = _floor(df)
    return made(GAMMA_DIST(x, k / 2, 2.0, cumulative).raw, [x, df], ((num(x) < 0) | (k < 1), NUM))


def CHISQ_DIST_RT(x, df):
    p = CHISQ_DIST(x, df)
    return made(1 - p.raw, [p])


def CHISQ_INV(p, df):
    return made(GAMMA_INV(p, _floor(df) / 2, 2.0).raw, [p, df], ((num(p) < 0) | (num(p) >= 1) | (_floor(df) < 1), NUM))


def CHISQ_INV_RT(p, df):
    return made(GAMMA_INV(1 - num(p), _floor(df) / 2, 2.0).raw, [p, df], ((num(p) <= 0) | (num(p) > 1) | (_floor(df) < 1), NUM))


def BETA_DIST(x, a, b, cumulative: bool = True, low=0, high=1):
    z = (num(x) - num(low)) / (num(high) - num(low))
    rules = ((num(a) <= 0) | (num(b) <= 0) | (num(x) < num(low)) | (num(x) > num(high)) | (num(low) == num(high)), NUM)
    if cumulative:
        return made(_beta_cdf(z, num(a), num(b)), [x, a, b, low, high], rules)
    log = (num(a) - 1) * F.ln(z) + (num(b) - 1) * F.ln(1 - z) + _lgamma(num(a) + num(b)) - _lgamma(num(a)) - _lgamma(num(b))
    return number(F.exp(log) / (num(high) - num(low)), [x, a, b, low, high], rules)


def BETA_INV(p, a, b, low=0, high=1):
    z = _made(_beta_inv, [p, a, b], ((num(p) <= 0) | (num(p) >= 1) | (num(a) <= 0) | (num(b) <= 0), NUM))
    return made(num(low) + z.raw * (num(high) - num(low)), [z, low, high])


def T_DIST(x, df, cumulative: bool = True):
    k = _floor(df)
    if cumulative:
        return _made(_t_cdf, [x, k], (k < 1, NUM))
    log = _lgamma((k + 1) / 2) - _lgamma(k / 2) - 0.5 * F.ln(k * math.pi) - (k + 1) / 2 * F.ln(1 + num(x) * num(x) / k)
    return number(F.exp(log), [x, df], (k < 1, NUM))


def T_DIST_RT(x, df):
    p = T_DIST(-num(x), df)
    return made(p.raw, [p])


def T_DIST_2T(x, df):
    p = T_DIST_RT(x, df)
    return made(2 * p.raw, [p], (num(x) < 0, NUM))


def T_INV(p, df):
    u = _made(_t_inv, [p, _floor(df)], ((num(p) <= 0) | (num(p) >= 1) | (_floor(df) < 1), NUM))
    return made(F.tan(u.raw), [u])


def T_INV_2T(p, df):
    q = T_INV(1 - num(p) / 2, df)
    return made(q.raw, [q])


def F_DIST(x, d1, d2, cumulative: bool = True):
    a, b = _floor(d1), _floor(d2)
    rules = ((num(x) < 0) | (a < 1) | (b < 1), NUM)
    if cumulative:
        return _made(_f_cdf, [x, a, b], rules)
    v = num(x)
    log = _lgamma((a + b) / 2) - _lgamma(a / 2) - _lgamma(b / 2) + a / 2 * F.ln(a / b) + (a / 2 - 1) * F.ln(v) - (a + b) / 2 * F.ln(1 + a * v / b)
    return number(F.exp(log), [x, d1, d2], rules)


def F_DIST_RT(x, d1, d2):
    p = F_DIST(x, d1, d2)
    return made(1 - p.raw, [p])


def F_INV(p, d1, d2):
    u = _made(_f_inv, [p, _floor(d1), _floor(d2)], ((num(p) < 0) | (num(p) >= 1) | (_floor(d1) < 1) | (_floor(d2) < 1), NUM))
    return made(u.raw / (1 - u.raw), [u])


def F_INV_RT(p, d1, d2):
    q = F_INV(1 - num(p), d1, d2)
    return made(q.raw, [q])


def FISHER(x):
    return number(F.atanh(num(x)), [x], ((num(x) <= -1) | (num(x) >= 1), NUM))


def FISHERINV(y):
    return number(F.tanh(num(y)), [y])


def _log_choose(n: Column, k: Column) -> Column:
    return _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1)


def BINOM_DIST(k, n, p, cumulative: bool = True):
    a, b, q = _floor(k), _floor(n), num(p)
    rules = ((a < 0) | (a > b) | (q < 0) | (q > 1), NUM)
    if cumulative:
        return made(F.when(a == b, 1.0).otherwise(_beta_cdf(1 - q, b - a, a + 1)), [k, n, p], rules)
    sure = F.when(q == 0, (a == 0).cast("double")).when(q == 1, (a == b).cast("double"))
    return made(F.coalesce(sure, F.exp(_log_choose(b, a) + a * F.ln(q) + (b - a) * F.ln(1 - q))), [k, n, p], rules)


def BINOM_DIST_RANGE(n, p, low, high=None):
    lo, hi = _floor(low), _floor(low if high is None else high)
    upper = BINOM_DIST(hi, n, p).raw
    lower = F.when(lo > 0, BINOM_DIST(lo - 1, n, p).raw).otherwise(0.0)
    return made(upper - lower, [n, p, low], ((lo < 0) | (hi < lo) | (hi > _floor(n)) | (num(p) < 0) | (num(p) > 1), NUM))


_binom_inv = _udf(lambda n, p, a: sp.binomial_quantile(n, p, a), once=True)


def BINOM_INV(n, p, alpha):
    """Smallest number of successes with at least that probability."""
    return _made(_binom_inv, [_floor(n), p, alpha], ((_floor(n) < 0) | (num(p) <= 0) | (num(p) >= 1) | (num(alpha) <= 0) | (num(alpha) >= 1), NUM))


def NEGBINOM_DIST(failures, successes, p, cumulative: bool = True):
    f, s, q = _floor(failures), _floor(successes), num(p)
    rules = ((f < 0) | (s < 1) | (q < 0) | (q > 1), NUM)
    if cumulative:
        return made(_beta_cdf(q, s, f + 1), [failures, successes, p], rules)
    return number(F.exp(_log_choose(f + s - 1, f) + s * F.ln(q) + f * F.ln(1 - q)), [failures, successes, p], rules)


def POISSON_DIST(k, mean, cumulative: bool = True):
    a, m = _floor(k), num(mean)
    rules = ((a < 0) | (m < 0), NUM)
    if cumulative:
        return made(F.when(m == 0, 1.0).otherwise(1 - _gamma_cdf(m, a + 1, F.lit(1.0))), [k, mean], rules)
    return number(F.when(m == 0, (a == 0).cast("double")).otherwise(F.exp(a * F.ln(m) - m - _lgamma(a + 1))), [k, mean], rules)


def HYPGEOM_DIST(s, n, successes, population, cumulative: bool = False):
    x, k, m, t = _floor(s), _floor(n), _floor(successes), _floor(population)
    rules = ((x < 0) | (x > F.least(k, m)) | (x < k - t + m) | (k <= 0) | (k > t) | (m <= 0) | (m > t), NUM)
    first = F.exp(_log_choose(m, x) + _log_choose(t - m, k - x) - _log_choose(t, k))
    if not cumulative:
        return made(first, [s, n, successes, population], rules)
    # each smaller count from the one above it
    down = F.filter(F.sequence(F.lit(0), F.greatest(x, F.lit(0)).cast("int")), lambda i: i > 0)
    step = lambda acc, i: F.struct((acc.p * (x - i + 1) * (t - m - k + x - i + 1) / ((m - x + i) * (k - x + i))).alias("p"), (acc.sum + acc.p * (x - i + 1) * (t - m - k + x - i + 1) / ((m - x + i) * (k - x + i))).alias("sum"))
    return made(F.aggregate(down, F.struct(first.alias("p"), first.alias("sum")), step, lambda acc: acc.sum), [s, n, successes, population], rules)


def CONFIDENCE_NORM(alpha, sd, n):
    z = NORM_S_INV(1 - num(alpha) / 2)
    return made(z.raw * num(sd) / F.sqrt(_floor(n)), [alpha, sd, n], ((num(alpha) <= 0) | (num(alpha) >= 1) | (num(sd) <= 0) | (_floor(n) < 1), NUM))


def CONFIDENCE_T(alpha, sd, n):
    t = T_INV_2T(alpha, _floor(n) - 1)
    return made(t.raw * num(sd) / F.sqrt(_floor(n)), [alpha, sd, n], ((num(alpha) <= 0) | (num(alpha) >= 1) | (num(sd) <= 0), NUM), (_floor(n) <= 1, DIV))


# legacy names with arguments of their own


def BETADIST(x, a, b, low=0, high=1):
    return BETA_DIST(x, a, b, True, low, high)


def HYPGEOMDIST(s, n, successes, population):
    return HYPGEOM_DIST(s, n, successes, population, False)


def LOGNORMDIST(x, mean, sd):
    return LOGNORM_DIST(x, mean, sd, True)


def NEGBINOMDIST(f, s, p):
    return NEGBINOM_DIST(f, s, p, False)


def NORMSDIST(z):
    return NORM_S_DIST(z, True)


def TDIST(x, df, tails: int):
    return T_DIST_RT(x, df) if tails == 1 else T_DIST_2T(x, df)


# legacy aliases

BETAINV, BINOMDIST, CHIDIST, CHIINV, CONFIDENCE, CRITBINOM, EXPONDIST = BETA_INV, BINOM_DIST, CHISQ_DIST_RT, CHISQ_INV_RT, CONFIDENCE_NORM, BINOM_INV, EXPON_DIST
FDIST, FINV, GAMMADIST, GAMMAINV, LOGINV, NORMDIST, NORMINV, NORMSINV = F_DIST_RT, F_INV_RT, GAMMA_DIST, GAMMA_INV, LOGNORM_INV, NORM_DIST, NORM_INV, NORM_S_INV
POISSON, TINV, WEIBULL = POISSON_DIST, T_INV_2T, WEIBULL_DIST

