"""Financial functions. Closed forms and iterations are Columns; rates of cash-flow tables are found by rounds of aggregation."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cells import DIV, NUM, VALUE, Cell, bound, made, num, number
from ..operators.shared import checkpointed
from . import special as sp
from .dates import as_date, year_fraction
from .distributions import _udf
from .grouped import beside


def _growth(rate: Column, n: Column) -> tuple[Column, Column]:
    """(1 + rate)^n, and the sum of its smaller powers."""
    g = F.pow(1 + rate, n)
    return g, F.when(rate == 0, n).otherwise((g - 1) / rate)


def _fv(rate, nper, pmt, pv, kind) -> Column:
    g, s = _growth(rate, nper)
    return -(pv * g + pmt * (1 + rate * kind) * s)


def _pmt(rate, nper, pv, fv, kind) -> Column:
    g, s = _growth(rate, nper)
    return -(pv * g + fv) / ((1 + rate * kind) * s)


def FV(rate, nper, pmt, pv=0, kind: int = 0):
    return number(_fv(num(rate), num(nper), num(pmt), num(pv), kind), [rate, nper, pmt, pv])


def PV(rate, nper, pmt, fv=0, kind: int = 0):
    g, s = _growth(num(rate), num(nper))
    return number(-(num(pmt) * (1 + num(rate) * kind) * s + num(fv)) / g, [rate, nper, pmt, fv], (num(rate) <= -1, NUM))


def PMT(rate, nper, pv, fv=0, kind: int = 0):
    return number(_pmt(num(rate), num(nper), num(pv), num(fv), kind), [rate, nper, pv, fv], (num(nper) == 0, NUM))


def _ipmt(rate, per, nper, pv, fv, kind) -> Column:
    pmt = _pmt(rate, nper, pv, fv, kind)
    due = _fv(rate, per - 1, pmt, pv, kind) * rate
    return F.when((per == 1) & F.lit(bool(kind)), 0.0).otherwise(due / (1 + rate) if kind else due)


def IPMT(rate, per, nper, pv, fv=0, kind: int = 0):
    return number(_ipmt(num(rate), num(per), num(nper), num(pv), num(fv), kind), [rate, per, nper, pv, fv], ((num(per) < 1) | (num(per) > num(nper)), NUM))


def PPMT(rate, per, nper, pv, fv=0, kind: int = 0):
    out = _pmt(num(rate), num(nper), num(pv), num(fv), kind) - _ipmt(num(rate), num(per), num(nper), num(pv), num(fv), kind)
    return number(out, [rate, per, nper, pv, fv], ((num(per) < 1) | (num(per) > num(nper)), NUM))


def _cumulative(part, rate, nper, pv, start: int, end: int, kind: int) -> Cell:
    out = F.lit(0.0)
    for per in range(int(start), int(end) + 1):
        out = out + part(num(rate), F.lit(float(per)), num(nper), num(pv), F.lit(0.0), kind)
    return number(out, [rate, nper, pv], ((num(rate) <= 0) | (num(nper) <= 0) | (num(pv) <= 0) | (F.lit(end) > num(nper)) | F.lit(start < 1 or end < start), NUM))


def CUMIPMT(rate, nper, pv, start: int, end: int, kind: int = 0):
    return _cumulative(_ipmt, rate, nper, pv, start, end, kind)


def CUMPRINC(rate, nper, pv, start: int, end: int, kind: int = 0):
    return _cumulative(lambda r, per, n, p, f, k: _pmt(r, n, p, f, k) - _ipmt(r, per, n, p, f, k), rate, nper, pv, start, end, kind)


def NPER(rate, pmt, pv, fv=0, kind: int = 0):
    r, p = num(rate), num(pmt) * (1 + num(rate) * kind)
    out = F.when(r == 0, -(num(pv) + num(fv)) / num(pmt)).otherwise(F.ln((p - num(fv) * r) / (p + num(pv) * r)) / F.ln(1 + r))
    return number(out, [rate, pmt, pv, fv], ((r == 0) & (num(pmt) == 0), DIV), ((r != 0) & ((p - num(fv) * r) / F.nullif(p + num(pv) * r, F.lit(0.0)) <= 0), NUM))


#: Newton's steps and the step at which RATE has converged; fixed values.
RATE_STEPS, RATE_NEAR = 50, 1e-7


def _balance(r, n, p, v, f, kind):
    """What is left of an annuity at a rate above -1, and its slope by the rate."""
    flat = np.abs(r) < 1e-9
    safe = np.where(flat, 1.0, r)
    g = np.power(1 + r, n)
    s = np.where(flat, n, (g - 1) / safe)
    ds = np.where(flat, n * (n - 1) / 2, (n * g / (1 + r) - s) / safe)
    return v * g + p * (1 + r * kind) * s + f, v * n * g / (1 + r) + p * kind * s + p * (1 + r * kind) * ds


def solve_rate(n, p, v, f, kind: int, guess: float) -> np.ndarray:
    """Rates of annuities given as arrays: Newton's steps from the guess, else a change of sign closed in on; NaN without one."""
    n, p, v, f = (np.asarray(x, np.float64) for x in (n, p, v, f))
    r, done = np.full(len(n), guess), np.zeros(len(n), bool)
    with np.errstate(all="ignore"):
        for _ in range(RATE_STEPS):
            left, slope = _balance(r, n, p, v, f, kind)
            new = np.where(done, r, r - left / slope)
            done |= np.abs(new - r) < RATE_NEAR
            r = np.where(new > -1, new, np.nan)
            if (done | np.isnan(r)).all():
                break
        lost = np.flatnonzero(~(done & np.isfinite(r)))
        if len(lost):
            r[lost] = np.nan
            at = [x[lost] for x in (n, p, v, f)]
            # growth a period from 1e-6 to 1e6, dense about 1; the change of sign nearest to it
            grid = np.power(10.0, 6 * np.linspace(-1, 1, 121) ** 3) - 1
            sign = np.stack([np.sign(_balance(np.full(len(lost), x), *at, kind)[0]) for x in grid])
            turns = (sign[1:] * sign[:-1] < 0) | (sign[1:] == 0)
            away = np.where(turns, np.abs(grid[1:, None]), np.inf)
            pick, some = away.argmin(0), turns.any(0)
            lo, hi, low_sign = grid[pick], grid[pick + 1], sign[pick, np.arange(len(lost))]
            for _ in range(100):
                mid = (lo + hi) / 2
                below = np.sign(_balance(mid, *at, kind)[0]) == low_sign
                lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
            r[lost[some]] = ((lo + hi) / 2)[some]
    return r


@functools.cache
def _rates(kind: int, guess: float):
    def run(n: pd.Series, p: pd.Series, v: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series(solve_rate(n, p, v, f, kind, guess))

    return F.pandas_udf(run, "double")


def RATE(nper, pmt, pv, fv=0, kind: int = 0, guess: float = 0.1):
    """The rate above -1 at which nothing is left; ``#NUM!`` where there is none, ``#VALUE!`` for a guess of -1 or less."""
    if guess <= -1:
        return made(F.lit(None).cast("double"), [nper, pmt, pv, fv], (F.lit(True), VALUE))
    given = [num(x) for x in (nper, pmt, pv, fv)]
    out = F.nanvl(_rates(kind, float(guess))(*given), F.lit(None).cast("double"))
    return number(out, [nper, pmt, pv, fv], (out.isNull() & F.concat(*[g.cast("string") for g in given]).isNotNull(), NUM))


def RRI(nper, pv, fv):
    return number(F.pow(num(fv) / num(pv), 1 / num(nper)) - 1, [nper, pv, fv], ((num(nper) <= 0) | (num(pv) == 0), NUM))


def PDURATION(rate, pv, fv):
    return number((F.ln(num(fv)) - F.ln(num(pv))) / F.ln(1 + num(rate)), [rate, pv, fv], ((num(rate) <= 0) | (num(pv) <= 0) | (num(fv) <= 0), NUM))


def EFFECT(nominal, n):
    k = F.floor(num(n))
    return number(F.pow(1 + num(nominal) / k, k) - 1, [nominal, n], ((num(nominal) <= 0) | (k < 1), NUM))


def NOMINAL(effective, n):
    k = F.floor(num(n))
    return number((F.pow(1 + num(effective), 1 / k) - 1) * k, [effective, n], ((num(effective) <= 0) | (k < 1), NUM))


def ISPMT(rate, per, nper, pv):
    return number(num(pv) * num(rate) * (num(per) / num(nper) - 1), [rate, per, nper, pv], (num(nper) == 0, DIV))


def SLN(cost, salvage, life):
    return number((num(cost) - num(salvage)) / num(life), [cost, salvage, life], (num(life) == 0, DIV))


def SYD(cost, salvage, life, per):
    return number((num(cost) - num(salvage)) * (num(life) - num(per) + 1) * 2 / (num(life) * (num(life) + 1)), [cost, salvage, life, per], ((num(life) <= 0) | (num(per) <= 0) | (num(per) > num(life)), NUM))


def DDB(cost, salvage, life, per, factor=2):
    """Depreciation of one period at the declining rate, never below the salvage value."""
    c, s, rate = num(cost), num(salvage), F.least(num(factor) / num(life), F.lit(1.0))
    before = c - F.least(c - s, F.greatest(c * (1 - F.pow(1 - rate, num(per) - 1)), F.lit(0.0)))
    after = c - F.least(c - s, F.greatest(c * (1 - F.pow(1 - rate, num(per))), F.lit(0.0)))
    return number(F.greatest(before - after, F.lit(0.0)), [cost, salvage, life, per, factor], ((c < 0) | (s < 0) | (num(life) <= 0) | (num(per) <= 0) | (num(per) > num(life)) | (num(factor) <= 0), NUM))


def DB(cost, salvage, life, per, month: int = 12):
    c, s, p = num(cost), num(salvage), F.floor(num(per))
    rate = F.round(1 - F.pow(s / c, 1 / num(life)), 3)
    first = c * rate * month / 12
    left = (c - first) * F.pow(1 - rate, p - 2)
    last = (p > num(life))
    out = F.when(p == 1, first).when(last, left * rate * (12 - month) / 12).otherwise(left * rate)
    return number(F.when(c == 0, 0.0).otherwise(out), [cost, salvage, life, per], ((c < 0) | (s < 0) | (num(life) <= 0) | (p < 1) | (p > num(life) + (0 if month == 12 else 1)), NUM))


def VDB(cost, salvage, life, start, end, factor=2, no_switch: bool = False):
    """Depreciation from start to end, period by period; a straight line takes over where it is larger."""
    c, s, n, a, b, f = (num(x) for x in (cost, salvage, life, start, end, factor))

    def step(acc, i):
        lo, hi = i.cast("double"), i.cast("double") + 1
        declining = F.least(acc.left * f / n, F.greatest(acc.left - s, F.lit(0.0)))
        line = F.when(n - lo > 0, F.greatest(acc.left - s, F.lit(0.0)) / (n - lo)).otherwise(0.0)
        whole = F.greatest(declining, declining if no_switch else line)
        whole = F.least(whole, F.greatest(acc.left - s, F.lit(0.0)))
        part = F.greatest(F.least(hi, b) - F.greatest(lo, a), F.lit(0.0))
        return F.struct((acc.left - whole).alias("left"), (acc.sum + whole * part).alias("sum"))

    periods = F.sequence(F.lit(0), F.greatest(F.ceil(b).cast("int") - 1, F.lit(0)))
    out = F.aggregate(periods, F.struct(c.alias("left"), F.lit(0.0).alias("sum")), step, lambda acc: acc.sum)
    return number(F.when(a < b, out).otherwise(0.0), [cost, salvage, life, start, end, factor], ((c < 0) | (s < 0) | (n <= 0) | (a < 0) | (b < a) | (b > n) | (f <= 0), NUM))


def DOLLARDE(x, fraction):
    k = F.floor(num(fraction))
    whole = F.signum(num(x)) * F.floor(F.abs(num(x)))
    return number(whole + (num(x) - whole) * F.pow(F.lit(10.0), F.ceil(F.log10(k.cast("double")))) / k, [x, fraction], (k < 0, NUM), (k == 0, DIV))


def DOLLARFR(x, fraction):
    k = F.floor(num(fraction))
    whole = F.signum(num(x)) * F.floor(F.abs(num(x)))
    return number(whole + (num(x) - whole) * k / F.pow(F.lit(10.0), F.ceil(F.log10(k.cast("double")))), [x, fraction], (k < 0, NUM), (k == 0, DIV))


def FVSCHEDULE(pv, rates):
    """Aggregate: pv grown by every rate of a column."""
    return F.max(num(pv)) * F.product(1 + num(rates))


# discount papers


def _between(settle, mature, basis) -> Column:
    return year_fraction(as_date(settle), as_date(mature), basis)


def _late(settle, mature):
    return (as_date(settle) >= as_date(mature), NUM)


def DISC(settle, mature, price, redemption, basis: int = 0):
    return number((num(redemption) - num(price)) / num(redemption) / _between(settle, mature, basis), [price, redemption], _late(settle, mature), ((num(price) <= 0) | (num(redemption) <= 0), NUM))


def INTRATE(settle, mature, investment, redemption, basis: int = 0):
    return number((num(redemption) - num(investment)) / num(investment) / _between(settle, mature, basis), [investment, redemption], _late(settle, mature), ((num(investment) <= 0) | (num(redemption) <= 0), NUM))


def RECEIVED(settle, mature, investment, discount, basis: int = 0):
    return number(num(investment) / (1 - num(discount) * _between(settle, mature, basis)), [investment, discount], _late(settle, mature), ((num(investment) <= 0) | (num(discount) <= 0), NUM))


def PRICEDISC(settle, mature, discount, redemption, basis: int = 0):
    return number(num(redemption) * (1 - num(discount) * _between(settle, mature, basis)), [discount, redemption], _late(settle, mature), ((num(discount) <= 0) | (num(redemption) <= 0), NUM))


def YIELDDISC(settle, mature, price, redemption, basis: int = 0):
    return number((num(redemption) / num(price) - 1) / _between(settle, mature, basis), [price, redemption], _late(settle, mature), ((num(price) <= 0) | (num(redemption) <= 0), NUM))


def _at_maturity(settle, mature, issue, basis):
    return _between(issue, mature, basis), _between(issue, settle, basis), _between(settle, mature, basis)


def PRICEMAT(settle, mature, issue, rate, yld, basis: int = 0):
    im, i_s, sm = _at_maturity(settle, mature, issue, basis)
    return number((100 + im * num(rate) * 100) / (1 + sm * num(yld)) - i_s * num(rate) * 100, [rate, yld], _late(settle, mature), ((num(rate) < 0) | (num(yld) < 0), NUM))


def YIELDMAT(settle, mature, issue, rate, price, basis: int = 0):
    im, i_s, sm = _at_maturity(settle, mature, issue, basis)
    return number(((1 + im * num(rate)) / (num(price) / 100 + i_s * num(rate)) - 1) / sm, [rate, price], _late(settle, mature), ((num(rate) < 0) | (num(price) <= 0), NUM))


def ACCRINTM(issue, settle, rate, par=1000, basis: int = 0):
    return number(num(par) * num(rate) * _between(issue, settle, basis), [rate, par], _late(issue, settle), ((num(rate) <= 0) | (num(par) <= 0), NUM))


def ACCRINT(issue, first, settle, rate, par=1000, frequency: int = 2, basis: int = 0):
    """Interest accrued from issue to settlement, in fractions of a year of the basis."""
    return number(num(par) * num(rate) * _between(issue, settle, basis), [rate, par], _late(issue, settle), ((num(rate) <= 0) | (num(par) <= 0), NUM))


def _bill_days(settle, mature) -> Column:
    return F.datediff(as_date(mature), as_date(settle))


def _bill(settle, mature):
    return ((_bill_days(settle, mature) <= 0) | (as_date(mature) > F.add_months(as_date(settle), 12)), NUM)


def TBILLPRICE(settle, mature, discount):
    return number(100 * (1 - num(discount) * _bill_days(settle, mature) / 360), [discount], _bill(settle, mature), (num(discount) <= 0, NUM))


def TBILLYIELD(settle, mature, price):
    return number((100 - num(price)) / num(price) * 360 / _bill_days(settle, mature), [price], _bill(settle, mature), (num(price) <= 0, NUM))


def TBILLEQ(settle, mature, discount):
    d, days = num(discount), _bill_days(settle, mature)
    price = 1 - d * days / 360
    year = F.when(days == 366, 366.0).otherwise(365.0)
    term = days / year
    long = (-2 * term + 2 * F.sqrt(term * term - (2 * term - 1) * (1 - 1 / price))) / (2 * term - 1)
    return number(F.when(days <= 182, 365 * d / (360 - d * days)).otherwise(long), [discount], _bill(settle, mature), ((d <= 0) | (price <= 0), NUM))


# coupon bonds: coupons fall on the maturity's day, counted back from it


class Coupons:
    """Dates around the settlement, as Columns: previous and next coupon, number left, days."""

    def __init__(self, settle, mature, frequency: int, basis: int = 0):
        s, m, step = as_date(settle), as_date(mature), 12 // frequency
        months = (F.year(m) - F.year(s)) * 12 + F.month(m) - F.month(s)
        at_end, longest = F.last_day(m) == m, F.dayofmonth(F.last_day(s))
        # the day a coupon has in the settlement's month; where it is past, the next coupon is a month later at least
        day = F.when(at_end, longest).otherwise(F.least(F.dayofmonth(m), longest))

        def back(k: Column) -> Column:
            d = F.add_months(m, (-k * step).cast("int"))
            return F.when(at_end, F.last_day(d)).otherwise(d)

        self.number = (F.floor((months - F.when(day <= F.dayofmonth(s), 1).otherwise(0)) / step) + 1).cast("int")
        self.previous, self.next = back(self.number), back(self.number - 1)
        thirty = basis in (0, 4)
        actual = F.datediff(self.next, self.previous).cast("double")
        self.days = {1: actual, 3: F.lit(365.0 / frequency)}.get(basis, F.lit(360.0 / frequency))
        self.since = year_fraction(self.previous, s, basis) * 360 if thirty else F.datediff(s, self.previous).cast("double")
        self.until = self.days - self.since if thirty else F.datediff(self.next, s).cast("double")
        self.rule = (s >= m, NUM)

    def terms(self) -> tuple[Column, Column, Column]:
        """What a price depends on: coupons left, and the parts of a period to the next one and since the last."""
        return self.number.cast("double"), self.until / self.days, self.since / self.days


def COUPNUM(settle, mature, frequency: int, basis: int = 0):
    c = Coupons(settle, mature, frequency, basis)
    return made(c.number, [], c.rule)


def COUPPCD(settle, mature, frequency: int, basis: int = 0):
    c = Coupons(settle, mature, frequency, basis)
    return made(c.previous, [], c.rule)


def COUPNCD(settle, mature, frequency: int, basis: int = 0):
    c = Coupons(settle, mature, frequency, basis)
    return made(c.next, [], c.rule)


def COUPDAYS(settle, mature, frequency: int, basis: int = 0):
    c = Coupons(settle, mature, frequency, basis)
    return made(c.days, [], c.rule)


def COUPDAYBS(settle, mature, frequency: int, basis: int = 0):
    c = Coupons(settle, mature, frequency, basis)
    return made(c.since, [], c.rule)


def COUPDAYSNC(settle, mature, frequency: int, basis: int = 0):
    c = Coupons(settle, mature, frequency, basis)
    return made(c.until, [], c.rule)


def _price(n: Column, w: Column, past: Column, rate: Column, yld: Column, redemption: Column, frequency: int) -> Column:
    """Present values of the coupons as a geometric sum, less what has accrued."""
    coupon, v = 100 * rate / frequency, 1 / (1 + yld / frequency)
    annuity = F.when(yld == 0, n).otherwise((1 - F.pow(v, n)) / (1 - v))
    many = redemption * F.pow(v, n - 1 + w) + coupon * F.pow(v, w) * annuity
    one = (redemption + coupon) / (1 + w * yld / frequency)
    return F.when(n == 1, one).otherwise(many) - coupon * past


def PRICE(settle, mature, rate, yld, redemption=100, frequency: int = 2, basis: int = 0):
    c = Coupons(settle, mature, frequency, basis)
    out = _price(*c.terms(), num(rate), num(yld), num(redemption), frequency)
    return number(out, [rate, yld, redemption], c.rule, ((num(rate) < 0) | (num(yld) < 0) | (num(redemption) <= 0), NUM))


def _geometric(v, n, yld):
    """1 + v + ... over n terms, as arrays."""
    flat = yld == 0
    return np.where(flat, n, (1 - np.power(v, n)) / np.where(flat, 1.0, 1 - v))


def _prices(yld, n, w, past, rate, redemption, frequency):
    """As _price(), over arrays."""
    coupon, v = 100 * rate / frequency, 1 / (1 + yld / frequency)
    many = np.power(v, w) * (redemption * np.power(v, n - 1) + coupon * _geometric(v, n, yld))
    return np.where(n == 1, (redemption + coupon) / (1 + w * yld / frequency), many) - coupon * past


def _odd_first_prices(yld, after, wait, whole, accrued, rate, redemption, frequency):
    """As _odd_first_price(), over arrays."""
    coupon, v = 100 * rate / frequency, 1 / (1 + yld / frequency)
    return np.power(v, wait) * (coupon * whole + coupon * v * _geometric(v, after, yld) + redemption * np.power(v, after)) - coupon * accrued


#: Bounds of a yield and what it may be off by; fixed values.
LEAST_YIELD, MOST_YIELD, YIELD_NEAR = -0.99, 10.0, 1e-16


@functools.cache
def _yields(prices, frequency: int):
    def solve(goal, *facts):
        low, high = np.full(len(goal), LEAST_YIELD), np.full(len(goal), MOST_YIELD)
        return sp.rising(lambda y, g, *at: g - prices(y, *at, frequency), low, high, goal, *facts, near=YIELD_NEAR)

    return _udf(solve)


def YIELD(settle, mature, rate, price, redemption=100, frequency: int = 2, basis: int = 0):
    c = Coupons(settle, mature, frequency, basis)
    out = _yields(_prices, frequency)(num(price), *c.terms(), num(rate), num(redemption))
    return number(out, [rate, price, redemption], c.rule, ((num(rate) < 0) | (num(price) <= 0) | (num(redemption) <= 0), NUM))


def DURATION(settle, mature, coupon, yld, frequency: int = 2, basis: int = 0):
    """Macaulay duration: the mean time of the payments, weighed by present value."""
    c = Coupons(settle, mature, frequency, basis)
    pay, v = 100 * num(coupon) / frequency, 1 / (1 + num(yld) / frequency)

    def sums(facts: Column) -> Column:
        w, n = facts["until"], facts["number"]
        worth = lambda k: (pay + F.when(k == n, 100.0).otherwise(0.0)) * F.pow(v, k - 1 + w)
        step = lambda acc, k: F.struct((acc["value"] + worth(k)).alias("value"), (acc["timed"] + worth(k) * (k - 1 + w)).alias("timed"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("timed")), step, lambda acc: acc["timed"] / acc["value"] / frequency)

    return number(bound(F.struct((c.until / c.days).alias("until"), c.number.alias("number")), sums), [coupon, yld], c.rule, ((num(coupon) < 0) | (num(yld) < 0), NUM))


def MDURATION(settle, mature, coupon, yld, frequency: int = 2, basis: int = 0):
    d = DURATION(settle, mature, coupon, yld, frequency, basis)
    return made(d.raw / (1 + num(yld) / frequency), [d, yld])


def _odd_last(settle, mature, last, rate, redemption, frequency, basis):
    """Coupons of the odd last period in whole periods: to settlement, to maturity, and between."""
    part = lambda a, b: year_fraction(as_date(a), as_date(b), basis) * frequency
    return part(last, settle), part(last, mature), part(settle, mature), 100 * num(rate) / frequency


def ODDLPRICE(settle, mature, last, rate, yld, redemption=100, frequency: int = 2, basis: int = 0):
    a, whole, left, coupon = _odd_last(settle, mature, last, rate, redemption, frequency, basis)
    return number((num(redemption) + whole * coupon) / (1 + left * num(yld) / frequency) - a * coupon, [rate, yld, redemption], _late(settle, mature), (as_date(last) >= as_date(settle), NUM))


def ODDLYIELD(settle, mature, last, rate, price, redemption=100, frequency: int = 2, basis: int = 0):
    a, whole, left, coupon = _odd_last(settle, mature, last, rate, redemption, frequency, basis)
    paid = num(price) + a * coupon
    return number((num(redemption) + whole * coupon - paid) / paid * frequency / left, [rate, price, redemption], _late(settle, mature), (as_date(last) >= as_date(settle), NUM))


def _odd_first_facts(settle, mature, issue, first, frequency, basis) -> Column:
    """Coupons after the first one, and lengths in whole periods: settlement and issue to the first, issue to settlement."""
    part = lambda a, b: year_fraction(as_date(a), as_date(b), basis) * frequency
    after = F.when(as_date(first) == as_date(mature), 0).otherwise(Coupons(first, mature, frequency, basis).number)
    return F.struct(after.alias("after"), part(settle, first).alias("wait"), part(issue, first).alias("whole"), part(issue, settle).alias("accrued"))


def _odd_first_price(facts: Column, rate, yld: Column, redemption, frequency) -> Column:
    """An odd first coupon in proportion to its length, then whole ones, less what has accrued."""
    coupon, v, after = 100 * num(rate) / frequency, 1 / (1 + yld / frequency), facts["after"]
    annuity = F.when(yld == 0, after.cast("double")).otherwise(v * (1 - F.pow(v, after)) / (1 - v))
    return F.pow(v, facts["wait"]) * (coupon * facts["whole"] + coupon * annuity + num(redemption) * F.pow(v, after)) - coupon * facts["accrued"]


def _odd_first_order(settle, mature, issue, first):
    return ((as_date(issue) >= as_date(settle)) | (as_date(settle) >= as_date(first)) | (as_date(first) > as_date(mature)), NUM)


def ODDFPRICE(settle, mature, issue, first, rate, yld, redemption=100, frequency: int = 2, basis: int = 0):
    facts = _odd_first_facts(settle, mature, issue, first, frequency, basis)
    return number(bound(facts, lambda f: _odd_first_price(f, rate, num(yld), redemption, frequency)), [rate, yld, redemption], _odd_first_order(settle, mature, issue, first))


def ODDFYIELD(settle, mature, issue, first, rate, price, redemption=100, frequency: int = 2, basis: int = 0):
    facts = _odd_first_facts(settle, mature, issue, first, frequency, basis)
    out = _yields(_odd_first_prices, frequency)(num(price), *[facts[n].cast("double") for n in ("after", "wait", "whole", "accrued")], num(rate), num(redemption))
    return number(out, [rate, price, redemption], _odd_first_order(settle, mature, issue, first))


def AMORLINC(cost, bought, first_end, salvage, period, rate, basis: int = 0):
    c, s, r, p = num(cost), num(salvage), num(rate), F.floor(num(period))
    first = F.least(c * r * year_fraction(as_date(bought), as_date(first_end), basis), c - s)
    whole = c * r
    left = c - s - first - whole * F.greatest(p - 1, F.lit(0))
    return number(F.when(p == 0, first).otherwise(F.greatest(F.least(whole, left), F.lit(0.0))), [cost, salvage, period, rate], ((r <= 0) | (p < 0) | (s > c), NUM))


def AMORDEGRC(cost, bought, first_end, salvage, period, rate, basis: int = 0):
    """Degressive coefficients by the asset's life; values rounded to whole units; the last two periods halve what is left."""
    c, s, r, p = num(cost), num(salvage), num(rate), F.floor(num(period))
    life = 1 / r
    factor = F.when(life < 3, 1.0).when(life < 5, 1.5).when(life <= 6, 2.0).otherwise(2.5)
    rate_in_use = r * factor
    nearest = lambda x: F.floor(x + 0.5).cast("double")
    first = nearest(year_fraction(as_date(bought), as_date(first_end), basis) * rate_in_use * c)
    start = F.struct((c - first).alias("left"), first.alias("now"), (c - first - s).alias("rest"), F.lit(False).alias("over"))

    def step(acc, i):
        now = nearest(acc.left * rate_in_use)
        rest = acc.rest - now
        tail = F.when(p - i.cast("double") <= 1, nearest(acc.left * 0.5)).otherwise(0.0)
        return F.when(acc["over"], acc).otherwise(F.when(rest < 0, F.struct(acc.left.alias("left"), tail.alias("now"), rest.alias("rest"), F.lit(True).alias("over"))).otherwise(F.struct((acc.left - now).alias("left"), now.alias("now"), rest.alias("rest"), F.lit(False).alias("over"))))

    periods = F.when(p >= 1, F.sequence(F.lit(0), (F.greatest(p, F.lit(1)) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return number(F.aggregate(periods, start, step, lambda acc: acc.now), [cost, salvage, period, rate], ((r <= 0) | (p < 0) | (s > c), NUM))


# cash-flow tables


def NPV(rate, value, position):
    """Aggregate: values discounted by their position, from 1."""
    return F.sum(num(value) / F.pow(1 + num(rate), num(position)))


def XNPV(rate, value, date, first_date):
    return F.sum(num(value) / F.pow(1 + num(rate), F.datediff(as_date(date), as_date(first_date)) / 365.0))


def MIRR(value, position, n, finance: float, reinvest: float):
    """Aggregate: positions from 0 to n - 1 of a group."""
    v, p = num(value), num(position)
    gains = F.sum(F.when(v > 0, v * F.pow(F.lit(1 + reinvest), num(n) - 1 - p)).otherwise(0.0))
    costs = F.sum(F.when(v < 0, v / F.pow(F.lit(1 + finance), p)).otherwise(0.0))
    return F.when((gains > 0) & (costs < 0), F.pow(gains / -costs, 1 / (F.max(num(n)) - 1)) - 1)


#: Cuts of the first bracket of a rate of return.
FIRST_CUTS = 48


def rate_of_return(flows: DataFrame, value: str, time: Column, by: list[str], rounds: int = 6, cuts: int = 32) -> DataFrame:
    """IRR and XIRR of each group: by columns and rate.

    Each round sums every group's present value at ``cuts`` rates of its
    bracket in one aggregation and keeps the part where the sign changes, so
    no group's flows are ever gathered. The first bracket is a growth of 1e-12
    to 1e12 a period, with FIRST_CUTS cuts dense near 1, and of several changes of sign
    the one nearest to a rate of 0.1 counts. The rate is null where the present
    value has the same sign at all of them. Flows are scaled to the first one
    at rates above 0 and to the last one below, so that sums don't overflow.
    """
    rows = flows.select(*by, F.col(value).cast("double").alias("_v"), time.cast("double").alias("_t")).where("_v IS NOT NULL")
    rows = checkpointed(beside(rows, rows.groupBy(*by).agg(F.min("_t").alias("_t0"), F.max("_t").alias("_t1")), by))
    grid = [12 * (2 * i / FIRST_CUTS - 1) ** 3 for i in range(FIRST_CUTS + 1)]
    start = min(range(FIRST_CUTS), key=lambda i: abs(10 ** grid[i] - 1.1))
    bracket = None
    for _ in range(rounds):
        use = rows if bracket is None else beside(rows, bracket, by)
        powers = [F.lit(x) for x in grid] if bracket is None else [F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (i / cuts) for i in range(cuts + 1)]
        present = lambda x: F.sum(F.col("_v") * F.pow(F.lit(10.0), x * F.when(x > 0, F.col("_t0") - F.col("_t")).otherwise(F.col("_t1") - F.col("_t"))))
        sums = use.groupBy(*by).agg(*[present(x).alias(f"_s{i}") for i, x in enumerate(powers)], *([] if bracket is None else [F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")]))
        turns = lambda i: (F.signum(f"_s{i}") != 0) & (F.signum(f"_s{i}") * F.signum(f"_s{i + 1}") <= 0)
        hit = F.coalesce(*[F.when(turns(i), F.lit(i)) for i in sorted(range(len(powers) - 1), key=lambda i: abs(i - start))])
        pick = lambda k: F.get(F.array(*powers), k)
        bracket = checkpointed(sums.withColumn("_i", hit).select(*by, pick(F.col("_i")).alias("_lo"), pick(F.col("_i") + 1).alias("_hi")))
    return bracket.select(*by, (F.pow(F.lit(10.0), (F.col("_lo") + F.col("_hi")) / 2) - 1).alias("rate"))


def IRR(flows: DataFrame, value: str, position: str, by: list[str]) -> DataFrame:
    return rate_of_return(flows, value, F.col(position), by)


def XIRR(flows: DataFrame, value: str, date: str, by: list[str]) -> DataFrame:
    """Days are counted from each group's first date."""
    first = flows.groupBy(*by).agg(F.min(date).alias("_first"))
    return rate_of_return(beside(flows, first, by), value, F.datediff(F.col(date), F.col("_first")) / 365.0, by)
