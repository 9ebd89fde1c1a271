"""Date and time functions over DATE and TIMESTAMP columns, with serial numbers at the edges.

Serial 1 is 1899-12-31; the session's time zone is taken as it is.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cells import NUM, VALUE, Cell, bound, made, num, raw

EPOCH = "DATE'1899-12-30'"
LAST_SERIAL = 2958465
#: A Monday from which working days are counted.
MONDAY = "DATE'1899-12-25'"
#: Weekend of each code: Monday first, 1 = day off.
WEEKENDS = {
    1: "0000011", 2: "1000001", 3: "1100000", 4: "0110000", 5: "0011000", 6: "0001100", 7: "0000110",
    11: "0000001", 12: "1000000", 13: "0100000", 14: "0010000", 15: "0001000", 16: "0000100", 17: "0000010",
}
#: Layouts that DATEVALUE reads, month first where both orders are possible.
LAYOUTS = (("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "y-M-d"), ("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "y/M/d"), ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/y"), ("^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$", "d-MMM-y"), ("^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", "d MMM y"))


def serial(d: Column) -> Column:
    return F.datediff(d, F.expr(EPOCH)).cast("double")


def date_of(s: Column) -> Column:
    return F.date_add(F.expr(EPOCH), F.floor(s).cast("int"))


def timestamp_of(s: Column) -> Column:
    return F.timestamp_seconds(F.unix_date(date_of(s)).cast("double") * 86400 + F.round((s - F.floor(s)) * 86400, 0))


def parse_date(t: Column) -> Column:
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(layout)).cast("date")) for shape, layout in LAYOUTS])


def as_date(x) -> Column:
    if isinstance(x, datetime.date):
        return F.lit(x).cast("date")
    return raw(x).cast("date")


def DATE(y, m, d):
    """Months and days may overflow; years below 1900 count from 1900."""
    year = F.floor(num(y)) + F.when(num(y) < 1900, 1900).otherwise(0)
    first = F.add_months(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (F.floor(num(m)) - 1).cast("int"))
    out = F.date_add(first, (F.floor(num(d)) - 1).cast("int"))
    return made(out, [y, m, d], ((serial(out) < 0) | (serial(out) > LAST_SERIAL) | (num(y) < 0), NUM))


def DATEVALUE(t):
    out = serial(parse_date(F.trim(raw(t))))
    return made(out, [t], (out.isNull(), VALUE))


def TIMEVALUE(t):
    low = F.upper(F.trim(raw(t)))
    pm, am = low.endswith("PM"), low.endswith("AM")
    part = lambda i: F.coalesce(F.regexp_extract(low, r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?", i).try_cast("int"), F.lit(0))
    hour = F.when(pm & (part(1) < 12), part(1) + 12).when(am & (part(1) == 12), 0).otherwise(part(1))
    return made((hour * 3600 + part(2) * 60 + part(3)) / 86400.0, [t], (~low.rlike(r"[0-9]{1,2}:[0-9]{2}") | (hour > 23) | (part(2) > 59) | (part(3) > 59), VALUE))


def TIME(h, m, s):
    seconds = F.floor(num(h)) * 3600 + F.floor(num(m)) * 60 + F.floor(num(s))
    return made((seconds % 86400) / 86400.0, [h, m, s], (seconds < 0, NUM))


def DAY(d):
    return made(F.dayofmonth(as_date(d)), [d])


def MONTH(d):
    return made(F.month(as_date(d)), [d])


def YEAR(d):
    return made(F.year(as_date(d)), [d])


def _seconds(t) -> Column:
    """Whole seconds since midnight of a time, a text or a serial number's fraction."""
    c = raw(t)
    serial_ = c.try_cast("string").try_cast("double")
    # a little more, as a serial's fraction may fall just short of a whole second
    return F.when(_is_number(t), F.floor((serial_ - F.floor(serial_)) * 86400 + 1e-6)).otherwise(_of_clock(c))


def _of_clock(c: Column) -> Column:
    at = F.try_to_timestamp(c.cast("string"))
    return (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).cast("bigint")


def _part_of_time(t, value: Column) -> Cell:
    return made(value, [t], (_is_number(t) & (raw(t).try_cast("string").try_cast("double") < 0), NUM), (raw(t).isNotNull() & _seconds(t).isNull(), VALUE))


def _is_number(t) -> Column:
    return F.typeof(raw(t)).rlike("int|double|float|decimal")


def HOUR(t):
    """Of a timestamp, a text of one, or a serial number, whose fraction is the time."""
    return _part_of_time(t, F.floor(_seconds(t) / 3600).cast("int"))


def MINUTE(t):
    return _part_of_time(t, (F.floor(_seconds(t) / 60) % 60).cast("int"))


def SECOND(t):
    return _part_of_time(t, (_seconds(t) % 60).cast("int"))


def NOW(zone: str | None = None):
    now = F.current_timestamp()
    return Cell(F.convert_timezone(None, F.lit(zone), now.cast("timestamp_ntz")) if zone else now)


def TODAY(zone: str | None = None):
    return Cell(NOW(zone).raw.cast("date") if zone else F.current_date())


def EDATE(d, months):
    return made(F.add_months(as_date(d), _whole(months)), [d, months])


def EOMONTH(d, months):
    return made(F.last_day(F.add_months(as_date(d), _whole(months))), [d, months])


def _whole(x) -> Column:
    """Toward zero, as an integer."""
    return (F.signum(num(x)) * F.floor(F.abs(num(x)))).cast("int")


def DAYS(end, start):
    return made(F.datediff(as_date(end), as_date(start)), [end, start])


def DATEDIF(start, end, unit: str):
    """Whole years (Y), months (M), days (D), or days and months that are left over (MD, YM, YD)."""
    a, b = as_date(start), as_date(end)
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)
    in_year = F.add_months(a, (F.floor(months / 12) * 12).cast("int"))
    out = {
        "Y": F.floor(months / 12), "M": months, "D": F.datediff(b, a), "YM": months % 12,
        "MD": F.datediff(b, F.add_months(a, months.cast("int"))), "YD": F.datediff(b, in_year),
    }[unit.upper()]
    return made(out.cast("long"), [start, end], (b < a, NUM))


def DAYS360(start, end, european: bool = False):
    a, b = as_date(start), as_date(end)
    d1, d2 = F.dayofmonth(a), F.dayofmonth(b)
    if european:
        d1, d2 = F.least(d1, F.lit(30)), F.least(d2, F.lit(30))
    else:
        ends = lambda d: F.last_day(d) == d
        d1 = F.when(ends(a), 30).otherwise(d1)
        d2 = F.when((d2 == 31) & (d1 >= 30), 30).otherwise(d2)
    return made((F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + d2 - d1, [start, end])


def WEEKDAY(d, kind: int = 1):
    monday = F.weekday(as_date(d))
    if kind == 1:
        return made((monday + 1) % 7 + 1, [d])
    if kind == 3:
        return made(monday, [d])
    shift = 0 if kind == 2 else kind - 11
    return made((monday - shift + 7) % 7 + 1, [d])


def WEEKNUM(d, kind: int = 1):
    """Week of the year: weeks begin on the kind's first day; 21 counts ISO weeks."""
    if kind == 21:
        return ISOWEEKNUM(d)
    first_day = {1: 6, 2: 0, 17: 6}.get(kind, kind - 11)
    new_year = F.trunc(as_date(d), "year")
    lead = (F.weekday(new_year) - first_day + 7) % 7
    return made((F.floor((F.datediff(as_date(d), new_year) + lead) / 7) + 1).cast("int"), [d])


def ISOWEEKNUM(d):
    return made(F.weekofyear(as_date(d)), [d])


def _mask(weekend) -> str:
    return WEEKENDS[weekend] if isinstance(weekend, int) else weekend


def _free(holidays, mask: str) -> list[datetime.date]:
    """Holidays that fall on working days, once each."""
    return sorted({h for h in holidays if mask[h.weekday()] == "0"})


def _number(day: datetime.date, work: list[int]) -> int:
    """Days that are no weekend from 1899-12-25 up to and with a day."""
    days = (day - datetime.date(1899, 12, 25)).days
    return days // 7 * len(work) + sum(1 for w in work if w <= day.weekday())


def _work_before(d: Column, mask: str, holidays) -> Column:
    """Working days from 1899-12-25, a Monday, up to and with a day: whole weeks, the rest of one, less holidays."""
    work = [i for i, c in enumerate(mask) if c == "0"]
    days = F.datediff(d, F.expr(MONDAY))
    upto = F.array(*[F.lit(sum(1 for w in work if w <= i)) for i in range(7)])
    out = F.floor(days / 7) * len(work) + F.get(upto, F.weekday(d))
    free = _free(holidays, mask)
    if free:
        listed = F.array(*[F.lit(h) for h in free])
        out = out - F.size(F.filter(listed, lambda h: h <= d))
    return out


def NETWORKDAYS_INTL(start, end, weekend=1, holidays=()):
    """Working days from start to end, both counted; negative where start is later. No list of days is made."""
    mask, a, b = _mask(weekend), as_date(start), as_date(end)
    between = lambda lo, hi: _work_before(hi, mask, holidays) - _work_before(F.date_sub(lo, 1), mask, holidays)
    return made(F.when(a <= b, between(a, b)).otherwise(-between(b, a)), [start, end])


def NETWORKDAYS(start, end, holidays=()):
    return NETWORKDAYS_INTL(start, end, 1, holidays)


def WORKDAY_INTL(start, n, weekend=1, holidays=()):
    """The day n working days away, in closed form.

    Days that are no weekend are numbered from the same Monday as in
    ``_work_before``. The g-th working day has the number g plus the holidays
    before it, and those are the ones whose own number, less their place among
    the holidays, is below g.
    """
    mask, a, k = _mask(weekend), as_date(start), _whole(n)
    if "0" not in mask:
        return made(F.lit(None).cast("date"), [start, n], (F.lit(True), VALUE))
    work = [i for i, c in enumerate(mask) if c == "0"]
    goal = _work_before(F.when(k < 0, F.date_sub(a, 1)).otherwise(a), mask, holidays) + k + F.when(k < 0, 1).otherwise(0)
    before = [_number(h, work) - i for i, h in enumerate(_free(holidays, mask), 1)]
    if before:
        listed = F.array(*map(F.lit, before))
        goal = bound(goal, lambda g: g + F.size(F.filter(listed, lambda x: x < g)))

    def day(v: Column) -> Column:
        days = F.floor((v - 1) / len(work)) * 7 + F.get(F.array(*map(F.lit, work)), F.pmod(v - 1, F.lit(len(work))).cast("int"))
        return F.date_add(F.expr(MONDAY), days.cast("int"))

    return made(F.when(k == 0, a).otherwise(bound(goal, day)), [start, n])


def WORKDAY(start, n, holidays=()):
    return WORKDAY_INTL(start, n, 1, holidays)


def days_in_year(y: Column) -> Column:
    return F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 366).otherwise(365)


def year_fraction(start: Column, end: Column, basis: int = 0) -> Column:
    a, b = F.least(start, end), F.greatest(start, end)
    days = F.datediff(b, a)
    if basis == 0:
        return DAYS360(a, b).raw / 360.0
    if basis == 2:
        return days / 360.0
    if basis == 3:
        return days / 365.0
    if basis == 4:
        return DAYS360(a, b, True).raw / 360.0
    years = F.sequence(F.year(a), F.year(b))
    average = F.aggregate(years, F.lit(0.0), lambda acc, y: acc + days_in_year(y)) / F.size(years)
    leap = F.exists(years, lambda y: (days_in_year(y) == 366) & (F.make_date(y, F.lit(2), F.lit(28)) < b) & (F.make_date(y, F.lit(3), F.lit(1)) > a) & ((F.make_date(y, F.lit(3), F.lit(1)) <= b) | (F.month(b) == 2) & (F.dayofmonth(b) == 29)))
    within = b <= F.add_months(a, 12)
    year = F.when(within, F.when(F.year(a) == F.year(b), days_in_year(F.year(a))).when(leap, 366).otherwise(365).cast("double")).otherwise(average)
    return days / year


def YEARFRAC(start, end, basis: int = 0):
    return made(year_fraction(as_date(start), as_date(end), basis), [start, end])
