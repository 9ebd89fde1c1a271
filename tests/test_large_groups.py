"""Order statistics, ranks, sums and shifts over groups that lie in many partitions, and working days in closed form, against plain Python."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridspan.functions import dates as D
from gridspan.functions import stats as S
from gridspan.operators import frames as FR


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    names = ["hot"] * 600 + [None] * 40 + ["a", "b", "c"] * 20 + ["one"]
    return [(i, g, rng.choice([None, *range(12)]) if g == "a" else rng.randrange(90)) for i, g in enumerate(rng.sample(names, len(names)))]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "i long, g string, v long")


def groups(rows):
    out = {}
    for i, g, v in sorted(rows):
        out.setdefault(g, []).append((i, v))
    return out


def test_order_statistics(df, rows):
    found = S.tally(df, "v", ["g"]).groupBy("g").agg(
        S.percentile_of(0.3).alias("p"), S.percentile_of(0.5, True).alias("m"), S.large_of(4).alias("l"), S.small_of(2).alias("s"), S.trimmean_of(0.3).alias("t"),
    )
    found = {r.g: r for r in found.collect()}
    for g, own in groups(rows).items():
        x = sorted(v for _, v in own if v is not None)
        r, n = found[g], len(x)
        at = 0.3 * (n - 1)
        assert r.p == pytest.approx(x[int(at)] + (at % 1) * (x[min(int(at) + 1, n - 1)] - x[int(at)]))
        assert r.m == statistics.median(x) and r.l == (x[-4] if n > 3 else None) and r.s == (x[1] if n > 1 else None)
        cut = int(n * 0.3 / 2)
        assert r.t == pytest.approx(statistics.mean(x[cut : n - cut]))


def test_order_statistics_of_nothing(df):
    assert S.tally(df.where("v < 0"), "v", ["g"]).groupBy("g").agg(S.large_of(1).alias("l")).count() == 0
    assert S.order_statistic(df.where("v < 0"), "v", 1).first().value is None


def test_running_sums_and_shifts(df, rows):
    summed = FR.prefix_sum(df, "v", "i", by=["g"], name="sum", total="all")
    found = {r.i: r for r in FR.shifted(summed, "v", 2, "i", by=["g"], name="next").collect()}
    assert len(found) == len(rows)
    for own in groups(rows).values():
        upto, values = 0, [v or 0 for _, v in own]
        for k, (i, v) in enumerate(own):
            upto += v or 0
            assert found[i].all == sum(values) and found[i].next == (own[k + 2][1] if k + 2 < len(own) else None)
            assert found[i].sum == upto or (found[i].sum is None and all(w is None for _, w in own[: k + 1]))


def test_ranks(df, rows):
    found = {r.i: r for r in S.ranked(df, "v", True, ["g"]).collect()}
    assert len(found) == len(rows)
    for own in groups(rows).values():
        values = [v for _, v in own if v is not None]
        for i, v in own:
            above = None if v is None else sum(w > v for w in values) + 1
            assert found[i].rank_eq == above and found[i].rank_avg == (None if v is None else above + (values.count(v) - 1) / 2)


def test_expand_pads_added_rows_only(spark):
    df = spark.createDataFrame([(0, "x", None), (1, None, 3)], "_pos long, a string, b int")
    assert [tuple(r) for r in FR.EXPAND(df, 3, "9").orderBy("_pos").collect()] == [(0, "x", None), (1, None, 3), (2, "9", 9)]


@pytest.mark.parametrize("weekend", [1, 3, 11, "0101010", "1111110"])
def test_workdays(spark, weekend):
    holidays = [datetime.date(2024, 1, 1) + datetime.timedelta(k) for k in (0, 3, 4, 5, 6, 7, 8, 30, 31, 200, 201, 366)] + [datetime.date(1899, 12, 20), datetime.date(2024, 1, 1)]
    mask = D.WEEKENDS.get(weekend, weekend)
    days = [datetime.date(2023, 12, 28) + datetime.timedelta(k) for k in range(16)]
    steps = [-300, -20, -7, -2, -1, 0, 1, 2, 3, 9, 40, 500]

    def plain(d, n):
        while n:
            d += datetime.timedelta(1 if n > 0 else -1)
            if mask[d.weekday()] == "0" and d not in holidays:
                n += -1 if n > 0 else 1
        return d

    df = spark.createDataFrame([(d, n) for d in days for n in steps], "d date, n int")
    for r in df.select("d", "n", D.WORKDAY_INTL(F.col("d"), F.col("n"), weekend, holidays).value.alias("out")).collect():
        assert r.out == plain(r.d, r.n)
