"""Small fixtures for criteria, database functions, dynamic arrays, lookups, formatting, workbooks and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridspan.functions import stats as S
from gridspan.operators import criteria as C
from gridspan.operators import database as DB
from gridspan.operators import formatting as CF
from gridspan.operators import frames as FR
from gridspan.operators import lookup as L
from gridspan.sources import workbook as WB
from gridspan.streaming import windows as W

d = datetime.date


@pytest.fixture(scope="module")
def ledger(spark):
    return spark.createDataFrame([(1, d(2026, 1, 15), 1200.0), (2, d(2026, 3, 15), 900.0), (3, d(2026, 6, 15), 2100.0)], "ID int, Date date, Amount double")


def one(df):
    return df.first()[0]


def test_database_functions(ledger):
    where = [{"Date": ">=2026-03-01"}]
    expected = {DB.DMIN: 900, DB.DMAX: 2100, DB.DAVERAGE: 1500, DB.DSUM: 3000, DB.DPRODUCT: 1890000, DB.DCOUNT: 2, DB.DVAR: 720000, DB.DVARP: 360000, DB.DSTDEV: 848.528137424, DB.DSTDEVP: 600}
    for f, value in expected.items():
        assert one(f(ledger, "amount", where)) == pytest.approx(value)
    assert tuple(DB.DGET(ledger, "Amount", [{"Date": d(2026, 1, 15)}]).first()) == (1200.0, None)
    assert DB.DGET(ledger, 3, [{"ID": ">9"}]).first().error == "#VALUE!"
    assert one(DB.DCOUNT(ledger, "Amount", [{"Nope": ">1"}])) == 0


def test_criteria_with_dates_as_serials(spark):
    rows = [(45131 + i, float(i + 1)) for i in range(7)] + [(45138, 100.0), (45139, 99.0), (45200, 50.0)]
    df = spark.createDataFrame(rows, "d long, c double")
    at = lambda test: df.agg(C.SUMIF("d", "num", test, "c"), C.AVERAGEIF("d", "num", test, "c"), C.MAXIFS("c", ("d", "num", test)), C.MINIFS("c", ("d", "num", test))).first()
    assert tuple(at("<7/31/2023")) == (28, 4, 7, 1)
    assert at(">=7/31/2023")[0] == 249 and at(">=7/31/2023")[2] == 100
    assert tuple(at(">1/1/2030")) == (0, None, 0, 0)


def test_criteria_kinds(spark):
    df = spark.createDataFrame([("Apples", 5.0, True), ("Almonds", 15.0, False), ("5", 0.0, None), (None, None, True)], "s string, n double, b boolean")
    count = lambda *w: df.agg(C.COUNTIFS(w)).first()[0]
    assert count("s", "str", "=A*") == 2 and count("s", "str", "a?p*") == 1 and count("s", "str", "5") == 1 and count("s", "str", "<>5") == 3
    assert count("s", "str", "<>a*") == 2 and count("s", "str", "=") == 1 and count("s", "str", "<>") == 3 and count("s", "str", "<b") == 3
    assert count("n", "num", None) == 1 and count("n", "num", "<>5") == 3 and count("n", "num", "abc") == 0 and count("b", "bool", "TRUE") == 2 and count("b", "bool", "<>FALSE") == 3


def test_sort_unique_and_stacks(spark):
    df = FR.with_pos(spark.createDataFrame([("Charlie", 3), ("Alice", 1), ("bob", 2), ("ALICE", 1), (None, None)], "name string, score int"))
    assert [r.name for r in FR.SORT(df, "score", pos="_pos").collect()] == ["Alice", "ALICE", "bob", "Charlie", None]
    assert [r.score for r in FR.SORT(df, 2, -1, pos="_pos").collect()] == [3, 2, 1, 1, None]
    assert {r.name for r in FR.UNIQUE(df, "name", pos="_pos").collect()} == {"Charlie", "Alice", "bob", None}
    assert {r.name for r in FR.UNIQUE(df, "name", pos="_pos", exactly_once=True).collect()} == {"Charlie", "bob", None}
    assert sorted(r._pos for r in df.collect()) == list(range(5))
    assert FR.FILTER(df, F.col("score") > 9, {"name": "none"}).first().name == "none"
    assert [r.name for r in FR.INDEX(df, 3).collect()] == ["bob"] and FR.EXPAND(df, 7, "x").count() == 7
    assert FR.TRIMRANGE(df, "name", "score").count() == 4
    assert FR.TOROW(df.where("score IS NOT NULL"), "score").first()[0] == [3, 1, 2, 1]
    assert [tuple(r) for r in FR.WRAPCOLS(df, "score", 3, 2).orderBy("r").select("c1", "c2").collect()] == [(3, 1), (1, None), (2, None)]


def test_matrices(spark):
    m = spark.createDataFrame([("a", 0, 0, 2.0), ("a", 0, 1, 1.0), ("a", 1, 0, 5.0), ("a", 1, 1, 3.0), ("s", 0, 0, 1.0), ("s", 0, 1, 2.0), ("s", 1, 0, 2.0), ("s", 1, 1, 4.0)], "g string, r int, c int, value double")
    assert {r.g: round(r.value, 9) for r in FR.MDETERM(m, ["g"]).collect()} == {"a": 1.0, "s": 0.0}
    inverse = {(r.r, r.c): round(r.value, 9) for r in FR.MINVERSE(m, ["g"]).where("g = 'a'").collect()}
    assert inverse == {(0, 0): 3.0, (0, 1): -1.0, (1, 0): -5.0, (1, 1): 2.0}


def test_lookups(spark):
    t = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c"), (30, "z")], "key int, val string").withColumn("pos", F.col("key").cast("long"))
    df = spark.createDataFrame([(20,), (25,), (5,), (None,), (30,)], "v int")
    exact = {r.v: (r.val, r.lookup_error) for r in L.XLOOKUP(df, "v", t, "key", ["val"], pos="pos").collect()}
    assert exact[20] == ("b", None) and exact[25] == (None, "#N/A") and exact[None] == (None, "#N/A")
    low = {r.v: r.key for r in L.XLOOKUP(df, "v", t, "key", ["key"], match=-1).collect()}
    high = {r.v: r.key for r in L.XLOOKUP(df, "v", t, "key", ["key"], match=1).collect()}
    assert low == {20: 20, 25: 20, 5: None, None: None, 30: 30} and high == {20: 20, 25: 30, 5: 10, None: None, 30: 30}
    assert {r.v: r.val for r in L.VLOOKUP(df, "v", t.select("key", "val"), 2, sorted_=False).collect()}[30] == "c"


def test_asof_over_many_slices(spark):
    import random

    rng = random.Random(1)
    keys = sorted({rng.randrange(10000) for _ in range(800)})
    table = spark.createDataFrame([(k, k * 2) for k in keys], "k int, twice int")
    seek = spark.createDataFrame([(i, rng.randrange(-50, 10100)) for i in range(500)], "i int, v int")
    for r in L.ASOF(seek, "v", table, "k", ["twice"]).collect():
        below = [k for k in keys if k <= r.v]
        assert r.twice == (2 * below[-1] if below else None)
    for r in L.ASOF(seek, "v", table, "k", ["twice"], forward=True).collect():
        above = [k for k in keys if k >= r.v]
        assert r.twice == (2 * above[0] if above else None)


def test_statistics_fixtures(spark):
    xs = [3, 4, 5, 8, 9, 1, 2, 4, 5]
    ys = [6, 19, 3, 2, 14, 4, 5, 17, 1]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(xs, ys)], "a double, b double")
    assert one(S.t_test(df, "a", "b", 2, 1)) == pytest.approx(0.196016, abs=1e-5)
    assert one(S.z_test(spark.createDataFrame([(float(x),) for x in (3, 6, 7, 8, 6, 5, 4, 2, 1, 9)], "a double"), "a", 4)) == pytest.approx(0.090574, abs=1e-5)
    assert one(S.f_test(spark.createDataFrame([(6.0, 20.0), (7.0, 28.0), (9.0, 31.0), (15.0, 38.0), (21.0, 40.0)], "a double, b double"), "a", "b")) == pytest.approx(0.64831785, abs=1e-6)
    f = spark.createDataFrame([(float(x),) for x in range(1, 6)], "v double")
    assert [r.n for r in S.frequency(f, "v", [2, 4]).orderBy("bin").collect()] == [2, 2, 1]
    m = spark.createDataFrame([(3, 0), (1, 1), (3, 2), (2, 3)], "v int, pos int")
    assert S.modes(m, "v", "pos").first().value == 3
    line = spark.createDataFrame([(float(x), 3.0 * x - 2 * z + 7, float(z)) for x, z in ((1, 4), (2, 2), (3, 9), (4, 1), (5, 5))], "x double, y double, z double")
    fit = S.linest(line, "y", ["x", "z"])
    assert fit["coefficients"] == pytest.approx({"x": 3, "z": -2, "const": 7}) and fit["r2"] == pytest.approx(1)


def test_formatting(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "A", 5.0), (3, "b", 3.0), (4, None, None)], "i int, t string, v double")
    flags = lambda out: [r.flag for r in out.orderBy("i").collect()]
    assert flags(CF.duplicates(df, "t")) == [True, True, False, False] and flags(CF.duplicates(df, "t", unique=True)) == [False, False, True, False]
    assert flags(CF.average_rule(df, "v")) == [False, True, False, False] and flags(CF.top_rule(df, "v", 2)) == [False, True, True, False]
    assert [r.color for r in CF.color_scale(df, "v", ["000000", "ffffff"]).orderBy("i").collect()] == ["000000", "ffffff", "808080", None]
    assert [r.icon for r in CF.icon_set(df, "v", [33, 67]).orderBy("i").collect()] == [0, 2, 1, None]


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "x & <y>", True, d(2023, 7, 31)), (None, "", False, None), (-2e10, "ü", None, d(1999, 1, 1))], "n double, t string, b boolean, d date").coalesce(1)
    for i, r in enumerate(WB.to_workbooks(df, 2).collect()):
        (tmp_path / f"w{i}.xlsx").write_bytes(bytes(r.content))
    cells = WB.read_cells(spark, str(tmp_path / "*.xlsx"))
    back = WB.table_of(cells, "Sheet1", {"n": "double", "t": "string", "b": "boolean", "d": "date"})
    assert sorted((str(r.n), r.t, r.b, str(r.d)) for r in back.collect()) == sorted((str(r.n), r.t, r.b, str(r.d)) for r in df.collect())
    area = WB.used_area(cells).orderBy("path").first()
    assert (area.first_row, area.last_row, area.last_col) == (1, 3, 4)
    assert WB.range_of(cells, "Sheet1", "A1:B1").count() == 4


def test_pasted_text(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("1,234.5\tTRUE\t#N/A\t'007\t=A1+1\t\tword\t5%\n")
    rows = {r.col: r for r in WB.read_pasted(spark, str(tmp_path / "p.tsv")).collect()}
    assert [rows[i].kind for i in range(8)] == ["num", "bool", "err", "str", "formula", "blank", "str", "num"]
    assert rows[0].num == 1234.5 and rows[3].str == "007" and rows[4].formula == "A1+1" and rows[7].num == 0.05


def test_streams_equal_batches(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    where = ("event_type", "str", "p*")
    query = W.windowed(stream, "ts", "1 day", "value", where).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = W.windowed(events, "ts", "1 day", "value", where)
    shape = lambda df: sorted((r.start, r.n, round(r.total, 6)) for r in df.collect())
    assert shape(spark.table("w")) == shape(batch)
    query = W.running_total(stream, "user_id", "value").writeStream.format("memory").queryName("t").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    expected = {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}
    got = {}
    for r in spark.table("t").collect():
        got[r.user_id] = max(got.get(r.user_id, 0), r.n)
    assert got == expected
