"""Approximate, wildcard and exact lookups against plain loops."""

import random

import pytest

from gridspan.operators import lookup as L


def nearest(rows, value, forward, last):
    """Result of the nearest key, by a loop over (key, pos, result)."""
    fits = [r for r in rows if r[0] is not None and value is not None and (r[0] >= value if forward else r[0] <= value)]
    if not fits:
        return None
    edge = (min if forward else max)(r[0] for r in fits)
    return (max if last else min)((r for r in fits if r[0] == edge), key=lambda r: r[1])[2]


@pytest.mark.parametrize("kind, make", [("long", lambda r: 2**53 + r.randrange(400)), ("string", lambda r: r.choice("ABCÉZ") + r.choice("MNO") * r.randrange(3)), ("double", lambda r: r.randrange(90) / 4), ("timestamp", None)])
def test_asof_equals_a_loop(spark, kind, make):
    import datetime

    rng = random.Random(5)
    make = make or (lambda r: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=r.randrange(500)))
    some = lambda: None if rng.random() < 0.05 else make(rng)
    table = [(some(), i, rng.choice(["g", "h", None]), f"r{i}") for i in range(300)]
    seek = [(i, some(), rng.choice(["g", "h", None, "no"])) for i in range(200)]
    t = spark.createDataFrame(table, f"k {kind}, pos int, g string, res string")
    s = spark.createDataFrame(seek, f"id int, v {kind}, g string")
    for forward in (False, True):
        for last in (False, True):
            out = {r.id: (r.res, r._hit) for r in L.ASOF(s, "v", t, "k", ["res"], ["g"], forward, slices=7, pos="pos", last=last).collect()}
            expected = {i: nearest([(k, p, res) for k, p, h, res in table if h == g], v, forward, last) for i, v, g in seek}
            assert {i: r for i, (r, _) in out.items()} == expected
            assert all(hit == (expected[i] is not None or None) for i, (_, hit) in out.items())
    assert L.ASOF(s, "v", t.limit(0), "k", ["res"]).where("_hit").count() == 0 and L.ASOF(s.limit(0), "v", t, "k", ["res"]).count() == 0


def test_text_and_large_keys(spark):
    t = spark.createDataFrame([("apple", 0, 1), ("Banana", 1, 2), ("cherry", 2, 3)], "k string, pos int, n int")
    v = spark.createDataFrame([("BANANA",), ("b",), ("a",), ("zoo",), (None,)], "v string")
    pick = lambda df, c: {r.v: r[c] for r in df.collect()}
    assert pick(L.LOOKUP(v, "v", t, "k", "n"), "n") == {"BANANA": 2, "b": 1, "a": None, "zoo": 3, None: None}
    assert pick(L.VLOOKUP(v, "v", t.select("k", "n"), 2), "n") == {"BANANA": 2, "b": 1, "a": None, "zoo": 3, None: None}
    assert pick(L.MATCH(v, "v", t, "k", "pos", 1), "match") == {"BANANA": 2, "b": 1, "a": None, "zoo": 3, None: None}
    assert pick(L.MATCH(v, "v", t, "k", "pos", -1), "match") == {"BANANA": 2, "b": 2, "a": 1, "zoo": None, None: None}
    big = spark.createDataFrame([(2**53 + 1, 0)], "k long, pos int")
    asked = spark.createDataFrame([(2**53,), (2**53 + 1,)], "v long")
    assert pick(L.MATCH(asked, "v", big, "k", "pos", 1), "match") == {2**53: None, 2**53 + 1: 1}
    numbers = spark.createDataFrame([(24.0, 0), (43.5, 1), (52.8, 2), (69.0, 3), (269.0, 4)], "k double, pos int")
    seventy = spark.createDataFrame([(70.0,)], "v double")
    assert pick(L.MATCH(seventy, "v", numbers, "k", "pos"), "match") == {70.0: 4} and pick(L.MATCH(seventy, "v", numbers, "k", "pos", -1), "match") == {70.0: 5}
    # a text finds no number and a number no text
    assert pick(L.MATCH(v, "v", numbers, "k", "pos"), "lookup_error") == dict.fromkeys(["BANANA", "b", "a", "zoo", None], "#N/A")
    assert pick(L.LOOKUP(seventy, "v", t, "k", "n"), "n") == {70.0: None}


def test_wildcards(spark, monkeypatch):
    t = spark.createDataFrame([("apple", 0), ("Banana", 1), ("banjo", 2), ("a?b", 3), (None, 4)], "k string, pos int")
    v = spark.createDataFrame([("ban*",), ("APPLE",), ("?anjo",), ("a~?b",), ("zz*",), (None,)], "v string")
    pick = lambda df, c="match": {r.v: r[c] for r in df.collect()}
    expected = {"ban*": 2, "APPLE": 1, "?anjo": 3, "a~?b": 4, "zz*": None, None: None}
    assert pick(L.MATCH(v, "v", t, "k", "pos", 0)) == pick(L.XMATCH(v, "v", t, "k", "pos", 2)) == expected
    assert pick(L.XMATCH(v, "v", t, "k", "pos", 2, last=True)) == expected | {"ban*": 3}
    assert pick(L.XMATCH(v, "v", t, "k", "pos", 0)) == dict.fromkeys(expected) | {"APPLE": 1}
    # more patterns than a pass tests
    monkeypatch.setattr(L, "PATTERNS", 2)
    assert pick(L.XMATCH(v, "v", t, "k", "pos", 2)) == expected
    found = L.XLOOKUP(v, "v", t, "k", ["pos"], {"pos": -1}, match=2, pos="pos")
    assert pick(found, "pos") == {"ban*": 1, "APPLE": 0, "?anjo": 2, "a~?b": 3, "zz*": -1, None: -1} and found.where("lookup_error IS NOT NULL").count() == 0
