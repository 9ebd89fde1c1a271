"""Lookups as joins: exact, wildcard, and the nearest key below or above (as-of)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cells import NA
from ..functions.text import pattern_of


def _key(df: DataFrame, name: str) -> Column:
    return F.upper(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name)


def one_per_key(table: DataFrame, key: str, columns: list[str], pos: str | None = None, last: bool = False) -> DataFrame:
    """_key and the columns of the first (or last) row of each key, text in any case."""
    row = F.struct(*columns)
    pick = (F.max_by if last else F.min_by)(row, F.col(pos)) if pos else F.min(row)
    return table.where(F.col(key).isNotNull()).groupBy(_key(table, key).alias("_key")).agg(pick.alias("_row")).select("_key", *[F.col(f"_row.{c}").alias(c) for c in columns])


def XLOOKUP(
    df: DataFrame, value: str, table: DataFrame, key: str, columns: list[str], if_missing: dict | None = None, match: int = 0, pos: str | None = None, last: bool = False
) -> DataFrame:
    """``df`` with the columns of the matching row of ``table``, and ``lookup_error``.

    match 0 is exact, -1 the next smaller key, 1 the next larger, 2 a wildcard
    (the looked-up texts are the patterns). Of rows that match equally well the
    first by ``pos`` counts, or the last.
    """
    if match in (-1, 1):
        out = ASOF(df, value, table, key, columns, forward=match == 1, pos=pos, last=last)
    elif match == 2:
        out = WILDCARD(df, value, table, key, columns, pos, last)
    else:
        found = one_per_key(table, key, columns, pos, last).withColumn("_hit", F.lit(True))
        out = df.join(found, _key(df, value) == F.col("_key"), "left").drop("_key")
    missing = F.col("_hit").isNull()
    for c, default in (if_missing or {}).items():
        out = out.withColumn(c, F.when(missing, F.lit(default)).otherwise(F.col(c)))
    error = F.lit(None).cast("string") if if_missing else F.when(missing, NA)
    return out.withColumn("lookup_error", error).drop("_hit")


def VLOOKUP(df: DataFrame, value: str, table: DataFrame, column: int, sorted_: bool = True, pos: str | None = None) -> DataFrame:
    """The column-th column of the table, found by its first one: the largest key not above (of equal ones the last), or exact."""
    return XLOOKUP(df, value, table, table.columns[0], [table.columns[column - 1]], match=-1 if sorted_ else 0, pos=pos, last=sorted_)


def LOOKUP(df: DataFrame, value: str, table: DataFrame, key: str, result: str, pos: str | None = None) -> DataFrame:
    return XLOOKUP(df, value, table, key, [result], match=-1, pos=pos, last=True)


def HLOOKUP(df: DataFrame, value: str, wide: DataFrame, row: int, index: str, sorted_: bool = True) -> DataFrame:
    """VLOOKUP in a small table turned on its side; ``index`` names its rows."""
    turned = wide.transpose(index)
    return VLOOKUP(df, value, turned, row, sorted_)


def XMATCH(df: DataFrame, value: str, table: DataFrame, key: str, pos: str, match: int = 0, last: bool = False) -> DataFrame:
    """Position from 1 of the match, in the modes of XLOOKUP; ``pos`` counts from 0."""
    out = XLOOKUP(df, value, table, key, [pos], match=match, pos=pos, last=last)
    return out.withColumn("match", F.col(pos) + 1).drop(pos)


def MATCH(df: DataFrame, value: str, table: DataFrame, key: str, pos: str, kind: int = 1) -> DataFrame:
    """Position from 1 of the match: largest not above (1, of equal ones the last), smallest not below (-1), exact (0, in which texts may have wildcards)."""
    if kind:
        return XMATCH(df, value, table, key, pos, -kind, last=kind == 1)
    if dict(df.dtypes)[value] != "string":
        return XMATCH(df, value, table, key, pos)
    wild = F.coalesce(F.col(value).rlike("[*?~]"), F.lit(False))
    return XMATCH(df.where(~wild), value, table, key, pos).unionByName(XMATCH(df.where(wild), value, table, key, pos, 2))


#: Patterns that one pass over a table tests.
PATTERNS = 1000


def WILDCARD(df: DataFrame, value: str, table: DataFrame, key: str, columns: list[str], pos: str | None = None, last: bool = False) -> DataFrame:
    """``df`` with the columns of the first (or last) row whose key fits the pattern in ``value``, and _hit.

    Distinct patterns are dealt by a hash into blocks of about PATTERNS; each
    block comes to the driver on its own and is tested in one pass over the table.
    """
    wanted = df.select(F.col(value).alias("_pattern")).where(F.col(value).isNotNull()).distinct()
    blocks = max(1, -(-wanted.count() // PATTERNS))
    kept = list(dict.fromkeys([*columns, *([pos] if pos else [])]))
    hits = table.limit(0).select(F.lit("").alias("_pattern"), *kept)
    for i in range(blocks):
        patterns = [r[0] for r in wanted.where(F.pmod(F.xxhash64("_pattern"), F.lit(blocks)) == i).collect()]
        if patterns:
            tests = F.array(*[F.when(F.lower(F.col(key)).rlike(f"(?s)^{pattern_of(p.lower())}$"), F.lit(p)) for p in patterns])
            hits = hits.unionByName(table.select(F.explode(F.filter(tests, lambda p: p.isNotNull())).alias("_pattern"), *kept))
    row = F.struct(*columns)
    pick = (F.max_by if last else F.min_by)(row, F.col(pos)) if pos else (F.max if last else F.min)(row)
    found = hits.groupBy("_pattern").agg(pick.alias("_row")).withColumn("_hit", F.lit(True))
    out = df.join(found, df[value] == found["_pattern"], "left")
    return out.select(*[df[f"`{c}`"] for c in df.columns], *[F.col(f"_row.`{c}`").alias(c) for c in columns], "_hit")


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _comparable(df: DataFrame, value: str, table: DataFrame, key: str) -> tuple[Column, Column]:
    """The looked-up value and the key in one type that orders both: whole numbers stay whole, texts are upper-cased; values of another kind are null."""
    v, k = dict(df.dtypes)[value], dict(table.dtypes)[key]
    timed = lambda t: t.startswith("timestamp") or t == "date"
    if k == "string" or v == "string":
        same = F.upper(F.col(value)) if v == k else F.lit(None).cast(k)
        return same, F.upper(F.col(key)) if k == "string" else F.col(key)
    if v == k or (v in _WHOLE and k in _WHOLE):
        return F.col(value), F.col(key)
    if timed(v) and timed(k):
        return F.col(value).cast("timestamp"), F.col(key).cast("timestamp")
    if timed(v) or timed(k):
        return F.lit(None).cast(k), F.col(key)
    return F.col(value).cast("double"), F.col(key).cast("double")


#: Keys drawn to place the cuts between ranges.
DRAWN = 4096


def ASOF(
    df: DataFrame, value: str, table: DataFrame, key: str, columns: list[str], by: list[str] | None = None, forward: bool = False, slices: int = 256, pos: str | None = None, last: bool = True
) -> DataFrame:
    """``df`` with the columns of the row of ``table`` whose key is the nearest not above (or not below) its value, and _hit.

    Keys are compared in their own type; null keys are never found and null
    values find nothing. Of rows with equal keys the last by ``pos`` counts, or
    the first. Both tables are cut into ranges of the key at quantiles of a
    bounded draw, so a lookup without groups, or in one large group, is spread
    over them. A range of a group begins with the nearest row of the ranges
    before it, which is carried along the ranges that the group has rows or
    values in: never more than twice ``slices`` rows a group.
    """
    by = by or []
    x, k = _comparable(df, value, table, key)
    row = F.struct(*columns)
    pick = (F.max_by if last else F.min_by)(row, F.col(pos)) if pos else (F.max if last else F.min)(row)
    right = table.where(F.col(key).isNotNull()).groupBy(*by, k.alias("_k")).agg(pick.alias("_row"))
    kind = right.schema["_k"].dataType
    keys = table.select(k.alias("_k")).where(F.col("_k").isNotNull() & ~F.col("_k").cast("string").eqNullSafe("NaN"))
    drawn = sorted(r[0] for r in keys.orderBy(F.rand(11)).limit(DRAWN).collect())
    cuts = sorted({drawn[len(drawn) * i // slices] for i in range(1, slices)}) if drawn else []
    bounds = F.array(*map(F.lit, cuts)).cast(T.ArrayType(kind))
    # the number of cuts not above the key, by halving
    half = lambda s: F.floor((s.lo + s.hi) / 2).cast("int")
    step = lambda s, _: F.when(s.lo >= s.hi, s).otherwise(
        F.when(F.get(bounds, half(s)) <= F.col("_k"), F.struct((half(s) + 1).alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), half(s).alias("hi")))
    )
    rounds = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    slice_of = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), step, lambda s: s.lo) if cuts else F.lit(0)

    right = right.withColumn("_slice", slice_of)
    left = df.withColumn("_k", x.cast(kind)).withColumn("_slice", slice_of)
    toward = (lambda c: F.col(c).desc_nulls_first()) if forward else (lambda c: F.col(c).asc_nulls_first())
    nearest = (F.min_by if forward else F.max_by)(F.struct("_k", "_row"), F.col("_k"))
    ends = right.groupBy(*by, "_slice").agg(nearest.alias("_end"))
    asked = left.where("_k IS NOT NULL").groupBy(*by, "_slice").agg(F.lit(True).alias("_asked"))
    carried = ends.unionByName(asked, allowMissingColumns=True).groupBy(*by, "_slice").agg(F.first("_end", ignorenulls=True).alias("_end"), F.first("_asked", ignorenulls=True).alias("_asked"))
    earlier = Window.partitionBy(*by).orderBy(toward("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    starts = carried.withColumn("_start", F.last("_end", ignorenulls=True).over(earlier)).where("_asked AND _start IS NOT NULL")
    starts = starts.select(*by, F.col("_start._k").alias("_k"), F.col("_start._row").alias("_row"), "_slice")
    sides = right.select(*starts.columns).unionByName(starts).withColumns({"_left": F.lit(None).cast(left.schema), "_side": F.lit(0)})
    seekers = left.select(*by, "_k", F.lit(None).cast(right.schema["_row"].dataType).alias("_row"), "_slice", F.struct(*left.columns).alias("_left"), F.lit(1).alias("_side"))
    order = Window.partitionBy(*by, "_slice").orderBy(toward("_k"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    near = F.when(F.col("_k").isNotNull(), F.last("_row", ignorenulls=True).over(order))
    filled = sides.unionByName(seekers).withColumn("_near", near).where("_side = 1")
    return filled.select(*[F.col(f"_left.`{c}`").alias(c) for c in df.columns], *[F.col(f"_near.`{c}`").alias(c) for c in columns], F.when(F.col("_near").isNotNull(), True).alias("_hit"))


def SEMI(df: DataFrame, value: str, table: DataFrame, key: str, present: bool = True) -> DataFrame:
    """Rows whose value is (or isn't) among the keys: COUNTIF(keys, value) > 0, or = 0."""
    keys = table.select(_key(table, key).alias("_key"))
    return df.join(keys, _key(df, value) == F.col("_key"), "left_semi" if present else "left_anti")
