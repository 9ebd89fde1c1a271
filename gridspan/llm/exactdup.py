"""Exact deduplication by distributed MSD radix partitioning.

Texts are split by successive digits of their bytes: first their length and 32
bytes, then 480, 7680, ... more. A group that has one row left is done, one
whose texts have ended is a group of equal texts; only the others go on to the
next digit. Equality is decided by the bytes alone, never by a digest.

Group sizes are summed before they are shuffled, and rows meet them in joins
whose large partitions adaptive execution splits, so a text that a third of
all rows share stays spread. Each round is written to the shared folder.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, lower_ascii, stored

FIRST_DIGIT = 32
WIDEN = 16


def _normalised(batches, text: str):
    """Length, first digit and SHA-256 of the lower-cased bytes; Spark's ``translate`` takes several times as long for all texts."""
    for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
        bodies = [(t or "").encode("utf-8", "surrogatepass").lower() for t in batch.column(text).to_pylist()]
        shas = [hashlib.sha256(b).hexdigest() for b in bodies]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([len(b) for b in bodies], pa.int32()), pa.array([b[:FIRST_DIGIT] for b in bodies], pa.binary()), pa.array(shas, pa.string())],
            names=[*batch.schema.names, "_n", "_digit", "_sha"],
        )


def _met(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of their group, if any; groups grow with the documents, so they are never broadcast."""
    return rows.join(groups.hint("merge"), on, "left")


def _split(docs: DataFrame, id_col: str, text_col: str, keep_text: bool) -> tuple[DataFrame, dict[str, str]]:
    """A row for each row of ``docs`` with its columns renamed, _keep, _size, _kept and _sha; the new name of each column."""
    renamed = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    key, text = renamed[id_col], renamed[text_col]
    docs = docs.toDF(*renamed.values())
    carried = [n for n in renamed.values() if keep_text or n != text]

    filled = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(F.octet_length(filled).alias("_n"), F.substring(F.encode(lower_ascii(F.substring(filled, 1, FIRST_DIGIT)), "UTF-8"), 1, FIRST_DIGIT).alias("_digit"))
    several = first.groupBy("_n", "_digit").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    several = stored(several.select("_n", "_digit", F.monotonically_increasing_id().alias("_group")), "radix-groups")

    added = [T.StructField("_n", T.IntegerType()), T.StructField("_digit", T.BinaryType()), T.StructField("_sha", T.StringType())]
    rows = in_batches(docs, lambda batches, text=text: _normalised(batches, text), T.StructType([*docs.schema.fields, *added]))
    rows = _met(rows, several, ["_n", "_digit"])
    # only texts that aren't alone are lower-cased again and go on
    body = F.encode(lower_ascii(filled), "UTF-8")
    rest = F.when(F.col("_group").isNotNull(), F.substring(body, FIRST_DIGIT + 1, 2**31 - 1))
    rows = stored(rows.select(*carried, "_sha", "_n", "_group", rest.alias("_rest"), F.monotonically_increasing_id().alias("_row")), "radix-rows")

    alone = lambda df: df.select(*carried, "_sha", F.col(key).alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"))
    done = [alone(rows.where(F.col("_group").isNull()))]
    active, depth = rows.where(F.col("_group").isNotNull()), FIRST_DIGIT
    while (longest := active.agg(F.max("_n")).first()[0]) is not None:
        width = depth * (WIDEN - 1)
        digit = F.expr(f"substring(_rest, 1, {width})").alias("_digit")
        sums = active.groupBy("_group", digit).agg(F.count(F.lit(1)).alias("_size"), F.max(F.struct(F.col(key).alias("id"), F.col("_row").alias("row"))).alias("_last"))
        sums = stored(sums.where("_size > 1").withColumn("_next", F.monotonically_increasing_id()), "radix-groups")
        split = _met(active.withColumn("_digit", digit), sums, ["_group", "_digit"])
        depth += width
        goes_on = F.col("_size").isNotNull() & (F.col("_n") > depth)
        split = stored(
            split.select(
                *carried, "_sha", "_n", "_row",
                F.when(goes_on, F.col("_next")).alias("_group"),
                F.when(goes_on, F.expr(f"substring(_rest, {width + 1})")).alias("_rest"),
                F.when(F.col("_size").isNull(), F.col(key)).otherwise(F.col("_last.id")).alias("_keep"),
                F.coalesce("_size", F.lit(1).cast("long")).alias("_size"),
                (F.col("_size").isNull() | (F.col("_last.row") == F.col("_row"))).alias("_kept"),
            ),
            "radix-rows",
        )
        done.append(split.where(F.col("_group").isNull()).select(*carried, "_sha", "_keep", "_size", "_kept"))
        if longest <= depth:
            break
        active = split.where(F.col("_group").isNotNull()).select(*carried, "_sha", "_n", "_row", "_group", "_rest")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out, {c: n for c, n in renamed.items() if n in carried}


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Columns of ``docs`` plus keep_id, group_size, kept and text_sha256, a row for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty, and texts may be of any length. Of equal texts one row stays: that with the largest id, of repeated
    rows of that id any one; a null id is below all others. ``keep_text=False``
    leaves out the text, which then isn't stored either. Columns that already
    have a name of the result are replaced. An empty table gives an empty one.
    """
    out, names = _split(docs.drop("keep_id", "group_size", "kept", "text_sha256"), id_col, text_col, keep_text)
    return out.select(
        *[F.col(n).alias(c) for c, n in names.items()],
        F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each group of equal texts (see exact_groups), columns as they were."""
    out, names = _split(docs, id_col, text_col, keep_text=True)
    return out.where("_kept").select(*[F.col(n).alias(c) for c, n in names.items()])
