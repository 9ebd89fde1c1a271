"""Mixing sources to target weights by Poisson replication.

A document of a source whose target weight asks for a mean repetition rate r is
repeated Poisson(r) times. The draw inverts the Poisson distribution at a
number hashed from the seed and the document's id, so it is the same in every
run and on every executor. Rates over 16 are drawn as a sum of independent
draws with smaller rates, which is again Poisson and keeps exp(-rate) exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

#: Largest rate drawn by one inversion, and the number of terms summed for it (the tail beyond is under 1e-15).
PART_RATE = 16.0
TERMS = 72
#: Sources whose rates are broadcast; with more, rates and documents meet in a shuffled join.
FEW_SOURCES = 10_000


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(16**13)


def poisson_count(rate: Column, key: Column, seed: int) -> Column:
    """Poisson(rate) draws: the number of j whose cumulated probability is at most the hashed number."""
    parts = F.greatest(F.ceil(rate / PART_RATE), F.lit(1))
    part_rate = rate / parts

    def one(part: Column) -> Column:
        u = unit_hash(F.lit(str(seed)), part.cast("string"), key)
        first = F.exp(-part_rate)
        start = F.struct(F.lit(0).alias("k"), first.alias("p"), first.alias("cdf"), u.alias("u"))
        step = lambda s, j: F.when(s.cdf > s.u, s).otherwise(F.struct((s.k + 1).alias("k"), (s.p * part_rate / j).alias("p"), (s.cdf + s.p * part_rate / j).alias("cdf"), s.u.alias("u")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s.k)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), parts), F.lit(0), lambda acc, part: acc + one(part))


def source_rates(docs: DataFrame, source_col: str, weights: dict | None, total: int | None) -> DataFrame:
    """_source and _rate: weight share x total rows of the mix / rows of the source.

    Without ``weights`` every source, null included, has the same weight;
    without ``total`` the mix is as large as ``docs``. Sources that ``weights``
    leaves out have weight 0.
    """
    counts = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        counts = counts.withColumn("_w", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "_k string, _w double")
        counts = counts.join(given, F.col("_source").eqNullSafe(F.col("_k")), "left").select("_source", "_n", F.coalesce("_w", F.lit(0.0)).alias("_w"))
    counts = stored(counts, "source-counts")
    sums = counts.agg(F.sum("_n").alias("n"), F.sum("_w").alias("w"), F.count(F.lit(1)).alias("sources")).first()
    size = float(total if total is not None else sums["n"] or 0)
    rates = counts.select("_source", (F.col("_w") / float(sums["w"] or 1) * size / F.col("_n")).alias("_rate"))
    return F.broadcast(rates) if sums["sources"] <= FEW_SOURCES else rates


def mix_sources(docs: DataFrame, weights: dict | None = None, total: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` in the mix's repetition, with ``copy`` (from 0) and ``shuffle_key``, in a globally shuffled order.

    Rows are dealt to partitions by a hash of id and copy and ordered by it
    within them, so neither a large source nor a much repeated document stays
    together. Repeated rows of one id get the same number of copies; a null id
    hashes as an empty one. An empty table gives an empty one; columns of
    ``docs`` named copy or shuffle_key are replaced.
    """
    rates = source_rates(docs, source_col, weights, total)
    docs = docs.drop("copy", "shuffle_key")
    n, name, rate = (fresh(docs, c) for c in ("_copies", "_source", "_rate"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    drawn = docs.join(rates.toDF(name, rate), F.col(source_col).eqNullSafe(F.col(name)), "left").withColumn(n, poisson_count(F.col(rate), key, seed))
    copies = drawn.where(F.col(n) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("copy"))
    copies = copies.withColumn("shuffle_key", F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), key, F.col("copy").cast("string"))), 1, 16))
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
