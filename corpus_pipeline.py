"""Corpus pipeline: language ID, exact dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next stage's documents. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.llm import decontaminate, exactdup, langid, mixing, neardup
from gridspan.llm.common import scratch, stored, table

#: SQL can't express the trained language model and the registers; the stages are tested against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what is in none of the labelled languages: null texts, texts without a letter, and texts far from every codeword.

    Short texts and those that are merely ambiguous stay, and so does all with
    a letter where fewer than two languages are labelled.
    """
    own = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(own))])
    name = dict(zip(own, plain.columns))
    found = langid.in_language(plain, langid.fit(docs), name["text"])
    return found.select(*[F.col(name[c]).alias(c) for c in own])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exactdup.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 80 % of their five-word shingles, one stays."""
    return neardup.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), policy="drop")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of as many rows as there are documents."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents.

    What the stages store goes as soon as it is read, but for the documents
    that the last stage reads: ``common.drop_stored`` deletes those once the
    result is written.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as tables:
        for name, stage in STAGES[:-1]:
            with scratch(spark) as inner:
                docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", codec="snappy")
                inner.keep(docs)
        tables.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
