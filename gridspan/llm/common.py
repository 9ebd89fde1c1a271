"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is set for a local master (tests);
    on a cluster that would be one machine's folder, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-gridspan-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_open = threading.local()
#: Paths and tables that no block deletes.
_left: list[tuple[str, DataFrame]] = []


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    blocks = getattr(_open, "blocks", None)
    (blocks[-1] if blocks else _left).append((path, out))
    return out


def delete(spark: SparkSession, paths) -> None:
    """Delete paths of any file system that Spark reaches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def drop_stored(spark: SparkSession, keep: DataFrame | None = None) -> int:
    """Delete the tables that operators left in the shared folder, and say how many.

    Results of operators are read from such tables: call this once they are
    written elsewhere. Tables that ``keep`` reads stay.
    """
    needed = " ".join(keep.inputFiles()) if keep is not None else ""
    gone = [(path, table) for path, table in _left if path.rsplit("/", 1)[1] not in needed]
    delete(spark, [path for path, _ in gone])
    _left[:] = [x for x in _left if x not in gone]
    return len(gone)


class Tables(list):
    """Paths and tables stored in a block."""

    kept: tuple = ()

    def keep(self, *tables: DataFrame) -> None:
        self.kept = tables


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes what is stored inside the block at its end, but for the tables to keep, which pass to an enclosing block.

    Those that no block encloses stay until ``drop_stored``.

    The result of a block may read kept tables only.
    """
    tables = Tables()
    _open.blocks = [*getattr(_open, "blocks", []), tables]
    try:
        yield tables
    finally:
        _open.blocks = _open.blocks[:-1]
        kept = [(path, table) for path, table in tables if any(table is x for x in tables.kept)]
        (_open.blocks[-1] if _open.blocks else _left).extend(kept)
        delete(spark, [path for path, table in tables if not any(table is x for x in tables.kept)])


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def number_array(values) -> Column:
    """A constant array of doubles, folded once by the optimizer."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def bound(value: Column, f) -> Column:
    """``f(value)``, with the value computed once however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Bytes of an Arrow batch handed to Python. Texts may be very long, so rows are no measure.
BATCH_BYTES = 8 << 20


def in_batches(df: DataFrame, f, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most BATCH_BYTES; the session's setting is lowered where it is larger."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    at = conf.get(name)
    if not at.rstrip("b").isdigit() or int(at.rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)
