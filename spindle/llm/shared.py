"""What the operators of this folder share: scratch tables, text input, worker caches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word and line contracts: tab, LF, VT, FF, CR and blank.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and all runs on one machine (tests) a folder of our own is set.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: driver and executors need a folder that they share")
        place = tempfile.mkdtemp(prefix="spindle-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver's process ends."""
    place = f"{shared_dir(spark)}/spindle-{spark.sparkContext.applicationId}"
    if place not in _USED:
        _USED.add(place)
        atexit.register(_forget, spark, place)
    return place


_USED: set[str] = set()


def _forget(spark: SparkSession, place: str) -> None:
    with contextlib.suppress(Exception):  # the session's JVM may be gone
        discard(spark, place)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, in this application's own part of it."""
    return f"{own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, what: str, compact: bool = False, by: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there: a lost executor costs the tasks that were running, not the
    work before the table. compact: for rows of a few numbers that were made from long texts;
    they are rebalanced, so that the table has files of a fair size and not one a scan task.
    by: columns whose values have a folder each; path: where, if not at a fresh place.
    """
    spark, path = df.sparkSession, path or scratch_path(df.sparkSession, what)
    (df.hint("rebalance") if compact else df).write.partitionBy(*by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, place: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application at once; call it when results are stored."""
    discard(spark, own_dir(spark))


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the jobs inside, put back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text"):
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def modest_batches(spark: SparkSession) -> None:
    """Sets smaller Arrow batches where the session has Spark's own default.

    Texts can be long; a batch lies in the memory of the JVM and of the worker, going in and
    coming out.
    """
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
    if spark.conf.get(name).rstrip("b") == str(default):
        spark.conf.set(name, str(4 << 20))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the Python copies of long texts stay few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(rows: pa.StructArray, column: str) -> pa.Array:
    """A field of the input rows."""
    return pc.struct_field(rows, [rows.type.get_field_index(column)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
