"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Holds a whole input row, so that columns of any name can't clash with those of an operator.
ROW = "_row"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="passel-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Store a DataFrame in the shared folder and go on from there, whatever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The DataFrame as Parquet in the shared folder, and where it lies, so that it can be deleted when it has been read."""
    path = f"{shared_folder(df.sparkSession)}/passel-{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def held(df: DataFrame) -> DataFrame:
    """The table with its rows in one struct column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def of_row(name: str) -> Column:
    return F.col(f"{ROW}.`{name}`")


def released(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The held columns again, those of ``new`` replaced or put behind."""
    kept = [new[c].alias(c) if c in new else of_row(c).alias(c) for c in columns if c in new or c.lower() not in {n.lower() for n in new}]
    return df.select(*kept, *[v.alias(n) for n, v in new.items() if n not in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder that an operator wrote and has read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most ``rows`` rows go to Python at once, as whole texts are long; a setting of the user's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Not every C library has it.
        pass


def tidy(task: Callable) -> Callable:
    """A task on batches, or on one column, that gives its memory back at the end."""

    @wraps(task)
    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    @wraps(task)
    def on_column(column: pa.Array) -> pa.Array:
        try:
            return task(column)
        finally:
            give_back()

    return on_batches if "batches" in task.__annotations__ else on_column
