"""Session helpers shared by jobs, the benchmark and the tests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Shuffle widths up to this merge the rows of a key in one step.
MERGE_SALT_FROM = 64
# Lookup tables up to this many narrow rows are broadcast.
BROADCAST_ROWS = 200_000
# Inputs up to this size are dealt out to all cores before work that is heavy for each row.
SPREAD_BYTES = 1 << 30


def local_session(app: str, cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shuffle_width(spark: SparkSession) -> int:
    """The configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def merge_salts(spark: SparkSession) -> int:
    """How many sub-groups a per-key merge is split into before its final step.

    A top-k merge gets up to ``k`` rows per key from every scan task. With few tasks one step
    is enough; on a wide cluster the rows of one key would pile up in a single task, so they are
    cut down in about sqrt(width) sub-groups first.
    """
    width = shuffle_width(spark)
    return 1 if width <= MERGE_SALT_FROM else max(2, int(width**0.5))


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own, because no other machine could
    read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_scratch()


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="passel-")


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint: a lost executor costs a re-read. Being Parquet,
    it is also read by column, so a later pass over one key does not touch vectors or text.
    """
    path = f"{_own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Store a result in the checkpoint folder, so that the files it was read from can go."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def scratch_path(spark: SparkSession) -> Iterator[str]:
    """A path in the shared folder that is deleted at the end of the block."""
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/passel-{spark.sparkContext.applicationId}"


def drop_intermediates(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that still read them must be stored first."""
    _delete(spark, _own_folder(spark))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Store a lookup table, count it, and mark it for broadcast when it is within the bound.

    Beyond the bound Spark joins it by shuffle. Without the mark a large other side might be
    shuffled before the small size of this one is known.
    """
    stored = materialise(df)
    return F.broadcast(stored) if stored.count() <= max_rows else stored


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy row work on an input of few scan splits.

    Only an input below one full split per core, and of at most ``SPREAD_BYTES`` whatever the cluster, is
    redistributed. A large one has splits enough, and shuffling its raw text would cost more than the
    work itself.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if estimate < min(cores * split_bytes, SPREAD_BYTES) else df
