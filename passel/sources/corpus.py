"""Stage tables, vector files and sharded corpora at rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_READ = 65536


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a stage table; a collection is dropped and recreated the same way.

    Rows are written from the partitions they are in. A source with a third of the corpus is
    spread over many files instead of being gathered in one task.
    """
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_shards(corpus: DataFrame, path: str, shard: str = "shard", files_per_shard: int | None = None) -> None:
    """Store a corpus by shard.

    Each task writes one file per shard it holds. ``files_per_shard`` bounds their number by a
    shuffle on the shard and a random salt, which also divides a shard far larger than the others;
    the corpus should be a stored table then, so that a repeated task draws the same salts.
    """
    if files_per_shard is None:
        write_stage(corpus, path, [shard])
        return
    salted = corpus.withColumn("_salt", F.floor(F.rand(11) * files_per_shard))
    write_stage(salted.repartition(shard, "_salt").drop("_salt"), path, [shard])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """A sharded corpus; shard numbers come from the folder names, so filters on them prune."""
    return spark.read.parquet(path)


def read_npy(spark: SparkSession, path: str, rows_per_read: int = ROWS_PER_READ) -> DataFrame:
    """A float matrix file as ``(row_index, embedding)``.

    Every task reads its own rows of the file; the path must be mounted on all executors. The
    driver reads the header only.
    """
    rows, dim = np.load(path, mmap_mode="r").shape
    starts = spark.range(0, rows, rows_per_read, max(1, -(-rows // rows_per_read)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.load(path, mmap_mode="r")
        for batch in batches:
            for start in batch.column(0).to_pylist():
                block = np.ascontiguousarray(matrix[start : start + rows_per_read], dtype=np.float32)
                offsets = np.arange(0, block.size + 1, dim, dtype=np.int32)
                vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.ravel()))
                index = pa.array(np.arange(start, start + len(block), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([index, vectors], names=["row_index", "embedding"])

    return starts.mapInArrow(read, "row_index long, embedding array<float>")


def attach_by_position(meta: DataFrame, vectors: DataFrame, row_index: str = "row_index") -> DataFrame:
    """Pair row i of the metadata with vector i; both sides carry the row number."""
    return meta.join(vectors, row_index)


def store_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store a table below ``path`` in buckets of its key, known to the catalog as ``name``.

    Joins and groupings on the key of two tables with equally many buckets need no shuffle. Rows are shuffled once, when
    they are written, to one file for each bucket, so the key should be one that spreads: an identifier or a row number.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def discover_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards found at a path with their row counts, in shard order."""
    return read_shards(spark, path).groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard")
