"""Continuous ingest: the stateless stages over a stream of raw documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from passel.operators.corpus import hash_shards
from passel.plans.corpus import embed_passages, passages


def read_documents(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of raw documents as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(
    documents: DataFrame,
    target: str,
    checkpoint: str,
    style: str = "encyclopedia",
    n_shards: int = 8,
    encoder: Callable[[Column], Column] | None = None,
) -> StreamingQuery:
    """Clean, cut, encode and append what has arrived, then stop.

    No stage keeps state, so the stream needs neither watermark nor shuffle; the file sink and the
    checkpoint make every passage appear exactly once.
    """
    corpus = hash_shards(embed_passages(passages(documents, style), encoder), n_shards)
    return (
        corpus.writeStream.format("parquet")
        .partitionBy("shard")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
