"""Schemas of the tables that flow between the stages."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("text", T.StringType()),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("chunk_id", T.IntegerType()),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("chunk_tokens", T.IntegerType()),
    ]
)

# Column order of a hit log; sinks write it in this order.
HIT_LOG_COLUMNS = [
    "query",
    "iter",
    "rank",
    "score",
    "id",
    "uid",
    "source",
    "title",
    "url",
    "chunk_id",
    "text",
]

MERGED_HIT_COLUMNS = ["query", "rank", "score", "id", "uid", "source", "title", "url", "chunk_id", "text"]

# Only the fields that the analytics read; absent ones come back as null.
RUN_SUMMARY = T.StructType(
    [
        T.StructField("backend", T.StringType()),
        T.StructField("index_key", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("n_queries", T.LongType()),
        T.StructField("iters", T.LongType()),
        T.StructField("top_k", T.LongType()),
        T.StructField("avg_ms", T.DoubleType()),
        T.StructField("p50_ms", T.DoubleType()),
        T.StructField("p90_ms", T.DoubleType()),
        T.StructField("qps", T.DoubleType()),
        T.StructField("llm_avg_ms", T.DoubleType()),
        T.StructField("llm_p50_ms", T.DoubleType()),
        T.StructField("llm_p95_ms", T.DoubleType()),
        T.StructField("llm_qps", T.DoubleType()),
        T.StructField("source_mix", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField(
            "quality",
            T.StructType([T.StructField("recall_at_k", T.DoubleType()), T.StructField("mrr", T.DoubleType())]),
        ),
    ]
)
