"""Overlapping word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Window length, step between window starts, shortest and longest passage kept.
MAX_LEN = 500
STRIDE = 150
MIN_LEN = 120
MAX_TOKENS = 800

DOCUMENT_FIELDS = ["id", "domain", "source_id", "title", "url"]


def word_windows(words: Column, max_len: int, stride: int, min_len: int) -> Column:
    """The windows of a word array as an array of ``(chunk_text, chunk_tokens)`` structs.

    Windows start at multiples of ``stride``; the first one to reach the end is the last. A window
    shorter than ``min_len`` is left out.
    """
    n = F.size(words)
    last = F.greatest(F.ceil((n - max_len) / F.lit(stride)), F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: i * stride)
    kept = F.filter(starts, lambda s: (s < n) & (F.least(F.lit(max_len), n - s) >= min_len))
    return F.transform(
        kept,
        lambda s: F.struct(
            F.array_join(F.slice(words, s + 1, F.lit(max_len)), " ").alias("chunk_text"),
            F.least(F.lit(max_len), n - s).cast("int").alias("chunk_tokens"),
        ),
    )


def chunk_documents(
    documents: DataFrame,
    text: str = "clean_text",
    keep: list[str] | None = None,
    max_len: int = MAX_LEN,
    stride: int = STRIDE,
    min_len: int = MIN_LEN,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """One row per passage: the kept document fields, ``chunk_id``, ``chunk_text``, ``chunk_tokens``.

    A narrow transformation without a UDF: no shuffle, and it takes a streaming table as well. The
    text must have been cleaned, with single spaces between the words.
    """
    if max_len < 1 or stride < 1:
        raise ValueError("max_len and stride must be positive")
    keep = DOCUMENT_FIELDS if keep is None else keep
    no_words = F.array().cast("array<string>")
    words = F.when(F.col(text) == "", no_words).otherwise(F.split(F.col(text), " "))
    split_once = documents.select(*keep, words.alias("_words"))
    windows = word_windows(F.col("_words"), max_len, stride, min_len)
    return (
        split_once.select(*keep, F.posexplode(windows).alias("chunk_id", "_window"))
        .select(*keep, "chunk_id", "_window.chunk_text", "_window.chunk_tokens")
        .where(F.col("chunk_tokens").between(min_len, max_tokens))
    )
