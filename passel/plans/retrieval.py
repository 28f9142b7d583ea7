"""Text queries to hits, context and run records."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passel.functions.encode import hashing_encoder
from passel.operators.evaluate import recall_mrr, source_mix, source_mix_map
from passel.operators.hits import attach_text, rag_context
from passel.operators.latency import latency_summary
from passel.operators.search import search_many


def answer(
    queries: DataFrame, corpus: DataFrame, chunks: DataFrame, k: int = 10,
    encoder: Callable[[Column], Column] | None = None, **options: Any,
) -> DataFrame:
    """Hits of all text queries with the text of their passages.

    Vectors are searched without the text; it is joined to the few hits afterwards.
    """
    hits = search_many(queries, hashing_encoder() if encoder is None else encoder, corpus, k=k, **options)
    return attach_text(hits, chunks)


def answer_context(queries: DataFrame, corpus: DataFrame, chunks: DataFrame, k: int = 10, **options: Any) -> DataFrame:
    """The passages of every query as one context text."""
    return rag_context(answer(queries, corpus, chunks, k, **options))


def run_summary(
    timings: DataFrame, hits: DataFrame, gold: DataFrame, queries: DataFrame, *, backend: str, index_key: str,
    metric: str, iters: int, top_k: int, value: str = "ms", **rounding: int,
) -> DataFrame:
    """One record of a run: latency figures, source mix and quality.

    The three parts are one row each; they are stacked and folded into one. ``hits`` is read twice
    and should be a stored hit log.
    """
    figures = latency_summary(timings, [], value, F.lit(metric), **rounding)
    mix = source_mix_map(source_mix(hits))
    quality = recall_mrr(hits, gold, queries).select(F.struct("recall_at_k", "mrr").alias("quality"))
    stacked = figures.unionByName(mix, allowMissingColumns=True).unionByName(quality, allowMissingColumns=True)
    record = stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])
    fixed = {"backend": backend, "index_key": index_key, "metric": metric, "iters": iters, "top_k": top_k}
    return record.withColumns({name: F.lit(v) for name, v in fixed.items()})
