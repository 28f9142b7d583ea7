"""Raw documents to cleaned documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passel.functions.text import CLEANERS, MIN_CLEAN_CHARS, long_enough


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters must not evaluate again.

    Catalyst copies a projected expression into a filter pushed below it. It does not push filters
    through a generator, so the one-element explode makes the value a plain attribute. Meant for a
    chain of functions; an expression that repeats its parts is better projected, where Spark
    evaluates equal parts once.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def clean_documents(
    documents: DataFrame, style: str = "encyclopedia", more_than: int = MIN_CLEAN_CHARS, text: str = "text"
) -> DataFrame:
    """Replace the raw text by ``clean_text`` and keep documents longer than ``more_than``."""
    if style not in CLEANERS:
        raise ValueError(f"unknown cleaning style {style!r}; use one of {sorted(CLEANERS)}")
    cleaned = with_computed(documents, "clean_text", CLEANERS[style](F.col(text))).drop(text)
    return cleaned.where(long_enough(F.col("clean_text"), more_than))
