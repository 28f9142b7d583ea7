"""Passage metadata: normalised fields, identifiers, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passel.functions.ids import build_uid, row_uid, tolerant_chunk_id
from passel.functions.text import normalize_label
from passel.operators.corpus import with_row_index

LABEL_FIELDS = ("domain", "source")
TEXT_FIELDS = ("title", "url", "source_id", "id")


def _chunk_number(df: DataFrame) -> Column:
    return tolerant_chunk_id(F.col("chunk_id"), isinstance(df.schema["chunk_id"].dataType, T.StringType))


def normalize_metadata(df: DataFrame) -> DataFrame:
    """Lower-cased, trimmed labels, string keys and integer chunk numbers; nulls stay null."""
    changes = {c: normalize_label(F.col(c)) for c in LABEL_FIELDS if c in df.columns}
    changes |= {c: F.col(c).cast("string") for c in TEXT_FIELDS if c in df.columns}
    if "chunk_id" in df.columns:
        changes["chunk_id"] = _chunk_number(df)
    return df.withColumns(changes)


def add_uid(df: DataFrame, order_by: Sequence[str] = ("id",), on_duplicate: str = "keep") -> DataFrame:
    """Add ``uid``: by chunk number where the table has one, else by row number.

    With ``on_duplicate="suffix_all"`` one repeated uid makes every uid end in its row number.
    """
    if on_duplicate not in ("keep", "suffix_all"):
        raise ValueError("on_duplicate must be keep or suffix_all")
    if "chunk_id" in df.columns:
        named = df.withColumn("uid", build_uid(F.col("id"), _chunk_number(df)))
    else:
        named = with_row_index(df, order_by, "_row").withColumn("uid", row_uid(F.col("id"), F.col("_row"))).drop("_row")
    if on_duplicate == "keep" or named.groupBy("uid").count().where("count > 1").isEmpty():
        return named
    return (
        with_row_index(named, order_by, "_row")
        .withColumn("uid", F.concat_ws("::", "uid", F.col("_row").cast("string")))
        .drop("_row")
    )


def vector_metadata(chunks: DataFrame) -> DataFrame:
    """The passage table without its text."""
    return chunks.drop("chunk_text")
