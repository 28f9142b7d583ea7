"""A packed training corpus from raw documents, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passel.llm.line_dedup import drop_repeated_lines
from passel.llm.near_text import drop_near_texts
from passel.llm.packing import pack_documents
from passel.llm.quality import fit_classifier, score_quality
from passel.llm.suffix_dedup import drop_repeated_strings
from passel.llm.tables import delete, short_batches, stored, table

VOCABULARY = "word_bpe_49k.json"

# Near-duplicate grouping, suffix sorting and packing have no SQL form.
ORACLE_SQL = None


def _as_documents(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the documents table, with the length of the text as it is now."""
    counted = found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, with the prior of their source and language, takes for good.

    Null texts are empty; repeated rows and rows without an id are judged like any other. An empty table stays empty.
    """
    short_batches(spark)
    classifier = fit_classifier(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, classifier).where("keep").select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the one of the smallest id.

    Null texts become empty; rows without an id lose no lines; rows of one id are one document.
    """
    return _as_documents(drop_repeated_lines(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more.

    Texts without words are one group; rows without an id stay, as do equal rows of the id that stays.
    """
    short_batches(spark)
    return drop_near_texts(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes stay where they start first.

    Null texts become empty; rows without an id stay whole; equal rows are one document.
    """
    short_batches(spark)
    return _as_documents(drop_repeated_strings(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    Every row has a piece, a null or empty text one of the end token alone.
    """
    short_batches(spark)
    return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage reads the Parquet that the one before has written to the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs, path = stored(docs)
            if before:
                delete(spark, before)
            before = path
    return docs
