"""Raw collections to the common document schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passel.functions.ids import stable_id
from passel.functions.text import ANSWER_SEPARATOR
from passel.schema import RAW_DOCUMENT

# The names of the three collections and the address form of an abstract.
ENCYCLOPEDIA = "wikipedia"
ABSTRACTS = "pubmed"
QUESTIONS = "stackexchange"
ABSTRACT_URL = "https://pubmed.ncbi.nlm.nih.gov/{key}/"

ABSTRACT_RECORD = T.StructType(
    [
        T.StructField(
            "MedlineCitation",
            T.StructType(
                [
                    T.StructField("PMID", T.StringType()),
                    T.StructField(
                        "Article",
                        T.StructType(
                            [
                                T.StructField("ArticleTitle", T.StringType()),
                                T.StructField(
                                    "Abstract",
                                    T.StructType([T.StructField("AbstractText", T.ArrayType(T.StringType()))]),
                                ),
                                T.StructField(
                                    "Journal",
                                    T.StructType(
                                        [
                                            T.StructField(
                                                "JournalIssue",
                                                T.StructType(
                                                    [
                                                        T.StructField(
                                                            "PubDate",
                                                            T.StructType(
                                                                [
                                                                    T.StructField("Year", T.StringType()),
                                                                    T.StructField("Month", T.StringType()),
                                                                    T.StructField("Day", T.StringType()),
                                                                ]
                                                            ),
                                                        )
                                                    ]
                                                ),
                                            )
                                        ]
                                    ),
                                ),
                            ]
                        ),
                    ),
                ]
            ),
        )
    ]
)


def to_document(
    df: DataFrame,
    domain: Column,
    source_id: Column,
    text: Column,
    title: Column | None = None,
    url: Column | None = None,
    published_at: Column | None = None,
) -> DataFrame:
    """Select the common schema from any table."""
    absent = F.lit(None)
    values = {
        "id": stable_id(domain, source_id),
        "domain": domain,
        "source_id": source_id,
        "title": absent if title is None else title,
        "url": absent if url is None else url,
        "published_at": absent if published_at is None else published_at,
        "text": text,
    }
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in RAW_DOCUMENT])


def published_from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds.cast("bigint"))


def published_from_parts(year: Column, month: Column, day: Column) -> Column:
    """A date whose month may be a number or a short English name; missing parts count as the first."""
    spelled = F.concat_ws(
        " ", year, F.coalesce(F.nullif(month, F.lit("")), F.lit("01")), F.coalesce(F.nullif(day, F.lit("")), F.lit("01"))
    )
    return F.coalesce(
        F.try_to_timestamp(spelled, F.lit("yyyy M d")), F.try_to_timestamp(spelled, F.lit("yyyy MMM d"))
    )


def published_at(value: Column) -> Column:
    """A timestamp from an epoch, an ISO date or nothing, whatever the text holds."""
    text = value.cast("string")
    epoch = F.when(text.rlike(r"^\d{9,}$"), F.timestamp_seconds(text.try_cast("bigint")))
    return F.coalesce(epoch, F.try_to_timestamp(text))


def encyclopedia_documents(articles: DataFrame) -> DataFrame:
    """Articles with ``title``, ``text`` and maybe ``url``; the title is the source key."""
    url = F.col("url") if "url" in articles.columns else None
    title = F.coalesce(F.col("title"), F.lit(""))
    return to_document(articles, F.lit(ENCYCLOPEDIA), title, F.coalesce(F.col("text"), F.lit("")), title, url)


def read_abstract_records(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Nested citation records from JSON lines or XML."""
    reader = spark.read.schema(ABSTRACT_RECORD)
    if form == "xml":
        return reader.option("rowTag", "PubmedArticle").xml(path)
    return reader.json(path)


def abstract_documents(records: DataFrame) -> DataFrame:
    """Nested citation records; the abstract's parts are joined with one space."""
    key = F.col("MedlineCitation.PMID")
    article = F.col("MedlineCitation.Article")
    parts = article["Abstract"]["AbstractText"]
    date = article["Journal"]["JournalIssue"]["PubDate"]
    before, after = ABSTRACT_URL.split("{key}")
    return to_document(
        records,
        F.lit(ABSTRACTS),
        key,
        F.coalesce(F.array_join(parts, " "), F.lit("")),
        F.coalesce(article["ArticleTitle"], F.lit("")),
        F.concat(F.lit(before), key, F.lit(after)),
        published_from_parts(date["Year"], date["Month"], date["Day"]),
    )


def qa_documents(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions joined with their accepted answer; questions without one are left out.

    Both sides are keyed by identifiers that occur once, so the join cannot become skewed.
    """
    accepted = answers.select(F.col("answer_id").alias("accepted_answer_id"), F.col("body").alias("_answer"))
    pairs = questions.where(F.col("accepted_answer_id").isNotNull()).join(accepted, "accepted_answer_id")
    text = F.concat(
        F.coalesce(F.col("body"), F.lit("")), F.lit(ANSWER_SEPARATOR), F.coalesce(F.col("_answer"), F.lit(""))
    )
    have = pairs.columns
    return to_document(
        pairs,
        F.lit(QUESTIONS),
        F.col("question_id").cast("string"),
        text,
        F.coalesce(F.col("title"), F.lit("")) if "title" in have else F.lit(""),
        F.coalesce(F.col("link"), F.lit("")) if "link" in have else F.lit(""),
        published_from_epoch(F.col("creation_date")) if "creation_date" in have else None,
    )
