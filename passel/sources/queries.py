"""Query sets and gold lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passel.functions.text import strip

LINE_END = "\r\n|\r|\n"


def query_lines(texts: DataFrame, text: Column, *keys: str) -> DataFrame:
    """The non-blank lines of a text column without outer whitespace, with their line numbers.

    A line ends at a line feed, a carriage return or both.
    """
    lines = texts.select(*keys, F.posexplode(F.split(text, LINE_END)).alias("line_no", "_line"))
    return lines.select(*keys, "line_no", strip(F.col("_line")).alias("query")).where(F.length("query") > 0)


def require_queries(queries: DataFrame) -> DataFrame:
    if queries.isEmpty():
        raise ValueError("the query set is empty")
    return queries


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """One query per non-blank line; ``qid`` follows the order of the lines."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("qid"), strip(F.col("value")).alias("query"))
    return require_queries(lines.where(F.length("query") > 0))


def _gold_rows(maps: DataFrame, column: str) -> DataFrame:
    by_query = maps.select(F.explode(column).alias("query", "_uids"))
    return by_query.select("query", F.explode("_uids").alias("uid")).distinct()


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object from query to relevant uids, as ``(query, uid)`` rows."""
    whole = spark.read.text(path, wholetext=True)
    return _gold_rows(whole.select(F.from_json("value", "map<string,array<string>>").alias("gold")), "gold")


def read_gold_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same object split into one small JSON object a line, for gold lists of any size."""
    lines = spark.read.text(path)
    return _gold_rows(lines.select(F.from_json("value", "map<string,array<string>>").alias("gold")), "gold")


def key_gold(gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Gold keyed by ``qid``; a repeated query text gives each of its qids the list."""
    return gold.join(queries.select("qid", "query"), "query").select("qid", "uid")
