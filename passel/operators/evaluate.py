"""Quality of hit lists: recall, reciprocal rank, agreement, coverage, source mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passel.functions.numbers import round_report
from passel.functions.text import normalize_label

# Decimals of reported shares and qualities, the name of a missing source, and how
# many differing uids a comparison shows.
DECIMALS = 4
UNKNOWN_SOURCE = "unknown"
SHOWN_DIFFERENCES = 5


def recall_per_query(hits: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Recall and reciprocal rank of every query that has gold.

    ``gold`` is ``(qid, uid)``. A query without hits scores 0 in both. Hits without an identifier
    do not count towards the rank. Hits and gold are stacked and counted per (query, uid), each
    read once; long gold lists are never collected.
    """
    in_order = Window.partitionBy("qid").orderBy("rank")
    key = F.nullif(F.col("uid"), F.lit(""))
    if "id" in hits.columns:
        key = F.coalesce(key, F.nullif(F.col("id").cast("string"), F.lit("")))
    known = hits.select("qid", "rank", key.alias("uid")).where(F.col("uid").isNotNull())
    placed = known.select("qid", "uid", F.row_number().over(in_order).alias("_place"), F.lit(0).alias("_gold"))
    wanted = gold.where(F.col("uid").isNotNull()).select(
        "qid", "uid", F.lit(None).cast("int").alias("_place"), F.lit(1).alias("_gold")
    )
    # The first place of a uid stands for all its places.
    cells = placed.unionAll(wanted).groupBy("qid", "uid").agg(F.min("_place").alias("_place"), F.max("_gold").alias("_gold"))
    place = F.when(F.col("_gold") == 1, F.col("_place"))
    judged = cells.groupBy("qid").agg(
        F.sum("_gold").alias("n_gold"), F.count(place).alias("n_found"), F.min(place).alias("_first")
    )
    return (
        judged.where("n_gold > 0")
        .join(queries.select("qid"), "qid", "left_semi")
        .select(
            "qid",
            "n_gold",
            "n_found",
            (F.col("n_found") / F.greatest("n_gold", F.lit(1))).alias("recall"),
            F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
        )
    )


def recall_mrr(hits: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean recall@k and mean reciprocal rank; both null when no query has gold."""
    per_query = recall_per_query(hits, gold, queries)
    return per_query.agg(
        F.count("*").alias("n_queries"),
        round_report(F.avg("recall"), DECIMALS).alias("recall_at_k"),
        round_report(F.avg("reciprocal_rank"), DECIMALS).alias("mrr"),
    )


def agreement(run_a: DataFrame, run_b: DataFrame, k: int = 10) -> DataFrame:
    """Per query present in both runs: are the top-k uid sets equal, and where do they differ?

    The runs are stacked and counted per (query, uid), which replaces a full outer join. What is
    collected per query is at most ``2 k`` uids.
    """

    def tagged(run: DataFrame, a: int, b: int) -> DataFrame:
        top = run.where(F.col("rank") <= k)
        return top.select("qid", "uid", F.lit(a).alias("_a"), F.lit(b).alias("_b"))

    cells = (
        tagged(run_a, 1, 0)
        .unionAll(tagged(run_b, 0, 1))
        .groupBy("qid", "uid")
        .agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    )
    in_a, in_b = F.col("_a") > 0, F.col("_b") > 0

    def shown(uids: Column) -> Column:
        return F.slice(F.sort_array(F.collect_list(uids)), 1, SHOWN_DIFFERENCES)

    grouped = cells.groupBy("qid").agg(
        F.sum("_a").alias("_size_a"),
        F.sum("_b").alias("_size_b"),
        F.count_if(in_a & ~in_b).alias("_only_a"),
        F.count_if(in_b & ~in_a).alias("_only_b"),
        shown(F.when(in_a & ~in_b, F.col("uid"))).alias("only_a"),
        shown(F.when(in_b & ~in_a, F.col("uid"))).alias("only_b"),
        F.sum(F.when(in_a, F.col("_a") - 1).otherwise(0)).alias("dupes_a"),
        F.sum(F.when(in_b, F.col("_b") - 1).otherwise(0)).alias("dupes_b"),
    )
    return grouped.where((F.col("_size_a") > 0) & (F.col("_size_b") > 0)).select(
        "qid",
        ((F.col("_only_a") == 0) & (F.col("_only_b") == 0)).alias("equal_sets"),
        "only_a",
        "only_b",
        F.least("_size_a", "_size_b").alias("k_compared"),
        "dupes_a",
        "dupes_b",
    )


def agreement_ratio(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("n_compared"),
        F.count_if("equal_sets").alias("n_equal"),
        F.try_divide(F.count_if("equal_sets"), F.count("*")).alias("ratio"),
    )


def hits_by_source(hits: DataFrame, source: str = "source") -> DataFrame:
    """Hits per source; a missing source is counted too."""
    return hits.groupBy(source).agg(F.count("*").alias("n_hits"))


def coverage(hits: DataFrame, source: str = "source") -> DataFrame:
    """Hits and distinct sources of every query."""
    return hits.groupBy("qid").agg(F.count("*").alias("n_hits"), F.count_distinct(source).alias("n_sources"))


def source_mix(hits: DataFrame, source: str = "source") -> DataFrame:
    """The share of every source among all hits; the total is the sum of the few counts per source."""
    label = F.coalesce(F.nullif(normalize_label(F.col(source)), F.lit("")), F.lit(UNKNOWN_SOURCE))
    counted = hits.groupBy(label.alias("source")).agg(F.count("*").alias("n_hits"))
    total = F.sum("n_hits").over(Window.partitionBy(F.lit(0)))
    return counted.select("source", "n_hits", round_report(F.col("n_hits") / total, DECIMALS).alias("share"))


def source_mix_map(mix: DataFrame) -> DataFrame:
    """The mix as one map, as a run summary stores it."""
    entries = F.sort_array(F.collect_list(F.struct("source", "share")))
    return mix.agg(F.map_from_entries(entries).alias("source_mix"))
