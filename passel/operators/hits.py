"""Work on hit lists: filter, deduplicate, re-rank, complete, assemble context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passel.functions.ids import build_uid
from passel.functions.text import normalize_label, pick_text, resolve_source
from passel.operators.topk import rank_hits
from passel.session import broadcast_if_small

NO_SCORE = -1e30


def source_matches(source: Column, wanted: str) -> Column:
    """Equality after trimming and lower-casing both sides."""
    return F.coalesce(normalize_label(source), F.lit("")) == wanted.strip().lower()


def dedup_best_hit(hits: DataFrame, keys: Sequence[str] = ("qid",), k: int | None = None) -> DataFrame:
    """Keep the best-scoring hit of every uid, rank by (score desc, uid asc), optionally cut.

    A hit without uid is known by its id and chunk number. Equal scores keep the earlier rank.
    """
    fallback = build_uid(F.col("id"), F.col("chunk_id")) if "id" in hits.columns else F.lit("")
    named = hits.withColumn("uid", F.coalesce(F.nullif("uid", F.lit("")), fallback))
    rest = [c for c in hits.columns if c not in (*keys, "uid", "rank", "score")]
    earlier = -F.col("rank") if "rank" in hits.columns else F.lit(0)
    score = F.coalesce(F.col("score"), F.lit(NO_SCORE))
    best = named.groupBy(*keys, "uid").agg(
        F.max(F.struct(score.alias("score"), earlier.alias("_earlier"), *rest)).alias("_best")
    )
    flat = best.select(*keys, "_best.score", "uid", *[f"_best.{c}" for c in rest])
    return rank_hits(flat, k, keys)


def filter_after(hits: DataFrame, source: str, k: int, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """Keep the hits of one source, then rank again and cut; may leave fewer than ``k``."""
    return rank_hits(hits.where(source_matches(F.col("source"), source)).drop("rank"), k, keys)


def first_hit_per_query(hits: DataFrame) -> DataFrame:
    """The highest-ranked hit of every query, found by a partial aggregation."""
    rest = [c for c in hits.columns if c not in ("qid", "rank")]
    first = hits.groupBy("qid").agg(F.min(F.struct("rank", *rest)).alias("_first"))
    return first.select("qid", "_first.*")


def attach_metadata(hits: DataFrame, meta: DataFrame, columns: Sequence[str], keep_unmatched: bool = False) -> DataFrame:
    """Look up metadata columns by uid, after the top-k.

    The hits are the small side: stored, counted and, within the bound, broadcast, so that the
    metadata streams past them unshuffled. Copies of a passage collapse in the map-side half of the
    aggregation; each hit gives one row. Hits without metadata are kept on request: what was found is
    joined to the stored hits, which are few, once more.
    """
    wanted = meta.select("uid", *[F.col(c).alias(f"_meta_{c}") for c in columns])
    few = broadcast_if_small(hits)
    joined = wanted.join(few, "uid")
    if keep_unmatched:
        # Hits can lack any value, so whole rows are compared, nulls as equal.
        none = [F.lit(None).cast(meta.schema[c].dataType).alias(f"_meta_{c}") for c in columns]
        joined = joined.select(*hits.columns, F.lit(0).alias("_missed"), *wanted.columns[1:]).unionAll(
            few.select(*hits.columns, F.lit(1).alias("_missed"), *none)
        )
        best = F.min(F.struct("_missed", *[f"_meta_{c}" for c in columns])).alias("_meta")
        found = joined.groupBy(*hits.columns).agg(best)
        return found.select(*hits.columns, *[F.col(f"_meta._meta_{c}").alias(c) for c in columns])
    found = joined.groupBy(*hits.columns).agg(F.min(F.struct(*[f"_meta_{c}" for c in columns])).alias("_meta"))
    return found.select(*hits.columns, *[F.col(f"_meta._meta_{c}").alias(c) for c in columns])


def attach_text(hits: DataFrame, chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """Give every hit the text of its passage; a hit without one has the empty text."""
    keyed = chunks.select(build_uid(F.col("id"), F.col("chunk_id")).alias("uid"), F.col(text).alias("text"))
    found = attach_metadata(hits, keyed, ["text"], keep_unmatched=True)
    return found.withColumn("text", F.coalesce("text", F.lit("")))


def complete_hits(hits: DataFrame) -> DataFrame:
    """The full result shape: missing columns are empty, text and source follow their preference."""
    have = hits.columns
    empty = F.lit("")
    values = {
        "id": F.coalesce(F.col("id").cast("string"), empty) if "id" in have else empty,
        "source": resolve_source(have),
        "title": F.coalesce(F.col("title").cast("string"), empty) if "title" in have else empty,
        "url": F.coalesce(F.col("url").cast("string"), empty) if "url" in have else empty,
        "text": pick_text(have),
        "chunk_id": F.col("chunk_id").cast("int") if "chunk_id" in have else F.lit(None).cast("int"),
    }
    return hits.select("qid", "rank", "score", "uid", *[v.alias(n) for n, v in values.items()])


def rag_context(hits: DataFrame, text: str = "text", separator: str = "\n\n") -> DataFrame:
    """The passages of every query joined in rank order; a query has at most k of them."""
    entries = F.sort_array(F.collect_list(F.struct("rank", F.coalesce(text, F.lit("")).alias("_text"))))
    grouped = hits.groupBy("qid").agg(entries.alias("_entries"))
    texts = F.transform("_entries", lambda e: e["_text"])
    return grouped.select("qid", F.size("_entries").alias("n_passages"), F.array_join(texts, separator).alias("context"))


def hit_log(hits: DataFrame, queries: DataFrame, iteration: int = 1) -> DataFrame:
    """Hits with their query text and the iteration they come from."""
    return hits.join(queries.select("qid", "query"), "qid").withColumn("iter", F.lit(iteration))

