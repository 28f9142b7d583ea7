"""What the two vector searches share: usable vectors, parts of bounded size, blocks of queries, and the merge."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Vectors of one local index, and queries that search it together.
PART_ROWS = 8192
BLOCK_QUERIES = 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``vector`` as doubles of the rows that have an id and only finite components."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("vec_id is not null and vector is not null").where(finite)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors of a list column as rows, short ones filled up with zeros."""
    lists = column.combine_chunks()
    lengths, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    out = np.zeros((len(lengths), width), values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def search_parts(
    vectors: DataFrame, queries: DataFrame, find: Callable[..., tuple], score_type: str, k: int, part_rows: int = PART_ROWS
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` best vectors of each query, ties to smaller ids.

    ``find(ids, matrix, query_ids, query_matrix)`` gives the query ids, vector ids and scores of the best of
    one part. Parts are chosen by the hash of a row's place in the table, so copies of one row spread too; a part is
    searched by one block of queries at a time, so that no task holds more than about ``part_rows`` vectors and
    ``BLOCK_QUERIES`` queries. No pair of a query and a vector is a row: every part gives up to ``k`` for each query.
    """
    n, width = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    parts, blocks = -(-n // part_rows) or 1, -(-queries.count() // BLOCK_QUERIES) or 1
    width = width or 0

    def one_of(value: Column, count: int) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(count)).cast("int")

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    corpus = vectors.select("*", one_of(F.monotonically_increasing_id(), parts).alias("part"), each(blocks).alias("block"))
    asked = queries.select("*", one_of(F.col("vec_id"), blocks).alias("block"), each(parts).alias("part"))

    def local(own: pa.Table, ask: pa.Table) -> pa.Table:
        if not len(own) or not len(ask):
            found = (np.empty(0, np.int64),) * 3
        else:
            found = find(
                own.column("vec_id").to_numpy(),
                matrix(own.column("vector"), width),
                ask.column("vec_id").to_numpy(),
                matrix(ask.column("vector"), width),
            )
        kind = pa.int64() if score_type == "long" else pa.float64()
        columns = [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2]).cast(kind)]
        return pa.Table.from_arrays(columns, ["query_id", "vec_id", "score"])

    best = corpus.groupBy("part", "block").cogroup(asked.groupBy("part", "block"))
    best = best.applyInArrow(local, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def one_row_each(queries: DataFrame) -> DataFrame:
    """Query vectors by id; of several under one id the smallest counts."""
    return queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
