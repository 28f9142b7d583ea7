"""Exact top-k by similarity: block products inside the tasks, then one small merge.

Every task multiplies its Arrow batches of corpus vectors with the query matrix and keeps the k
best rows per query, so no pair of query and passage is ever written out. What is shuffled is at
most ``tasks x queries x k`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passel.functions.vectors import NORM_FLOOR, canonical_metric
from passel.session import broadcast_if_small, materialise, merge_salts

# A query set is broadcast up to these sizes and joined block by block beyond them.
BROADCAST_QUERIES = 20_000
BROADCAST_BYTES = 64 << 20
# Rows of one cell of the block join.
CORPUS_BLOCK = 50_000
QUERY_BLOCK = 16_000

# Scores are compared after rounding to this many bits of the product of the two lengths. A product
# depends in its last digits on where a row stands in a block; without rounding, equal vectors
# could rank differently from run to run.
SCORE_BITS = 40

# Single precision is used up to this length, and its error is at least this large.
_SINGLE_SAFE = 1e15
_SINGLE_TINY = 1e-36
_CELLS_PER_PRODUCT = 1 << 20
_COMPACT_FROM = 20_000
_OUTPUT_ROWS = 10_000


@dataclass(frozen=True)
class Scoring:
    """What a task keeps: the measure, how many rows, and within which groups."""

    k: int
    metric: str = "ip"
    distinct_uids: bool = True
    per_bucket: bool = False

    def __post_init__(self) -> None:
        if self.k < 1:
            raise ValueError("k must be positive")
        object.__setattr__(self, "metric", canonical_metric(self.metric))


@dataclass
class QueryBlock:
    """Query vectors in memory. ``probes`` names the queries that look into a bucket; absent, all do.

    ``hashes`` has the buckets of every query; a row with several buckets then meets the queries
    that share one of them.
    """

    qids: np.ndarray
    vectors: np.ndarray
    probes: dict[int, np.ndarray] | None = None
    hashes: np.ndarray | None = None
    everyone: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.everyone = np.arange(len(self.qids))

    def with_buckets(self, hashes: np.ndarray) -> QueryBlock:
        return QueryBlock(self.qids, self.vectors, None, hashes)

    def probing(self, bucket: int) -> np.ndarray:
        return self.everyone if self.probes is None else self.probes.get(bucket, self.everyone[:0])


def list_matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a double matrix."""
    if column.null_count:
        raise ValueError("a vector is missing")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    width = dim if dim is not None else (int(lengths[0]) if len(lengths) else 0)
    if len(lengths) and (lengths != width).any():
        raise ValueError(f"vectors of dimension {sorted(set(lengths.tolist()))} where {width} is expected")
    return flat.reshape(len(column), width)


def row_lengths(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix * matrix).sum(axis=1))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(row_lengths(matrix)[:, None], NORM_FLOOR)


def score_matrix(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Unrounded ip or l2 scores of all queries against a block; l2 is the negated square."""
    scores = queries @ vectors.T
    if metric == "l2":
        squares = (queries * queries).sum(axis=1)[:, None] + (vectors * vectors).sum(axis=1)[None, :]
        scores = -np.maximum(squares - 2 * scores, 0)
    return scores


def score_size(query_lengths: np.ndarray, vector_lengths: np.ndarray, metric: str) -> np.ndarray:
    """The magnitude a score can have, which its rounding errors are proportional to."""
    return query_lengths * vector_lengths if metric == "ip" else (query_lengths + vector_lengths) ** 2


def rounded(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Scores as they are compared and reported; those that are not numbers rank nowhere."""
    step = np.ldexp(1.0, np.frexp(sizes)[1] - SCORE_BITS)
    return np.where(np.isfinite(scores), np.rint(scores / step) * step + 0.0, -np.inf)


def _uid_ranks(uids: pa.Array) -> np.ndarray:
    """The place of every uid in sorted order; equal uids share one."""
    encoded = uids.dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    ranks = np.empty(len(encoded.dictionary), dtype=np.int64)
    ranks[pc.sort_indices(encoded.dictionary).to_numpy()] = np.arange(len(ranks))
    return ranks[encoded.indices.to_numpy()]


def _best_per_group(
    group: np.ndarray, score: np.ndarray, uid_rank: np.ndarray, k: int, distinct: bool
) -> np.ndarray:
    """Positions of the k best entries of every group by (score desc, uid asc), in that order."""
    order = np.lexsort((uid_rank, -score, group))
    if distinct:
        key = group[order] * (int(uid_rank.max(initial=0)) + 1) + uid_rank[order]
        order = order[np.sort(np.unique(key, return_index=True)[1])]
    sorted_group = group[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_group, sorted_group, side="left")
    return order[place < k]


def _floor_of_block(scores: np.ndarray, uid_rank: np.ndarray, k: int, distinct: bool) -> np.ndarray:
    """Per query the k-th best score of a block, over distinct uids where asked for."""
    if distinct:
        by_uid = np.argsort(uid_rank, kind="stable")
        starts = np.flatnonzero(np.diff(uid_rank[by_uid], prepend=-1))
        if len(starts) < len(uid_rank):
            scores = np.maximum.reduceat(scores[:, by_uid], starts, axis=1)
    n = scores.shape[1]
    if n <= k:
        return np.full(scores.shape[0], -np.inf)
    return np.partition(scores, n - k, axis=1)[:, n - k]


def _worst_of_full_groups(group: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups that have all their k rows, and the last score of each; the input is in order."""
    last = np.flatnonzero(np.diff(group, append=-1))
    full = last[np.diff(last, prepend=-1) == k]
    return group[full], score[full]


class TaskWinners:
    """The best rows a task has seen, per query or per query and bucket."""

    def __init__(self, queries: QueryBlock, scoring: Scoring) -> None:
        self.queries = queries
        self.scoring = scoring
        # The cosine is the inner product of unit vectors.
        self.cosine = scoring.metric == "cosine"
        self.metric = "l2" if scoring.metric == "l2" else "ip"
        self.vectors = unit_rows(queries.vectors) if self.cosine else queries.vectors
        self.single = self.vectors.astype(np.float32)
        self.lengths = row_lengths(self.vectors)
        self.buckets: dict[int, int] = {}
        self.floors: dict[int, np.ndarray] = {}
        self.tables: list[pa.Table] = []
        self.pending = 0
        self.compacted = 0

    def add(self, uids: pa.Array, vectors: np.ndarray, buckets: np.ndarray | None, carried: pa.Table) -> None:
        # A row whose length is no number cannot be scored; it must not spoil the bounds of the others.
        usable = np.isfinite(row_lengths(vectors))
        if not usable.all():
            rows = pa.array(np.flatnonzero(usable))
            uids, carried, vectors = uids.take(rows), carried.take(rows), vectors[usable]
            buckets = None if buckets is None else buckets[usable]
        if self.cosine:
            vectors = unit_rows(vectors)
        if buckets is None:
            self._add_bucket(0, self.queries.everyone, np.arange(len(uids)), uids, vectors, carried)
            return
        if self.queries.hashes is not None:
            near = np.flatnonzero(np.isin(buckets, self.queries.hashes).any(axis=1))
            self._add_bucket(0, self.queries.everyone, near, uids, vectors, carried, buckets)
            return
        for bucket in np.unique(buckets).tolist():
            asking = self.queries.probing(bucket)
            if len(asking):
                self._add_bucket(bucket, asking, np.flatnonzero(buckets == bucket), uids, vectors, carried)

    def _add_bucket(
        self,
        bucket: int,
        asking: np.ndarray,
        rows: np.ndarray,
        uids: pa.Array,
        vectors: np.ndarray,
        carried: pa.Table,
        hashes: np.ndarray | None = None,
    ) -> None:
        if not len(rows):
            return
        scoring, width = self.scoring, len(self.queries.qids)
        slot = self.buckets.setdefault(bucket if scoring.per_bucket else 0, len(self.buckets))
        floors = self.floors.setdefault(slot, np.full(width, -np.inf))
        block = vectors if len(rows) == len(uids) else vectors[rows]
        own = row_lengths(block)
        # Rows are screened in single precision against the floors less the possible error; once
        # the floors have risen, few are left to be scored in double precision.
        longest = float(own.max())
        safe = longest < _SINGLE_SAFE and self.lengths.max(initial=0.0) < _SINGLE_SAFE
        queries, screened = (self.single, block.astype(np.float32)) if safe else (self.vectors, block)
        error = 4.0 * (block.shape[1] + 4) * np.finfo(np.float32).eps if safe else 4.0 * 2.0**-SCORE_BITS
        margin = error * score_size(self.lengths, longest, self.metric) + _SINGLE_TINY
        step = max(1, _CELLS_PER_PRODUCT // len(rows))
        for start in range(0, len(asking), step):
            some = asking[start : start + step]
            raw = score_matrix(queries[some], screened, self.metric)
            reach = (floors[some] - margin[some]).astype(raw.dtype)
            near = np.flatnonzero((raw >= reach[:, None]).any(axis=0))
            if not len(near):
                continue
            sizes = score_size(self.lengths[some][:, None], own[near][None, :], self.metric)
            scores = rounded(score_matrix(self.vectors[some], block[near], self.metric), sizes)
            if hashes is not None:
                meets = (self.queries.hashes[some][:, None, :] == hashes[rows[near]][None, :, :]).any(axis=2)
                scores = np.where(meets, scores, -np.inf)
            uid_rank = _uid_ranks(uids.take(pa.array(rows[near])))
            floor = np.maximum(floors[some], _floor_of_block(scores, uid_rank, scoring.k, scoring.distinct_uids))
            q, v = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
            if not len(q):
                continue
            best = _best_per_group(q, scores[q, v], uid_rank[v], scoring.k, scoring.distinct_uids)
            q, v = q[best], v[best]
            full, worst = _worst_of_full_groups(q, scores[q, v], scoring.k)
            floors[some[full]] = np.maximum(floors[some[full]], worst)
            self._append(slot * width + some[q], scores[q, v], uids, rows[near[v]], carried)

    def _append(
        self, group: np.ndarray, score: np.ndarray, uids: pa.Array, rows: np.ndarray, carried: pa.Table
    ) -> None:
        taken = pa.array(rows)
        table = carried.take(taken)
        table = table.append_column("uid", uids.take(taken).cast(pa.string()))
        table = table.append_column("score", pa.array(score)).append_column("_group", pa.array(group.astype(np.int64)))
        self.tables.append(table)
        self.pending += len(rows)
        if self.pending > max(_COMPACT_FROM, 3 * self.compacted):
            self.compact()

    def compact(self) -> None:
        """Trim to k rows per group and raise the scores that new rows have to reach."""
        if not self.tables:
            return
        table = pa.concat_tables(self.tables)
        group, score = table["_group"].to_numpy(), table["score"].to_numpy()
        best = _best_per_group(
            group, score, _uid_ranks(table["uid"]), self.scoring.k, self.scoring.distinct_uids
        )
        self.tables = [table.take(pa.array(best)).combine_chunks()]
        self.compacted = self.pending = len(best)
        full, worst = _worst_of_full_groups(group[best], score[best], self.scoring.k)
        width = len(self.queries.qids)
        for g, floor in zip(full.tolist(), worst.tolist()):
            floors = self.floors[g // width]
            floors[g % width] = max(floors[g % width], floor)

    def result(self, names: Sequence[str]) -> pa.Table | None:
        """The winners with the named columns, or None when there are none."""
        self.compact()
        if not self.tables:
            return None
        table = self.tables[0]
        group, width = table["_group"].to_numpy(), len(self.queries.qids)
        values: dict[str, pa.Array | pa.ChunkedArray] = {name: table[name] for name in table.column_names}
        values["qid"] = pa.array(self.queries.qids[group % width])
        if self.scoring.per_bucket:
            numbers = np.array(list(self.buckets), dtype=np.int64)
            values["bucket"] = pa.array(numbers[group // width])
        return pa.table([values[name] for name in names], names=list(names))


def _feed(winners: TaskWinners, batch: pa.RecordBatch, carry: Sequence[str], bucketed: bool) -> None:
    dim = winners.queries.vectors.shape[1]
    buckets = None
    if bucketed and winners.queries.hashes is not None:
        buckets = batch.column("bucket").flatten().to_numpy().reshape(batch.num_rows, -1)
    elif bucketed:
        buckets = batch.column("bucket").to_numpy(zero_copy_only=False)
    uids = batch.column("uid")
    carried = pa.table({"_row": pa.array(np.arange(batch.num_rows))} | {c: batch.column(c) for c in carry})
    winners.add(uids, list_matrix(batch.column("embedding"), dim), buckets, carried)


def collect_queries(queries: DataFrame, max_rows: int, max_bytes: int) -> QueryBlock | None:
    """The query vectors on the driver if they are within both bounds, else None.

    At most ``max_rows + 1`` rows are fetched, whatever the size of the query set.
    """
    fetched = queries.select("qid", "embedding").limit(max_rows + 1).toArrow()
    if fetched.num_rows > max_rows or fetched.nbytes > max_bytes:
        return None
    vectors = fetched["embedding"].combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.chunk(0) if vectors.num_chunks else pa.array([], pa.list_(pa.float32()))
    return QueryBlock(fetched["qid"].to_numpy().astype(np.int64), list_matrix(vectors))


def _output_schema(corpus: DataFrame, carry: Sequence[str], per_bucket: bool) -> T.StructType:
    fields = [T.StructField("qid", T.LongType())]
    fields += [T.StructField("bucket", T.LongType())] if per_bucket else []
    fields += [T.StructField("score", T.DoubleType()), T.StructField("uid", T.StringType())]
    return T.StructType(fields + [T.StructField(c, corpus.schema[c].dataType) for c in carry])


def _corpus_columns(corpus: DataFrame, carry: Sequence[str], bucket: str | None) -> DataFrame:
    """Only what the product needs travels to Python; rows without a vector cannot be found."""
    several = bucket is not None and isinstance(corpus.schema[bucket].dataType, T.ArrayType)
    kind = "array<bigint>" if several else "bigint"
    extra = [] if bucket is None else [F.col(bucket).cast(kind).alias("bucket")]
    chosen = corpus.select(F.col("uid").cast("string").alias("uid"), "embedding", *extra, *carry)
    return chosen.where(F.col("uid").isNotNull() & F.col("embedding").isNotNull())


def broadcast_topk(
    block: QueryBlock, corpus: DataFrame, scoring: Scoring, carry: Sequence[str] = (), bucket: str | None = None
) -> DataFrame:
    """Per-task winners with the whole query block in every task; the corpus is not shuffled."""
    schema = _output_schema(corpus, carry, scoring.per_bucket)
    names = schema.names
    shared = corpus.sparkSession.sparkContext.broadcast((block.qids, block.vectors, block.probes, block.hashes))
    carried = list(carry)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winners = TaskWinners(QueryBlock(*shared.value), scoring)
        for batch in batches:
            if batch.num_rows:
                _feed(winners, batch, carried, bucket is not None)
        found = winners.result(names)
        if found is not None:
            yield from found.to_batches(max_chunksize=_OUTPUT_ROWS)

    read = _corpus_columns(corpus, carry, bucket)
    if len(block.qids) == 0:
        read = read.where(F.lit(False))
    return read.mapInArrow(task, schema)


def block_join_topk(
    queries: DataFrame,
    corpus: DataFrame,
    scoring: Scoring,
    carry: Sequence[str] = (),
    bucket: str | None = None,
    corpus_block: int = CORPUS_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Winners per cell for query sets of any size.

    Corpus and queries are cut into blocks of bounded length; one task multiplies one corpus block
    with one query block. Queries with a ``bucket`` column meet that bucket only, and the blocks are
    cut inside the buckets; a bucket with a third of the corpus simply has more of them. Block
    numbers come from a hash of the stored place of the rows, so copies of one passage spread too,
    and a recomputed task sees the same blocks.
    """
    schema = _output_schema(corpus, carry, scoring.per_bucket)
    names = schema.names
    probing = "bucket" in queries.columns
    everywhere = F.lit(0).cast("bigint")
    left = _corpus_columns(corpus, carry, bucket).withColumn("_part", F.col("bucket") if probing else everywhere)
    left = materialise(left.withColumn("_place", F.xxhash64(F.monotonically_increasing_id())))
    part = F.col("bucket").cast("bigint") if probing else everywhere
    right = queries.select("qid", F.col("embedding").alias("_vector"), part.alias("_part"))
    right = materialise(right.withColumn("_place", F.xxhash64(F.monotonically_increasing_id())))
    grid = broadcast_if_small(
        left.groupBy("_part")
        .agg(F.ceil(F.count("*") / corpus_block).alias("_corpus_blocks"))
        .join(right.groupBy("_part").agg(F.ceil(F.count("*") / query_block).alias("_query_blocks")), "_part")
    )
    key = ["_part", "_c", "_q"]
    bucketed = bucket is not None
    corpus_cells = (
        left.join(grid, "_part")
        .withColumn("_c", F.pmod("_place", "_corpus_blocks"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_query_blocks") - 1)))
        .select("uid", "embedding", *carry, *(["bucket"] if bucketed else []), *key)
    )
    query_cells = (
        right.join(grid, "_part")
        .withColumn("_q", F.pmod("_place", "_query_blocks"))
        .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_corpus_blocks") - 1)))
        .select("qid", "_vector", *key)
    )
    carried = list(carry)

    def cell(passages: pa.Table, asked: pa.Table) -> pa.Table:
        columns = {n: passages.schema.empty_table()[n] for n in passages.column_names}
        columns |= {"qid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        empty = pa.table([columns[n] for n in names], names=names)
        if not passages.num_rows or not asked.num_rows:
            return empty
        vectors = list_matrix(pa.concat_arrays(asked["_vector"].chunks))
        winners = TaskWinners(QueryBlock(asked["qid"].to_numpy().astype(np.int64), vectors), scoring)
        for batch in passages.to_batches(max_chunksize=_OUTPUT_ROWS):
            _feed(winners, batch, carried, bucketed)
        found = winners.result(names)
        return empty if found is None else found

    return corpus_cells.groupBy(*key).cogroup(query_cells.groupBy(*key)).applyInArrow(cell, schema)


def keep_best_per_uid(hits: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """The best-scoring row of every uid; an aggregation, so copies collapse before the shuffle."""
    if not carry:
        return hits.groupBy(*keys, "uid").agg(F.max("score").alias("score")).select(*keys, "score", "uid")
    best = F.max(F.struct("score", *carry)).alias("_best")
    grouped = hits.groupBy(*keys, "uid").agg(best)
    return grouped.select(*keys, "_best.score", "uid", *[f"_best.{c}" for c in carry])


def rank_hits(hits: DataFrame, k: int | None, keys: Sequence[str] = ("qid",), rank: str = "rank") -> DataFrame:
    """Rank by (score desc, uid asc) inside the keys and keep ``k``.

    On a wide cluster the rows are first cut to ``k`` in sub-groups by the task they come from, so
    that neither a query nor a uid with very many candidates meets in one task.
    """
    order = [F.desc("score"), F.asc("uid")]
    salts = merge_salts(hits.sparkSession)
    if k is not None and salts > 1:
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        hits = (
            hits.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
            .withColumn("_cut", F.row_number().over(part))
            .where(F.col("_cut") <= k)
            .drop("_salt", "_cut")
        )
    ranked = hits.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def topk(
    queries: DataFrame,
    corpus: DataFrame,
    scoring: Scoring,
    carry: Sequence[str] = (),
    bucket: str | None = None,
    max_rows: int = BROADCAST_QUERIES,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The ``k`` best passages of every query, or of every query and bucket, ranked.

    ``queries`` has ``qid`` and ``embedding`` with one row per query; ``corpus`` has ``uid`` and
    ``embedding``. With ``per_bucket`` the bucket column comes back under its own name.
    """
    block = collect_queries(queries, max_rows, max_bytes)
    if block is not None:
        local = broadcast_topk(block, corpus, scoring, carry, bucket)
    else:
        local = block_join_topk(queries.select("qid", "embedding"), corpus, scoring, carry, bucket)
    return merge_local(local, scoring, carry, bucket)


def merge_local(local: DataFrame, scoring: Scoring, carry: Sequence[str], bucket: str | None = None) -> DataFrame:
    """Bring the per-task winners together."""
    keys = ["qid", "bucket"] if scoring.per_bucket else ["qid"]
    if scoring.distinct_uids:
        local = keep_best_per_uid(local, keys, carry)
    ranked = rank_hits(local, scoring.k, keys)
    return ranked.withColumnRenamed("bucket", bucket) if scoring.per_bucket and bucket else ranked
