"""Approximate search: only the buckets near a query are scored.

Corpus vectors carry a bucket number, at rest best as a partition column. A query looks into a few
buckets; scoring inside them is the same block product as in the exact search, so a bucket that
holds a third of the corpus is read by many tasks and merged like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passel.functions.vectors import normalize_vector
from passel.operators.search import SearchOptions, prefiltered, register_strategy
from passel.operators.topk import (
    QueryBlock,
    Scoring,
    block_join_topk,
    broadcast_topk,
    collect_queries,
    list_matrix,
    merge_local,
    rounded,
    unit_rows,
)

MAX_CELLS = 65_536
MAX_CENTROID_BYTES = 64 << 20
DEFAULT_CELLS = 16
DEFAULT_NPROBE = 4
DEFAULT_TABLES = 8
DEFAULT_ROUNDS = 5
# Scores of vectors against cells that a task holds at once.
_CELL_SCORES = 1 << 22
# Projections are compared after rounding to this many decimals.
_HASH_DECIMALS = 9
# One table's hash values stay within this distance of each other in the bucket numbers.
_TABLE_STRIDE = 1 << 40


def mean_vectors(df: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """The unit-length mean vector of every group, as ``(key, embedding)``.

    The sums are built per task before the shuffle, whatever share of the rows a group has.
    """
    vector = array_to_vector(F.col(embedding).cast("array<double>"))
    means = df.groupBy(key).agg(Summarizer.mean(vector).alias("_mean"))
    return means.select(key, normalize_vector(vector_to_array("_mean")).alias(embedding))


def train_cells(
    corpus: DataFrame,
    n_cells: int = DEFAULT_CELLS,
    seed: int = 42,
    rounds: int = DEFAULT_ROUNDS,
    training_rows: int | None = None,
    embedding: str = "embedding",
    uid: str = "uid",
) -> np.ndarray:
    """Cell centres by spherical k-means over all vectors: ``rounds`` times every vector goes to its closest centre, and
    every centre becomes the mean of its vectors. A centre without vectors stays.

    The first centres are the vectors of the ``n_cells`` uids of smallest seeded hash, so the same corpus gives the
    same cells however it is stored. Vectors without direction teach nothing about the cells. ``training_rows``
    trains on that many uids of smallest hash instead of all, if a caller asks for it.
    """
    _check_cells(n_cells, 1)
    usable = F.exists(embedding, lambda x: x != 0) & F.forall(embedding, lambda x: F.abs(x) < float("inf"))
    order = F.sha1(F.concat_ws(":", F.col(uid).cast("string"), F.lit(str(seed))))
    points = corpus.where(F.col(uid).isNotNull() & F.coalesce(usable, F.lit(False)))
    points = points.select(order.alias("_order"), F.col(embedding).cast("array<double>").alias("embedding"))
    if training_rows is not None:
        points = points.orderBy("_order").limit(training_rows)
    # As many rows as cells.
    first = points.orderBy("_order", "embedding").limit(n_cells).select("embedding").collect()
    if not first:
        raise ValueError("no vector to train on")
    centres = unit_rows(np.array([r.embedding for r in first]))
    for _ in range(rounds):
        means = mean_vectors(assign_cells(points, centres), "cell").collect()
        for row in means:
            centres[row.cell] = row.embedding
    return centres


def collect_centroids(centroids: DataFrame, cell: str, embedding: str = "embedding") -> np.ndarray:
    """A table of at most ``MAX_CELLS`` centres as a matrix, ordered by cell number from 0."""
    rows = centroids.select(cell, embedding).limit(MAX_CELLS + 1).collect()
    _check_cells(len(rows), len(rows[0][1]) if rows else 1)
    ordered = sorted(rows, key=lambda r: r[0])
    if [r[0] for r in ordered] != list(range(len(ordered))):
        raise ValueError("cells must be numbered from 0 without gaps")
    return np.array([r[1] for r in ordered], dtype=np.float64)


def _check_cells(n_cells: int, dim: int) -> None:
    if not 1 <= n_cells <= MAX_CELLS or n_cells * dim * 8 > MAX_CENTROID_BYTES:
        raise ValueError(f"{n_cells} cells of dimension {dim} are beyond what is broadcast")


def _nearest(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` closest cells of every vector by cosine, closest first, lower number on ties.

    Rows are taken in blocks, so that the scores of a batch stay within ``_CELL_SCORES`` numbers.
    """
    units, step = unit_rows(centroids).T, max(1, _CELL_SCORES // max(1, len(centroids)))
    out = np.empty((len(vectors), min(n, len(centroids))), np.int64)
    for start in range(0, len(vectors), step):
        scores = rounded(unit_rows(vectors[start : start + step]) @ units, np.ones(1))
        if n == 1:
            out[start : start + step, 0] = scores.argmax(axis=1)
        else:
            out[start : start + step] = np.argsort(-scores, axis=1, kind="stable")[:, :n]
    return out


def nearest_cells(centroids: np.ndarray, n: int) -> Callable[[Column], Column]:
    """A column function giving the ``n`` closest cells of a vector as an array."""
    _check_cells(*centroids.shape)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def cells(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.list_(pa.int32()))
        found = _nearest(list_matrix(vectors, centroids.shape[1]), centroids, n).astype(np.int32)
        offsets = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))

    return cells


def assign_cells(
    corpus: DataFrame, centroids: np.ndarray, name: str = "cell", embedding: str = "embedding"
) -> DataFrame:
    """Give every vector the number of its closest cell; a narrow transformation."""
    with_vector = corpus.where(F.col(embedding).isNotNull())
    return with_vector.withColumn(name, F.get(nearest_cells(centroids, 1)(F.col(embedding)), F.lit(0)))


def _probe_block(block: QueryBlock, buckets: np.ndarray) -> QueryBlock:
    """Group query positions by the buckets they look into; ``buckets`` has one row per query."""
    asked: dict[int, list[int]] = {}
    for position, row in enumerate(buckets.tolist()):
        for bucket in row:
            asked.setdefault(bucket, []).append(position)
    probes = {bucket: np.unique(positions) for bucket, positions in asked.items()}
    return QueryBlock(block.qids, block.vectors, probes)


def search_cells(
    queries: DataFrame, corpus: DataFrame, centroids: np.ndarray, options: SearchOptions, nprobe: int, cell: str = "cell"
) -> DataFrame:
    """The best ``k`` passages in the ``nprobe`` closest cells of every query."""
    if nprobe < 1:
        raise ValueError("nprobe must be at least 1")
    nprobe = min(nprobe, len(centroids))
    scoring = Scoring(options.k, options.metric, options.dedup)
    block = collect_queries(queries, **options.limits())
    if block is not None:
        nearest = _nearest(block.vectors, centroids, nprobe) if len(block.qids) else np.zeros((0, nprobe), int)
        probed = _probe_block(block, nearest)
        # Only probed cells are read when the corpus is stored by cell.
        near = corpus.where(F.col(cell).isin([int(c) for c in probed.probes]))
        local = broadcast_topk(probed, near, scoring, options.carried(), cell)
    else:
        asked = queries.select(
            "qid", "embedding", F.explode(nearest_cells(centroids, nprobe)(F.col("embedding"))).alias("bucket")
        )
        local = block_join_topk(asked, corpus, scoring, options.carried(), cell)
    return merge_local(local, scoring, options.carried())


def ivf(queries: DataFrame, corpus: DataFrame, options: SearchOptions) -> DataFrame:
    """Strategy ``ivf``. Extra options: ``centroids`` (else trained), ``n_cells``, ``seed``, ``rounds``, ``nprobe``.

    A corpus that already has a ``cell`` column from the same centres is searched as it is.
    """
    centroids = options.extra.get("centroids")
    if centroids is None:
        chosen = {n: options.extra[n] for n in ("n_cells", "seed", "rounds") if n in options.extra}
        centroids = train_cells(corpus, **chosen)
        corpus = corpus.drop("cell")
    if "cell" not in corpus.columns:
        corpus = assign_cells(corpus, centroids)
    return search_cells(
        queries, prefiltered(corpus, options), centroids, options, options.extra.get("nprobe", DEFAULT_NPROBE)
    )


def hash_directions(dim: int, n_tables: int = DEFAULT_TABLES, seed: int = 42) -> np.ndarray:
    """One direction per hash table and component, in thousandths between -1 and 1, from the MD5 of their numbers.

    They depend on nothing but the seed, so queries and corpora hashed apart have the same buckets.
    """

    def part(t: int, i: int) -> float:
        digits = hashlib.md5(f"{seed}:{t}:{i}".encode()).hexdigest()[:8]
        return (int(digits, 16) % 2001 - 1000) / 1000

    return np.array([[part(t, i) for i in range(dim)] for t in range(n_tables)]).reshape(n_tables, dim)


def _bucket_numbers(vectors: np.ndarray, directions: np.ndarray, bucket_length: float) -> np.ndarray:
    """The bucket of every vector in every table; table numbers are part of it. Rounding makes the sums repeatable."""
    places = np.floor(np.round(vectors @ directions.T, _HASH_DECIMALS) / bucket_length)
    usable = np.where(np.abs(places) < _TABLE_STRIDE // 2, places, 0).astype(np.int64)
    return np.arange(len(directions), dtype=np.int64) * _TABLE_STRIDE + usable


def hash_buckets(directions: np.ndarray, bucket_length: float) -> Callable[[Column], Column]:
    """A column function giving the buckets of a vector, one per table, as an array."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def buckets(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.list_(pa.int64()))
        found = _bucket_numbers(np.nan_to_num(list_matrix(vectors, directions.shape[1])), directions, bucket_length)
        offsets = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))

    return buckets


def lsh(queries: DataFrame, corpus: DataFrame, options: SearchOptions) -> DataFrame:
    """Strategy ``lsh``. Extra options: ``n_tables``, ``bucket_length``, ``seed``.

    A passage is a candidate when it shares a bucket with the query in at least one table. Every vector travels
    once, with the buckets of its that some query probes; it is scored once for each query that it meets.
    """
    n_tables, length = options.extra.get("n_tables", DEFAULT_TABLES), options.extra.get("bucket_length", 0.5)
    scoring = Scoring(options.k, options.metric, distinct_uids=True)
    carry = options.carried()
    block = collect_queries(queries, **options.limits())
    if block is not None and not len(block.qids):
        return merge_local(broadcast_topk(block, prefiltered(corpus, options), scoring, carry), scoring, carry)
    dim = block.vectors.shape[1] if block is not None else queries.select(F.size("embedding")).first()[0]
    directions = hash_directions(dim, n_tables, options.extra.get("seed", 42))
    hashed = hash_buckets(directions, length)
    near = prefiltered(corpus, options).select("uid", "embedding", *carry).where("embedding is not null")
    near = near.withColumn("_buckets", hashed(F.col("embedding")))
    if block is None:
        filed = near.withColumn("bucket", F.explode("_buckets")).drop("_buckets")
        asked = queries.select("qid", "embedding", F.explode(hashed(F.col("embedding"))).alias("bucket"))
        return merge_local(block_join_topk(asked, filed, scoring, carry, "bucket"), scoring, carry)
    probed = _bucket_numbers(block.vectors, directions, length)
    shared = block.with_buckets(probed)
    return merge_local(broadcast_topk(shared, near, scoring, carry, "_buckets"), scoring, carry)


register_strategy("ivf", ivf, ["centroids", "n_cells", "seed", "rounds", "nprobe"])
register_strategy("lsh", lsh, ["n_tables", "bucket_length", "seed"])
