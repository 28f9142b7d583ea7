"""Cells with known extents: exact search that leaves far cells unread, and the number of cells a recall needs.

A cell's extent is how far its vectors lie from its centre at most and at least. With the triangle inequality it says
how good the best of them can be for a query, before any of them is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passel.functions.vectors import canonical_metric
from passel.operators.ann import MAX_CELLS, _nearest, assign_cells, nearest_cells
from passel.operators.search import SearchOptions, exact, prefiltered, register_strategy
from passel.operators.topk import (
    QueryBlock,
    Scoring,
    block_join_topk,
    broadcast_topk,
    collect_queries,
    list_matrix,
    merge_local,
    row_lengths,
    score_matrix,
    score_size,
    unit_rows,
)
from passel.session import materialise

# Bounds are widened by this share of the size of a score, far above the rounding of scores.
_SLACK = 2.0**-30
# Cells searched first hold this many times k rows, so that repeated uids leave k different ones.
_HOME_ROWS = 4
# A calibration searches this many queries exactly, whatever the corpus.
CALIBRATION_QUERIES = 256
EXTENT = "cell int, embedding array<double>, middle array<double>, n bigint, outer_radius double, inner_radius double, unit_radius double"
PLACE = "struct<cell:int,middle_distance:double,unit_distance:double>"
_PLACE_TYPE = pa.struct([("cell", pa.int32()), ("middle_distance", pa.float64()), ("unit_distance", pa.float64())])


@dataclass(frozen=True)
class Cells:
    """One row a cell: the centre that decides who belongs to it, the mean of its vectors and its extents."""

    centers: np.ndarray
    middles: np.ndarray
    rows: np.ndarray
    outer: np.ndarray
    inner: np.ndarray
    unit: np.ndarray

    def best_scores(self, queries: np.ndarray, metric: str) -> np.ndarray:
        """What the best vector of each cell can score for each query; a cell without vectors scores nothing.

        l2: no vector is nearer than the mean's distance less the outer radius, or the inner radius less that
        distance. ip: a vector at most the outer radius from the mean adds at most that times the query's length.
        cosine: the same for directions, around the centre.
        """
        metric = canonical_metric(metric)
        if metric == "cosine":
            queries = unit_rows(queries)
        lengths, outer = row_lengths(queries)[:, None], self.unit if metric == "cosine" else self.outer
        middles = self.centers if metric == "cosine" else self.middles
        if metric == "l2":
            distance = np.sqrt(np.maximum(-score_matrix(queries, middles, "l2"), 0))
            gap = np.maximum(np.maximum(distance - outer, self.inner - distance), 0)
            best = -(gap * gap)
        else:
            best = score_matrix(queries, middles, "ip") + lengths * outer
        size = score_size(lengths, (row_lengths(middles) + outer)[None, :], "l2" if metric == "l2" else "ip")
        return np.where(self.rows > 0, best + _SLACK * size, -np.inf)

    def home(self, best: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the most promising cells that hold ``_HOME_ROWS * k`` rows together."""
        order = np.argsort(-best, axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        need = (held < _HOME_ROWS * k).sum(axis=1) + 1
        return [row[:n] for row, n in zip(order, need)]


def cell_middles(corpus: DataFrame, centers: np.ndarray, embedding: str = "embedding") -> np.ndarray:
    """The mean vector of every cell, summed before the shuffle; the centre where a cell has none that holds numbers."""
    real = F.forall(embedding, lambda x: F.abs(x.cast("double")) < float("inf"))
    vector = array_to_vector(F.col(embedding).cast("array<double>"))
    means = assign_cells(corpus.where(real), centers, embedding=embedding).groupBy("cell").agg(Summarizer.mean(vector).alias("_mean"))
    middles = centers.copy()
    for row in means.select("cell", vector_to_array("_mean").alias("_mean")).collect():
        middles[row.cell] = row["_mean"]
    return middles


def place_in_cells(corpus: DataFrame, centers: np.ndarray, middles: np.ndarray, embedding: str = "embedding") -> DataFrame:
    """The corpus with ``cell``, the distance of a vector from the cell's mean and that of its direction from the centre.

    A vector that holds no numbers is in a cell and has no distance: no search finds it, so it must not widen the cell.
    """

    @F.arrow_udf(PLACE)
    def placed(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], _PLACE_TYPE)
        matrix = list_matrix(vectors, centers.shape[1])
        real = np.isfinite(row_lengths(matrix))
        matrix = np.where(real[:, None], matrix, 0.0)
        cell = _nearest(matrix, centers, 1)[:, 0]
        far, turned = row_lengths(matrix - middles[cell]), row_lengths(unit_rows(matrix) - centers[cell])
        columns = [pa.array(cell, pa.int32()), pa.array(far, mask=~real), pa.array(turned, mask=~real)]
        return pa.StructArray.from_arrays(columns, fields=list(_PLACE_TYPE))

    rows = corpus.where(F.col(embedding).isNotNull()).withColumn("_place", placed(F.col(embedding)))
    return rows.select(*[c for c in corpus.columns if c != "cell"], "_place.*")


def cell_extents(placed: DataFrame, centers: np.ndarray, middles: np.ndarray) -> DataFrame:
    """One row of ``EXTENT`` for each cell; from stored cells this reads three columns and no vector."""
    found = placed.groupBy("cell").agg(
        F.count("middle_distance").alias("n"),
        F.max("middle_distance").alias("outer_radius"),
        F.min("middle_distance").alias("inner_radius"),
        F.max("unit_distance").alias("unit_radius"),
    )
    rows = [(i, c.tolist(), m.tolist()) for i, (c, m) in enumerate(zip(centers, middles))]
    named = placed.sparkSession.createDataFrame(rows, "cell int, embedding array<double>, middle array<double>")
    return named.join(found, "cell", "left").select(
        "cell", "embedding", "middle", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "outer_radius", "inner_radius", "unit_radius")]
    )


def collect_cells(extents: DataFrame) -> Cells:
    """Extents of at most ``MAX_CELLS`` cells, numbered from 0, on the driver."""
    rows = sorted(extents.limit(MAX_CELLS + 1).collect(), key=lambda r: r.cell)
    if len(rows) > MAX_CELLS or [r.cell for r in rows] != list(range(len(rows))):
        raise ValueError("cells must be numbered from 0 without gaps, and no more than are broadcast")
    columns = [np.array([r[c] for r in rows], np.float64) for c in ("outer_radius", "inner_radius", "unit_radius")]
    vectors = [np.array([r[c] for r in rows], np.float64) for c in ("embedding", "middle")]
    return Cells(*vectors, np.array([r.n for r in rows], np.int64), *columns)


class Bounded(NamedTuple):
    """Hits of an exact search, and for each query the cells and rows that were scored for it."""

    hits: DataFrame
    asked: DataFrame


def _asked_cells(cells: Cells, metric: str, k: int):
    """Column function: the first cells of a query, or, given a floor, the other ones that can reach it."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def asked(vectors: pa.Array, floors: pa.Array, second: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.list_(pa.int32()))
        best = cells.best_scores(list_matrix(vectors, cells.centers.shape[1]), metric)
        home = cells.home(best, k)
        floor = np.array([-np.inf if f is None else f for f in floors.to_pylist()])
        out = []
        for row, first, least, again in zip(best, home, floor, second.to_pylist()):
            out.append((np.setdiff1d(np.flatnonzero((row >= least) & (row > -np.inf)), first) if again else first).tolist())
        return pa.array(out, pa.list_(pa.int32()))

    return asked


def bounded_search(queries: DataFrame, corpus: DataFrame, cells: Cells, options: SearchOptions) -> Bounded:
    """The exact ``k`` best passages, found in two rounds.

    The cells that promise most are searched first; the k-th hit is a floor. Then only cells are read whose best
    possible score reaches some query's floor, and in them only those queries are scored. With the corpus stored by
    cell both rounds prune by folder. The result is that of the exact search; a filter in ``options`` comes
    first, as cells keep their extents when rows go. Query sets beyond the broadcast bounds are joined cell by cell.
    """
    if options.source is not None and options.filter_stage != "pre":
        raise ValueError("cell bounds need the filter before the scoring")
    scoring = Scoring(options.k, options.metric, options.dedup)
    near, carry = prefiltered(corpus, options), options.carried()
    block = collect_queries(queries, **options.limits())
    names = ["qid", "score", "uid", *carry]
    if block is None:
        return _joined_search(queries, near, cells, options, scoring, names)
    best = cells.best_scores(block.vectors, options.metric) if len(block.qids) else np.zeros((0, len(cells.rows)))
    home = cells.home(best, options.k)

    def probe(buckets: list[np.ndarray]) -> DataFrame:
        asked: dict[int, list[int]] = {}
        for position, row in enumerate(buckets):
            for cell in row.tolist():
                asked.setdefault(cell, []).append(position)
        probes = {cell: np.array(positions) for cell, positions in asked.items()}
        probed = QueryBlock(block.qids, block.vectors, probes)
        return broadcast_topk(probed, near.where(F.col("cell").isin(list(probes))), scoring, carry, "cell")

    first = materialise(merge_local(probe(home), scoring, carry))
    # One number for each query of the broadcast block.
    floors = dict(first.where(F.col("rank") == options.k).select("qid", "score").collect())
    least = np.array([floors.get(int(q), -np.inf) for q in block.qids])
    others = [np.setdiff1d(np.flatnonzero((row >= f) & (row > -np.inf)), h) for row, f, h in zip(best, least, home)]
    second = probe(others)
    hits = merge_local(first.select(*names).unionByName(second.select(*names)), scoring, carry)
    counted = [
        (int(q), len(h) + len(o), int(cells.rows[h].sum() + cells.rows[o].sum())) for q, h, o in zip(block.qids, home, others)
    ]
    asked = queries.sparkSession.createDataFrame(counted, "qid long, n_cells long, n_rows long")
    return Bounded(hits, asked)


def _joined_search(
    queries: DataFrame, near: DataFrame, cells: Cells, options: SearchOptions, scoring: Scoring, names: list[str]
) -> Bounded:
    carry = options.carried()
    asked = _asked_cells(cells, options.metric, options.k)
    none = F.lit(None).cast("double")
    home = queries.select("qid", "embedding", asked(F.col("embedding"), none, F.lit(False)).alias("_cells"))
    first = materialise(merge_local(block_join_topk(home.select("qid", "embedding", F.explode("_cells").alias("bucket")), near, scoring, carry, "cell"), scoring, carry))
    floors = first.where(F.col("rank") == options.k).select("qid", F.col("score").alias("_floor"))
    floored = queries.select("qid", "embedding").join(floors, "qid", "left")
    others = floored.select("qid", "embedding", asked(F.col("embedding"), F.col("_floor"), F.lit(True)).alias("_cells"))
    second = block_join_topk(others.select("qid", "embedding", F.explode("_cells").alias("bucket")), near, scoring, carry, "cell")
    hits = merge_local(first.select(*names).unionByName(second.select(*names)), scoring, carry)
    rows = F.array(*[F.lit(int(n)).cast("bigint") for n in cells.rows])
    both = home.select("qid", "_cells").unionByName(others.select("qid", "_cells"))
    sizes = F.aggregate(F.transform("_cells", lambda c: F.get(rows, c)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    counted = both.groupBy("qid").agg(F.sum(F.size("_cells").cast("bigint")).alias("n_cells"), F.sum(sizes).alias("n_rows"))
    return Bounded(hits, counted)


def bounded(queries: DataFrame, corpus: DataFrame, options: SearchOptions) -> DataFrame:
    """Strategy ``bounded``: exact, over a corpus with a ``cell`` column. Extra option: ``cells``, its :class:`Cells`."""
    cells = options.extra.get("cells")
    if cells is None or "cell" not in corpus.columns:
        raise ValueError("strategy 'bounded' needs a corpus with cells and their extents")
    return bounded_search(queries, corpus, cells, options).hits


register_strategy("bounded", bounded, ["cells"])


def sample_queries(corpus: DataFrame, n: int = CALIBRATION_QUERIES, seed: int = 42) -> DataFrame:
    """The ``n`` vectors whose uids have the smallest seeded hash, as queries that also name their ``uid``."""
    order = F.sha1(F.concat_ws(":", F.col("uid").cast("string"), F.lit(f"q{seed}")))
    usable = F.forall("embedding", lambda x: F.abs(x) < float("inf")) & F.exists("embedding", lambda x: x != 0)
    first = corpus.where(F.col("uid").isNotNull() & usable).select("uid", "embedding", order.alias("_order"))
    chosen = first.orderBy("_order", "embedding").limit(n)
    return chosen.select((F.row_number().over(Window.orderBy("_order", "embedding")) - 1).cast("long").alias("qid"), "uid", "embedding")


def probe_curve(
    corpus: DataFrame, cells: Cells, queries: DataFrame, k: int, metric: str = "ip", max_queries: int = CALIBRATION_QUERIES
) -> DataFrame:
    """``nprobe, recall, share_read`` for every number of probed cells: the recall@k of the queries against the exact
    search and the mean share of the rows that is scored.

    ``queries`` are at most ``max_queries``; where they name a ``uid``, it is no hit of its own query. The exact hits
    carry their cells; a hit is found from the number of probes on that its cell has in the query's order.
    """
    bound = queries.limit(max_queries + 1).count()
    if bound > max_queries:
        raise ValueError(f"a calibration takes at most {max_queries} queries")
    named = "uid" in queries.columns
    found = exact(queries, corpus, SearchOptions(k=k + 1 if named else k, metric=metric, carry=("cell",)))
    if named:
        own = queries.select("qid", F.col("uid").alias("_own"))
        kept = found.join(F.broadcast(own), "qid").where("uid <> _own")
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= k)
    else:
        kept = found
    n = len(cells.rows)
    order = materialise(queries.select("qid", nearest_cells(cells.centers, n)(F.col("embedding")).alias("_order")))
    needed = kept.join(F.broadcast(order), "qid").select(F.array_position("_order", F.col("cell")).cast("int").alias("nprobe"))
    per_probe = needed.groupBy("nprobe").agg(F.count("*").alias("hits"))
    rows = F.array(*[F.lit(int(r)).cast("bigint") for r in cells.rows])
    read = order.select(F.posexplode("_order").alias("_at", "_cell")).groupBy((F.col("_at") + 1).alias("nprobe")).agg(F.sum(F.get(rows, F.col("_cell"))).alias("rows"))
    curve = read.join(per_probe, "nprobe", "left").na.fill(0, ["hits"])
    # One row for each cell.
    upto = Window.orderBy("nprobe").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("nprobe").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return curve.select(
        "nprobe",
        F.coalesce(F.try_divide(F.sum("hits").over(upto), F.sum("hits").over(whole)), F.lit(1.0)).alias("recall"),
        F.coalesce(F.try_divide(F.sum("rows").over(upto), F.sum("rows").over(whole)), F.lit(1.0)).alias("share_read"),
    )


def probes_for(curve: DataFrame, recalls: Sequence[float]) -> DataFrame:
    """For each asked recall the fewest probes that reach it: ``recall_asked, nprobe, recall, share_read``."""
    asked = curve.sparkSession.createDataFrame([(float(r),) for r in recalls], "recall_asked double")
    reaching = F.broadcast(asked).join(curve, F.col("recall") >= F.col("recall_asked"))
    first = F.min(F.struct("nprobe", "recall", "share_read")).alias("_first")
    return reaching.groupBy("recall_asked").agg(first).select("recall_asked", "_first.*")
