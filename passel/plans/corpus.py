"""Raw documents to a searchable corpus."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passel.functions.encode import hashing_encoder
from passel.functions.ids import build_uid
from passel.functions.text import normalize_label
from passel.operators.ann import DEFAULT_NPROBE, train_cells
from passel.operators.cells import (
    CALIBRATION_QUERIES,
    Bounded,
    Cells,
    bounded_search,
    cell_extents,
    cell_middles,
    collect_cells,
    place_in_cells,
    probe_curve,
    probes_for,
    sample_queries,
)
from passel.operators.chunk import chunk_documents
from passel.operators.corpus import assign_shards, merge_corpora
from passel.operators.documents import clean_documents
from passel.operators.hashing import DEFAULT_PROBES, HashTables, file_in_tables
from passel.operators.search import SearchOptions, search
from passel.sources.corpus import read_stage, write_shards, write_stage


def passages(raw: DataFrame, style: str = "encyclopedia", keep: list[str] | None = None) -> DataFrame:
    """Clean and cut raw documents; narrow from end to end."""
    return chunk_documents(clean_documents(raw, style), keep=keep)


def embed_passages(chunks: DataFrame, encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Give passages their ``uid``, normalised ``source`` and vector; the text stays behind."""
    encode = hashing_encoder() if encoder is None else encoder
    return chunks.select(
        build_uid(F.col("id"), F.col("chunk_id")).alias("uid"),
        *[c for c in chunks.columns if c != "chunk_text"],
        normalize_label(F.col("domain")).alias("source"),
        encode(F.col("chunk_text")).alias("embedding"),
    )


def build_corpus(
    collections: Sequence[tuple[DataFrame, str]],
    folder: str,
    n_shards: int = 8,
    encoder: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Run all stages and store each one below ``folder``; returns the stored sharded corpus.

    ``collections`` pairs raw documents with their cleaning style. Later jobs read the stages, so
    nothing is cleaned or encoded twice.
    """
    spark = collections[0][0].sparkSession
    write_stage(merge_corpora(*[passages(raw, style) for raw, style in collections]), f"{folder}/passages")
    vectors = embed_passages(read_stage(spark, f"{folder}/passages"), encoder)
    write_shards(assign_shards(vectors, n_shards), f"{folder}/corpus")
    return read_stage(spark, f"{folder}/corpus")


def store_by_cell(corpus: DataFrame, folder: str, **training) -> None:
    """Train cells on a corpus, give every vector its cell, and store centres with extents and the corpus by cell."""
    centers = train_cells(corpus, **training)
    middles = cell_middles(corpus, centers)
    write_stage(place_in_cells(corpus, centers, middles), f"{folder}/cells", ["cell"])
    stored = read_stage(corpus.sparkSession, f"{folder}/cells")
    write_stage(cell_extents(stored, centers, middles).coalesce(1), f"{folder}/centres")


def stored_cells(corpus: DataFrame, folder: str) -> tuple[DataFrame, Cells]:
    """The corpus that ``store_by_cell`` has stored and the extents of its cells; ``corpus`` lends its session."""
    spark = corpus.sparkSession
    return read_stage(spark, f"{folder}/cells"), collect_cells(read_stage(spark, f"{folder}/centres"))


def calibrate(
    session_of: DataFrame, folder: str, k: int, metric: str = "ip", queries: DataFrame | None = None, n_queries: int = CALIBRATION_QUERIES
) -> DataFrame:
    """Measure and store, beside the stored cells, the recall of every number of probes for ``k`` and a measure.

    The queries are the caller's or a sample of the corpus of ``n_queries`` vectors, whatever its size.
    """
    stored, cells = stored_cells(session_of, folder)
    asked = sample_queries(stored, n_queries) if queries is None else queries
    curve = probe_curve(stored, cells, asked, k, metric, n_queries).withColumns({"k": F.lit(k), "metric": F.lit(metric)})
    path = f"{folder}/calibration/metric={metric}/k={k}"
    write_stage(curve.drop("k", "metric").coalesce(1), path)
    return read_stage(session_of.sparkSession, path)


def search_by_cell(
    queries: DataFrame, folder: str, k: int, nprobe: int | None = None, recall: float | None = None, metric: str = "ip", **options
) -> DataFrame:
    """Search what ``store_by_cell`` has stored; only the folders of the probed cells are read.

    ``recall`` asks for the fewest probes that reached it in the calibration for this ``k`` and measure.
    """
    if nprobe is not None and recall is not None:
        raise ValueError("give nprobe or recall, not both")
    stored, cells = stored_cells(queries, folder)
    if recall is not None:
        curve = read_stage(queries.sparkSession, f"{folder}/calibration/metric={metric}/k={k}")
        nprobe = probes_for(curve, [recall]).first().nprobe
    return search(queries, stored, k, strategy="ivf", centroids=cells.centers, nprobe=nprobe or DEFAULT_NPROBE, metric=metric, **options)


def exact_by_cell(queries: DataFrame, folder: str, k: int, **options) -> Bounded:
    """Search it exactly, reading only cells that can hold a hit, and tell how much was scored for each query."""
    stored, cells = stored_cells(queries, folder)
    return bounded_search(queries, stored, cells, SearchOptions(k=k, **options))


def store_in_tables(corpus: DataFrame, folder: str, tables: HashTables) -> None:
    """Store a corpus in hash tables, by folders of buckets."""
    write_stage(file_in_tables(corpus, tables), folder, ["part"])


def search_in_tables(queries: DataFrame, folder: str, tables: HashTables, k: int, n_probes: int = DEFAULT_PROBES, **options) -> DataFrame:
    """Search what ``store_in_tables`` has stored with the same tables; only the folders of probed buckets are read."""
    stored = read_stage(queries.sparkSession, folder)
    return search(queries, stored, k, strategy="hash_tables", tables=tables, n_probes=n_probes, **options)
