"""Exact search by cell bounds and calibrated probing."""

import numpy as np
import pytest

from passel.operators.cells import (
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
from passel.operators.search import SearchOptions, search
from passel.plans.corpus import calibrate, exact_by_cell, search_by_cell, store_by_cell
from passel.sources.corpus import read_stage

DIM = 6


def frame(spark, vectors, uids=None):
    rows = [(f"u{i:04d}" if uids is None else uids[i], None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "uid string, embedding array<float>").repartition(4)


def queries_of(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "qid long, embedding array<float>")


def grouped(seed=1, groups=8, each=40):
    """Vectors in far groups of different lengths, and queries near some of the groups."""
    pick = np.random.default_rng(seed)
    middles = pick.normal(size=(groups, DIM)) * np.linspace(3, 9, groups)[:, None]
    return middles, np.concatenate([m + pick.normal(size=(each, DIM)) * 0.2 for m in middles])


def placed(spark, vectors, centers, uids=None):
    rows = frame(spark, vectors, uids)
    middles = cell_middles(rows, centers)
    corpus = place_in_cells(rows, centers, middles)
    return corpus, collect_cells(cell_extents(corpus, centers, middles))


def rows_of(found):
    return sorted((r.qid, r["rank"], r.uid, round(r.score, 9)) for r in found.collect())


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("max_rows", [1000, 2])
@pytest.mark.parametrize("dedup", [True, False])
def test_equals_the_exact_search(spark, metric, max_rows, dedup):
    """Groups, random vectors, copies under one uid, a cell of one vector, an empty one, vectors without numbers."""
    middles, vectors = grouped()
    pick = np.random.default_rng(2)
    vectors = [*vectors, *pick.normal(size=(80, DIM)), np.zeros(DIM), *vectors[:30], 50 * np.ones(DIM)]
    vectors += [None, [float("nan")] * DIM, [float("inf")] + [0.0] * (DIM - 1)]
    uids = [f"u{i % 300:04d}" for i in range(len(vectors))]
    centers = np.concatenate([middles, [50 * np.ones(DIM), -70 * np.ones(DIM)], pick.normal(size=(3, DIM))])
    corpus, cells = placed(spark, vectors, centers, uids)
    asked = queries_of(spark, [*middles[:3], *pick.normal(size=(4, DIM)), np.zeros(DIM)])
    options = SearchOptions(k=7, metric=metric, dedup=dedup, max_query_rows=max_rows)
    found = bounded_search(asked, corpus, cells, options)
    assert rows_of(found.hits) == rows_of(search(asked, frame(spark, vectors, uids), 7, metric=metric, dedup=dedup))
    asked_rows = {r.qid: (r.n_cells, r.n_rows) for r in found.asked.collect()}
    assert len(asked_rows) == 8 and all(r <= cells.rows.sum() for _, r in asked_rows.values())


def test_far_cells_stay_unread(spark, tmp_path):
    middles, vectors = grouped(groups=12)
    store_by_cell(frame(spark, vectors), str(tmp_path), n_cells=40, rounds=6)
    stored = read_stage(spark, f"{tmp_path}/cells")
    asked = queries_of(spark, middles[:2])
    found = exact_by_cell(asked, str(tmp_path), 5, metric="l2")
    assert rows_of(found.hits) == rows_of(search(asked, frame(spark, vectors), 5, metric="l2"))
    shares = [r.n_rows / len(vectors) for r in found.asked.collect()]
    assert max(shares) < 0.4
    # The scans prune by folder: no file of another cell is opened.
    plan = found.hits._jdf.queryExecution().executedPlan().toString()
    assert any("cell" in filters.split("]")[0] for filters in plan.split("PartitionFilters: [")[1:])
    assert stored.select("cell").distinct().count() > 12


def test_no_vector_beats_its_cell(spark):
    pick = np.random.default_rng(4)
    vectors, centers = pick.normal(size=(200, DIM)) * pick.uniform(0.1, 5, size=(200, 1)), pick.normal(size=(9, DIM))
    corpus, cells = placed(spark, vectors, centers)
    asked = pick.normal(size=(20, DIM)) * 2
    rows = corpus.select("cell", "embedding").collect()
    own = np.array([r.embedding for r in rows])
    for metric in ("l2", "ip", "cosine"):
        best = cells.best_scores(asked, metric)
        for q, bounds in zip(asked, best):
            dots = own @ q
            scores = {"ip": dots, "l2": -((own - q) ** 2).sum(axis=1), "cosine": dots / np.linalg.norm(own, axis=1) / np.linalg.norm(q)}[metric]
            assert all(s <= bounds[r.cell] for s, r in zip(scores, rows))


def test_bounds_need_the_filter_first_and_cells(spark):
    corpus, cells = placed(spark, np.eye(DIM), np.eye(DIM)[:2])
    with pytest.raises(ValueError, match="before the scoring"):
        bounded_search(queries_of(spark, np.eye(DIM)[:1]), corpus, cells, SearchOptions(source="a", filter_stage="post"))
    with pytest.raises(ValueError, match="extents"):
        search(queries_of(spark, np.eye(DIM)[:1]), corpus, strategy="bounded")
    assert search(queries_of(spark, np.zeros((0, DIM))), corpus, strategy="bounded", cells=cells).collect() == []
    empty = corpus.where("false")
    nothing = Cells(cells.centers, cells.centers, np.zeros(2, int), np.zeros(2), np.zeros(2), np.zeros(2))
    assert search(queries_of(spark, np.eye(DIM)[:1]), empty, strategy="bounded", cells=nothing).collect() == []


def test_curve_equals_counting(spark):
    pick = np.random.default_rng(7)
    vectors, centers = pick.normal(size=(150, DIM)), pick.normal(size=(6, DIM))
    corpus, cells = placed(spark, vectors, centers)
    sample = sample_queries(corpus, 20)
    curve = sorted(probe_curve(corpus, cells, sample, 5).collect())
    cell_of = {r.uid: (r.cell, np.array(r.embedding)) for r in corpus.collect()}
    units = centers / np.linalg.norm(centers, axis=1)[:, None]
    hits, read = np.zeros(7), np.zeros(7)
    for q in sample.collect():
        vector = np.array(q.embedding)
        order = np.argsort(-(units @ vector), kind="stable").tolist()
        gold = sorted((u for u in cell_of if u != q.uid), key=lambda u: (-(cell_of[u][1] @ vector), u))[:5]
        for n in range(1, 7):
            hits[n] += sum(cell_of[u][0] in order[:n] for u in gold)
            read[n] += sum(cell_of[u][0] in order[:n] for u in cell_of)
    for n, row in enumerate(curve, 1):
        assert (row.nprobe, round(row.recall, 9), round(row.share_read, 9)) == (n, round(hits[n] / 100, 9), round(read[n] / 3000, 9))
    chosen = probes_for(probe_curve(corpus, cells, sample, 5), [0.0, 0.9, 1.0]).collect()
    for row in chosen:
        assert row.nprobe == min(n for n in range(1, 7) if hits[n] / 100 >= row.recall_asked)


def test_calibrated_recall_holds_for_other_queries(spark, tables, tmp_path):
    """Asked for 0.9, queries that the calibration has not seen get it, and not all is read."""
    from passel.plans.registered import vector_corpus

    corpus = vector_corpus(spark, tables)
    store_by_cell(corpus, str(tmp_path), n_cells=16, rounds=4)
    curve = calibrate(corpus, str(tmp_path), 10)
    assert probes_for(curve, [0.9]).first().share_read < 0.9
    seen = sample_queries(corpus).select("uid")
    asked = corpus.join(seen, "uid", "left_anti").where("cast(id AS long) % 9 = 0")
    asked = asked.select(asked.id.cast("long").alias("qid"), "embedding")
    gold = {(r.qid, r.uid) for r in search(asked, corpus, 10).collect()}
    found = {(r.qid, r.uid) for r in search_by_cell(asked, str(tmp_path), 10, recall=0.9).collect()}
    assert len(gold & found) >= 0.88 * len(gold)
    with pytest.raises(ValueError, match="not both"):
        search_by_cell(asked, str(tmp_path), 10, nprobe=3, recall=0.9)
    with pytest.raises(ValueError, match="at most 5"):
        calibrate(corpus, str(tmp_path), 10, queries=sample_queries(corpus, 9), n_queries=5)
