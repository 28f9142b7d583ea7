"""Stored hash tables."""

import numpy as np
import pytest

from passel.operators.hashing import HashTables, file_in_tables
from passel.operators.search import search
from passel.plans.corpus import search_in_tables, store_in_tables
from passel.plans.registered import vector_corpus
from passel.sources.corpus import read_stage


def corpus_of(spark, vectors):
    rows = [(f"u{i:03d}", None if v is None else [float(x) for x in v], f"s{i % 2}") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "uid string, embedding array<float>, source string").repartition(3)


def queries_of(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "qid long, embedding array<float>")


def hits_of(found):
    return sorted((r.qid, r["rank"], r.uid, r.score) for r in found.collect())


def check(found, want):
    got = hits_of(found)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-6)


def by_hand(vectors, asked, tables, n_probes, k, keep=lambda i: True):
    """Candidates by bit strings, then the best inner products."""
    directions = tables.directions.reshape(tables.n_tables, tables.n_bits, -1)
    out = []
    for qid, q in enumerate(asked):
        costs = []
        for t in range(tables.n_tables):
            own = [round(float(d @ q), 9) for d in directions[t]]
            for code in range(1 << tables.n_bits):
                costs.append((round(sum(p * p for b, p in enumerate(own) if (p > 0) != bool(code >> b & 1)), 9), t, code))
        probed = {(t, code) for _, t, code in sorted(costs)[:n_probes]}
        found = []
        for i, v in enumerate(vectors):
            if v is None or not np.isfinite(v).all() or not keep(i):
                continue
            v = np.float32(v).astype(float)
            codes = {(t, sum(1 << b for b in range(tables.n_bits) if round(float(directions[t][b] @ v), 9) > 0)) for t in range(tables.n_tables)}
            if codes & probed:
                found.append((-float(v @ q), f"u{i:03d}"))
        out += [(qid, rank, uid, -score) for rank, (score, uid) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("n_probes", [1, 9, 10_000])
@pytest.mark.parametrize("max_rows", [100, 1])
def test_equals_plain_buckets(spark, tmp_path, n_probes, max_rows):
    pick = np.random.default_rng(n_probes)
    vectors = [*pick.normal(size=(90, 5)), None, np.zeros(5), [np.nan] * 5]
    asked = np.float32(pick.normal(size=(6, 5))).astype(float)
    tables = HashTables(5, n_tables=3, n_bits=4)
    store_in_tables(corpus_of(spark, vectors), str(tmp_path), tables)
    found = search_in_tables(queries_of(spark, asked), str(tmp_path), tables, 6, n_probes, max_query_rows=max_rows)
    check(found, by_hand(vectors, asked, tables, n_probes, 6))
    wanted = search_in_tables(queries_of(spark, asked), str(tmp_path), tables, 6, n_probes, source="S1")
    check(wanted, by_hand(vectors, asked, tables, n_probes, 6, lambda i: i % 2))


def test_only_folders_of_probed_buckets_are_read(spark, tmp_path):
    pick = np.random.default_rng(3)
    tables = HashTables(8, n_tables=4, n_bits=6)
    store_in_tables(corpus_of(spark, pick.normal(size=(300, 8))), str(tmp_path), tables)
    found = search_in_tables(queries_of(spark, pick.normal(size=(1, 8))), str(tmp_path), tables, 5, 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("part" in filters.split("]")[0] for filters in plan.split("PartitionFilters: [")[1:])
    assert read_stage(spark, str(tmp_path)).select("part").distinct().count() > 30


def recall_and_share(spark, corpus, asked, folder, n_probes, dim):
    filed = HashTables(dim)
    store_in_tables(corpus, folder, filed)
    gold = {(r.qid, r.uid) for r in search(asked, corpus, 10).collect()}
    found = {(r.qid, r.uid) for r in search_in_tables(asked, folder, filed, 10, n_probes).collect()}
    vectors = np.array([r.embedding for r in corpus.collect()])
    probes = filed.probes(np.array([r.embedding for r in asked.collect()]), n_probes)
    return len(gold & found) / len(gold), np.mean([np.isin(filed.codes(vectors), p).any(axis=1).mean() for p in probes])


def test_recall_and_share_on_the_given_vectors(spark, tables, tmp_path):
    """These vectors have no groups: nine of ten hits take well over half of the rows."""
    corpus = vector_corpus(spark, tables)
    asked = corpus.where("cast(id AS long) % 3 = 0")
    recall, share = recall_and_share(spark, corpus, asked.select(asked.id.cast("long").alias("qid"), "embedding"), str(tmp_path), 240, 64)
    assert recall >= 0.9 and share < 0.7


def test_recall_and_share_on_groups(spark, tmp_path):
    """Where vectors have near ones, few rows are scored for as many hits."""
    pick = np.random.default_rng(5)
    middles = pick.normal(size=(40, 16))
    corpus = corpus_of(spark, np.concatenate([m + pick.normal(size=(25, 16)) * 0.15 for m in middles]))
    recall, share = recall_and_share(spark, corpus, queries_of(spark, middles[:20]), str(tmp_path), 24, 16)
    assert recall >= 0.9 and share < 0.3


def test_edges(spark):
    tables = HashTables(4, 2, 3)
    filed = file_in_tables(corpus_of(spark, np.eye(4)), tables)
    assert search(queries_of(spark, np.zeros((0, 4))), filed, strategy="hash_tables", tables=tables).collect() == []
    assert search(queries_of(spark, np.eye(4)), filed.where("false"), strategy="hash_tables", tables=tables).collect() == []
    with pytest.raises(ValueError, match="filed"):
        search(queries_of(spark, np.eye(4)), corpus_of(spark, np.eye(4)), strategy="hash_tables", tables=tables)
    with pytest.raises(ValueError, match="bits"):
        HashTables(4, 2, 40)
