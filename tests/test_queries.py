"""Every registered query against its SQL, and the contract of the entry module."""

import os
import subprocess
import sys

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from passel.operators.topk import rank_hits
from passel.plans import registered
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def connection(tables):
    return connect(tables)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, tables, connection, name):
    assert differences(spark, connection, contract.queries()[name], contract.oracle_sql()[name], tables) == []


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_gives_ranked_passages(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["qid", "rank", "uid", "score"]
    assert frame.where("rank = 1").count() == frame.select("qid").distinct().count() > 0


@pytest.mark.parametrize("name", ["topk_ivf_trained", "topk_lsh"])
def test_approximate_search_returns_true_scores(spark, tables, name):
    """Without SQL: every hit carries its exact score, ranks follow scores, most of the best are found."""
    asked = registered.label_queries(spark, tables)
    corpus = registered.vector_corpus(spark, tables)
    everything = registered.search(asked, corpus, corpus.count(), carry=[])
    truth = {(r["qid"], r["uid"]): round(r["score"], 6) for r in everything.collect()}
    got = contract.queries()[name](spark, tables).collect()
    assert all(abs(truth[(r["qid"], r["uid"])] - r["score"]) < 1e-6 for r in got)
    for qid in {r["qid"] for r in got}:
        ordered = sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])
        assert [r["rank"] for r in ordered] == list(range(1, len(ordered) + 1))
        assert [r["score"] for r in ordered] == sorted((r["score"] for r in ordered), reverse=True)
    best = {(r["qid"], r["uid"]) for r in rank_hits(everything.drop("rank"), 10).collect()}
    found = {(r["qid"], r["uid"]) for r in got}
    assert len(best & found) / len(best) >= 0.5


def test_no_query_stops_at_a_prefix(spark, tables):
    """Counting queries see all rows of their tables."""
    documents = spark.read.parquet(f"{tables}/documents.parquet").count()
    assert contract.queries()["hash_shards"](spark, tables).count() == documents
    assert contract.queries()["contiguous_shards"](spark, tables).agg(F.max("row_index")).first()[0] == documents - 1


def test_workers_need_no_installed_package(tables, tmp_path):
    """From another folder the Python workers cannot import the package; its code comes with the job."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from passel.session import local_session\n"
        "import __spark_entry__ as e\n"
        "spark = local_session('elsewhere', '2', 2)\n"
        "for name in ('search_text', 'topk_fanout', 'topk_ivf'):\n"
        f"    assert e.queries()[name](spark, {tables!r}).count() > 0\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
