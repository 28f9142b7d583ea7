import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from passel.operators.corpus import hash_shards
from passel.plans.corpus import build_corpus
from passel.plans.retrieval import answer, answer_context
from passel.sources import corpus, documents, queries, runs


def test_query_set_file(spark, tmp_path):
    path = tmp_path / "queries.txt"
    path.write_text("  first query \n\n   \nsecond\nfirst query\n", encoding="utf-8")
    rows = queries.read_query_set(spark, str(path)).orderBy("qid").collect()
    assert [r["query"] for r in rows] == ["first query", "second", "first query"]
    path.write_text(" \n\n", encoding="utf-8")
    with pytest.raises(ValueError, match="empty"):
        queries.read_query_set(spark, str(path))


def test_gold_files(spark, tmp_path):
    gold = {"q one": ["a::c0", "b::c1", "a::c0"], "q two": [], "q three": ["c::c2"]}
    whole, lines = tmp_path / "gold.json", tmp_path / "gold.jsonl"
    whole.write_text(json.dumps(gold, indent=2))
    lines.write_text("\n".join(json.dumps({q: u}) for q, u in gold.items()))
    want = {("q one", "a::c0"), ("q one", "b::c1"), ("q three", "c::c2")}
    assert {tuple(r) for r in queries.read_gold(spark, str(whole)).collect()} == want
    assert {tuple(r) for r in queries.read_gold_lines(spark, str(lines)).collect()} == want
    asked = spark.createDataFrame([(7, "q one"), (8, "q one")], "qid long, query string")
    keyed = queries.key_gold(queries.read_gold(spark, str(whole)), asked)
    assert {tuple(r) for r in keyed.collect()} == {(q, u) for q in (7, 8) for u in ("a::c0", "b::c1")}


def test_run_summary_folder(spark, tmp_path):
    for name, p50 in {"wiki_flat_single_10k": 1.5, "deep/er/multidomain_store_llm_50k": 2.5, "wiki_odd": 9.0}.items():
        path = tmp_path / f"{name}_bench_summary.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"p50_ms": p50, "qps": 4.0, "llm_p50_ms": 8.0, "environment": {"x": 1}}, indent=2))
    (tmp_path / "other.json").write_text("{}")
    rows = {(r["domain"], r["backend"], r["size"]): r for r in runs.read_run_summaries(spark, str(tmp_path)).collect()}
    assert set(rows) == {("wiki", "flat_single", 10000), ("multidomain", "store", 50000), ("wiki", None, None)}
    assert rows[("multidomain", "store", 50000)]["retrieval_p50_ms"] == 2.5
    assert rows[("wiki", "flat_single", 10000)]["retrieval_avg_ms"] is None


HIT_ROW = ("q, \"quoted\"\nline", 1, 1, 0.5, "d", "d::c0", "wiki", "t", None, 0, "text with, comma")
HIT_SCHEMA = "query string, iter int, rank int, score double, id string, uid string, source string, title string, url string, chunk_id int, text string"


@pytest.mark.parametrize("form", ["jsonl", "csv"])
def test_hit_log_round_trip(spark, tmp_path, form):
    frame = spark.createDataFrame([HIT_ROW], HIT_SCHEMA)
    runs.write_hits(frame.select(*sorted(frame.columns)), str(tmp_path / "hits"), form)
    back = runs.read_hits(spark, str(tmp_path / "hits"), form).first()
    assert (back["query"], int(back["rank"]), float(back["score"]), back["uid"], back["url"]) == (HIT_ROW[0], 1, 0.5, "d::c0", None)
    written = "".join(f.read_text() for f in (tmp_path / "hits").glob("part-*"))
    assert written.startswith('{"query"' if form == "jsonl" else "query,iter,rank,score,id,uid,source,title,url,chunk_id,text")


def test_hit_log_none_and_unknown(spark, tmp_path):
    frame = spark.createDataFrame([HIT_ROW], HIT_SCHEMA)
    runs.write_hits(frame, str(tmp_path / "none"), "none")
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        runs.write_hits(frame, str(tmp_path / "x"), "xml")


def test_merged_results_are_ordered(spark, tmp_path):
    rows = [("b", 1), ("a", 2), ("a", 1)]
    frame = spark.createDataFrame([(q, 1, r, *HIT_ROW[3:]) for q, r in rows], HIT_SCHEMA)
    runs.write_merged_hits(frame, str(tmp_path / "merged"))
    files = sorted((tmp_path / "merged").glob("part-*"))
    lines = [line for f in files for line in f.read_text().splitlines()[1:]]
    assert [tuple(line.split(",")[:2]) for line in lines] == [("a", "1"), ("a", "2"), ("b", "1")]


def test_latest_run(spark, tmp_path):
    for run, value in (("20250101-000000-aa", 1), ("20250301-000000-bb", 3), ("20250201-000000-cc", 2)):
        frame = spark.createDataFrame([("idx", run, value), ("other", "2026", 9)], "index_key string, run_id string, v int")
        runs.append_summary(frame, str(tmp_path / "runs"))
    assert [r["v"] for r in runs.read_latest_run(spark, str(tmp_path / "runs"), "idx").collect()] == [3]
    log = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 2, 2), (None, 5, 3)], "k string, t int, v int")
    assert {r["v"] for r in runs.latest_run(log, "k", "t").collect()} == {1, 2, 3}


def test_run_id_layout(spark):
    fixed = F.lit("2025-03-04 05:06:07").cast("timestamp")
    row = spark.range(1).select(runs.run_id(fixed).alias("a"), runs.run_id(fixed, F.lit("abc")).alias("b")).first()
    assert tuple(row) == ("20250304-050607", "20250304-050607-abc")


def test_vector_file(spark, tmp_path):
    matrix = np.random.default_rng(0).normal(size=(1001, 5))
    np.save(tmp_path / "v.npy", matrix)
    frame = corpus.read_npy(spark, str(tmp_path / "v.npy"), rows_per_read=100)
    rows = frame.orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(1001))
    assert np.allclose(np.array([r["embedding"] for r in rows]), matrix.astype(np.float32))
    meta = spark.range(1001).select(F.col("id").alias("row_index"), F.concat(F.lit("d"), "id").alias("doc"))
    assert corpus.attach_by_position(meta, frame).where("doc = 'd7'").first()["embedding"] == pytest.approx(matrix[7], rel=1e-6)


def test_sharded_corpus_prunes(spark, tmp_path):
    frame = hash_shards(spark.range(500).select(F.col("id").cast("string").alias("id")), 4)
    corpus.write_shards(frame, str(tmp_path / "c"))
    back = corpus.read_shards(spark, str(tmp_path / "c"))
    assert back.count() == 500
    found = corpus.discover_shards(spark, str(tmp_path / "c")).collect()
    assert [r["shard"] for r in found] == [0, 1, 2, 3] and sum(r["n"] for r in found) == 500
    plan = back.where("shard = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan
    corpus.write_shards(frame.limit(3), str(tmp_path / "c"))
    assert corpus.read_shards(spark, str(tmp_path / "c")).count() == 3


RECORD = {
    "MedlineCitation": {
        "PMID": "17",
        "Article": {
            "ArticleTitle": "Title",
            "Abstract": {"AbstractText": ["Part one.", "Part two."]},
            "Journal": {"JournalIssue": {"PubDate": {"Year": "2019", "Month": "Mar", "Day": "4"}}},
        },
    }
}


def test_nested_abstracts_from_json(spark, tmp_path):
    bare = {"MedlineCitation": {"PMID": "18", "Article": {}}}
    (tmp_path / "r.json").write_text(json.dumps(RECORD) + "\n" + json.dumps(bare))
    got = documents.abstract_documents(documents.read_abstract_records(spark, str(tmp_path / "r.json")))
    rows = {r["source_id"]: r for r in got.collect()}
    assert rows["17"]["text"] == "Part one. Part two." and str(rows["17"]["published_at"]) == "2019-03-04 00:00:00"
    assert rows["17"]["url"] == "https://pubmed.ncbi.nlm.nih.gov/17/" and rows["17"]["domain"] == "pubmed"
    assert rows["18"]["text"] == rows["18"]["title"] == "" and rows["18"]["published_at"] is None


def test_nested_abstracts_from_xml(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        "<Set><PubmedArticle><MedlineCitation><PMID>17</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract>"
        "<AbstractText>Part one.</AbstractText><AbstractText>Part two.</AbstractText></Abstract>"
        "<Journal><JournalIssue><PubDate><Year>2019</Year></PubDate></JournalIssue></Journal>"
        "</Article></MedlineCitation></PubmedArticle></Set>"
    )
    row = documents.abstract_documents(documents.read_abstract_records(spark, str(tmp_path / "r.xml"), "xml")).first()
    assert (row["source_id"], row["text"], str(row["published_at"])) == ("17", "Part one. Part two.", "2019-01-01 00:00:00")


def test_published_at_in_all_spellings(spark):
    rows = spark.createDataFrame([("1700000000",), ("2020-02-03",), ("2020-02-03T04:05:06",), (None,), ("{'Year': '2020'}",)], "v string")
    got = [str(r[0]) for r in rows.select(documents.published_at(F.col("v"))).collect()]
    assert got == ["2023-11-14 22:13:20", "2020-02-03 00:00:00", "2020-02-03 04:05:06", "None", "None"]


def test_questions_need_an_accepted_answer(spark):
    asked = spark.createDataFrame([(1, "T", "body", 10, 1700000000), (2, "U", None, None, 0), (3, "V", "b", 99, 0), (4, "W", None, 11, 0)], "question_id long, title string, body string, accepted_answer_id long, creation_date long")
    answers = spark.createDataFrame([(10, "yes"), (11, None), (12, "spare")], "answer_id long, body string")
    rows = {r["source_id"]: r for r in documents.qa_documents(asked, answers).collect()}
    assert set(rows) == {"1", "4"}
    assert rows["1"]["text"] == "body\n\n[ANSWER]\n\nyes" and rows["4"]["text"] == "\n\n[ANSWER]\n\n"
    assert str(rows["1"]["published_at"]) == "2023-11-14 22:13:20"


def test_ids_are_stable(spark):
    frame = spark.createDataFrame([("T", "text", None)], "title string, text string, url string")
    first, again = (documents.encyclopedia_documents(frame.repartition(p)).first()["id"] for p in (1, 3))
    assert first == again and len(first) == 64


def test_stages_from_raw_documents_to_answers(spark, tables, tmp_path):
    raw = spark.read.parquet(f"{tables}/documents.parquet").select(
        F.lit("wikipedia").alias("domain"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("source_id"),
        F.lit("").alias("title"), F.lit("").alias("url"), "text",
    )
    pages = spark.read.parquet(f"{tables}/pages.parquet").select(
        F.lit("web").alias("domain"), F.concat(F.lit("p"), "page_id").alias("id"), F.lit("").alias("source_id"),
        F.lit("").alias("title"), "url", F.col("html").alias("text"),
    )
    stored = build_corpus([(raw, "encyclopedia"), (pages, "html")], str(tmp_path), 4)
    chunks = corpus.read_stage(spark, str(tmp_path / "passages"))
    assert stored.count() == chunks.count() and "chunk_text" not in stored.columns
    asked = spark.read.parquet(f"{tables}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    found = answer(asked, stored, chunks, k=3, strategy="fanout").collect()
    assert len(found) == 3 * asked.count() and all(r["text"] for r in found)
    context = answer_context(asked, stored, chunks, k=2, source="Web")
    assert {r["n_passages"] for r in context.collect()} == {2}


def test_intermediate_tables_can_be_dropped(tmp_path):
    """In a process of its own, as the tables of the other tests live in the shared session."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys, os; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "from passel.session import materialise, drop_intermediates\n"
        f"builder = SparkSession.builder.master('local[2]').config('spark.checkpoint.dir', {str(tmp_path)!r})\n"
        "spark = builder.getOrCreate()\n"
        "assert materialise(spark.range(5)).count() == 5\n"
        f"own = os.path.join({str(tmp_path)!r}, 'passel-' + spark.sparkContext.applicationId)\n"
        "assert os.path.isdir(own)\n"
        "drop_intermediates(spark)\n"
        "assert not os.path.exists(own)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path):
    """Vectors and metadata stored in buckets of the row number are aligned where they lie, as are their counts."""
    vectors = spark.range(500).selectExpr("id as row_index", "array(cast(id as float)) as embedding")
    meta = spark.range(480).selectExpr("id * 2 as row_index", "concat('u', id) as uid")
    want = sorted(map(tuple, corpus.attach_by_position(meta, vectors).collect()))
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        one = corpus.store_bucketed(meta, "bucketed_meta", f"{tmp_path}/meta", "row_index", 4)
        two = corpus.store_bucketed(vectors, "bucketed_vectors", f"{tmp_path}/vectors", "row_index", 4)
        joined = corpus.attach_by_position(one, two)
        for frame in (joined, joined.groupBy("row_index").count()):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan, plan
        assert sorted(map(tuple, joined.collect())) == want and len(want) == 250
    finally:
        spark.conf.set(key, before)
        for name in ("bucketed_meta", "bucketed_vectors"):
            spark.sql(f"drop table if exists {name}")
