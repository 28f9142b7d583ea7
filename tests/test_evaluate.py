import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passel.operators import evaluate, hits, latency

HITS = "qid long, rank int, uid string"


def test_recall_and_mrr_by_hand(spark):
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (2, 1, None), (2, 2, "z"), (2, 3, "c"), (5, 1, "q")], HITS)
    gold = spark.createDataFrame([(1, "b"), (1, "x"), (1, "b"), (2, "c"), (3, "n"), (9, "m"), (4, None)], "qid long, uid string")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "qid long")
    rows = {r["qid"]: r for r in evaluate.recall_per_query(found, gold, asked).collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[1]["recall"], rows[1]["reciprocal_rank"]) == (0.5, 0.5)
    assert (rows[2]["recall"], rows[2]["reciprocal_rank"]) == (1.0, 0.5)
    assert (rows[3]["recall"], rows[3]["reciprocal_rank"]) == (0.0, 0.0)
    total = evaluate.recall_mrr(found, gold, asked).first()
    assert tuple(total) == (3, 0.5, 0.3333)


def test_quality_without_gold_is_null(spark):
    found = spark.createDataFrame([(1, 1, "a")], HITS)
    gold = spark.createDataFrame([], "qid long, uid string")
    asked = spark.createDataFrame([(1,)], "qid long")
    assert tuple(evaluate.recall_mrr(found, gold, asked).first()) == (0, None, None)


def test_hit_without_uid_counts_by_id(spark):
    found = spark.createDataFrame([(1, 1, None, "d")], HITS + ", id string")
    gold = spark.createDataFrame([(1, "d")], "qid long, uid string")
    assert evaluate.recall_per_query(found, gold, found.select("qid")).first()["recall"] == 1.0


def test_agreement_by_hand(spark):
    a = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (2, 1, "x"), (3, 1, "only")] + [(4, i, f"l{i}") for i in range(1, 9)], HITS)
    b = spark.createDataFrame([(1, 1, "b"), (1, 2, "c"), (2, 1, "x"), (4, 1, "l1"), (4, 99, "far")], HITS)
    rows = {r["qid"]: r for r in evaluate.agreement(a, b, 10).collect()}
    assert set(rows) == {1, 2, 4}
    assert (rows[1]["equal_sets"], rows[1]["only_a"], rows[1]["only_b"]) == (False, ["a"], ["c"])
    assert (rows[1]["k_compared"], rows[1]["dupes_a"], rows[1]["dupes_b"]) == (2, 1, 0)
    assert rows[2]["equal_sets"] and rows[4]["only_a"] == ["l2", "l3", "l4", "l5", "l6"]
    assert tuple(evaluate.agreement_ratio(evaluate.agreement(a, b, 10)).first()) == (3, 1, 1 / 3)


def test_source_mix_sums_to_one(spark):
    frame = spark.createDataFrame([(" Wiki",), ("wiki ",), ("",), (None,), ("b",)], "source string")
    rows = {r["source"]: (r["n_hits"], r["share"]) for r in evaluate.source_mix(frame).collect()}
    assert rows == {"wiki": (2, 0.4), "unknown": (2, 0.4), "b": (1, 0.2)}
    assert evaluate.source_mix_map(evaluate.source_mix(frame)).first()[0] == {"wiki": 0.4, "unknown": 0.4, "b": 0.2}


def test_counts_by_source_keep_null(spark):
    frame = spark.createDataFrame([(1, "a"), (1, None), (2, "a")], "qid long, source string")
    assert {tuple(r) for r in evaluate.hits_by_source(frame).collect()} == {("a", 2), (None, 1)}
    assert {tuple(r) for r in evaluate.coverage(frame).collect()} == {(1, 2, 1), (2, 1, 1)}


def test_best_hit_wins_and_ties_keep_the_first(spark):
    rows = [(1, 1, 0.9, "a", "d1", 0, "first"), (1, 2, 0.9, "a", "d1", 0, "second"), (1, 3, 0.8, None, "d2", None, "x"), (1, 4, 0.95, "", "d2", -1, "y"), (1, 5, 0.9, "0", "d3", 1, "z")]
    frame = spark.createDataFrame(rows, "qid long, rank int, score double, uid string, id string, chunk_id int, note string")
    got = hits.dedup_best_hit(frame).orderBy("rank").collect()
    assert [(r["rank"], r["uid"], r["score"], r["note"]) for r in got] == [(1, "d2::c-1", 0.95, "y"), (2, "0", 0.9, "z"), (3, "a", 0.9, "first")]


def test_metadata_of_hot_uid_gives_one_row(spark):
    found = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (2, 2, "b"), (3, 1, "gone")], HITS)
    meta = spark.range(3000).select(F.when(F.col("id") > 0, "a").otherwise("b").alias("uid"), F.lit("t").alias("title"))
    assert hits.attach_metadata(found, meta, ["title"]).count() == 3
    kept = hits.attach_metadata(found, meta, ["title"], keep_unmatched=True)
    assert {(r["qid"], r["uid"]): r["title"] for r in kept.collect()}[(3, "gone")] is None


def test_context_follows_rank(spark):
    frame = spark.createDataFrame([(1, 10, "ten"), (1, 2, "two"), (1, 1, None)], "qid long, rank int, text string")
    assert tuple(hits.rag_context(frame, separator="|").first()) == (1, 3, "|two|ten")


def test_complete_hits_fills_the_shape(spark):
    frame = spark.createDataFrame([(1, 1, 0.5, "a::c0", " Wiki ", "", "body")], "qid long, rank int, score double, uid string, domain string, chunk_text string, text string")
    row = hits.complete_hits(frame).first().asDict()
    assert row == {"qid": 1, "rank": 1, "score": 0.5, "uid": "a::c0", "id": "", "source": "wiki", "title": "", "url": "", "text": "body", "chunk_id": None}


def test_hit_log_carries_query_and_iteration(spark):
    found = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], HITS)
    asked = spark.createDataFrame([(1, "same text"), (2, "same text")], "qid long, query string")
    rows = hits.hit_log(found, asked, 3).collect()
    assert {(r["qid"], r["query"], r["iter"]) for r in rows} == {(1, "same text", 3), (2, "same text", 3)}


def test_first_hit(spark):
    frame = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], HITS)
    assert {tuple(r) for r in hits.first_hit_per_query(frame).collect()} == {(1, 1, "a"), (2, 1, "c")}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50).map(float), min_size=1, max_size=60), st.sampled_from([4, 10, 10_000]))
def test_percentiles_are_exact(spark, values, accuracy):
    """Also with a sketch so coarse that the brackets leave most values out."""
    frame = spark.createDataFrame([("g", v) for v in values], "k string, v double")
    wanted = {"p0": 0.0, "p10": 10.0, "p50": 50.0, "p90": 90.0, "p100": 100.0}
    linear = latency.exact_percentiles(frame, ["k"], "v", wanted, accuracy=accuracy).first()
    nearest = latency.exact_percentiles(frame, ["k"], "v", wanted, "nearest", accuracy).first()
    ordered = sorted(values)
    for name, p in wanted.items():
        assert linear[name] == pytest.approx(np.percentile(values, p))
        assert nearest[name] == ordered[min(int(len(ordered) * (p / 100.0)), len(ordered) - 1)]


def test_percentiles_of_a_hot_group(spark):
    """Beyond the unbracketed size, with one value holding a third of the group."""
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(10_000, 42.0), rng.exponential(50, 20_000)])
    frame = spark.createDataFrame([("hot", float(v)) for v in values] + [("cold", 1.0)], "k string, v double").repartition(8)
    rows = {r["k"]: r for r in latency.exact_percentiles(frame, ["k"], "v", {"a": 1.0, "b": 50.0, "c": 99.9}).collect()}
    for name, p in {"a": 1.0, "b": 50.0, "c": 99.9}.items():
        assert rows["hot"][name] == pytest.approx(np.percentile(values, p), rel=1e-12)
    assert rows["cold"]["b"] == 1.0


def test_empty_groups_and_no_time(spark):
    frame = spark.createDataFrame([("a", None), ("b", 0.0), ("b", 0.0), (None, 4.0)], "k string, v double")
    rows = {r["k"]: r for r in latency.latency_summary(frame, ["k"], "v", F.lit("l2")).collect()}
    assert (rows["a"]["n_queries"], rows["a"]["p50_ms"], rows["a"]["qps"]) == (0, 0.0, 0.0)
    assert (rows["b"]["n_queries"], rows["b"]["qps"], rows["b"]["score_type"]) == (2, 0.0, "distance")
    assert (rows[None]["p90_ms"], rows[None]["qps"]) == (4.0, 250.0)


def test_system_rows_fall_back(spark):
    small = spark.createDataFrame([(5.0, 6.0, 7.0, None, 9.0)], "p50_ms double, avg_ms double, qps double, llm_p50_ms double, llm_avg_ms double")
    big = spark.createDataFrame([(50.0, 60.0, 0.7)], "p50_ms double, avg_ms double, qps double")
    rows = latency.system_comparison(small, big, "s", "b").collect()
    assert tuple(rows[0]) == ("s", "small+rag", 5.0, 9.0, 7.0, 5.0, 6.0)
    assert tuple(rows[1]) == ("b", "big_no_rag", 50.0, 60.0, 0.7, None, None)


def test_domain_gap(spark):
    frame = spark.createDataFrame([("wiki", "x", 10, 2.0), ("multi", "x", 10, 3.0), ("wiki", "y", 10, 1.0)], "domain string, backend string, size int, p50_ms double")
    rows = {r["backend"]: tuple(r)[2:] for r in latency.domain_gap(frame, "wiki", "multi").collect()}
    assert rows == {"x": (2.0, 3.0, 1.0, 1.5), "y": (1.0, None, None, None)}


def test_hits_without_a_passage_keep_their_place(spark):
    found = spark.createDataFrame([(1, 1, "a::c0"), (1, 2, "gone::c0")], HITS)
    chunks = spark.createDataFrame([("a", 0, "text of a"), ("b", 0, "other")], "id string, chunk_id int, chunk_text string")
    assert {r["uid"]: r["text"] for r in hits.attach_text(found, chunks).collect()} == {"a::c0": "text of a", "gone::c0": ""}


def test_pivot_names_every_backend(spark):
    rows = spark.createDataFrame([("wiki", 10, "a", 1.0), ("wiki", 10, "b", 2.0)], "domain string, size int, backend string, p50_ms double")
    assert latency.summary_pivot(rows, "p50_ms", ["a", "b"]).first().asDict() == {"domain": "wiki", "size": 10, "a": 1.0, "b": 2.0}
    with pytest.raises(Exception, match="backend not named: b"):
        latency.summary_pivot(rows, "p50_ms", ["a"]).collect()
