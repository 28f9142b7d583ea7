"""Runs at rest, sketches and checksums."""

import json
import random

import pytest
from pyspark.sql import functions as F

from passel.operators import latency, validate
from passel.schema import RUN_SUMMARY
from passel.sources import runs


def summary(spark, run, *values, key="idx"):
    return spark.createDataFrame([(key, run, v) for v in values], "index_key string, run_id string, avg_ms double")


def test_a_broken_old_run_is_never_opened(spark, tmp_path):
    for run in ("20240101-000000", "20240301-000000", "20231231-235959"):
        runs.append_summary(summary(spark, run, float(run[4:6])), str(tmp_path))
    runs.append_summary(summary(spark, "20990101-000000", 9.0, key="other/index"), str(tmp_path))
    old = tmp_path / "index_key=idx" / "run_id=20240101-000000"
    for file in old.glob("part-*"):
        file.write_bytes(b"\xff\xfe not json {")
        file.chmod(0)
    found = runs.read_latest_run(spark, str(tmp_path), "idx", RUN_SUMMARY)
    assert runs.read_latest_run(spark, str(tmp_path), "idx").columns == ["avg_ms", "index_key", "run_id"]
    assert [(r.index_key, r.run_id, r.avg_ms) for r in found.collect()] == [("idx", "20240301-000000", 3.0)]
    assert all("20240301" in f for f in found.inputFiles())
    assert set(RUN_SUMMARY.names) <= set(found.columns)
    assert [r.avg_ms for r in runs.read_latest_run(spark, str(tmp_path), "other/index", "avg_ms double").collect()] == [9.0]
    with pytest.raises(FileNotFoundError):
        runs.read_latest_run(spark, str(tmp_path), "none")


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    runs.append_summary(summary(spark, "20240101-000000", 1.0, 2.0), str(tmp_path))
    runs.append_summary(summary(spark, "20240102-000000", 3.0), str(tmp_path))
    runs.append_summary(summary(spark, "20240102-000000", 4.0), str(tmp_path))
    every = spark.read.json(str(tmp_path))
    assert sorted(r.avg_ms for r in every.collect()) == [1.0, 2.0, 4.0]


def test_summaries_in_nested_folders(spark, tmp_path):
    rows = [("wiki_click_llm_10k_bench_summary.json", 1.5), ("multidomain_view_llm_50k_bench_summary.json", 2.5)]
    runs.write_run_summaries(spark.createDataFrame(rows, "file_name string, p50_ms double"), str(tmp_path))
    files = sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*.json"))
    assert files == ["multidomain/multidomain_view_llm_50k_bench_summary.json", "wiki/wiki_click_llm_10k_bench_summary.json"]
    assert json.loads((tmp_path / files[1]).read_text()) == {"p50_ms": 1.5}
    found = {(r.domain, r.backend, r.size, r.retrieval_p50_ms) for r in runs.read_run_summaries(spark, str(tmp_path)).collect()}
    assert found == {("wiki", "click", 10000, 1.5), ("multidomain", "view", 50000, 2.5)}


def test_merged_sketches_rank_like_the_log(spark):
    pick = random.Random(3)
    rows = [(pick.choice("aab"), i % 40, pick.lognormvariate(2, 1.5)) for i in range(30_000)]
    rows += [("a", 1, None), ("a", 2, float("nan")), ("empty", 3, None)]
    log = spark.createDataFrame(rows, "backend string, run int, ms double")
    stored = latency.run_sketches(log, ["backend", "run"], "ms")
    twice = latency.merge_sketches(latency.merge_sketches(stored.withColumn("week", F.col("run") % 7), ["backend", "week"]), ["backend"])
    got = {r.backend: r for r in latency.sketch_percentiles(twice, ["backend"]).collect()}
    for backend in "ab":
        values = sorted(v for b, _, v in rows if b == backend and v is not None and v == v)
        assert got[backend].n == len(values)
        for name, share in (("p50_ms", 0.5), ("p90_ms", 0.9)):
            rank = sum(v <= got[backend][name] for v in values) / len(values)
            assert abs(rank - share) < 0.02
    assert (got["empty"].n, got["empty"].p50_ms) == (0, 0.0)


@pytest.mark.parametrize("case", ["equal", "one missing", "replaced", "repeated", "disjoint", "empty", "nulls"])
def test_checksums_find_what_the_full_comparison_finds(spark, case):
    left = [f"u{i}" for i in range(500)]
    right = {
        "equal": left[::-1], "one missing": left[1:], "replaced": ["x", *left[1:]], "repeated": [*left, "u3", "u3"],
        "disjoint": [f"v{i}" for i in range(500)], "empty": [], "nulls": [None, *left[1:]],
    }[case]
    one, two = (spark.createDataFrame([(x,) for x in side], "uid string").repartition(4) for side in (left, right))
    for n_buckets in (1, 64):
        assert validate.check_alignment_by_sums(one, two, n_buckets=n_buckets).collect() == validate.check_alignment(one, two).collect()
        assert validate.check_alignment_by_sums(two, one, n_buckets=n_buckets).collect() == validate.check_alignment(two, one).collect()


def test_equal_sides_shuffle_bucket_rows_only(spark):
    ids = spark.range(20_000, numPartitions=4).selectExpr("string(id) AS uid")
    found = validate.check_alignment_by_sums(ids, ids.repartition(3), n_buckets=16)
    assert found.first().aligned
    # What is left to run knows the result: no key is compared.
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_estimates_of_distinct_uids(spark):
    rows = [(i % 3, f"u{i % 4000}") for i in range(12_000)] + [(None, "u1"), (1, None)]
    frame = spark.createDataFrame(rows, "shard int, uid string")
    whole = validate.uid_estimates(validate.uid_sketches(frame))
    # Sketches of shards that come later are put beside the others.
    apart = validate.uid_sketches(frame.where("shard = 0")).unionByName(validate.uid_sketches(frame.where("shard <> 0 or shard is null")))
    assert sorted(whole.collect(), key=repr) == sorted(validate.uid_estimates(apart).collect(), key=repr)
    exact = {(r.shard, r.n_rows): r.distinct_uids for r in validate.uid_uniqueness(frame).collect()}
    for r in whole.collect():
        if (r.shard, r.n_rows) in exact:
            assert abs(r.distinct_uids - exact[r.shard, r.n_rows]) <= max(1, 0.08 * exact[r.shard, r.n_rows])
