import numpy as np
import pytest
from pyspark.sql import functions as F

from passel.operators import ann, hits, topk
from passel.operators.search import EXTRA_OPTIONS, STRATEGIES, register_strategy, search, search_many, search_one
from passel.operators.topk import Scoring, block_join_topk, merge_local, rank_hits
from passel.functions.encode import hashing_encoder

SCHEMA = "uid string, embedding array<float>, source string, shard int"


def make_corpus(spark, n=300, dim=8, seed=3, copies=100):
    """Random vectors, a third of them exact copies of one passage under different uids."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)).astype(np.float32)
    base[:copies] = base[0]
    base[n - 1] = 0.0
    rows = [(f"d{i}::c0", [float(x) for x in base[i]], f"Src{i % 3}", i % 5) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def make_queries(spark, n=7, dim=8, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dim).astype(np.float32)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "qid long, embedding array<float>")


def score(q, v, metric):
    q, v = np.asarray(q, dtype=np.float64), np.asarray(v, dtype=np.float64)
    if metric == "l2":
        return -float(((q - v) ** 2).sum())
    if metric == "cosine":
        return float(q @ v / (max(np.linalg.norm(q), 1e-12) * max(np.linalg.norm(v), 1e-12)))
    return float(q @ v)


def compared(q, v, metric):
    """The score to about twelve digits of the magnitude it can have."""
    lq, lv = np.linalg.norm(np.asarray(q, float)), np.linalg.norm(np.asarray(v, float))
    size = {"ip": lq * lv, "cosine": 1.0, "l2": (lq + lv) ** 2}[metric]
    return score(q, v, metric) if size == 0 else round(score(q, v, metric) / size, 12) * size


def brute(queries, rows, k, metric="ip", keep=lambda r: True, distinct=True):
    out = {}
    for qid, q in queries:
        scored = sorted((-compared(q, r[1], metric), r[0]) for r in rows if keep(r))
        if distinct:
            seen, unique = set(), []
            for s, uid in scored:
                if uid not in seen:
                    seen.add(uid)
                    unique.append((s, uid))
            scored = unique
        out[qid] = [uid for _, uid in scored[:k]]
    return {q: u for q, u in out.items() if u}


def by_query(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r["uid"])
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    return make_corpus(spark)


@pytest.fixture(scope="module")
def queries(spark):
    return make_queries(spark)


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
@pytest.mark.parametrize("k", [1, 10, 150, 1000])
def test_exact_search_equals_brute_force(corpus, queries, metric, k):
    assert by_query(search(queries[1], corpus[1], k, metric=metric)) == brute(queries[0], corpus[0], k, metric)


@pytest.mark.parametrize("strategy", ["sharded", "fanout"])
def test_sharded_strategies_equal_exact(corpus, queries, strategy):
    assert by_query(search(queries[1], corpus[1], 10, strategy=strategy)) == brute(queries[0], corpus[0], 10)


def test_ivf_over_all_cells_equals_exact(corpus, queries):
    found = search(queries[1], corpus[1], 10, strategy="ivf", n_cells=6, nprobe=6, metric="cosine")
    assert by_query(found) == brute(queries[0], corpus[0], 10, "cosine")


def test_block_join_equals_broadcast(corpus, queries):
    for strategy in ("exact", "sharded", "ivf", "lsh"):
        options = {"strategy": strategy, "nprobe": 2, "n_cells": 5} if strategy == "ivf" else {"strategy": strategy}
        small = search(queries[1], corpus[1], 10, **options)
        blocks = search(queries[1], corpus[1], 10, max_query_rows=2, **options)
        assert by_query(small) == by_query(blocks), strategy


def test_tiny_blocks_split_the_copies(corpus, queries):
    scoring = Scoring(10)
    local = block_join_topk(queries[1], corpus[1], scoring, corpus_block=16, query_block=2)
    assert by_query(merge_local(local, scoring, [])) == brute(queries[0], corpus[0], 10)


def test_repeated_uids(spark, corpus, queries):
    """Half of the rows share one uid; with deduplication it takes one place, with its best score."""
    rows = [("same" if i % 2 else r[0], *r[1:]) for i, r in enumerate(corpus[0])]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert by_query(search(queries[1], frame, 10)) == brute(queries[0], rows, 10)
    kept = search(queries[1], frame, 10, dedup=False)
    assert by_query(kept) == brute(queries[0], rows, 10, distinct=False)
    assert by_query(hits.dedup_best_hit(search(queries[1], frame, 400, dedup=False), k=10)) == brute(queries[0], rows, 10)


@pytest.mark.parametrize("wanted", [" SRC1 ", "src1"])
def test_filter_before_scoring(corpus, queries, wanted):
    found = search(queries[1], corpus[1], 10, source=wanted)
    assert by_query(found) == brute(queries[0], corpus[0], 10, keep=lambda r: r[2] == "Src1")


def test_filter_after_may_return_fewer(corpus, queries):
    found = by_query(search(queries[1], corpus[1], 10, source="src1", filter_stage="post", overfetch=4))
    source = {r[0]: r[2] for r in corpus[0]}
    fetched = brute(queries[0], corpus[0], 40)
    want = {q: [u for u in uids if source[u] == "Src1"][:10] for q, uids in fetched.items()}
    assert found == {q: u for q, u in want.items() if u}


@pytest.mark.parametrize("stage", ["merge", "local"])
def test_filter_on_shard_candidates(corpus, queries, stage):
    found = search(queries[1], corpus[1], 4, strategy="sharded", alpha=2, source="src2", filter_stage=stage)
    want = {}
    for qid, q in queries[0]:
        kept = []
        for shard in range(5):
            rows = [r for r in corpus[0] if r[3] == shard]
            best = brute([(qid, q)], rows, 8)[qid]
            kept += [r for r in rows if r[0] in set(best) and r[2] == "Src2"]
        want |= brute([(qid, q)], kept, 4)
    assert by_query(found) == want


def test_filter_without_match_is_empty(corpus, queries):
    assert search(queries[1], corpus[1], 5, source="nowhere").count() == 0
    assert search(queries[1], corpus[1], 5, source="nowhere", strategy="fanout", filter_stage="local").count() == 0


def test_no_queries_no_hits(spark, corpus):
    none = spark.createDataFrame([], "qid long, embedding array<float>")
    for strategy in ("exact", "fanout", "ivf", "lsh"):
        assert search(none, corpus[1], 5, strategy=strategy).count() == 0


def test_rows_without_vector_are_skipped(spark, queries):
    rows = [("a", None, "s", 0), (None, [1.0] * 8, "s", 0), ("b", [1.0] * 8, "s", 0), ("c", [float("nan")] * 8, "s", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert by_query(search(queries[1], frame, 5)) == {q: ["b"] for q, _ in queries[0]}


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
@pytest.mark.parametrize("strategy", ["exact", "sharded", "fanout", "ivf", "lsh"])
def test_one_bad_vector_costs_no_other(spark, corpus, queries, metric, strategy):
    """Undefined, infinite and overlong vectors in the middle of one batch are skipped alone."""
    bad = [(f"bad{i}", [x] * 8, "s", 0) for i, x in enumerate((float("nan"), float("inf"), float("-inf"), 3e38))]
    clean = spark.createDataFrame(corpus[0], SCHEMA).coalesce(1)
    mixed = spark.createDataFrame([*corpus[0][:20], *bad[:3], *corpus[0][20:]], SCHEMA).coalesce(1)
    options = {"n_cells": 4, "nprobe": 4} if strategy == "ivf" else {}
    got, want = (by_query(search(queries[1], f, 10, strategy=strategy, metric=metric, **options)) for f in (mixed, clean))
    assert got == want and (strategy == "lsh" or all(len(uids) == 10 for uids in got.values()))


@pytest.mark.parametrize("strategy", ["exact", "sharded", "fanout"])
def test_bad_vectors_within_one_batch(spark, corpus, queries, strategy):
    """Null, infinite and undefined vectors between the others of a single partition."""
    bad = {0: [float("nan")] * 8, 1: [float("inf")] * 8, 2: None}
    rows = [(r[0], bad[i % 7] if i % 7 in bad else r[1], *r[2:]) for i, r in enumerate(corpus[0])]
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert by_query(search(queries[1], frame, 10, strategy=strategy)) == brute(queries[0], [r for i, r in enumerate(rows) if i % 7 not in bad], 10)


def test_bad_vectors_query_reads_in_many_tasks(spark, tables):
    """The scan's own partitions do the work of the registered query."""
    from passel.plans.registered import topk_nonfinite

    assert "Coalesce 1" not in topk_nonfinite(spark, tables)._jdf.queryExecution().toString()


def test_trained_cells_do_not_depend_on_partitions(corpus):
    from passel.operators.ann import train_cells

    a, b = train_cells(corpus[1].coalesce(1), 5), train_cells(corpus[1].repartition(7), 5)
    assert a.shape == b.shape and np.allclose(a, b)


def test_hash_buckets_are_the_same_everywhere():
    from passel.operators.ann import _bucket_numbers, hash_directions

    directions = hash_directions(8, 3)
    vectors = np.random.default_rng(0).normal(size=(50, 8))
    assert (hash_directions(8, 5)[:3] == directions).all()
    assert (_bucket_numbers(vectors, directions, 0.5)[:7] == _bucket_numbers(vectors[:7], directions, 0.5)).all()


def test_blocks_of_a_join_are_all_used(spark, corpus, queries):
    """Stored places are multiples of a large power of two; the blocks of the join must not be."""
    many = corpus[1].repartition(64)
    found = by_query(merge_local(block_join_topk(queries[1], many, Scoring(10), corpus_block=20), Scoring(10), []))
    assert found == by_query(search(queries[1], corpus[1], 10))
    places = many.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(16)).alias("b")).distinct()
    assert places.count() > 8


def test_wrong_dimension_fails(spark, queries):
    frame = spark.createDataFrame([("a", [1.0, 2.0], "s", 0)], SCHEMA)
    with pytest.raises(Exception, match="dimension"):
        search(queries[1], frame, 5).collect()


def test_query_without_vector_fails(spark, corpus):
    asked = spark.createDataFrame([(0, None), (1, [1.0] * 8)], "qid long, embedding array<float>")
    with pytest.raises(ValueError, match="missing"):
        search(asked, corpus[1], 5)


def test_numeric_uids_become_text(spark, queries):
    frame = spark.range(20).select(F.col("id").alias("uid"), F.array(*[F.col("id").cast("float")] * 8).alias("embedding"))
    found = by_query(search(queries[1], frame, 1))
    assert {uid for uids in found.values() for uid in uids} <= {"0", "19"}


def test_salted_merge_gives_the_same(spark, corpus, queries):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        assert by_query(search(queries[1], corpus[1], 10)) == brute(queries[0], corpus[0], 10)
        assert by_query(search(queries[1], corpus[1], 10, strategy="sharded")) == brute(queries[0], corpus[0], 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_limits_inside_the_task(monkeypatch, corpus, queries):
    """Compaction and query sub-blocks do not change the result."""
    vectors = np.array([r[1] for r in corpus[0]], dtype=np.float64)
    uids = [r[0] for r in corpus[0]]
    import pyarrow as pa

    monkeypatch.setattr(topk, "_COMPACT_FROM", 10)
    monkeypatch.setattr(topk, "_CELLS_PER_PRODUCT", 64)
    block = topk.QueryBlock(np.array([q for q, _ in queries[0]]), np.array([v for _, v in queries[0]]))
    winners = topk.TaskWinners(block, Scoring(10))
    for start in range(0, len(uids), 17):
        part = pa.array(uids[start : start + 17])
        winners.add(part, vectors[start : start + 17], None, pa.table({"_row": pa.array(range(len(part)))}))
    table = winners.result(["qid", "score", "uid"])
    got = {}
    for qid, uid in zip(table["qid"].to_pylist(), table["uid"].to_pylist()):
        got.setdefault(qid, []).append(uid)
    assert got == brute(queries[0], corpus[0], 10)


def test_unit_vectors_rank_alike_under_all_metrics(spark):
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(80, 6))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows = [(f"u{i}", [float(x) for x in v], "s", 0) for i, v in enumerate(unit)]
    frame = spark.createDataFrame(rows, "uid string, embedding array<double>, source string, shard int")
    asked = spark.createDataFrame([(0, rows[5][1])], "qid long, embedding array<double>")
    results = [by_query(search(asked, frame, 20, metric=m)) for m in ("ip", "cosine", "l2")]
    assert results[0] == results[1] == results[2] and results[0][0][0] == "u5"


def test_options_are_checked(corpus, queries):
    for wrong in ({"strategy": "none"}, {"metric": "hamming"}, {"filter_stage": "later"}, {"k": 0}, {"alpha": 0}, {"nprob": 3}):
        with pytest.raises(ValueError):
            search(queries[1], corpus[1], **wrong)


def test_own_strategy(corpus, queries):
    register_strategy("first", lambda q, c, o: rank_hits(c.select(F.lit(0).alias("qid"), F.lit(1.0).alias("score"), "uid"), o.k))
    try:
        assert search(queries[1], corpus[1], 3, strategy="first").count() == 3
    finally:
        STRATEGIES.pop("first")
        EXTRA_OPTIONS.pop("first")


def test_large_and_tiny_vectors_are_ranked_exactly(spark):
    """Near-equal scores that single precision cannot tell apart, and lengths beyond its range."""
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e-20, 1e-42, 1e18, 1e30):
        base = rng.normal(size=6)
        rows = [(f"v{i:02d}", [float(x) for x in (base + 1e-9 * rng.normal(size=6)) * scale], "s", 0) for i in range(40)]
        frame = spark.createDataFrame(rows, "uid string, embedding array<double>, source string, shard int")
        asked = [(0, [float(x) for x in base])]
        found = search(spark.createDataFrame(asked, "qid long, embedding array<double>"), frame, 15)
        assert by_query(found) == brute(asked, rows, 15), scale


def test_three_documents_end_to_end(spark):
    docs = [
        ("1", "wikipedia", "pagerank ranks pages by links"),
        ("2", "pubmed", "metformin lowers glucose in patients"),
        ("3", "stackexchange", "git rebase rewrites commits while merge keeps them"),
    ]
    frame = spark.createDataFrame(docs, "id string, source string, text string")
    encode = hashing_encoder(256)
    searchable = frame.select(F.concat("id", F.lit("::c0")).alias("uid"), "source", encode(F.col("text")).alias("embedding"))
    asked = spark.createDataFrame([(0, "metformin glucose"), (1, "git merge rebase"), (2, "git merge rebase")], "qid long, query string")
    found = by_query(search_many(asked, encode, searchable, k=3))
    assert [uids[0] for uids in found.values()] == ["2::c0", "3::c0", "3::c0"] and len(found[0]) == 3
    assert by_query(search_one("pagerank links", encode, searchable, k=1)) == {0: ["1::c0"]}
    with pytest.raises(ValueError):
        search_one("  ", encode, searchable)


def test_cells_are_assigned_by_cosine(spark):
    centres = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    rows = [("a", [5.0, 1.0]), ("b", [0.1, 0.2]), ("c", [-3.0, 0.0]), ("d", [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "uid string, embedding array<float>")
    assert {r["uid"]: r["cell"] for r in ann.assign_cells(frame, centres).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}


def test_cells_beyond_the_broadcast_bound_are_refused():
    with pytest.raises(ValueError):
        ann.nearest_cells(np.zeros((ann.MAX_CELLS + 1, 1)), 1)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_topk_plan_has_no_pairs(corpus, queries):
    plan = plan_of(search(queries[1], corpus[1], 10, dedup=False))
    assert "WindowGroupLimit" in plan and "MapInArrow" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_search_reads_only_uid_and_vector(spark, tables, queries):
    table = spark.read.parquet(f"{tables}/embeddings.parquet")
    frame = table.select(F.col("vec_id").cast("string").alias("uid"), "embedding", F.col("label").alias("source"))
    asked = table.limit(3).select(F.col("vec_id").alias("qid"), "embedding")
    plan = plan_of(search(asked, frame, 5))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
    assert "IsNotNull(embedding)" in plan.split("PushedFilters:")[1].split("ReadSchema")[0]


def test_stored_cells_are_pruned(spark, corpus, queries, tmp_path):
    """Only folders of probed cells are read, and what they hold is what a search of unstored cells finds."""
    from passel.plans.corpus import search_by_cell, store_by_cell

    store_by_cell(corpus[1], str(tmp_path), n_cells=6, rounds=2)
    found = search_by_cell(queries[1].limit(1), str(tmp_path), 10, nprobe=2)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell")
    same = search(queries[1].limit(1), corpus[1], 10, strategy="ivf", n_cells=6, rounds=2, nprobe=2)
    assert by_query(found) == by_query(same)
    everything = search_by_cell(queries[1], str(tmp_path), 10, nprobe=6)
    assert by_query(everything) == by_query(search(queries[1], corpus[1], 10))
