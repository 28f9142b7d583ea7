import math

import pytest
from pyspark.sql import functions as F

from passel.functions.ids import build_uid
from passel.operators import corpus, validate
from passel.operators.metadata import vector_metadata


def test_row_index_is_gapless_and_ordered(spark):
    frame = spark.range(1000).select((F.lit(5000) - F.col("id")).alias("key"), F.col("id").alias("payload"))
    rows = corpus.with_row_index(frame, ["key"], "i", "n").orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(1000))
    assert [r["key"] for r in rows] == list(range(4001, 5001)) and {r["n"] for r in rows} == {1000}


def test_row_index_with_a_hot_key_uses_several_partitions(spark):
    """A third of all rows share one key and still spread over partitions."""
    frame = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), "id")
    numbered = corpus.with_row_index(frame, ["key"], "i")
    rows = numbered.orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(9000))
    assert [r["key"] for r in rows] == sorted(r["key"] for r in rows)
    assert sorted(r["id"] for r in rows) == list(range(9000))
    width = 8
    ranged = frame.withColumn("_salt", F.rand(17)).repartitionByRange(width, "key", "_salt")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 9000 / 3


def test_row_index_of_nothing(spark):
    assert corpus.with_row_index(spark.range(0), ["id"]).count() == 0


@pytest.mark.parametrize("n, shards", [(10, 3), (10, 10), (7, 4), (5, 8), (9, 4)])
def test_contiguous_shards(spark, n, shards):
    rows = corpus.contiguous_shards(spark.range(n), shards, ["id"]).orderBy("id").collect()
    size = math.ceil(n / shards)
    assert [r["shard"] for r in rows] == [i // size for i in range(n)]


def test_split_without_identifier_is_contiguous(spark):
    frame = spark.range(8).select(F.col("id").alias("n"))
    got = corpus.assign_shards(frame, 4, "hash", "id", ["n"]).orderBy("n").collect()
    assert [r["shard"] for r in got] == [0, 0, 1, 1, 2, 2, 3, 3]
    with pytest.raises(ValueError):
        corpus.assign_shards(frame, 4, "random")


def test_slice_limits(spark, monkeypatch):
    frame = spark.range(100).withColumn("key", F.lit(100) - F.col("id"))
    assert [r["key"] for r in corpus.first_rows(frame, 3, ["key"]).orderBy("key").collect()] == [1, 2, 3]
    monkeypatch.setattr(corpus, "ORDERED_LIMIT_ROWS", 2)
    assert [r["key"] for r in corpus.first_rows(frame, 3, ["key"]).orderBy("key").collect()] == [1, 2, 3]
    with pytest.raises(ValueError, match="only 100 exist"):
        corpus.first_rows(frame, 101, ["key"])


def test_shuffle_is_seeded_and_complete(spark):
    frame = spark.range(200).select(F.col("id").cast("string").alias("uid"))
    first, again = (corpus.shuffle_corpus(frame.repartition(p), seed=1).collect() for p in (3, 7))
    other = corpus.shuffle_corpus(frame, seed=2).collect()
    assert first == again != other and sorted(first) == sorted(other) == sorted(frame.collect())
    places = corpus.shuffle_positions(frame, seed=1).orderBy("position").collect()
    assert [r["uid"] for r in places] == [r["uid"] for r in first]


def test_empty_shards_are_listed(spark):
    frame = spark.createDataFrame([(0,), (2,), (2,)], "shard int")
    counts = corpus.shard_counts(frame, 4)
    assert {r["shard"]: r["n"] for r in counts.collect()} == {0: 1, 1: 0, 2: 2, 3: 0}
    assert validate.check_shards(counts, 3).first().asDict() == {"n_shards": 4, "n_rows": 3, "empty_shards": 2, "complete": True}
    assert validate.check_shards(counts, 4).first()["complete"] is False


def test_manifest_counts_domains(spark):
    frame = spark.createDataFrame([(0, "a", [1.0, 0.0]), (0, None, [0.0, 1.0]), (2, "a", [0.0, 1.0])], "shard int, domain string, embedding array<float>")
    rows = {r["id"]: r for r in corpus.shard_manifest(frame, 3).collect()}
    assert rows["000"]["domain_counts"] == {"a": 1, "(null)": 1} and rows["001"]["n"] == 0 and rows["001"]["domain_counts"] == {}
    assert {r["n_total"] for r in rows.values()} == {3} and {r["dim"] for r in rows.values()} == {2}


def test_domain_counts_total_equals_sum(spark):
    frame = spark.range(500).select((F.col("id") % 7).cast("int").alias("shard"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("d"), (F.col("id") % 3).cast("string"))).alias("domain"))
    rows = corpus.domain_counts(frame).collect()
    totals = {r["domain"]: r["n"] for r in rows if r["shard"] is None}
    summed = {}
    for r in rows:
        if r["shard"] is not None:
            summed[r["domain"]] = summed.get(r["domain"], 0) + r["n"]
    assert totals == summed and "(null)" in totals and sum(totals.values()) == 500


def test_merge_matches_columns_by_name(spark):
    a = spark.createDataFrame([("1", "x")], "id string, domain string")
    b = spark.createDataFrame([("y", "2", "u")], "domain string, id string, url string")
    assert {tuple(r) for r in corpus.merge_corpora(a, b).collect()} == {("1", "x", None), ("2", "y", "u")}


def test_vector_metadata_drops_text(spark):
    frame = spark.createDataFrame([("1", 0, "t")], "id string, chunk_id int, chunk_text string")
    assert vector_metadata(frame).columns == ["id", "chunk_id"]


def test_alignment_and_uniqueness(spark):
    meta = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "uid string")
    vectors = spark.createDataFrame([("a",), ("c",)], "uid string")
    found = validate.check_alignment(meta, vectors).first().asDict()
    assert found == {"n_meta": 4, "n_vectors": 2, "meta_only": 2, "vector_only": 1, "aligned": False}
    assert validate.check_alignment(vectors, vectors).first()["aligned"] is True
    assert validate.check_alignment(meta.limit(0), vectors.limit(0)).first()["n_meta"] == 0
    placed = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("b", 1), ("c", 1)], "uid string, shard int")
    rows = {r["shard"]: (r["n_rows"], r["distinct_uids"], r["repeated_uids"], r["in_several_shards"]) for r in validate.uid_uniqueness(placed).collect()}
    assert rows == {0: (3, 2, 1, 0), 1: (2, 2, 0, 0), None: (5, 3, 2, 1)}


def test_vector_checks(spark):
    frame = spark.createDataFrame([([1.0, 0.0],), ([2.0, 0.0],), (None,), ([0.6, 0.8, 0.0],)], "embedding array<float>")
    assert tuple(validate.check_vectors(frame).first()) == (4, 1, 1, 2, 3)
    with pytest.raises(Exception, match="unit length"):
        validate.require_unit_vectors(frame).collect()
    assert validate.require_unit_vectors(frame.limit(1)).count() == 1


def test_recorded_count_and_encoder(spark):
    frame = spark.createDataFrame([("m",), ("m",)], "model_name string")
    assert validate.require_count(frame, 2) is frame and validate.require_encoder(frame, "m") is frame
    with pytest.raises(ValueError):
        validate.require_count(frame, 3)
    with pytest.raises(ValueError):
        validate.require_encoder(frame, "other")


def test_bad_queries_are_named(spark):
    rows = [(0, "ok", [1.0, 0.0]), (1, " ", [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, "x", None), (4, "x", [1.0])]
    frame = spark.createDataFrame(rows, "qid long, query string, embedding array<float>")
    found = {r["qid"]: r["reason"] for r in validate.check_queries(frame, 2).collect()}
    assert found == {1: "blank text", 2: "blank text", 3: "no vector", 4: "wrong dimension"}
    with pytest.raises(ValueError):
        validate.require_valid_queries(frame, 2)


def test_uid_built_from_columns(spark):
    frame = spark.createDataFrame([("a", 3), ("a", None)], "id string, chunk_id int")
    assert [r[0] for r in frame.select(build_uid(F.col("id"), F.col("chunk_id"))).collect()] == ["a::c3", "a::c-1"]


def test_rows_without_a_shard_are_counted(spark):
    frame = spark.createDataFrame([(0,), (None,), (9,), (-1,)], "shard int")
    counts = corpus.shard_counts(frame, 2)
    assert {r["shard"]: r["n"] for r in counts.collect()} == {0: 1, 1: 0, None: 3}
    assert validate.check_shards(counts, 4).first().asDict() == {"n_shards": 2, "n_rows": 1, "empty_shards": 1, "complete": False}


def test_blanks_of_any_kind_are_no_query(spark):
    rows = [(i, q) for i, q in enumerate(["\t", " \r\n", "\x1f \x0b", None, " x "])]
    found = validate.check_queries(spark.createDataFrame(rows, "qid long, query string"))
    assert sorted(r["qid"] for r in found.collect()) == [0, 1, 2, 3]
