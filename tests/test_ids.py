import hashlib
import json

import pytest
from pyspark.sql import functions as F

from passel.functions import ids, vectors
from passel.functions.numbers import round_report
from passel.operators.metadata import add_uid, normalize_metadata
from passel.sources.runs import require_run_sizes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "uid, parts",
    [
        ("a::c5", ("a", 5)),
        ("a::c-1", ("a", -1)),
        ("a::c5::c7", ("a", None)),
        ("a::cx", ("a", None)),
        ("a::row9", ("a", None)),
        ("a::row9::c3", ("a::row9", 3)),
        ("plain", ("plain", None)),
        ("", ("", None)),
    ],
)
def test_split_uid(spark, uid, parts):
    assert tuple(one(spark, ids.split_uid(F.lit(uid)))) == parts


@pytest.mark.parametrize("value, number", [("3", 3), ("3.0", None), ("\t7\n", 7), ("NaN", None), ("x", None), ("", None), (None, None), ("-1", -1)])
def test_tolerant_chunk_id(spark, value, number):
    assert one(spark, ids.tolerant_chunk_id(F.lit(value).cast("string"), text=True)) == number


@pytest.mark.parametrize("value, number", [(3.7, 3), (float("nan"), None), (float("inf"), None), (None, None), (-1.0, -1)])
def test_tolerant_chunk_id_of_numbers(spark, value, number):
    assert one(spark, ids.tolerant_chunk_id(F.lit(value).cast("double"))) == number


@pytest.mark.parametrize("value", [float("inf"), float("-inf"), None])
def test_values_without_decimals_stay(spark, value):
    assert one(spark, round_report(F.lit(value).cast("double"), 4)) == value


def test_uid_of_nan_chunk(spark):
    rows = spark.createDataFrame([("a", float("nan")), ("b", 2.0), (None, None)], "id string, chunk_id double")
    assert [r["uid"] for r in add_uid(rows).collect()] == ["a::c-1", "b::c2", "::c-1"]


def test_suffix_only_when_a_uid_repeats(spark):
    unique = spark.createDataFrame([("a", 0), ("a", 1)], "id string, chunk_id int")
    assert {r["uid"] for r in add_uid(unique, ["id", "chunk_id"], "suffix_all").collect()} == {"a::c0", "a::c1"}
    repeated = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 0, 3)], "id string, chunk_id int, n int")
    got = {r["n"]: r["uid"] for r in add_uid(repeated, ["n"], "suffix_all").collect()}
    assert got == {1: "a::c0::0", 2: "a::c0::1", 3: "b::c0::2"}


def test_hash_bucket_is_the_sha1_prefix(spark):
    rows = spark.createDataFrame([("doc-1",), ("ünïcode",), ("",), ("12",)], "id string")
    for r in rows.select("id", ids.hash_bucket(F.col("id"), 7).alias("b")).collect():
        assert r["b"] == int(hashlib.sha1(r["id"].encode()).hexdigest()[:8], 16) % 7


def test_fingerprint_is_the_sorted_json_digest(spark):
    record = {"metric": "ip", "alpha": 3, "name": 'q"uote é', "none": None, "flag": True, "rate": 0.5}
    columns = {k: (F.lit(None).cast("string") if v is None else F.lit(v)) for k, v in record.items()}
    text = json.dumps(record, sort_keys=True, ensure_ascii=False)
    assert one(spark, ids.fingerprint(columns)) == hashlib.sha1(text.encode()).hexdigest()[:12]


@pytest.mark.parametrize(
    "name, parts",
    [
        ("/r/wiki_flat_single_10k_bench_summary.json", ("wiki", "flat_single", "10k", 10000, 10)),
        ("multidomain_store_llm_50k_bench_summary.json", ("multidomain", "store", "50k", 50000, 50)),
        ("wiki_spark_30k_10k_bench_summary.json", ("wiki", "spark", "30k", 30000, 30)),
        ("wiki_10k_bench_summary.json", ("wiki", "", "10k", 10000, 10)),
        ("wiki_llm_llm_a_llm_b_llmx_10k_x_bench_summary.json", ("wiki", "a_b_llmx", "10k", 10000, 10)),
        ("wiki__a_30k", ("wiki", "_a", "30k", 30000, 30)),
        ("wiki_a10k_b_110k_50k_10k", ("wiki", "a10k_b_110k", "50k", 50000, 50)),
        ("10k_a_30k", ("10k", "", "10k", 10000, 10)),
        ("wiki_llm_50k", ("wiki", "", "50k", 50000, 50)),
        ("wiki_flat_99k_bench_summary.json", ("wiki", None, None, None, None)),
    ],
)
def test_parse_run_name(spark, name, parts):
    assert tuple(one(spark, ids.parse_run_name(F.lit(name)))) == parts


def test_run_without_size_fails_when_required(spark):
    rows = spark.createDataFrame([("p", None)], "path string, size int")
    with pytest.raises(Exception, match="no run size"):
        require_run_sizes(rows).collect()
    assert require_run_sizes(spark.createDataFrame([("p", 5)], "path string, size int")).first()["size"] == 5


def test_metadata_keeps_nulls(spark):
    rows = spark.createDataFrame([("\t Wiki \u00a0", None, 1, "2"), (None, "X", 2, "2.0")], "domain string, title string, id long, chunk_id string")
    assert [tuple(r) for r in normalize_metadata(rows).collect()] == [("wiki", None, "1", 2), (None, "X", "2", None)]


def test_normalize_vector_edges(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    got = [r[0] for r in rows.select(vectors.normalize_vector(F.col("v"))).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0] and got[2] is None


def test_metric_names():
    assert [vectors.canonical_metric(m) for m in (" COS ", "inner", "euclidean", "ip")] == ["cosine", "ip", "l2", "ip"]
    with pytest.raises(ValueError):
        vectors.canonical_metric("hamming")


def test_score_type_and_similarity(spark):
    rows = spark.createDataFrame([("ip",), ("Cosine",), ("l2",)], "m string")
    assert [r[0] for r in rows.select(vectors.score_type(F.col("m"))).collect()] == ["similarity", "similarity", "distance"]
    assert one(spark, vectors.distance_to_similarity(F.lit(0.25))) == 0.75


@pytest.mark.parametrize("decimals", [0, 1, 2, 4])
def test_rounding_is_that_of_python(spark, decimals):
    values = [0.00125, 35.825, 2.675, 0.5, 1.5, 2.5, 0.125, -0.00125, -2.5, 1 / 3, 1e9 + 0.5, 123456.785, 0.0, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in rows.select(round_report(F.col("v"), decimals)).collect()]
    assert got == [None if v is None else round(v, decimals) for v in values]
