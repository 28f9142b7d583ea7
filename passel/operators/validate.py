"""Checks on corpora, shards and query sets; each returns its findings as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passel.functions.text import strip
from passel.functions.vectors import UNIT_TOLERANCE, norm


def check_alignment(meta: DataFrame, vectors: DataFrame, key: str = "uid") -> DataFrame:
    """Row counts of both sides and how many keys occur on one side only.

    Both sides are stacked and grouped by the key; the counting starts before the shuffle, so a
    key repeated very often costs no more than any other.
    """
    both = meta.select(F.col(key).alias("_key"), F.lit(1).alias("_m"), F.lit(0).alias("_v")).unionAll(
        vectors.select(F.col(key).alias("_key"), F.lit(0).alias("_m"), F.lit(1).alias("_v"))
    )
    per_key = both.groupBy("_key").agg(F.sum("_m").alias("_m"), F.sum("_v").alias("_v"))
    found = per_key.agg(
        F.coalesce(F.sum("_m"), F.lit(0)).alias("n_meta"),
        F.coalesce(F.sum("_v"), F.lit(0)).alias("n_vectors"),
        F.count_if(F.col("_v") == 0).alias("meta_only"),
        F.count_if(F.col("_m") == 0).alias("vector_only"),
    )
    aligned = (F.col("n_meta") == F.col("n_vectors")) & (F.col("meta_only") == 0) & (F.col("vector_only") == 0)
    return found.withColumn("aligned", aligned)


# Buckets whose checksums are compared; a difference costs a full comparison of its bucket.
CHECKSUM_BUCKETS = 4096


def check_alignment_by_sums(meta: DataFrame, vectors: DataFrame, key: str = "uid", n_buckets: int = CHECKSUM_BUCKETS) -> DataFrame:
    """The findings of :func:`check_alignment`; sides that agree shuffle a row a bucket and task instead of their keys.

    Keys fall into hash buckets. Each side sums up two 64-bit hashes of its keys per bucket, in any order and before the
    shuffle. Only the keys of buckets whose counts or sums differ are stacked and grouped. Different keys of equal
    sums would have to agree in 128 bits.
    """

    def bucket(of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(n_buckets)).cast("int")

    def sums(side: DataFrame) -> DataFrame:
        keyed = side.select(F.col(key).alias("_key"))
        wide = [F.sum(F.xxhash64("_key", F.lit(seed)).cast("decimal(20,0)")) for seed in (1, 2)]
        return keyed.groupBy(bucket("_key").alias("_bucket")).agg(F.count("*").alias("_n"), F.struct(*wide).alias("_sums"))

    one, two = (sums(side).select("_bucket", F.col("_n").alias(f"_n{i}"), F.col("_sums").alias(f"_s{i}")) for i, side in enumerate((meta, vectors)))
    # At most n_buckets rows.
    compared = one.join(two, "_bucket", "full").select(
        "_bucket", F.coalesce("_n0", F.lit(0)).alias("m"), F.coalesce("_n1", F.lit(0)).alias("v"), (~F.col("_s0").eqNullSafe(F.col("_s1"))).alias("differs")
    ).collect()
    totals = sum(r.m for r in compared), sum(r.v for r in compared)
    unlike = [r["_bucket"] for r in compared if r.differs]
    counts = [F.lit(t).cast("bigint").alias(n) for t, n in zip(totals, ("n_meta", "n_vectors"))]
    if not unlike:
        none = [F.lit(0).cast("bigint").alias(n) for n in ("meta_only", "vector_only")]
        return meta.sparkSession.range(1).select(*counts, *none, F.lit(totals[0] == totals[1]).alias("aligned"))
    sides = [side.select(key).where(bucket(key).isin(unlike)) if len(unlike) < n_buckets else side.select(key) for side in (meta, vectors)]
    found = check_alignment(*sides, key)
    return found.select(*counts, "meta_only", "vector_only", "aligned")


def check_shards(counts: DataFrame, n_total: int) -> DataFrame:
    """Do the shard sizes add up to the corpus, and is any shard empty?

    Rows under a null shard belong to none and make the corpus incomplete.
    """
    return counts.where("shard is not null").agg(
        F.count("*").alias("n_shards"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("n") == 0).alias("empty_shards"),
    ).withColumn("complete", (F.col("n_rows") == n_total) & (F.col("n_shards") > 0))


def check_vectors(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Vectors that are missing or not of unit length, and the dimensions that occur."""
    vector = F.col(embedding)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(vector.isNull()).alias("n_missing"),
        F.count_if(F.abs(norm(vector) - 1.0) > UNIT_TOLERANCE).alias("n_not_unit"),
        F.min(F.size(vector)).alias("min_dim"),
        F.max(F.size(vector)).alias("max_dim"),
    )


def require_unit_vectors(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Fail the job on the first vector that is not of unit length."""
    wrong = F.abs(norm(F.col(embedding)) - 1.0) > UNIT_TOLERANCE
    guard = F.when(wrong, F.raise_error(F.lit("corpus vector is not of unit length")).cast("array<float>"))
    return df.withColumn(embedding, F.coalesce(guard, F.col(embedding)))


def require_count(df: DataFrame, recorded: int) -> DataFrame:
    have = df.count()
    if have != recorded:
        raise ValueError(f"the corpus has {have} rows, its record says {recorded}")
    return df


def require_encoder(df: DataFrame, model: str, column: str = "model_name") -> DataFrame:
    """Fail unless every vector comes from the encoder the queries use.

    One differing row is enough, so the check stops at the first and collects at most one name.
    """
    other = df.where(~F.col(column).eqNullSafe(F.lit(model))).select(column).first()
    if other is not None:
        raise ValueError(f"corpus encoded with {other[0]!r}, queries with {model!r}")
    return df


def uid_uniqueness(df: DataFrame, shard: str = "shard", uid: str = "uid") -> DataFrame:
    """Rows and distinct uids per shard and, with a null shard, overall.

    ``repeated_uids`` counts uids on more than one row, ``in_several_shards`` those in more than
    one shard. Rows are counted per (uid, shard) first; a uid then has one entry per shard, to
    which an entry for the whole corpus is added.
    """
    cells = df.groupBy(F.col(uid).alias("_uid"), F.col(shard).cast("int").alias("shard")).agg(F.count("*").alias("_n"))
    no, yes = F.lit(False).alias("whole"), F.lit(True).alias("whole")
    per_uid = cells.groupBy("_uid").agg(
        F.collect_list(F.struct(no, "shard", F.col("_n").alias("n"), F.lit(1).cast("bigint").alias("shards"))).alias("_each"),
        F.struct(
            yes, F.lit(None).cast("int").alias("shard"), F.sum("_n").alias("n"), F.count("*").alias("shards")
        ).alias("_whole"),
    )
    entries = per_uid.select("_uid", F.explode(F.array_append("_each", F.col("_whole"))).alias("_e"))
    return (
        entries.groupBy("_e.whole", "_e.shard")
        .agg(
            F.sum("_e.n").alias("n_rows"),
            F.count("_uid").alias("distinct_uids"),
            F.count_if(F.col("_e.n") > 1).alias("repeated_uids"),
            F.count_if(F.col("_e.shards") > 1).alias("in_several_shards"),
        )
        .drop("whole")
    )


def uid_sketches(df: DataFrame, shard: str = "shard", uid: str = "uid", bits: int = 12) -> DataFrame:
    """Rows and a HyperLogLog ``sketch`` of the uids of each shard, to be stored beside it; 2^bits registers each."""
    return df.groupBy(F.col(shard).cast("int").alias("shard")).agg(
        F.count("*").alias("n_rows"), F.hll_sketch_agg(F.col(uid).cast("string"), F.lit(bits)).alias("sketch")
    )


def uid_estimates(sketches: DataFrame) -> DataFrame:
    """``shard, n_rows, distinct_uids`` estimated from stored sketches, and with a null shard those of their union.

    The relative error is about 1.04 / 2^(bits / 2), 1.6 % by default. No uid is read, so shards can be added one by
    one; :func:`uid_uniqueness` has the exact figures.
    """
    whole = sketches.agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("sketch").alias("sketch"))
    both = sketches.unionByName(whole.withColumn("shard", F.lit(None).cast("int")))
    return both.select("shard", "n_rows", F.hll_sketch_estimate("sketch").alias("distinct_uids"))


def check_queries(queries: DataFrame, dim: int | None = None, text: str = "query", embedding: str = "embedding") -> DataFrame:
    """The rejected queries with a reason; an empty result means all can be searched."""
    reason = F.when(F.col(text).isNull() | (strip(F.col(text)) == ""), "blank text")
    if dim is not None:
        vector = F.col(embedding)
        reason = reason.when(vector.isNull(), "no vector").when(F.size(vector) != dim, "wrong dimension")
    return queries.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("qid", text, "reason")


def require_valid_queries(queries: DataFrame, dim: int | None = None) -> DataFrame:
    bad = check_queries(queries, dim).first()
    if bad is not None:
        raise ValueError(f"query {bad['qid']}: {bad['reason']}")
    return queries
