"""Merging, numbering, slicing, shuffling and sharding of corpora."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passel.functions.ids import hash_bucket
from passel.session import materialise

# Up to this many rows a slice is taken by Spark's ordered limit, which merges on the driver.
ORDERED_LIMIT_ROWS = 10_000

# Fixed value: how a missing domain is shown in counts.
NULL_DOMAIN = "(null)"

_POSITION_BITS = 33


def merge_corpora(*corpora: DataFrame) -> DataFrame:
    """All corpora one under the other, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), corpora)


def with_row_index(
    df: DataFrame, order_by: Sequence[str], name: str = "row_index", total: str | None = None
) -> DataFrame:
    """Number all rows from 0 in key order without gathering them in one task.

    The rows are range-partitioned by the key, with a random last column so that equal keys spread
    over several partitions, sorted inside the partitions and stored. Rows per partition then give
    every partition its offset; there are at most as many offsets as shuffle partitions, which
    bounds what is broadcast. The stored copy keeps both passes on the same partitions after a lost
    executor.
    """
    columns = df.columns
    keys = [F.col(c) for c in order_by]
    ranged = (
        df.withColumn("_salt", F.rand(17))
        .repartitionByRange(*keys, "_salt")
        .sortWithinPartitions(*keys, "_salt")
    )
    # The identifier holds the partition number above its lower 33 bits, the row's place below.
    stored = materialise(ranged.select(*columns, F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", _POSITION_BITS)
    place = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(everything).alias("_total"),
    )
    numbered = stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    extra = [] if total is None else [F.col("_total").alias(total)]
    return numbered.select(*columns, (F.col("_before") + place).alias(name), *extra)


def first_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in key order; an error when there are fewer."""
    have = df.count()
    if have < n:
        raise ValueError(f"{n} rows requested, only {have} exist")
    if n <= ORDERED_LIMIT_ROWS:
        return df.orderBy(*order_by).limit(n)
    return with_row_index(df, order_by, "_row").where(F.col("_row") < n).drop("_row")


def shuffle_key(uid: Column, seed: int) -> Column:
    """A hash that orders rows as if at random, the same on every run."""
    return F.sha1(F.concat_ws(":", uid.cast("string"), F.lit(str(seed))))


def shuffle_corpus(df: DataFrame, uid: str = "uid", seed: int = 42) -> DataFrame:
    """Mix the domains: all rows in the order of a seeded hash.

    Rows that share a uid stand together in any order; the random last key lets the sort divide
    very many of them.
    """
    return df.withColumn("_salt", F.rand(17)).orderBy(shuffle_key(F.col(uid), seed), uid, "_salt").drop("_salt")


def shuffle_positions(df: DataFrame, uid: str = "uid", seed: int = 42, name: str = "position") -> DataFrame:
    """The place every row takes in the shuffled corpus."""
    keyed = df.withColumn("_key", shuffle_key(F.col(uid), seed))
    return with_row_index(keyed, ["_key", uid], name).drop("_key")


def hash_shards(df: DataFrame, n_shards: int, id_column: str = "id", name: str = "shard") -> DataFrame:
    """A shard number from the hash of the identifier."""
    return df.withColumn(name, hash_bucket(F.col(id_column), n_shards))


def contiguous_shards(df: DataFrame, n_shards: int, order_by: Sequence[str], name: str = "shard") -> DataFrame:
    """Equal runs of rows in key order; also gives ``row_index``."""
    numbered = with_row_index(df, order_by, "row_index", "_total")
    size = F.ceil(F.col("_total") / n_shards)
    return numbered.withColumn(name, F.floor(F.col("row_index") / size).cast("int")).drop("_total")


def assign_shards(
    df: DataFrame, n_shards: int, split: str = "hash", id_column: str = "id", order_by: Sequence[str] = ()
) -> DataFrame:
    """``hash`` or ``contiguous`` shards; a table without identifiers is always cut contiguously."""
    if split not in ("hash", "contiguous"):
        raise ValueError("split must be hash or contiguous")
    if split == "hash" and id_column in df.columns:
        return hash_shards(df, n_shards, id_column)
    return contiguous_shards(df, n_shards, order_by)


def domain_counts(df: DataFrame, shard: str = "shard", domain: str = "domain") -> DataFrame:
    """Rows per domain, in total (null shard) and per shard.

    The rows are counted once per (shard, domain); the grouping sets work on those few counts.
    """
    named = F.coalesce(F.col(domain).cast("string"), F.lit(NULL_DOMAIN))
    cells = df.groupBy(F.col(shard).alias("shard"), named.alias("domain")).agg(F.count("*").alias("_n"))
    shard_col, domain_col = F.col("shard"), F.col("domain")
    sets = cells.groupingSets([[shard_col, domain_col], [domain_col]], shard_col, domain_col)
    return sets.agg(F.sum("_n").alias("n"))


def shard_counts(df: DataFrame, n_shards: int, shard: str = "shard") -> DataFrame:
    """Rows per shard; a shard without rows is listed with 0.

    Rows without a shard, or with one that does not exist, are counted under a null shard.
    """
    number = F.col(shard).cast("int")
    rows = df.select(F.when(number.between(0, n_shards - 1), number).alias("shard"), F.lit(1).alias("_n"))
    every = df.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).alias("_n"))
    return rows.unionAll(every).groupBy("shard").agg(F.sum("_n").alias("n"))


def shard_manifest(
    df: DataFrame, n_shards: int, metric: str = "ip", normalized: bool = True, split: str = "hash",
    embedding: str = "embedding", shard: str = "shard", domain: str = "domain",
) -> DataFrame:
    """One row per shard with its size and domain counts beside the totals of the corpus."""
    per_domain = df.groupBy(
        F.col(shard).cast("int").alias("shard"),
        F.coalesce(F.col(domain).cast("string"), F.lit(NULL_DOMAIN)).alias("_domain"),
    ).agg(F.count("*").alias("_n"), F.max(F.size(embedding)).alias("_dim"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("_domain", "_n"))))
    per_shard = per_domain.groupBy("shard").agg(
        F.sum("_n").alias("n"), entries.alias("domain_counts"), F.max("_dim").alias("_dim")
    )
    every = df.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    none = F.create_map().cast("map<string,bigint>")
    whole = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return every.join(per_shard, "shard", "left").select(
        F.lpad(F.col("shard").cast("string"), 3, "0").alias("id"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("domain_counts", none).alias("domain_counts"),
        F.sum(F.coalesce("n", F.lit(0))).over(whole).alias("n_total"),
        F.lit(n_shards).alias("n_shards"),
        F.max("_dim").over(whole).alias("dim"),
        F.lit(normalized).alias("normalized"),
        F.lit(metric).alias("index_metric"),
        F.lit(split).alias("split_strategy"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
    )
