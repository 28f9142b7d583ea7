"""Run summaries and hit logs."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passel.functions.ids import RUN_SUFFIX, parse_run_name
from passel.schema import HIT_LOG_COLUMNS, MERGED_HIT_COLUMNS, RUN_SUMMARY
from passel.session import broadcast_if_small

# Fixed value: how a run identifier spells its start time.
RUN_TIME = "yyyyMMdd-HHmmss"


def read_run_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*_bench_summary.json`` below a folder, with what its name says.

    Names without a known size keep null ``backend`` and ``size``.
    """
    files = (
        spark.read.schema(RUN_SUMMARY)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*" + RUN_SUFFIX)
        .json(folder)
    )
    path = F.col("_metadata.file_path")
    named = files.select(path.alias("path"), parse_run_name(path).alias("_run"), *files.columns)
    return named.select(
        "path",
        "_run.domain",
        "_run.backend",
        "_run.size_label",
        "_run.size",
        "_run.size_k",
        F.col("avg_ms").alias("retrieval_avg_ms"),
        F.col("p50_ms").alias("retrieval_p50_ms"),
        F.col("p90_ms").alias("retrieval_p90_ms"),
        "qps",
        "llm_avg_ms",
        "llm_p50_ms",
        "llm_p95_ms",
        "llm_qps",
    )


def require_run_sizes(summaries: DataFrame) -> DataFrame:
    """Fail the job when a run name carries no known size."""
    named = F.when(F.col("size").isNull(), F.raise_error(F.concat(F.lit("no run size in "), "path")))
    return summaries.withColumn("size", F.coalesce(named.cast("int"), F.col("size")))


def run_id(started: Column | None = None, fingerprint: Column | None = None) -> Column:
    """``<time>`` or ``<time>-<fingerprint>``."""
    time = F.date_format(F.current_timestamp() if started is None else started, RUN_TIME)
    return time if fingerprint is None else F.concat_ws("-", time, fingerprint)


def append_summary(summary: DataFrame, folder: str) -> None:
    """Add run records under ``index_key=…/run_id=…``; a run that is written again replaces itself and no other."""
    writer = summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("index_key", "run_id").json(folder)


def write_run_summaries(summaries: DataFrame, folder: str, file_name: str = "file_name") -> None:
    """One ``<name>_bench_summary.json`` for each run, below a folder of its domain, named by the column ``file_name``.

    The rows of a run, one, are written by its task; afterwards each file gets its name. The driver handles as many
    names as there are runs.
    """
    spark = summaries.sparkSession
    staged = f"{folder}/_staged"
    summaries.repartition(F.col(file_name)).write.mode("overwrite").partitionBy(file_name).json(staged)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path_of(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for run in files.listStatus(path_of(staged)):
        if run.isDirectory():
            name = unquote(run.getPath().getName().split("=", 1)[1])
            target = path_of(f"{folder}/{name.split('_', 1)[0]}")
            files.mkdirs(target)
            part = next(f.getPath() for f in files.listStatus(run.getPath()) if f.getPath().getName().startswith("part-"))
            files.rename(part, path_of(target, name))
    files.delete(path_of(staged), True)


def write_hits(hits: DataFrame, path: str, form: str = "jsonl") -> None:
    """Write a hit log in the fixed column order as ``jsonl``, ``csv`` or not at all (``none``)."""
    ordered = hits.select(*HIT_LOG_COLUMNS)
    if form == "jsonl":
        ordered.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif form == "csv":
        ordered.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif form != "none":
        raise ValueError("form must be jsonl, csv or none")


def write_merged_hits(hits: DataFrame, path: str) -> None:
    """Write merged results as CSV, ordered by query and rank, then uid for repeated queries."""
    merged = hits.select(*MERGED_HIT_COLUMNS).orderBy("query", "rank", "uid")
    merged.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def latest_run(log: DataFrame, key: str, started: str) -> DataFrame:
    """All rows of the latest run of every key, ties included.

    The latest times come from a partial aggregation and are broadcast back within a checked bound,
    so the rows of a key that holds most of the log never meet in one task.
    """
    newest = broadcast_if_small(log.groupBy(F.col(key).alias("_key")).agg(F.max(started).alias("_newest")))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col(started) == F.col("_newest"))
    return log.join(newest, same, "left_semi")


def _folders(spark: SparkSession, path: str, column: str) -> dict[str, str]:
    """The partition folders of a column below a path: value and full path."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path_of(path)):
        return {}
    found = [f.getPath() for f in files.listStatus(path_of(path)) if f.isDirectory()]
    named = [(p.getName().split("=", 1), p.toString()) for p in found if "=" in p.getName()]
    return {unquote(name[1]): full for name, full in named if name[0] == column}


def read_latest_run(spark: SparkSession, folder: str, index_key: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The newest run of an index in a folder written by :func:`append_summary`, with its ``index_key`` and ``run_id``.

    The folder's listing tells which run is the newest, and no file of an older one is opened. Without a ``schema``, such
    as ``RUN_SUMMARY``, it is inferred from the newest run alone.
    """
    runs = _folders(spark, _folders(spark, folder, "index_key").get(index_key, f"{folder}/index_key={index_key}"), "run_id")
    if not runs:
        raise FileNotFoundError(f"no run of {index_key!r} in {folder}")
    newest = max(runs)
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.json(runs[newest]).drop("index_key", "run_id")
    return rows.withColumns({"index_key": F.lit(index_key), "run_id": F.lit(newest)})


def read_hits(spark: SparkSession, path: str, form: str = "jsonl") -> DataFrame:
    if form == "jsonl":
        return spark.read.json(path)
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)

