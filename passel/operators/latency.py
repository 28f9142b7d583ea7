"""Latency, throughput and comparison tables over timing logs and run summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passel.functions.numbers import round_report
from passel.functions.vectors import score_type
from passel.session import broadcast_if_small

# The percentiles reported and the decimals of the report.
PERCENTILES = {"p50_ms": 50.0, "p90_ms": 90.0}
SUMMARY_DECIMALS = 2
TOTAL_DECIMALS = 1

SKETCH_ACCURACY = 10_000
# Items a KLL sketch keeps at its largest level; ranks are then off by about 0.4 % of the values.
SKETCH_ITEMS = 800


def _same_keys(n: int, left: str, right: str) -> Column:
    return reduce(and_, [F.col(f"{left}{i}").eqNullSafe(F.col(f"{right}{i}")) for i in range(n)])


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percentiles: Mapping[str, float] = PERCENTILES,
    method: str = "linear",
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Exact percentiles per group without gathering a group in one task.

    ``linear`` interpolates at rank (n-1)p; ``nearest`` takes the element at floor(n p). A group
    without values gives 0.

    A sketch first brackets every percentile. Values below the bracket are only counted, values
    inside it are counted per distinct value, both map-side, and the wanted ranks are read off the
    running count. Groups of up to ``accuracy`` rows are not bracketed. Should a rank ever fall
    outside its bracket, the job fails rather than return an approximate value.
    """
    return _figures(df, keys, value, percentiles, method, accuracy).drop("_n", "_total")


def _figures(
    df: DataFrame, keys: Sequence[str], value: str, percentiles: Mapping[str, float], method: str, accuracy: int
) -> DataFrame:
    """Keys, number of values ``_n``, their sum ``_total`` and the percentiles."""
    if method not in ("linear", "nearest"):
        raise ValueError("method must be linear or nearest")
    fractions = {name: p / 100.0 for name, p in percentiles.items()}
    group = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(c).alias(g) for c, g in zip(keys, group)], F.col(value).cast("double").alias("_v"))
    cells = _bracketed_counts(rows, group, list(fractions.values()), accuracy)
    before = Window.partitionBy(*group, "i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, -1)
    running = cells.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))

    def value_at(i: int, rank: Column) -> Column:
        covers = (F.col("i") == i) & (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c"))
        return F.max(F.when(covers, F.col("v")))

    n = F.col("_n")
    ends = []
    for i, fraction in enumerate(fractions.values()):
        place = n * F.lit(fraction) if method == "nearest" else (n - 1) * F.lit(fraction)
        first = F.least(F.floor(place), n - 1)
        second = first if method == "nearest" else F.ceil(place)
        ends += [value_at(i, first).alias(f"_first{i}"), value_at(i, second).alias(f"_second{i}")]
    found = running.groupBy(*group, "_n", "_total").agg(*ends)
    out = []
    for i, (name, fraction) in enumerate(fractions.items()):
        a, b = F.col(f"_first{i}"), F.col(f"_second{i}")
        place = (n - 1) * F.lit(fraction)
        share = place - F.floor(place)
        exact = a if method == "nearest" else F.when(share == 0, a).otherwise(a * (1 - share) + b * share)
        missed = F.raise_error(F.lit("percentile rank outside its bracket")).cast("double")
        out.append(F.when(n == 0, 0.0).when(a.isNull() | b.isNull(), missed).otherwise(exact).alias(name))
    return found.select(*[F.col(g).alias(c) for g, c in zip(group, keys)], "_n", "_total", *out)


def _bracketed_counts(rows: DataFrame, group: list[str], fractions: list[float], accuracy: int) -> DataFrame:
    """Counts ``_c`` per group, percentile number ``i`` and value ``v`` near the percentile.

    A null value stands for everything below the bracket. Entry -1 stands for the group itself, so
    that one without values stays in the result.
    """
    margin = 6.0 / accuracy
    bounds = [bound for f in fractions for bound in (max(0.0, f - margin), min(1.0, f + margin))]
    sketch = rows.groupBy(*[F.col(g).alias(f"_s{i}") for i, g in enumerate(group)]).agg(
        F.count("_v").alias("_n"),
        F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_total"),
        F.percentile_approx("_v", F.array(*[F.lit(b) for b in bounds]), accuracy).alias("_bounds"),
    )
    if group:
        keyed = rows.join(broadcast_if_small(sketch), _same_keys(len(group), "_k", "_s"))
    else:
        n, total, found = sketch.first()
        keyed = rows.select(
            "_v",
            F.lit(n).alias("_n"),
            F.lit(total).alias("_total"),
            F.array(*[F.lit(b) for b in found or []]).cast("array<double>").alias("_bounds"),
        )
    v, known, small = F.col("_v"), F.col("_v").isNotNull(), F.col("_n") <= accuracy
    no_value = F.lit(None).cast("double").alias("v")
    entries = [F.struct(F.lit(-1).alias("i"), no_value)]
    for i in range(len(fractions)):
        low, high = F.get("_bounds", F.lit(2 * i)), F.get("_bounds", F.lit(2 * i + 1))
        number = F.lit(i).alias("i")
        below = F.when(known & ~small & (v < low), F.struct(number, no_value))
        entries.append(below.when(known & (small | (v <= high)), F.struct(number, v.alias("v"))))
    listed = keyed.select(*group, "_n", "_total", F.explode(F.array(*entries)).alias("_e")).where("_e is not null")
    return listed.groupBy(*group, "_n", "_total", "_e.i", "_e.v").agg(F.count("*").alias("_c"))


def run_sketches(df: DataFrame, keys: Sequence[str], value: str, items: int = SKETCH_ITEMS) -> DataFrame:
    """``n``, ``total`` and a KLL ``sketch`` of the values of each group, to be stored beside the group's log.

    Sketches of a few kilobytes take the place of the log in every later rollup. Nulls and values that are not
    numbers are left out.
    """
    known = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return df.withColumn("_v", known).groupBy(*keys).agg(
        F.count("_v").alias("n"),
        F.coalesce(F.sum("_v"), F.lit(0.0)).alias("total"),
        F.kll_sketch_agg_double("_v", F.lit(items)).alias("sketch"),
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str], items: int = SKETCH_ITEMS) -> DataFrame:
    """Stored sketches of finer groups merged into those of coarser ones; merging may go on upward in any order."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", F.lit(items)).alias("sketch")
    )


def sketch_percentiles(
    sketches: DataFrame, keys: Sequence[str], percentiles: Mapping[str, float] = PERCENTILES
) -> DataFrame:
    """Percentiles read off sketches, close to the exact ones in rank; a group without values gives 0.

    :func:`exact_percentiles` stays the way to exact figures.
    """
    found = [
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100.0))).otherwise(F.lit(0.0)).alias(name)
        for name, p in percentiles.items()
    ]
    return sketches.select(*keys, "n", *found)


def throughput(n: Column, total_ms: Column) -> Column:
    """Queries per second; 0 when no time has passed."""
    return F.when(total_ms > 0, n / (total_ms / 1000.0)).otherwise(0.0)


def latency_summary(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    metric: Column | None = None,
    method: str = "linear",
    decimals: int = SUMMARY_DECIMALS,
    total_decimals: int = TOTAL_DECIMALS,
) -> DataFrame:
    """Count, mean, percentiles, total and throughput per group, rounded half to even."""
    figures = _figures(df, keys, value, PERCENTILES, method, SKETCH_ACCURACY)
    n, total = F.col("_n"), F.col("_total")
    tag = [] if metric is None else [score_type(metric).alias("score_type")]
    return figures.select(
        *keys,
        n.alias("n_queries"),
        round_report(F.coalesce(F.try_divide(total, n), F.lit(0.0)), decimals).alias("avg_ms"),
        *[round_report(F.col(p), decimals).alias(p) for p in PERCENTILES],
        round_report(throughput(n, total), decimals).alias("qps"),
        round_report(total, total_decimals).alias("total_elapsed_ms"),
        *tag,
    )


def summary_pivot(
    summaries: DataFrame, value: str, backends: Sequence[str], index: Sequence[str] = ("domain", "size")
) -> DataFrame:
    """One column per backend; the backends are named so that no extra job looks for them.

    A backend that is not named fails the job.
    """
    unnamed = F.raise_error(F.concat(F.lit("backend not named: "), "backend")).cast("string")
    known = F.col("backend").isNull() | F.col("backend").isin(*backends)
    checked = summaries.withColumn("backend", F.when(known, F.col("backend")).otherwise(unnamed))
    return checked.groupBy(*index).pivot("backend", list(backends)).agg(F.first(value, ignorenulls=True))


def domain_gap(
    summaries: DataFrame, single: str, multi: str, value: str = "p50_ms"
) -> DataFrame:
    """A measure of the single- and the multi-domain corpus side by side, their difference and ratio."""
    one = F.max(F.when(F.col("domain") == single, F.col(value)))
    many = F.max(F.when(F.col("domain") == multi, F.col(value)))
    both = summaries.groupBy("backend", "size").agg(one.alias("single"), many.alias("multi"))
    return both.select(
        "backend",
        "size",
        "single",
        "multi",
        (F.col("multi") - F.col("single")).alias("gap"),
        F.try_divide("multi", "single").alias("ratio"),
    )


def system_row(summary: DataFrame, system: str, kind: str, with_retrieval: bool) -> DataFrame:
    """A summary as a row of the system comparison; end-to-end fields fall back to the plain ones."""
    have = summary.columns

    def field(*names: str) -> Column:
        return F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None)).cast("double")

    def retrieval(name: str) -> Column:
        return field(name) if with_retrieval else F.lit(None).cast("double")

    return summary.select(
        F.lit(system).alias("system"),
        F.lit(kind).alias("type"),
        field("llm_p50_ms", "p50_ms").alias("lat_p50_ms"),
        field("llm_avg_ms", "avg_ms").alias("lat_avg_ms"),
        field("llm_qps", "qps").alias("qps"),
        retrieval("p50_ms").alias("retrieval_p50_ms"),
        retrieval("avg_ms").alias("retrieval_avg_ms"),
    )


def system_comparison(small: DataFrame, big: DataFrame, small_name: str, big_name: str) -> DataFrame:
    """Two systems under each other: a small one with retrieval, a big one without."""
    return system_row(small, small_name, "small+rag", True).unionAll(system_row(big, big_name, "big_no_rag", False))
