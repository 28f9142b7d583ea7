"""Vector arithmetic on array columns, and the names of the similarity measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of the three measures and the smallest norm divided by.
METRIC_ALIASES = {
    "cos": "cosine",
    "cosine": "cosine",
    "cos_sim": "cosine",
    "ip": "ip",
    "inner": "ip",
    "inner_product": "ip",
    "l2": "l2",
    "euclidean": "l2",
}
NORM_FLOOR = 1e-12
UNIT_TOLERANCE = 1e-3


def canonical_metric(name: str) -> str:
    """``ip``, ``cosine`` or ``l2`` for any accepted spelling."""
    key = name.strip().lower()
    if key not in METRIC_ALIASES:
        raise ValueError(f"unknown metric {name!r}; use one of {sorted(METRIC_ALIASES)}")
    return METRIC_ALIASES[key]


def score_type(metric: Column) -> Column:
    """``similarity`` for ip and cosine, ``distance`` for everything else."""
    return F.when(F.lower(metric).isin("ip", "cosine"), "similarity").otherwise("distance")


def distance_to_similarity(distance: Column) -> Column:
    return 1.0 - distance


def norm(vector: Column) -> Column:
    """Euclidean length, summed in double precision."""
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def normalize_vector(vector: Column) -> Column:
    """The vector over its length, the length floored so that a zero vector stays zero.

    The length is repeated into an array first; inside the lambda it would be summed again for
    every element.
    """
    lengths = F.array_repeat(F.greatest(norm(vector), F.lit(NORM_FLOOR)), F.size(vector))
    return F.zip_with(vector, lengths, lambda x, n: x.cast("double") / n)


def as_float_vector(vector: Column) -> Column:
    return vector.cast("array<float>")
