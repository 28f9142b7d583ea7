"""Rounding of reported figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_report(value: Column, decimals: int) -> Column:
    """Round half to even on the exact binary value.

    ``bround`` works on the shortest decimal spelling and sees ties where the number itself lies a
    little above or below one; formatting does not. Values that are not finite stay as they are.
    """
    pattern = "0." + "0" * decimals if decimals else "0"
    finite = F.abs(value.cast("double")) < float("inf")
    return F.when(finite, F.call_function("format_number", value, F.lit(pattern)).try_cast("double")).otherwise(value.cast("double"))
