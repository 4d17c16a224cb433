"""Control over plans where the optimizer would make them worse."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_numbers = count()


def settled(df: DataFrame, name: str) -> DataFrame:
    """Keeps later filters from being rewritten in terms of what lies below ``df``; counts its rows as a metric.

    Exact rounding names its argument a dozen times. Projections are merged only as long as nothing
    is computed twice, but a filter pushed through a chain of them writes every step out within the
    next: ten to the power of the steps. An observed row count stops the push, costs one addition a
    row, and works on streams.
    """
    return df.observe(f"{name}_{next(_numbers)}", F.count(F.lit(1)).alias("rows"))
