"""Aggregate-expression helpers.

Exact quantiles use ``percentile`` (linear interpolation between order
statistics, the same rule as pandas ``quantile`` and DuckDB
``quantile_cont``). It supports partial aggregation: each map task keeps a
value -> count map, so a hot key is pre-aggregated before the shuffle.
``approx=True`` swaps in ``percentile_approx`` (a bounded-size sketch) where
an exact answer is not required.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quantile(c, p, approx: bool = False, accuracy: int = 10_000) -> Column:
    if approx:
        return F.percentile_approx(_c(c), F.lit(p), F.lit(accuracy)).cast("double")
    return F.percentile(_c(c), F.lit(p))


def median(c, approx: bool = False) -> Column:
    return quantile(c, 0.5, approx=approx)


def nrows() -> Column:
    return F.count(F.lit(1))
