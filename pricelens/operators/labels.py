"""Good-deal labels (W22, W23) and the model matrix fill.

The group quantile is an aggregate joined back on the group key rather than an
unordered window: the aggregate is combined map-side, so a hot (entity, week)
group is reduced before the shuffle, and AQE can split the skewed side of the
join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggs import quantile
from ..schema import DEFAULT_COLS, FEATURE_COLUMNS, Cols
from .market import time_window
from .order_stats import group_quantiles, join_null_safe

GOOD_DEAL_QUANTILE = 0.2  # fixed value: cheapest 20 % of the market


def with_label(df: DataFrame, price: str, threshold: str, label: str) -> DataFrame:
    """1 where the price is at most the row's threshold, else 0."""
    return df.withColumn(label, F.coalesce((F.col(price) <= F.col(threshold)).cast("int"), F.lit(0)))


def _group_quantile_label(df: DataFrame, keys: list[str], price: str, q: float, stat: str, label: str,
                          approx: bool = False) -> DataFrame:
    g = df.groupBy(*keys).agg(quantile(price, q, approx=True).alias(stat)) if approx else group_quantiles(df, keys, price, {stat: q})
    return with_label(join_null_safe(df, g, keys), price, stat, label)


def with_good_deal_label(df: DataFrame, cols: Cols = DEFAULT_COLS, q: float = GOOD_DEAL_QUANTILE,
                         approx: bool = False) -> DataFrame:
    """``current_market_p20`` of (entity, week) and ``is_good_deal`` = price <= it."""
    if cols.time_window not in df.columns:
        df = df.withColumn(cols.time_window, time_window(cols.wall))
    return _group_quantile_label(df, [*cols.entity, cols.time_window], cols.price, q,
                                 "current_market_p20", cols.label, approx)


def with_good_price(df: DataFrame, cols: Cols = DEFAULT_COLS, q: float = GOOD_DEAL_QUANTILE,
                    approx: bool = False) -> DataFrame:
    """Whole-entity quantile label (``good_price``)."""
    return _group_quantile_label(df, list(cols.entity), cols.price, q, "price_threshold", "good_price", approx)


def fill_features(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, value: float = 0.0) -> DataFrame:
    """Model matrix fill: missing feature values become ``value`` (the reference's ``fillna(0)``)."""
    present = [c for c in features if c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(value)) for c in present})
