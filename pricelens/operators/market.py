"""Market-level rollups: price trends, weekly market stats, price patterns,
probability curves.

All are grouped aggregates: Spark plans them as partial aggregate ->
hash shuffle on the group key -> final aggregate, so a hot key is combined
map-side before it crosses the network.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggs import nrows
from ..schema import DEFAULT_COLS, Cols
from .order_stats import agg_with_quantiles
from .profile import top_entities


# A1 ------------------------------------------------------------------------
def price_trends(df: DataFrame, cols: Cols = DEFAULT_COLS) -> DataFrame:
    """Mean, median, std, count and coefficient of variation of price per day-until-event."""
    p = F.col(cols.price)
    out = agg_with_quantiles(df, [cols.days], cols.price, {"median_price": 0.5},
                             F.avg(p).alias("avg_price"), F.stddev_samp(p).alias("std_price"),
                             F.count(p).alias("ticket_count"))
    out = out.withColumn("price_volatility", F.try_divide(F.col("std_price"), F.col("avg_price")))
    return out.orderBy(cols.days)


# A2 ------------------------------------------------------------------------
def trend_maps(trends: DataFrame, name: str = "All Events", cols: Cols = DEFAULT_COLS) -> DataFrame:
    """One row per trend table: day -> mean price and day -> count maps.

    The input has one row per distinct day, so the collected list is bounded
    by the number of distinct days, not by the data size.
    """
    d = F.col(cols.days)
    entries = F.array_sort(F.collect_list(F.struct(d.alias("k"), F.col("avg_price").alias("p"),
                                                   F.col("ticket_count").alias("n"))))
    return (trends.agg(entries.alias("e"))
            .select(F.lit(name).alias("event_key"),
                    F.map_from_entries(F.transform("e", lambda x: F.struct(x["k"], x["p"]))).alias("prices"),
                    F.map_from_entries(F.transform("e", lambda x: F.struct(x["k"], x["n"]))).alias("counts")))


def trend_maps_long(maps: DataFrame) -> DataFrame:
    """Inverse of ``trend_maps`` (F10): one row per (key, day)."""
    return (maps.select("event_key", F.explode("prices").alias("days_until_event", "avg_price"), "counts")
            .select("event_key", "days_until_event", "avg_price",
                    F.element_at("counts", F.col("days_until_event")).alias("ticket_count")))


# W17 -----------------------------------------------------------------------
def time_window(wall, width: str = "7 days"):
    """Start of the fixed-width bucket holding ``wall`` (aligned to 1970-01-01)."""
    return F.window(F.col(wall) if isinstance(wall, str) else wall, width).start


# A7 ------------------------------------------------------------------------
def market_stats(df: DataFrame, cols: Cols = DEFAULT_COLS, extra: Mapping[str, float] | None = None) -> DataFrame:
    """Median price, non-null price count and ``extra`` quantiles per (entity, weekly bucket)."""
    keys = [*cols.entity, cols.time_window]
    if cols.time_window not in df.columns:
        df = df.withColumn(cols.time_window, time_window(cols.wall))
    return agg_with_quantiles(df, keys, cols.price, {"market_median": 0.5, **(extra or {})},
                              F.count(cols.price).alias("market_size"))


# A8 ------------------------------------------------------------------------
def price_patterns(df: DataFrame, month: str = "event_month", top_n: int = 20,
                   cols: Cols = DEFAULT_COLS) -> DataFrame:
    """Price mean/std/min/max/count per (entity, month) over the top-N entities by rows."""
    top = top_entities(df, top_n, cols=cols).select(*cols.entity)
    sub = df.join(F.broadcast(top), list(cols.entity), "left_semi")  # N rows: bounded by top_n
    p = F.col(cols.price)
    return sub.groupBy(*cols.entity, month).agg(
        F.avg(p).alias("mean_price"), F.stddev_samp(p).alias("std_price"),
        F.min(p).alias("min_price"), F.max(p).alias("max_price"), F.count(p).alias("n"))


# A9 ------------------------------------------------------------------------
def entity_summary(df: DataFrame, cols: Cols = DEFAULT_COLS) -> DataFrame:
    """Mean, std, count, min and max of price per entity, dearest first."""
    p = F.col(cols.price)
    out = df.groupBy(*cols.entity).agg(
        F.avg(p).alias("mean_price"), F.stddev_samp(p).alias("std_price"),
        nrows().alias("n"), F.min(p).alias("min_price"), F.max(p).alias("max_price"))
    return out.orderBy(F.desc("mean_price"), *cols.entity)


def month_distribution(df: DataFrame, month: str = "event_month", cols: Cols = DEFAULT_COLS) -> DataFrame:
    return df.groupBy(*cols.entity, month).agg(nrows().alias("n"))


# A10 / A11 ------------------------------------------------------------------
MONTHS = list(range(1, 13))


def crosstab_months(df: DataFrame, rows: list[str] | str, month: str, fill: int = 0) -> DataFrame:
    """Count per (rows, month) pivoted to 12 month columns m01..m12, zero-filled.

    The pivot values are given, so Spark skips the extra distinct-values job
    and plans one aggregate.
    """
    rows = [rows] if isinstance(rows, str) else list(rows)
    out = df.groupBy(*rows).pivot(month, MONTHS).agg(nrows())
    ren = {str(m): f"m{m:02d}" for m in MONTHS}
    out = out.select(*rows, *[F.coalesce(F.col(k), F.lit(fill)).cast("bigint").alias(v) for k, v in ren.items()])
    return out


def crosstab_month_by_month(df: DataFrame, row_month: str, col_month: str) -> DataFrame:
    """12 x 12 crosstab, every month present on both axes (J3 scaffold)."""
    ct = crosstab_months(df.where(F.col(row_month).isNotNull()), row_month, col_month)
    scaffold = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias(row_month))
    out = F.broadcast(scaffold).join(ct, row_month, "left")  # 12 rows: fixed size
    return out.na.fill(0, [f"m{m:02d}" for m in MONTHS])


# A22 -----------------------------------------------------------------------
def probability_by_day(scores: DataFrame, days: str = "days_until_event",
                       by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean, std and count of predicted probability per model and day."""
    pr = F.col("probability")
    return scores.groupBy(*by, days).agg(F.avg(pr).alias("mean_probability"),
                                         F.stddev_samp(pr).alias("std_probability"),
                                         F.count(pr).alias("count"))


# A23 -----------------------------------------------------------------------
def probability_summary(curve: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean and std of the per-day means, total samples and number of days."""
    return curve.groupBy(*by).agg(F.avg("mean_probability").alias("avg_probability"),
                                  F.stddev_samp("mean_probability").alias("std_probability"),
                                  F.sum("count").alias("total_samples"),
                                  nrows().alias("unique_days"))


# W25 -----------------------------------------------------------------------
def best_day(curve: DataFrame, value: str = "mean_probability", days: str = "days_until_event",
             n: str = "count", min_n: int = 5, max_day: int | None = None,
             by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Day with the highest value among days with at least ``min_n`` samples.

    Ties go to the smallest day (first in day order). Uses a per-group
    ``row_number() = 1`` that Spark runs as a WindowGroupLimit.
    """
    c = curve.where(F.col(n) >= min_n)
    if max_day is not None:
        c = c.where(F.col(days) <= max_day)
    w = Window.partitionBy(*by).orderBy(F.desc(value), F.asc(days))
    return (c.withColumn("_rk", F.row_number().over(w)).where("_rk = 1")
            .select(*by, F.col(days).alias("best_day"), F.col(value).alias("best_value")))
