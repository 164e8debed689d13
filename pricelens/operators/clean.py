"""Cleaning and quality rules: row filters, outliers, duplicates, quality report.

Group statistics are attached to rows with an aggregate followed by an
equi-join on the group key (never an unordered window): the aggregate is
combined map-side, and the join is planned by AQE, which broadcasts the
group table when its measured size is small and otherwise splits skewed
partitions of the row side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.aggs import nrows
from ..schema import DEFAULT_COLS, Cols
from .order_stats import agg_with_quantiles
from .profile import attach_quantiles


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# Typed projection of raw listing records ------------------------------
def typed_listings(raw: DataFrame, tz: str | None = None, strict: bool = True, nonexistent: str = "raise") -> DataFrame:
    """Coerce a raw listing table (``timestamp`` text, ``row`` text, keys from file name).

    Adds ``listing_time`` (wall clock, TIMESTAMP_NTZ), optionally ``listing_ts``
    (UTC instant) when ``tz`` is given, days/hours until the event and the
    calendar columns.
    """
    df = raw.withColumns({
        "quantity": S.coerce_numeric("quantity", "int"),
        "price": S.coerce_numeric("price", "double"),
        "row": S.coerce_numeric("row", "double"),
        "listing_time": S.parse_listing_time("timestamp", strict=strict),
    })
    ts = "listing_time"
    if tz:
        df = df.withColumn("listing_ts", S.localize("listing_time", tz, nonexistent))
        df = df.withColumn("event_ts", S.localize("event_date", tz, nonexistent))
        days = S.days_until("event_ts", "listing_ts")
        hours = S.hours_until("event_ts", "listing_ts")
    else:
        days = S.days_until("event_date", ts)
        hours = S.hours_until("event_date", ts)
    return df.withColumns({
        "days_until_event": days,
        "hours_until_event": hours,
        "day_of_week": S.day_of_week("event_date"),
        "is_weekend_event": S.is_weekend("event_date"),
        "event_month": F.month("event_date"),
        "event_year": F.year("event_date"),
        "listing_month": F.month(ts),
    })


# P8 / P9 / P10 / P11 / P12 / P16 / P18 -----------------------------------------
def filter_nonneg_days(df: DataFrame, cols: Cols = DEFAULT_COLS) -> DataFrame:
    return df.where(F.col(cols.days) >= 0)


def filter_valid(df: DataFrame, cols: Cols = DEFAULT_COLS) -> DataFrame:
    """Keep rows with quantity > 0 and price > 0 (null fails both tests)."""
    return df.where((F.col(cols.quantity) > 0) & (F.col(cols.price) > 0))


def filter_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def filter_ne_nullsafe(df: DataFrame, col: str, value) -> DataFrame:
    """``col != value`` that keeps nulls."""
    return df.where(~F.col(col).eqNullSafe(F.lit(value)))


def temporal_issues(df: DataFrame, cols: Cols = DEFAULT_COLS) -> DataFrame:
    return df.where(F.col(cols.ts) > F.col(cols.event_date))


def reliable(df: DataFrame, n: str = "n", min_n: int = 5) -> DataFrame:
    return df.where(F.col(n) >= min_n)


# P13 ------------------------------------------------------------------------
def global_outliers(df: DataFrame, col: str = "price", k: float = 1.5) -> DataFrame:
    """Rows outside [Q1 - k IQR, Q3 + k IQR] of the whole column."""
    d, q = attach_quantiles(df, "_iqr", col, (0.25, 0.75))
    iqr = q[1] - q[0]
    v = F.col(col)
    return d.where((v < q[0] - F.lit(k) * iqr) | (v > q[1] + F.lit(k) * iqr)).drop("_iqr")


# P14 / P15 ------------------------------------------------------------------
def group_quartiles(df: DataFrame, by, col: str = "price", k: float = 1.5) -> DataFrame:
    g = agg_with_quantiles(df, _list(by), col, {"q1": 0.25, "q3": 0.75}, F.min(col).alias("min"), F.max(col).alias("max"),
                           F.count(col).alias("n"))
    iqr = F.col("q3") - F.col("q1")
    return g.select(*_list(by), "q1", "q3", iqr.alias("iqr"), (F.col("q1") - F.lit(k) * iqr).alias("lower"),
                    (F.col("q3") + F.lit(k) * iqr).alias("upper"), "min", "max", "n")


def iqr_filter(df: DataFrame, by=DEFAULT_COLS.entity, col: str = "price", k: float = 1.5) -> DataFrame:
    """Keep rows within their group's [Q1 - k IQR, Q3 + k IQR] (inclusive)."""
    b = group_quartiles(df, by, col, k).select(*_list(by), "lower", "upper")
    v = F.col(col)
    return (df.join(b, _list(by)).where((v >= F.col("lower")) & (v <= F.col("upper")))
            .drop("lower", "upper"))


def low_outlier_report(df: DataFrame, by=DEFAULT_COLS.entity, col: str = "price", k: float = 1.5) -> DataFrame:
    """Per group: min, max, IQR, lower bound and the number of values below it."""
    b = group_quartiles(df, by, col, k)
    below = (df.select(*_list(by), col).join(b.select(*_list(by), "lower"), _list(by))
             .groupBy(*_list(by)).agg(F.count_if(F.col(col) < F.col("lower")).alias("n_below")))
    return b.select(*_list(by), "min", "max", "iqr", "lower").join(below, _list(by))


# U2 -------------------------------------------------------------------------
def split_overlaps(df: DataFrame, key, split: str = "split") -> DataFrame:
    """(split_a, split_b, n_shared) for keys found in two splits; empty when disjoint."""
    pairs = df.select(*_list(key), split).distinct()
    a = pairs.withColumnRenamed(split, "split_a")
    b = pairs.withColumnRenamed(split, "split_b")
    return (a.join(b, _list(key)).where(F.col("split_a") < F.col("split_b"))
            .groupBy("split_a", "split_b").agg(nrows().alias("n_shared")))


def assert_disjoint(df: DataFrame, key, split: str = "split") -> None:
    """Raise if any key appears in more than one split (runs one job)."""
    bad = df.groupBy(*_list(key)).agg(F.count_distinct(split).alias("k")).where("k > 1").limit(1).count()
    if bad:
        raise AssertionError("data leakage: a key appears in more than one split")


# U3 -------------------------------------------------------------------------
def missing_features(spark, expected: Sequence[str], actual: Sequence[str]) -> DataFrame:
    """Expected names that are absent from ``actual``, sorted."""
    e = spark.createDataFrame([(x,) for x in expected], "feature string")
    a = spark.createDataFrame([(x,) for x in actual], "feature string")
    return e.join(a, "feature", "left_anti").orderBy("feature")


def inputs_without_values(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected names that are no column of ``df`` or hold no value in any of its rows, sorted."""
    counts = df.agg(*[(F.count(c) if c in df.columns else F.lit(0)).alias(f"c{i}") for i, c in enumerate(expected)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").cast("long").alias("n")) for i, c in enumerate(expected)])
    return counts.select(F.inline(pairs)).where("n = 0").select("feature").orderBy("feature")


# U4 / U5 / U6 ---------------------------------------------------------------
def drop_exact_duplicates(df: DataFrame, subset=None) -> DataFrame:
    return df.dropDuplicates(_list(subset)) if subset else df.dropDuplicates()


EXPAND_CHUNK = 1_000_000  # copies emitted per task when duplicates are expanded


def duplicates_after_first(df: DataFrame, expand: bool = False, chunk: int = EXPAND_CHUNK) -> DataFrame:
    """Exact-duplicate rows beyond the first copy.

    Default: one row per duplicated record with ``n_extra`` copies (a
    map-side-combined aggregate). ``expand=True`` emits the extra copies: the
    count is first cut into pieces of at most ``chunk`` copies, the pieces are
    hash-distributed, and each task expands only its pieces, so a record
    repeated a billion times is not written out by one task.
    """
    cols = df.columns
    g = df.groupBy(*cols).agg(nrows().alias("_n")).where("_n > 1")
    if not expand:
        return g.select(*cols, (F.col("_n") - 1).alias("n_extra"))
    extra = F.col("_n") - 1
    pieces = g.select(*cols, extra.alias("_e"),
                      F.explode(F.sequence(F.lit(0).cast("long"), F.floor((extra - 1) / chunk).cast("long"))).alias("_k"))
    pieces = pieces.repartition("_k", *cols)
    size = F.least(F.lit(chunk).cast("long"), F.col("_e") - F.col("_k") * chunk).cast("int")
    return pieces.select(*cols, F.explode(F.array_repeat(F.lit(1), size)).alias("_x")).drop("_x")


def duplicates_all(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Every row whose ``subset`` values (nulls equal) occur more than once, sorted."""
    keys = list(subset)
    dup = df.groupBy(*keys).agg(nrows().alias("_n")).where("_n > 1").drop("_n")
    dk = dup.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = df.join(dk, cond, "left_semi")
    return out.orderBy(*keys)


# A19 ------------------------------------------------------------------------
def quality_report(df: DataFrame, cols: Cols = DEFAULT_COLS) -> DataFrame:
    """One row: nulls per column, negative days, temporal issues, duplicate rows, total."""
    rows = df.groupBy(*df.columns).agg(nrows().alias("_copies"))  # one shuffle: equal rows become one

    def total(condition=None):
        n = F.col("_copies") if condition is None else F.when(condition, F.col("_copies"))
        return F.coalesce(F.sum(n), F.lit(0))

    aggs = [total(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    if cols.days in df.columns:
        aggs.append(total(F.col(cols.days) < 0).alias("negative_days"))
    if cols.ts in df.columns and cols.event_date in df.columns:
        aggs.append(total(F.col(cols.ts) > F.col(cols.event_date)).alias("temporal_issues"))
    aggs += [total().alias("total_rows"), (total() - nrows()).alias("duplicate_rows")]
    return rows.agg(*aggs)
