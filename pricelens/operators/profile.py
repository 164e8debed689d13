"""Profile tables: descriptive statistics, counts, bins, pivots, correlations,
top-k, box statistics.

Global statistics (a quantile of the whole column, min/max for bin edges)
are computed as one-row aggregates used through scalar subqueries
(``DataFrame.scalar``). Spark runs the subquery as its own job and inlines the
value, so rows never gather in one task (no ``OVER ()`` window) and no join is
needed to attach a constant to every row. ``attach_stats`` puts all the
statistics of one operator into a single struct column, so the plan holds
one subquery however often the expressions refer to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggs import nrows
from ..functions.scalars import cut_right_closed, edge, hist_bin
from ..schema import DEFAULT_COLS, Cols
from .order_stats import agg_with_quantiles, group_quantiles, join_null_safe
from .prefix import with_prefix_totals


def _list(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def scalar_stats(df: DataFrame, **aggs: Column) -> dict[str, Column]:
    """Named one-row aggregates of ``df`` as scalar-subquery columns (for a single use each)."""
    row = df.agg(F.struct(*[a.alias(k) for k, a in aggs.items()]).alias("s"))
    sub = row.scalar()
    return {k: sub.getField(k) for k in aggs}


def attach_stats(df: DataFrame, name: str, **aggs: Column) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` plus one struct column ``name`` holding one-row aggregates of ``df``.

    Returns the frame and a column per statistic (fields of ``name``); drop
    ``name`` when done.
    """
    sub = df.agg(F.struct(*[a.alias(k) for k, a in aggs.items()]).alias("s")).scalar()
    return df.withColumn(name, sub), {k: F.col(f"{name}.{k}") for k in aggs}


def attach_quantiles(df: DataFrame, name: str, col: str, probs: Sequence[float]) -> tuple[DataFrame, list[Column]]:
    """``df`` plus one struct column ``name`` with exact quantiles of the whole column, and a column for each."""
    names = [f"q{i}" for i in range(len(probs))]
    row = group_quantiles(df, [], col, dict(zip(names, probs, strict=True)))
    return df.withColumn(name, row.select(F.struct(*names).alias("s")).scalar()), [F.col(f"{name}.{n}") for n in names]


# A3 / A4 -------------------------------------------------------------------
def describe_exact(df: DataFrame, col: str, by=None) -> DataFrame:
    """count, mean, std, min, 25 %, 50 %, 75 %, max with exact quantiles."""
    c = F.col(col)
    out = agg_with_quantiles(df, _list(by), col, {"p25": 0.25, "p50": 0.5, "p75": 0.75},
                             F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                             F.min(c).alias("min"), F.max(c).alias("max"))
    return out.select(*_list(by), "count", "mean", "std", "min", "p25", "p50", "p75", "max")


# A5 / A14 --------------------------------------------------------------------
def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """Rows per non-null value; with ``normalize`` the share of non-null rows."""
    nn = df.where(F.col(col).isNotNull())
    out = nn.groupBy(col).agg(nrows().alias("n"))
    if normalize:
        total = scalar_stats(nn, t=nrows())["t"]
        out = out.withColumn("share", F.col("n") / total)
    return out


# A6 --------------------------------------------------------------------------
def mean_by(df: DataFrame, by, col: str = "price", name: str = "mean_price") -> DataFrame:
    return df.groupBy(*_list(by)).agg(F.avg(col).alias(name))


# F9 / A12 --------------------------------------------------------------------
def with_cut(df: DataFrame, col: str, bins: int, name: str = "bin") -> DataFrame:
    """Equal-width, right-closed bin number of ``col`` with its edges."""
    d, st = attach_stats(df, "_cut", lo=F.min(col).cast("double"), hi=F.max(col).cast("double"))
    lo, hi = st["lo"], st["hi"]
    w = (hi - lo) / F.lit(float(bins))
    b = cut_right_closed(F.col(col).cast("double"), lo, hi, bins)
    return (d.withColumn(name, b)
            .withColumn(f"{name}_lo", F.when(F.col(name) == 1, lo - (hi - lo) * F.lit(0.001))
                        .otherwise(edge(lo, w, F.col(name) - 1)))
            .withColumn(f"{name}_hi", edge(lo, w, F.col(name)))
            .drop("_cut"))


def pivot_binned(df: DataFrame, rows, col: str = "days_until_event", bins: int = 20,
                 value: str = "price", wide: bool = False) -> DataFrame:
    """Mean of ``value`` per (rows, equal-width bin of ``col``); empty cells absent (long) or null (wide)."""
    binned = with_cut(df, col, bins)
    long = binned.groupBy(*_list(rows), "bin", "bin_lo", "bin_hi").agg(F.avg(value).alias("mean_value"))
    if not wide:
        return long
    return binned.groupBy(*_list(rows)).pivot("bin", list(range(1, bins + 1))).agg(F.avg(value))


# A13 -------------------------------------------------------------------------
def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram; every bin present (zero counts kept); last bin closed."""
    v = F.col(col).cast("double")
    d, st = attach_stats(df.select(v.alias("_v")), "_h", lo=F.min("_v"), hi=F.max("_v"))
    counts = (d.select(hist_bin(F.col("_v"), st["lo"], st["hi"], bins).alias("bin")).where("bin IS NOT NULL")
              .groupBy("bin").agg(nrows().alias("n")))
    # the bin grid: one stats row exploded to ``bins`` rows (fixed size), empty input gives none
    grid = (df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).where("lo IS NOT NULL")
            .select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    out = F.broadcast(grid).join(counts, "bin", "left")
    return out.select("bin", edge(F.col("lo"), w, F.col("bin") - 1).alias("bin_lo"),
                      F.when(F.col("bin") == bins, F.col("hi")).otherwise(edge(F.col("lo"), w, F.col("bin"))).alias("bin_hi"),
                      F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


# A15 -------------------------------------------------------------------------
# Hour bands [start, end) used by the reference.
HOUR_BANDS = [(0, 24), (24, 168), (168, 720), (720, None)]


def mean_by_band(df: DataFrame, hours: str = "hours_until_event", value: str = "price",
                 bands=HOUR_BANDS) -> DataFrame:
    h = F.col(hours)
    expr = None
    for i, (a, b) in enumerate(bands):
        cond = (h >= a) if b is None else ((h >= a) & (h < b))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return (df.withColumn("band", expr).where("band IS NOT NULL")
            .groupBy("band").agg(F.avg(value).alias("mean_price"), nrows().alias("n")))


# A16 / A17 -------------------------------------------------------------------
def corr_by(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    g = df.groupBy(*_list(by)) if by else df.groupBy()
    return g.agg(F.corr(x, y).alias("corr"), nrows().alias("n"))


def linear_trend(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    """Least-squares line y = slope * x + intercept (degree-1 fit)."""
    g = df.groupBy(*_list(by)) if by else df.groupBy()
    return g.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                 nrows().alias("n"))


# A18 -------------------------------------------------------------------------
def with_price_tier(df: DataFrame, col: str = "price", tiers: str = "median") -> DataFrame:
    """'low'/'high' around the median, or 'q1'..'q4' by quartile (upper edges inclusive)."""
    v = F.col(col)
    if tiers == "median":
        d, q = attach_quantiles(df, "_tier", col, (0.5,))
        return d.withColumn("tier", F.when(v <= q[0], "low").when(v > q[0], "high")).drop("_tier")
    d, q = attach_quantiles(df, "_tier", col, (0.25, 0.5, 0.75))
    return d.withColumn("tier", F.when(v <= q[0], "q1").when(v <= q[1], "q2")
                        .when(v <= q[2], "q3").when(v > q[2], "q4")).drop("_tier")


def price_tier_trend(df: DataFrame, tiers: str = "median", day: str = "days_until_event",
                     col: str = "price") -> DataFrame:
    return with_price_tier(df, col, tiers).where("tier IS NOT NULL") \
        .groupBy("tier", day).agg(F.avg(col).alias("mean_price"))


# A20 -------------------------------------------------------------------------
def distinct_values(df: DataFrame, cols) -> DataFrame:
    return df.select(*_list(cols)).distinct()


# A24 -------------------------------------------------------------------------
def importance_long(doc: DataFrame, col: str = "importances") -> DataFrame:
    """MAP<model, MAP<feature, importance>> to (model, feature, importance) rows."""
    return (doc.select(F.explode(col).alias("model", "m"))
            .select("model", F.explode("m").alias("feature", "importance")))


def importance_table(long: DataFrame, wide: bool = False) -> DataFrame:
    """Mean importance per feature across models, largest first; optional pivot by model."""
    if wide:
        return long.groupBy("feature").pivot("model").agg(F.first("importance"))
    return (long.groupBy("feature").agg(F.avg("importance").alias("mean_importance"))
            .orderBy(F.desc("mean_importance"), "feature"))


# A26 -------------------------------------------------------------------------
def box_stats(df: DataFrame, col: str = "price", by=None, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest values within k IQR of the box) and outlier count."""
    keys = _list(by)
    v = F.col(col)
    probs = (0.25, 0.5, 0.75)
    if keys:
        q = group_quantiles(df, keys, col, {f"_q{i}": p for i, p in enumerate(probs)})
        j = join_null_safe(df.select(*keys, col), q, keys, "inner")  # group-level table: AQE picks broadcast or shuffle
        q1, q2, q3 = (F.col(f"_q{i}") for i in range(3))
    else:
        j, (q1, q2, q3) = attach_quantiles(df.select(col), "_box", col, probs)
    lo_f = q1 - F.lit(k) * (q3 - q1)
    hi_f = q3 + F.lit(k) * (q3 - q1)
    g = j.groupBy(*keys) if keys else j.groupBy()
    return g.agg(F.first(q1).alias("q1"), F.first(q2).alias("median"), F.first(q3).alias("q3"),
                 F.min(F.when(v >= lo_f, v)).alias("whisker_lo"),
                 F.max(F.when(v <= hi_f, v)).alias("whisker_hi"),
                 F.count_if((v < lo_f) | (v > hi_f)).alias("n_outliers"),
                 F.count(v).alias("n"))


# J2 --------------------------------------------------------------------------
def semi_join_keys(df: DataFrame, keys: DataFrame, on, anti: bool = False) -> DataFrame:
    """Rows of ``df`` whose key is (or with ``anti`` is not) in ``keys``."""
    return df.join(keys.select(*_list(on)), _list(on), "left_anti" if anti else "left_semi")


# J3 --------------------------------------------------------------------------
def densify_months(df: DataFrame, by, month: str = "event_month") -> DataFrame:
    """All 12 months for every key of ``by``, left-joined to ``df`` so gaps show as nulls.

    The scaffold is generated per key (``explode(sequence(1, 12))``), no cross join.
    """
    keys = _list(by)
    scaffold = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(12))).alias(month))
    return scaffold.join(df, [*keys, month], "left")


# O1 --------------------------------------------------------------------------
def with_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Each row's place (from 1) in the sorted table: rows are dealt into ordered ranges and counted there, so no task
    holds the whole table. ``order`` must tell rows apart for a defined place; nulls come first."""
    placed = with_prefix_totals(df, [F.col(c) for c in order], {name: F.lit(1)})
    return placed.withColumn(name, (F.col(name) + 1).cast("long"))


# O2 / O3 / O4 ----------------------------------------------------------------
def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """First ``n`` rows by ``order`` (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def top_k_per(df: DataFrame, by, order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """``k`` first rows per group by ``order``.

    ``row_number() <= k`` is planned as a WindowGroupLimit, which also runs
    before the shuffle, so a hot group sends at most ``k`` rows per map task.
    """
    w = Window.partitionBy(*_list(by)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def top_entities(df: DataFrame, n: int, value: str | None = None, cols: Cols = DEFAULT_COLS) -> DataFrame:
    """Top-N entities by row count (ties by key), with the mean of ``value``."""
    aggs = [nrows().alias("n")]
    if value:
        aggs.append(F.avg(value).alias("mean_price"))
    g = df.groupBy(*cols.entity).agg(*aggs)
    return g.orderBy(F.desc("n"), *[F.asc(e) for e in cols.entity]).limit(n)
