"""Temporal split by entity (W24), split summary (A25), leakage check.

Each entity goes, with all its rows, to the split in which its last listing
time falls: train up to 60 % of the range of last times, validation up to
80 %, test after. The per-entity table is an aggregate; the range of last
times is a scalar subquery; the split is attached by an equi-join on the
entity key (broadcast by AQE when small, shuffle join otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_micros
from ..schema import DEFAULT_COLS, Cols
from .clean import split_overlaps
from .profile import attach_stats

TRAIN_END = 0.6       # fixed value: share of the time range for training
VALIDATION_END = 0.8  # fixed value: end of the validation share


def entity_splits(df: DataFrame, cols: Cols = DEFAULT_COLS, train_end: float = TRAIN_END,
                  validation_end: float = VALIDATION_END) -> DataFrame:
    """(entity..., last_listing_time, split) per entity."""
    last = df.groupBy(*cols.entity).agg(F.max(cols.ts).alias("last_listing_time"))
    last = last.withColumn("_last_us", epoch_micros("last_listing_time"))
    last, st = attach_stats(last, "_range", lo=F.min("_last_us"), hi=F.max("_last_us"))
    rng = (st["hi"] - st["lo"]).cast("double")
    x = (F.col("_last_us") - st["lo"]).cast("double")
    split = (F.when(x <= rng * F.lit(train_end), "train")
             .when(x <= rng * F.lit(validation_end), "validation")
             .otherwise("test"))
    return last.select(*cols.entity, "last_listing_time", split.alias(cols.split))


def temporal_split(df: DataFrame, cols: Cols = DEFAULT_COLS, **kw) -> DataFrame:
    """``df`` with a ``split`` column; all rows of an entity share one split."""
    s = entity_splits(df, cols, **kw).select(*cols.entity, cols.split)
    return df.join(s, list(cols.entity), "inner")


def split_summary(df: DataFrame, cols: Cols = DEFAULT_COLS) -> DataFrame:
    """Entities, listings, first and last time per split."""
    return df.groupBy(cols.split).agg(
        F.count_distinct(*cols.entity).alias("n_entities"), F.count(F.lit(1)).alias("n_listings"),
        F.min(cols.ts).alias("first_listing_time"), F.max(cols.ts).alias("last_listing_time"))


def leakage_report(df: DataFrame, cols: Cols = DEFAULT_COLS) -> DataFrame:
    """Split pairs sharing an entity (empty when the split is clean)."""
    return split_overlaps(df, list(cols.entity), cols.split)
