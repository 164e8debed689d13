"""Categorical label codes (F13): 0..k-1 in sorted string order.

The code table is fitted on one DataFrame (the training split) and applied
to others by an equi-join on the value, so codes agree across splits. A null
value is encoded as the text 'nan' (the reference encodes ``str(NaN)``).
Values unseen at fit time get the code k (one past the last), like
``StringIndexer(handleInvalid='keep')``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import with_prefix_totals

NULL_TEXT = "nan"  # fixed value: text the reference uses for a missing category


def _as_text(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(NULL_TEXT))


def fit_label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code) for the distinct values of ``col``: 0..k-1 in sorted order.

    A code is the number of values before it: a running total over ordered ranges, as many as the session has
    shuffle partitions, so no single task ranks all values.
    """
    v = df.select(_as_text(col).alias("value")).distinct()
    return with_prefix_totals(v, [F.col("value")], {"code": F.lit(1)}).select("value", F.col("code").cast("int"))


def apply_label_codes(df: DataFrame, codes: DataFrame, col: str, out: str | None = None) -> DataFrame:
    out = out or f"{col}_code"
    k = codes.agg(F.count(F.lit(1)).cast("int")).scalar()
    c = codes.withColumnRenamed("value", "_v").withColumnRenamed("code", out)
    j = df.withColumn("_v", _as_text(col)).join(c, "_v", "left").drop("_v")
    return j.withColumn(out, F.coalesce(F.col(out), k))


def encode_columns(train: DataFrame, frames: Sequence[DataFrame], cols: Sequence[str]) -> list[DataFrame]:
    """Fit codes of ``cols`` on ``train``; apply them to each frame in ``frames``."""
    out = list(frames)
    for c in cols:
        codes = fit_label_codes(train, c)
        out = [apply_label_codes(f, codes, c, f"{c}_encoded") for f in out]
    return out
