"""Running totals over a whole table, without one task that holds it.

The rows are dealt into ordered ranges; each range is summed by itself and starts from the total of the
ranges before it. What one task gathers is one row per range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.session import cut_lineage

RANGE = "_range"


def with_prefix_totals(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column],
                       ranges: int | None = None) -> DataFrame:
    """``df`` with, for each name in ``sums``, the total of that expression over the rows before this one.

    ``order`` must be unique per row for a defined result; nulls come first. The ranges are written to
    the shared checkpoint folder, since both passes must see the same ones.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_key{i}": c for i, c in enumerate(order)}
    values = {f"_add{i}": c for i, c in enumerate(sums.values())}
    dealt = (df.withColumns(keys | values).repartitionByRange(n, *keys)
             .withColumn(RANGE, F.spark_partition_id()))
    dealt = cut_lineage(dealt)
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = dealt.groupBy(RANGE).agg(*[F.sum(v).alias(f"_sum{v}") for v in values])
    totals = totals.select(RANGE, *[F.coalesce(F.sum(f"_sum{v}").over(before), F.lit(0)).alias(f"_base{v}") for v in values])
    inside = Window.partitionBy(RANGE).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(totals), RANGE)  # bounded: a row per range
    for name, v in zip(sums, values, strict=True):
        out = out.withColumn(name, F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_base{v}"))
    return out.drop(RANGE, *keys, *values, *[f"_base{v}" for v in values])
