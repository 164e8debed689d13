"""Growing quantiles (W3, W15) of chunked entities, with a bounded context per chunk.

For each row the quantiles of all earlier prices of its entity are wanted. Within a chunk :func:`.quantiles.growing_quantiles`
answers all rows at once. Of the prices before a chunk of m rows, only those can be an answer whose rank lies
between the quantile's rank at the chunk's begin, less m, and its rank at the end. So the entity's prices are dealt into value
ranges too; counts per (value range, chunk) tell for each chunk which value ranges hold those ranks. The chunk gets
their earlier prices, and of all other ranges only how many prices they hold. That is about two values per row and
quantile in all, however many chunks came before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_shared
from .order_stats import join_null_safe
from .quantiles import growing_quantiles


def context(rows: DataFrame, chunks: DataFrame, entity: Sequence[str], gid: str, price: str, probs: Sequence[float],
            ranges: int | None = None) -> DataFrame:
    """(gid, _hv value, _hf count) standing for all prices of the entity before each chunk."""
    E = list(entity)
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # chunks of entities that have more than one: only they have earlier chunks
    own = chunks.where(F.col("_chunks") > 1).select(*E, gid, "_k", "_np", "_Pnp", "_chunks")
    values = rows.where(F.col(price).isNotNull()).select(gid, F.col(price).cast("double").alias("_v")).join(own.select(*E, gid, "_k", "_chunks"), gid)
    counted = values.groupBy(*E, "_v", "_k", "_chunks").agg(F.count(F.lit(1)).alias("_c"))
    dealt = write_shared(counted.repartitionByRange(n, *E, "_v").withColumn("_part", F.spark_partition_id()))

    # prices before chunk k in each value range of the entity: a running total over chunks
    cells = dealt.groupBy(*E, "_part", "_k").agg(F.sum("_c").alias("_c"))
    parts = dealt.groupBy(*E, "_part", "_chunks").agg(F.min("_v").alias("_low"))
    grid = parts.select(*E, "_part", "_low", F.explode(F.sequence(F.lit(1), F.col("_chunks"))).alias("_k"))
    over_chunks = Window.partitionBy(*E, "_part").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    over_parts = Window.partitionBy(*E, "_k").orderBy("_part")
    held = join_null_safe(grid, cells, [*E, "_part", "_k"]).withColumn("_held", F.coalesce(F.sum("_c").over(over_chunks), F.lit(0)))
    held = (held.where(F.col("_held") > 0).drop("_c")
            .withColumn("_below", F.coalesce(F.sum("_held").over(over_parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    held = join_null_safe(held, own.select(*E, "_k", gid, "_np", "_Pnp"), [*E, "_k"], "inner")
    wanted = F.lit(False)
    for p in probs:
        low = F.floor(F.lit(p) * (F.col("_Pnp") - 1)) - F.col("_np")
        high = F.ceil(F.lit(p) * (F.col("_Pnp") + F.col("_np") - 1))
        wanted = wanted | ((F.col("_below") <= high) & (F.col("_below") + F.col("_held") > low))
    held = write_shared(held.withColumn("_wanted", wanted))

    near = (join_null_safe(dealt.withColumnRenamed("_k", "_was"), held.where("_wanted").select(*E, "_part", "_k", gid), [*E, "_part"], "inner")
            .where(F.col("_was") < F.col("_k")).groupBy(gid, F.col("_v").alias("_hv")).agg(F.sum("_c").alias("_hf")))
    # the other ranges: one value for each run of them, of which only the place among the others counts
    run = F.coalesce(F.sum(F.col("_wanted").cast("int")).over(over_parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    far = held.withColumn("_run", run).where(~F.col("_wanted")).groupBy(gid, "_run").agg(F.min("_low").alias("_hv"), F.sum("_held").alias("_hf"))
    return near.unionByName(far.drop("_run"))


def chunk_quantiles(rows: DataFrame, chunks: DataFrame, entity: Sequence[str], gid: str, rid: str, price: str,
                    qs: Mapping[str, float], ranges: int | None = None) -> DataFrame:
    """(rid, one column per quantile) of all prices of the entity before the row."""
    before = context(rows, chunks, entity, gid, price, list(qs.values()), ranges)
    return growing_quantiles(rows.select(gid, rid, price), [gid], [rid], price, dict(qs), before).drop(gid)
