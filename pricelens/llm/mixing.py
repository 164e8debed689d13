"""Mixing sources to target weights.

Tokens are summed per source, the sources' targets follow from their weights, and each document is
emitted ``floor(rate)`` times plus once more with the fraction's probability, drawn from a hash of the
document. DataFrame functions only; two scans, one aggregation with map-side sums, one join.

Rows that the hash can't tell apart (equal id, source and size) share one draw, so they are numbered, and the copies beyond the
floor are dealt evenly along the numbers from the drawn start: each row still has one with the fraction's probability, and together
they have the fraction's share to within one. Only such rows are shuffled for it, dealt by where they lie, so a group of any size
is spread over many tasks.

Defined cases: a null text has size 0 and is taken 0 words of; a null source is a source of its own
(last in order); a source without words has target 0 and rate 0; which of several equal rows is emitted once more is not defined, how many
are is; an empty table gives an empty result. Only the named columns are read, and columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import WORD, broadcast_if_small
from pricelens.operators.order_stats import join_null_safe
from pricelens.operators.prefix import with_prefix_totals
from pricelens.session import cut_lineage, write_shared

MAX_RATE = 3
WEIGHTS = (1, 2, 3)
OUTPUTS = ("size", "source_size", "target", "copies", "taken")


def text_size(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in order of code points (null last) weigh ``weights``, repeating. Each gets its share of all
    sizes by weight, but no more than ``max_rate`` times its own size; the excess goes to the others by
    weight until none is above. That fixed point is ``least(max_rate * size, level * weight)``, and the
    level is the largest of ``(total - caps) / (weights left)`` over the sources in order of cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = (F.col("source").isNull(), F.col("source"))
    per = with_prefix_totals(per, order, {"_place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    per = per.withColumn("_weight", weight).withColumn("_cap", F.col("source_size").cast("double") * max_rate)
    per = with_prefix_totals(per, (F.col("_cap") / F.col("_weight"), F.col("_place")),
                             {"_caps": F.col("_cap"), "_weights": F.col("_weight")})
    total = per.agg(F.sum("source_size").cast("double").alias("_all"), F.sum("_weight").alias("_weight_all"))
    level = (per.crossJoin(F.broadcast(total))  # one row
             .agg(F.max((F.col("_all") - F.col("_caps")) / (F.col("_weight_all") - F.col("_weights"))).alias("_level")))
    return (per.crossJoin(F.broadcast(level))
            .select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_weight")).alias("target")))


def draw(*keys: Column, seed: int = 0) -> Column:
    """Uniform in [0, 1) from a hash of the keys, the same in every run."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _numbered(rows: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """``rows`` numbered from 1 within equal keys (null equals null), in no stated order."""
    rows = cut_lineage(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = rows.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_at"))
    return (join_null_safe(rows.withColumn("_local", local), parts, [*key, "_part"])
            .withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_part", "_at", "_local", "_before"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE, seed: int = 0) -> DataFrame:
    """``docs`` with its size, its source's size and target, and how many copies and words the mix takes."""
    sized = docs.drop(*OUTPUTS).withColumn("size", text_size(F.col(text)))
    key = [doc_id, source, "size"]
    keys = write_shared(sized.select(*key))
    plan = (source_plan(keys.select(F.col(source).alias("source"), "size"), weights, max_rate)
            .select(F.col("source").alias("_mix_source"), "source_size", "target"))
    repeats = cut_lineage(keys.groupBy(*key).agg(F.count(F.lit(1)).alias("_times")).filter(F.col("_times") > 1))
    if repeats.isEmpty():
        rows = sized.withColumn("_number", F.lit(1).cast("long"))
    else:
        marked = join_null_safe(sized, broadcast_if_small(repeats), key)
        rows = (marked.filter(F.col("_times").isNull()).withColumn("_number", F.lit(1).cast("long"))
                .unionByName(_numbered(marked.filter(F.col("_times").isNotNull()), key, "_number"))).drop("_times")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    share, start = rate - F.floor(rate), draw(F.col(doc_id), F.col(source), F.col("size"), seed=seed)
    dealt = lambda n: F.ceil(n * share - start)
    joined = rows.join(broadcast_if_small(plan), F.col(source).eqNullSafe(F.col("_mix_source")))
    return (joined.withColumn("copies", (F.floor(rate) + dealt(F.col("_number")) - dealt(F.col("_number") - 1)).cast("long"))
            .withColumn("taken", F.col("copies") * F.col("size")).drop("_mix_source", "_number"))


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1 in ``copy_no``; documents without a copy go."""
    return (mixed.filter(F.col("copies") > 0)
            .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
