"""Leakage-aware per-entity features (W1-W21, J1, J4, J5), in chunks of bounded size.

Every feature of a row reads only rows of the same entity that come before it (except the reference's
look-ahead duration, W12, which ``strict=True`` turns off). Row loops of the reference become frames:

* positional history ("all earlier rows"), and the last 15 rows
* seven days up to now, current time included: times in (t - 7 d, t]
* the week before now, current time excluded: times in [t - 7 d, t)
* strictly earlier times

There is one plan for entities of any size. The rows are dealt once into ranges of (entity, time, tie-break) of about
equal size and written to the shared folder, each with a row number ``_rid`` that is never null and orders the rows; an entity's
share of a range is a chunk, and rows of one time may lie in several. Frames over positions are plain windows within a
chunk. What lies before the chunk comes from

* one summary row per chunk, running over the entity's earlier chunks (counts, sums, extremes, moments);
* the 15 rows before the chunk, copied into it, for the lag and the last-15 frame;
* for the growing quantiles: :mod:`.growing`, which hands each chunk only the earlier prices near its quantiles.

Frames over times are the same for all rows of one time, so they are answered once per distinct time (an instant), which
holds the moments of its rows, summed up before any shuffle: however many rows a time has, it is one row here. An instant
that chunks cut belongs to the chunk it begins in. The moments of instants inside a chunk come from an index
(:mod:`.instants`); of earlier chunks, those wholly inside a frame are added up from their summaries, and
those that a frame cuts are asked: an instant asks such a chunk for the moments of its part after t - 7 d. Chunks and cuts are
both in order of time, so there are about as many questions as instants, however dense the week is. The answers go back
to the rows by (chunk, time).

Moments of parts are merged as (count, mean, squared deviations), not as differences of sums, so that equal prices have
deviation 0. No task holds more than a chunk, its questions and its context.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import US_PER_DAY, US_PER_HOUR, epoch_micros
from ..schema import DEFAULT_COLS, Cols
from ..session import write_shared
from . import instants as I
from .growing import chunk_quantiles
from .market import market_stats, time_window
from .order_stats import join_null_safe

WEEK_US = 7 * US_PER_DAY
H48_US = 48 * US_PER_HOUR
MIN_HISTORY = 5        # fixed value: rows of history needed by W2, W3, W15, W16
STABILITY_START = 7    # fixed value: W21 starts at the 8th row (0-based index 7)
DECAY_DAYS = 30.0      # fixed value: W4 decay constant
EPS = 1e-6             # fixed value: guard added to denominators by the reference
TAIL = 15              # fixed value: rows of the W16 frame
QUANTILES = {"_q50": 0.5, "_q20": 0.2}  # W3 median and W15 20 % quantile of earlier prices

TS_US, CHUNK, RID, GID = "_ts_us", "_chunk", "_rid", "_gid"


def with_time_keys(df: DataFrame, cols: Cols = DEFAULT_COLS) -> DataFrame:
    """Add the integer order key (microseconds) and the weekly bucket."""
    out = df.withColumn(TS_US, epoch_micros(cols.ts))
    if cols.time_window not in df.columns:
        out = out.withColumn(cols.time_window, time_window(cols.wall))
    return out


# --- chunks ------------------------------------------------------------------
def deal(df: DataFrame, cols: Cols, ranges: int | None = None) -> DataFrame:
    """Rows with chunk and row number, written once to the shared folder.

    Rows of equal time stand in order of the tie-break, then of price, quantity and a hash of the row (nulls first), so that
    only rows equal in all columns are interchangeable, and only those always share a chunk.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashable = [c for c, t in df.dtypes if not t.startswith("map")]
    order = [*cols.entity, TS_US, *cols.tiebreak, cols.price, cols.quantity, F.xxhash64(*hashable)]
    dealt = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
             .withColumn(CHUNK, F.spark_partition_id()).withColumn(RID, F.monotonically_increasing_id()))
    return write_shared(dealt)


@dataclass
class Moments:
    """Count, mean and sum of squared deviations."""
    n: Column
    mean: Column
    m2: Column

    @classmethod
    def of(cls, struct: Column) -> Moments:
        return cls(struct["n"], struct["mean"], struct["m2"])

    @classmethod
    def or_none(cls, prefix: str) -> Moments:
        return cls(*[F.coalesce(F.col(prefix)[k], F.lit(0.0)) for k in ("n", "mean", "m2")])

    def plus(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        both = (self.n > 0) & (other.n > 0)
        return Moments(n, F.when(both, self.mean + gap * other.n / n).when(other.n > 0, other.mean).otherwise(self.mean),
                       self.m2 + other.m2 + F.when(both, gap * gap * self.n * other.n / n).otherwise(F.lit(0.0)))

    def struct(self) -> Column:
        return F.struct(self.n.alias("n"), self.mean.alias("mean"), self.m2.alias("m2"))

    def std(self) -> Column:
        return F.when(self.n > 1, F.sqrt(self.m2 / (self.n - 1)))

    def avg(self) -> Column:
        return F.when(self.n > 0, self.mean)


def _folded(parts: Column) -> Column:
    """The moments of an array of moments, added up in the array's order."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "mean", "m2")])
    return F.aggregate(parts, zero, lambda a, x: Moments.of(a).plus(Moments.of(x)).struct())


def summarise(rows: DataFrame, cols: Cols, chunk: str = CHUNK) -> DataFrame:
    """One row per chunk: its own sums, the sums of the entity's earlier chunks, and the entity's constants.

    ``_run`` is the chunk in which the chunk's first instant began, if that was not this one.
    """
    E, p, q = list(cols.entity), F.col(cols.price), F.col(cols.quantity)
    own = rows.groupBy(*E, chunk).agg(
        F.min(RID).alias(GID), F.count(F.lit(1)).alias("_n"), F.count(p).alias("_np"),
        F.coalesce(F.avg(p), F.lit(0.0)).alias("_mean"), F.coalesce(F.var_pop(p), F.lit(0.0)).alias("_var"),
        F.sum(q).alias("_sq"), F.count(q).alias("_nq"), F.min(p).alias("_mn"), F.max(p).alias("_mx"),
        F.min(TS_US).alias("_t0"), F.max(TS_US).alias("_t1"), F.max(cols.days).alias("_days"))
    entity = Window.partitionBy(*E)  # a row per chunk of the entity
    by_time = entity.orderBy(chunk)
    earlier = by_time.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    # sums of squares run over prices less those of the first chunk, which keeps them small and reads nothing later
    own = own.withColumn("_shift", F.first("_mean").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    off = F.col("_mean") - F.col("_shift")
    own = own.withColumn("_cut", F.coalesce(F.lag("_t1").over(by_time) == F.col("_t0"), F.lit(False)))
    # an instant begins in the last chunk that holds more than the rest of an earlier one
    begins = F.when(~(F.col("_cut") & (F.col("_t0") == F.col("_t1"))), F.col(GID))
    own = own.withColumn("_run", F.when(F.col("_cut"), F.last(begins, ignorenulls=True).over(earlier)))
    out = own.withColumns({
        "_k": F.row_number().over(by_time), "_chunks": F.count(GID).over(entity).cast("int"), "_first": F.min("_t0").over(entity), "_last": F.max("_t1").over(entity),
        "_maxd": F.max("_days").over(entity), "_m2": F.col("_var") * F.col("_np"),
        "_Pn": total("_n"), "_Pnp": total("_np"), "_Psq": total("_sq"),
        "_Pmn": F.min("_mn").over(earlier), "_Pmx": F.max("_mx").over(earlier),
        "_Ps1": total(off * F.col("_np")), "_Ps2": total(F.col("_var") * F.col("_np") + off * off * F.col("_np"))})
    return write_shared(out)


def _near_pairs(chunks: DataFrame, cols: Cols) -> DataFrame:
    """(chunk's _gid, earlier chunk's summary) for the earlier chunks that reach into the 7 days before some row.

    The first such chunk is found by counting, in order of time, the chunks that end before the frame begins.
    """
    E = list(cols.entity)
    marks = chunks.select(*E, F.col("_t1").alias("_at"), F.lit(1).alias("_end"), F.lit(None).cast("long").alias("_asks"))
    asks = chunks.select(*E, (F.col("_t0") - WEEK_US).alias("_at"), F.lit(0).alias("_end"), F.col(GID).alias("_asks"))
    ended = Window.partitionBy(*E).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    first = (marks.unionByName(asks).withColumn("_done", F.coalesce(F.sum("_end").over(ended), F.lit(0)))
             .where(F.col("_asks").isNotNull()).select(F.col("_asks").alias(GID), (F.col("_done") + 1).alias("_from")))
    own = chunks.join(first, GID).where(F.col("_from") < F.col("_k"))
    own = own.select(*E, F.col(GID).alias("_for"), (F.col("_t1") - WEEK_US).alias("_cut"),
                     F.explode(F.sequence(F.col("_from").cast("int"), F.col("_k") - 1)).alias("_k"))
    return join_null_safe(own, chunks.select(*E, "_k", GID, "_t0", "_np", "_mean", "_m2", "_nq", "_sq"), [*E, "_k"], "inner")


def _by_instant(rows: DataFrame, chunks: DataFrame, cols: Cols) -> DataFrame:
    """Per (chunk, time): what W7-W9 and W21 need of all rows before that time and of the seven days up to it."""
    p, q = F.col(cols.price).cast("double"), F.col(cols.quantity).cast("double")
    number = lambda c, kind: F.lit(c).cast(kind)
    points = (rows.groupBy("_pg", TS_US).agg(
        F.count(p).cast("double").alias("n"), F.coalesce(F.avg(p), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(p) * F.count(p), F.lit(0.0)).alias("m2"), F.count(q).cast("double").alias("nq"), F.coalesce(F.sum(q), F.lit(0.0)).alias("sq")))
    points = points.select(F.col("_pg").alias("_g"), F.lit(I.POINT).alias("_role"), F.col(TS_US).alias("_at"), *I.MOMENT, "nq", "sq",
                           F.col("_pg").alias("_og"), F.col(TS_US).alias("_oat"))
    cut = chunks.where("_run IS NOT NULL").select(F.col("_run").alias("_og"), F.col("_t0").alias("_oat"), GID)
    if cut.isEmpty():  # then the chunks of instants are the chunks of rows
        times = chunks
    else:
        times = summarise(rows.withColumn(RID, F.col("_pg")), cols, "_pg")
    pairs = _near_pairs(times, cols).withColumn("_whole", F.col("_t0") > F.col("_cut"))
    part = F.struct(F.col("_k").alias("k"), F.col("_np").cast("double").alias("n"), F.col("_mean").alias("mean"), F.col("_m2").alias("m2"))
    inside = F.transform(F.array_sort(F.collect_list(part)), lambda x: F.struct(*[x[m].alias(m) for m in I.MOMENT]))
    whole = (pairs.where("_whole").groupBy(F.col("_for").alias("_og"))  # at most the chunks of a week
             .agg(_folded(inside).alias("_w"), F.sum("_nq").alias("_w_nq"), F.sum("_sq").alias("_w_sq")))
    asked = pairs.where(~F.col("_whole")).select(F.col("_for").alias("_og"), F.col(GID).alias("_g"))
    asks = (rows.select(F.col("_pg").alias("_og"), F.col(TS_US).alias("_oat")).distinct().join(asked, "_og")
            .select("_g", F.lit(I.ASK).alias("_role"), (F.col("_oat") - WEEK_US).alias("_at"), *[number(None, "double").alias(c) for c in (*I.MOMENT, "nq", "sq")], "_og", "_oat"))
    found = I.folded(I.answers(points.unionByName(asks), WEEK_US), _folded)
    found = (found.join(times.select(F.col(GID).alias("_og"), "_Pnp", "_Ps1", "_Ps2", "_shift"), "_og").join(whole, "_og", "left"))
    n = F.col("_Pnp").cast("double")
    earlier = Moments(n, F.col("_shift") + F.coalesce(F.try_divide(F.col("_Ps1"), n), F.lit(0.0)),
                      F.greatest(F.lit(0.0), F.col("_Ps2") - F.coalesce(F.try_divide(F.col("_Ps1") * F.col("_Ps1"), n), F.lit(0.0))))
    before = Moments.or_none("_w")
    of = lambda c: Moments.of(F.col(c))
    sums = [(F.col(f"_{c}") + F.col(f"_c_{c}") + F.coalesce(F.col(f"_w_{c}"), F.lit(0))).cast("double").alias(f"_{c}7") for c in ("nq", "sq")]
    found = found.select("_og", "_oat", earlier.plus(of("_past")).struct().alias("_earlier"),
                         of("_a").plus(before).plus(of("_week")).struct().alias("_wk"), of("_s").plus(before).plus(of("_stable")).struct().alias("_st"), *sums)
    # back to every chunk that holds rows of the instant
    here = found.withColumn(GID, F.col("_og"))
    return (here.unionByName(found.join(cut, ["_og", "_oat"])).drop("_og").withColumnRenamed("_oat", TS_US))


def _tails(rows: DataFrame, chunks: DataFrame, cols: Cols) -> DataFrame:
    """The ``TAIL`` rows before each chunk, as rows of that chunk: each chunk's last rows, and of those the last over earlier chunks."""
    E = list(cols.entity)
    last = Window.partitionBy(GID).orderBy(F.desc(TS_US), F.desc(RID))
    kept = rows.select(GID, RID, TS_US, cols.price, cols.quantity).withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= TAIL)
    row = F.struct(TS_US, RID, cols.price, cols.quantity)
    lists = kept.groupBy(GID).agg(F.array_sort(F.collect_list(row)).alias("_rows"))  # TAIL rows
    before = Window.partitionBy(*E).orderBy("_k").rowsBetween(-TAIL, -1)  # every chunk has a row at least
    known = chunks.select(*E, "_k", GID).join(lists, GID).select(GID, F.flatten(F.collect_list("_rows").over(before)).alias("_rows"))
    return known.select(GID, F.inline(F.slice("_rows", F.greatest(F.size("_rows") - TAIL + 1, F.lit(1)), TAIL)))


# --- features ------------------------------------------------------------------
def _ratio_or_one(p: Column, h: Column, n: Column) -> Column:
    """p / h when at least MIN_HISTORY earlier values exist, else 1.0."""
    return F.when(n >= MIN_HISTORY, F.try_divide(p, h)).otherwise(F.lit(1.0))


_BEFORE = ["_k", "_first", "_last", "_maxd", "_Pn", "_Pnp", "_Psq", "_Pmn", "_Pmx"]


def _history(rows: DataFrame, chunks: DataFrame, cols: Cols, strict: bool) -> DataFrame:
    """W1, W2, W4-W6, W10-W12 and W16, per ``_rid``."""
    core = rows.drop("_pg", *cols.entity).withColumn("_core", F.lit(True))
    whole = core.unionByName(_tails(rows, chunks, cols).withColumn("_core", F.lit(False)), allowMissingColumns=True)
    whole = whole.join(chunks.select(GID, *_BEFORE), GID)
    w = Window.partitionBy(GID).orderBy(TS_US, RID)
    before, last15 = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-TAIL, -1)
    p, q, d, ts, core_row = F.col(cols.price), F.col(cols.quantity), F.col(cols.days), F.col(TS_US), F.col("_core")
    pc, qc = F.when(core_row, p), F.when(core_row, q)

    prev_p, prev_ts, prev_q = F.lag(p).over(w), F.lag(ts).over(w), F.lag(q).over(w)
    n_before = F.col("_Pnp") + F.count(pc).over(before)
    place = F.col("_Pn") + F.count(F.when(core_row, F.lit(1))).over(before)
    quantity = (F.col("_Psq") + F.coalesce(F.sum(qc).over(before), F.lit(0))).cast("double")
    n15 = F.count(p).over(last15)
    return whole.select(
        RID, GID, TS_US, cols.price, core_row.alias("_core"), place.alias("prior_listings_count"), n_before.alias("_n_before"),
        F.coalesce(F.when(prev_ts >= ts - H48_US, F.try_divide(p - prev_p, prev_p)), F.lit(0.0)).alias("price_change_48h"),
        _ratio_or_one(p, F.least(F.col("_Pmn"), F.min(pc).over(before)), n_before).alias("price_vs_event_min"),
        _ratio_or_one(p, F.greatest(F.col("_Pmx"), F.max(pc).over(before)), n_before).alias("price_vs_event_max"),
        *[c.alias(n) for n, c in _row_expressions(cols).items()],
        F.try_divide(d.cast("double"), F.col("_maxd")).alias("time_to_event_ratio"),
        quantity.alias("cumulative_quantity"),
        F.when(place > 0, quantity - F.coalesce(prev_q, F.lit(0)).cast("double")).otherwise(F.lit(0.0)).alias("prev_cumulative"),
        ((ts - F.col("_first")) / F.lit(float(US_PER_DAY))).alias("days_since_first_listing"),
        (((ts if strict else F.col("_last")) - F.col("_first")) / F.lit(float(US_PER_DAY))).alias("event_duration_so_far"),
        F.when(n15 >= MIN_HISTORY, F.stddev_samp(p).over(last15)).alias("hist_volatility_30d"),
    ).where("_core").drop("_core")


def _instant_features(df: DataFrame, price: str) -> DataFrame:
    """W7, W8, W9 and W21 from the moments of the row's instant."""
    past, week, stable = (Moments.of(F.col(c)) for c in ("_earlier", "_wk", "_st"))
    return df.withColumns({
        "event_listing_frequency": past.n.cast("long"),
        "event_avg_price": F.when(past.n > 0, past.mean).otherwise(F.col(price)),
        "event_price_std": F.when(past.n > 0, past.std()).otherwise(F.lit(0.0)),
        "listing_volume_7d": F.col("_nq7"),
        "avg_quantity_7d": F.coalesce(F.try_divide(F.col("_sq7"), F.col("_nq7")), F.lit(0.0)),
        "price_std_7d": F.coalesce(week.std(), F.lit(0.0)),
        "price_volatility": week.std() / F.when(week.mean == 0, F.lit(EPS)).otherwise(week.mean),
        "price_stability_7d": F.when((F.col("prior_listings_count") >= STABILITY_START) & (stable.n > 0) & (stable.mean != 0), stable.std() / stable.mean)})


def _row_expressions(cols: Cols) -> dict[str, Column]:
    """Features of the row alone."""
    d = F.col(cols.days)
    return {"demand_pressure": F.exp(-d / F.lit(DECAY_DAYS)),
            "urgency_factor": F.try_divide(F.lit(1.0), (d + 1).cast("double"))}


def _derived_expressions(cols: Cols) -> dict[str, tuple[Column, list[str]]]:
    """Features that are plain expressions (W13, W14, W15 ratio, W20), and the columns they need."""
    p = F.col(cols.price)
    prior, n = F.col("prior_listings_count"), ["prior_listings_count"]
    return {
        "listing_intensity": (prior / (F.col("event_duration_so_far") + F.lit(EPS)), [*n, "event_duration_so_far"]),
        "is_early_listing": ((prior < MIN_HISTORY).cast("int"), n),
        "is_last_week": ((F.col(cols.days) < 7).cast("int"), []),
        "price_vs_expanding_p20": (F.try_divide(p, F.nullif(F.col("expanding_p20"), F.lit(0.0))), ["expanding_p20"]),
        "price_trend_7d": (F.when(prior == 0, F.lit(0.0)), n),
        "inventory_burn_rate": (F.when(prior == 0, F.lit(0.5)), n),
    }


def prev_market(df: DataFrame, cols: Cols = DEFAULT_COLS, extra: dict[str, float] | None = None) -> DataFrame:
    """Per (entity, bucket) the stats of the entity's previous bucket that has data.

    A7 is an aggregate (map-side combined); the ``lag`` runs over the small bucket table, one row per (entity,
    week). ``extra`` quantiles are those of the bucket itself.
    """
    ms = market_stats(df, cols, extra)
    w = Window.partitionBy(*cols.entity).orderBy(cols.time_window)
    return ms.select(*cols.entity, cols.time_window, *(extra or {}),
                     F.lag("market_median").over(w).alias("prev_market_median"),
                     F.lag("market_size").over(w).alias("prev_market_size"))


def finalize_market(df: DataFrame, cols: Cols) -> DataFrame:
    """W19 and the size fill, once ``prev_market_median`` / ``prev_market_size`` are joined."""
    m = F.col("prev_market_median")
    return df.withColumns({
        "price_vs_prev_market": F.when(m.isNotNull() & (m > 0), F.col(cols.price) / m).otherwise(F.lit(1.0)),
        "prev_market_size": F.coalesce(F.col("prev_market_size"), F.lit(0)).cast("double"),
    })


def attach_prev_market(df: DataFrame, cols: Cols = DEFAULT_COLS) -> DataFrame:
    """J1 + W19: left join on (entity, bucket); AQE broadcasts the bucket table when small."""
    keys = [*cols.entity, cols.time_window]
    return finalize_market(join_null_safe(df, prev_market(df.select(*keys, cols.price), cols), keys), cols)


_OF_ROW = {"demand_pressure", "urgency_factor", "is_last_week"}
_OF_INSTANT = {"event_listing_frequency", "event_avg_price", "event_price_std", "listing_volume_7d", "avg_quantity_7d", "price_std_7d",
               "price_volatility", "price_stability_7d"}
_OF_QUANTILES = {"price_vs_event_median", "expanding_p20", "price_vs_expanding_p20"}
_OF_MARKET = {"prev_market_median", "prev_market_size", "price_vs_prev_market"}


def engineer_features(df: DataFrame, cols: Cols = DEFAULT_COLS, strict: bool = False, ranges: int | None = None,
                      week_quantiles: dict[str, float] | None = None, only: Sequence[str] | None = None,
                      row_id: str | None = None) -> DataFrame:
    """All per-row features of the reference plus ``time_window``; with ``only``, just those named.

    ``ranges``: into how many ranges the rows are dealt (the session's shuffle partitions if not given). ``week_quantiles``
    adds quantiles of the price over the row's own (entity, week), taken in the same pass as the market median.
    ``row_id`` keeps the row number under that name: a key that is never null and never repeats.

    The wide rows move twice: into the ranges, and in one join on the row number. All else is narrow. Parts that ``only``
    doesn't ask for are left out of the plan.
    """
    E = list(cols.entity)
    source = with_time_keys(df, cols)
    asked = None if only is None else set(only) - {cols.time_window}
    needs = lambda names: asked is None or bool(asked & names)
    in_chunks = asked is None or bool(asked - _OF_ROW - _OF_MARKET)
    out = base = deal(source, cols, ranges) if in_chunks else source
    if in_chunks:
        out = base.join(_chunk_features(base, cols, strict, needs(_OF_INSTANT), needs(_OF_QUANTILES)), RID)
    else:
        out = out.withColumns(_row_expressions(cols))
    if needs(_OF_MARKET) or week_quantiles:
        keys = [*E, cols.time_window]
        market = prev_market(base.select(*keys, cols.price), cols, week_quantiles)
        out = finalize_market(join_null_safe(out, market, keys), cols)
    derived = {n: c for n, (c, of) in _derived_expressions(cols).items() if set(of) <= set(out.columns)}
    out = out.withColumns(derived)
    if only is not None:
        return out.select(*df.columns, *[c for c in (week_quantiles or {})], *[c for c in only if c not in df.columns])
    return out.drop(TS_US, CHUNK, *([] if row_id else [RID])).withColumnsRenamed({RID: row_id} if row_id else {})


def _chunk_features(base: DataFrame, cols: Cols, strict: bool, instants: bool, quantiles: bool) -> DataFrame:
    """The features that need earlier rows, per ``_rid``."""
    E = list(cols.entity)
    narrow = [*E, CHUNK, RID, TS_US, cols.price, cols.quantity, cols.days]
    chunks = summarise(base.select(*narrow), cols)
    rows = join_null_safe(base.select(*narrow), chunks.select(*E, CHUNK, GID, "_t0", "_run"), [*E, CHUNK], "inner")
    began = F.when(F.col(TS_US) == F.col("_t0"), F.col("_run"))  # the chunk that the row's instant belongs to
    rows = write_shared(rows.withColumn("_pg", F.coalesce(began, F.col(GID))).drop(CHUNK, "_t0", "_run"))
    made = _history(rows, chunks, cols, strict)
    if instants:
        made = _instant_features(made.join(_by_instant(rows, chunks, cols), [GID, TS_US], "left"), cols.price)
    if quantiles:
        p, n = F.col(cols.price), F.col("_n_before")
        made = made.join(chunk_quantiles(rows, chunks, E, GID, RID, cols.price, QUANTILES), RID, "left")
        made = made.withColumns({"price_vs_event_median": _ratio_or_one(p, F.col("_q50"), n),
                                 "expanding_p20": F.when(n >= MIN_HISTORY, F.col("_q20"))})
    return made.drop(cols.price, *[c for c in made.columns if c.startswith("_") and c != RID])


def window_quantiles(df: DataFrame, cols: Cols = DEFAULT_COLS) -> DataFrame:
    """W3 and W15 by Spark's ``percentile`` over the growing frame: exact, but it sorts the earlier prices
    again on every row of an entity, in one task. For comparison on small tables only."""
    w = Window.partitionBy(*cols.entity).orderBy(TS_US, *cols.tiebreak)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    p = F.col(cols.price)
    n = F.count(p).over(before)
    out = with_time_keys(df, cols).select(
        "*", _ratio_or_one(p, F.percentile(p, F.lit(0.5)).over(before), n).alias("price_vs_event_median"),
        F.when(n >= MIN_HISTORY, F.percentile(p, F.lit(0.2)).over(before)).alias("expanding_p20"))
    return out.withColumn("price_vs_expanding_p20", F.try_divide(p, F.nullif(F.col("expanding_p20"), F.lit(0.0)))).drop(TS_US)
