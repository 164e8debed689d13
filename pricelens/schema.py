"""Canonical schemas and column-name parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class Cols:
    """Column names used by the operators.

    ``entity`` is the list of key columns that identify one event (the
    reference keys on the event name only). ``ts`` is the listing time used for
    ordering and elapsed-time arithmetic; ``wall`` is the local wall-clock time
    used for weekly buckets and calendar columns (the same column when the data
    carries no zone). ``tiebreak`` makes the order total when times tie.
    """

    entity: tuple[str, ...] = ("entity",)
    ts: str = "listing_time"
    wall: str = "listing_time"
    tiebreak: tuple[str, ...] = ()
    price: str = "price"
    quantity: str = "quantity"
    days: str = "days_until_event"
    hours: str = "hours_until_event"
    event_date: str = "event_date"
    zone: str = "zone"
    section: str = "section"
    row: str = "row"
    time_window: str = "time_window"
    split: str = "split"
    label: str = "is_good_deal"

    def with_(self, **kw) -> "Cols":
        return replace(self, **kw)

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.tiebreak]


DEFAULT_COLS = Cols()

# Raw listing record as found in one JSON array element.
RAW_LISTING_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("row", T.StringType()),
    T.StructField("quantity", T.StringType()),  # numbers or text: coerced later, so that neither is lost
    T.StructField("price", T.StringType()),
])

# Processed CSV written by the reference's cleaning notebook. ``EVENT_MONTH``
# duplicates ``event_month`` and clashes with it under case-insensitive
# resolution, so readers drop it.
PROCESSED_CSV_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("row", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("event_date", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("listing_time", T.StringType()),
    T.StructField("days_until_event", T.IntegerType()),
    T.StructField("hours_until_event", T.DoubleType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("is_weekend_event", T.IntegerType()),
    T.StructField("event_month", T.IntegerType()),
    T.StructField("event_year", T.IntegerType()),
    T.StructField("listing_month", T.IntegerType()),
    T.StructField("EVENT_MONTH_DUP", T.StringType()),
])

# The 24 model inputs, in the reference's order.
FEATURE_COLUMNS = [
    "avg_quantity_7d", "days_since_first_listing", "demand_pressure",
    "event_avg_price", "event_duration_so_far", "event_listing_frequency",
    "event_month", "event_price_std", "hist_volatility_30d",
    "is_weekend_event", "listing_intensity", "listing_volume_7d",
    "prev_market_size", "price_change_48h", "price_std_7d",
    "price_volatility", "price_vs_event_max", "price_vs_event_median",
    "price_vs_event_min", "price_vs_expanding_p20", "price_vs_prev_market",
    "prior_listings_count", "time_to_event_ratio", "price_stability_7d",
]
