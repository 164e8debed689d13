"""Views that map the driver's tables onto the library's data model.

Each view exists twice: as a Spark DataFrame builder and as a DuckDB SQL
text with the same meaning, so every query can be checked against an
independent engine. The mapping itself is fixed by SURVEY section 7.3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_calendar(df: DataFrame, ts: str = "listing_time", event_date: str = "event_date") -> DataFrame:
    """days/hours until the event and calendar columns."""
    return df.select(
        "*",
        S.days_until(event_date, ts).alias("days_until_event"),
        S.hours_until(event_date, ts).alias("hours_until_event"),
        S.day_of_week(event_date).alias("day_of_week"),
        S.is_weekend(event_date).alias("is_weekend_event"),
        F.month(event_date).alias("event_month"),
        F.year(event_date).alias("event_year"),
        F.month(ts).alias("listing_month"),
    )


def listings(spark: SparkSession, sf_dir: str, calendar: bool = True) -> DataFrame:
    """``listings`` stand-in built from ``events`` (one user = one event)."""
    ev = table(spark, sf_dir, "events")
    df = ev.select(
        F.col("user_id").cast("string").alias("entity"),
        "event_id",
        F.col("ts").alias("listing_time"),
        F.col("event_type").alias("zone"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").try_cast("int").alias("quantity"),
        (F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
         + F.make_dt_interval((F.col("user_id") % 15).cast("int"))).alias("event_date"),
    )
    return with_calendar(df) if calendar else df


DUCK_LISTINGS_BASE = """
SELECT CAST(user_id AS VARCHAR) AS entity, event_id, ts AS listing_time,
       event_type AS zone, value AS price,
       TRY_CAST(json_extract_string(props, '$.k') AS INT) AS quantity,
       TIMESTAMP '2024-01-20 00:00:00' + to_days(CAST(user_id % 15 AS INT)) AS event_date
FROM events
"""

DUCK_LISTINGS = f"""
SELECT b.*,
       CAST(trunc((epoch_us(event_date) - epoch_us(listing_time)) / 86400e6) AS INTEGER) AS days_until_event,
       (epoch_us(event_date) - epoch_us(listing_time)) / 3600e6 AS hours_until_event,
       CAST(isodow(event_date) - 1 AS INTEGER) AS day_of_week,
       CAST(isodow(event_date) - 1 IN (4, 5, 6) AS INTEGER) AS is_weekend_event,
       CAST(month(event_date) AS INTEGER) AS event_month,
       CAST(year(event_date) AS INTEGER) AS event_year,
       CAST(month(listing_time) AS INTEGER) AS listing_month
FROM ({DUCK_LISTINGS_BASE}) b
"""


def duck_with(body: str, **ctes: str) -> str:
    """Prefix ``body`` with ``listings`` and any extra CTEs (name -> SQL)."""
    parts = [f"listings AS ({DUCK_LISTINGS})"]
    parts += [f"{k} AS ({v})" for k, v in ctes.items()]
    head = "WITH " + ",\n".join(parts)
    b = body.lstrip()
    if b[:5].upper() == "WITH ":
        return head + ",\n" + b[5:]
    return head + "\n" + body


def clean_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings after the reference's row filters."""
    return listings(spark, sf_dir).where("days_until_event >= 0 AND quantity > 0 AND price > 0")


DUCK_CLEAN = "SELECT * FROM listings WHERE days_until_event >= 0 AND quantity > 0 AND price > 0"
