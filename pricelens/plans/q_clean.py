"""Registered queries: parsing, filters, outliers, duplicates, quality (P, U, A19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clean as C
from ..operators import market as M
from . import views as V
from .registry import query

_L = V.duck_with  # listings CTE prefix


# P1 ----------------------------------------------------------------------------
@query("p1_coerce_numeric", sql="""
SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS value
FROM orders
""")
def p1_coerce_numeric(spark, sf):
    o = V.table(spark, sf, "orders")
    txt = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", S.coerce_numeric(txt, "double").alias("value"))


# P2 / P3 -------------------------------------------------------------------------
@query("p2_parse_listing_time", sql="""
SELECT event_id, strptime(strftime(ts, '%m-%d-%y / %I:%M %p'), '%m-%d-%y / %I:%M %p') AS listing_time
FROM events
""")
def p2_parse_listing_time(spark, sf):
    ev = V.table(spark, sf, "events")
    txt = F.date_format("ts", S.LISTING_TIME_FORMAT)
    return ev.select("event_id", S.parse_listing_time(txt).alias("listing_time"))


@query("p3_parse_or_null", sql="""
SELECT event_id, try_strptime(CASE WHEN event_type = 'error' THEN 'not a time'
                                   ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END, '%Y-%m-%d %H:%M:%S') AS parsed
FROM events
""")
def p3_parse_or_null(spark, sf):
    ev = V.table(spark, sf, "events")
    txt = F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return ev.select("event_id", S.parse_or_null(txt, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


# P6 / P7 / F5 / F6 ---------------------------------------------------------------
@query("p6_p7_days_hours_until", sql=_L("""
SELECT entity, event_id, event_date, days_until_event, hours_until_event, day_of_week,
       is_weekend_event, event_month, event_year, listing_month
FROM listings
"""))
def p6_p7_days_hours_until(spark, sf):
    return V.listings(spark, sf).select(
        "entity", "event_id", "event_date", "days_until_event", "hours_until_event", "day_of_week",
        "is_weekend_event", "event_month", "event_year", "listing_month")


# P8 / P9 / P10 / P11 / P12 / P16 / P17 ---------------------------------------------
@query("p8_filter_nonneg_days", sql=_L("SELECT event_id, days_until_event FROM listings WHERE days_until_event >= 0"))
def p8_filter_nonneg_days(spark, sf):
    return C.filter_nonneg_days(V.listings(spark, sf)).select("event_id", "days_until_event")


@query("p9_filter_valid", sql=_L("SELECT event_id, quantity, price FROM listings WHERE quantity > 0 AND price > 0"))
def p9_filter_valid(spark, sf):
    return C.filter_valid(V.listings(spark, sf)).select("event_id", "quantity", "price")


@query("p10_filter_in", sql=_L("SELECT event_id, zone FROM listings WHERE zone IN ('click', 'view', 'purchase')"))
def p10_filter_in(spark, sf):
    return C.filter_in(V.listings(spark, sf), "zone", ["click", "view", "purchase"]).select("event_id", "zone")


@query("p11_range_days_le_30", sql=_L("SELECT event_id, days_until_event FROM clean WHERE days_until_event <= 30",
                                      clean=V.DUCK_CLEAN))
def p11_range_days_le_30(spark, sf):
    return V.clean_listings(spark, sf).where("days_until_event <= 30").select("event_id", "days_until_event")


@query("p11_range_price_lt_10", sql=_L("SELECT entity, event_id, price FROM listings WHERE price < 10"))
def p11_range_price_lt_10(spark, sf):
    return V.listings(spark, sf).where("price < 10").select("entity", "event_id", "price")


@query("p12_ne_nullsafe", sql=_L("""
SELECT event_id, zone_n FROM (
  SELECT event_id, CASE WHEN quantity < 5 THEN NULL ELSE zone END AS zone_n FROM listings)
WHERE zone_n IS DISTINCT FROM 'click'
"""))
def p12_ne_nullsafe(spark, sf):
    ls = V.listings(spark, sf).select(
        "event_id", F.when(F.col("quantity") < 5, F.lit(None)).otherwise(F.col("zone")).alias("zone_n"))
    return C.filter_ne_nullsafe(ls, "zone_n", "click")


@query("p16_temporal_issues", sql=_L("SELECT entity, event_id, listing_time, event_date FROM listings WHERE listing_time > event_date"))
def p16_temporal_issues(spark, sf):
    return C.temporal_issues(V.listings(spark, sf)).select("entity", "event_id", "listing_time", "event_date")


@query("p17_column_subset", sql=_L("SELECT entity, listing_time, price FROM listings"))
def p17_column_subset(spark, sf):
    return V.listings(spark, sf).select("entity", "listing_time", "price")


# P13 / P14 / P15 ------------------------------------------------------------------
@query("p13_global_outliers", sql=_L("""
WITH q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM listings)
SELECT l.entity, l.event_id, l.price FROM listings l, q
WHERE l.price < q.q1 - 1.5 * (q.q3 - q.q1) OR l.price > q.q3 + 1.5 * (q.q3 - q.q1)
"""))
def p13_global_outliers(spark, sf):
    return C.global_outliers(V.listings(spark, sf), "price").select("entity", "event_id", "price")


_GQ = """
SELECT entity, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3,
       min(price) AS min, max(price) AS max FROM listings GROUP BY entity
"""


@query("p14_iqr_filter", sql=_L("""
SELECT l.entity, l.event_id, l.price FROM listings l JOIN gq USING (entity)
WHERE l.price >= gq.q1 - 1.5 * (gq.q3 - gq.q1) AND l.price <= gq.q3 + 1.5 * (gq.q3 - gq.q1)
""", gq=_GQ))
def p14_iqr_filter(spark, sf):
    return C.iqr_filter(V.listings(spark, sf), ["entity"], "price").select("entity", "event_id", "price")


@query("p15_low_outlier_report", rnd=("iqr", "lower"), sql=_L("""
SELECT gq.entity, gq.min, gq.max, gq.q3 - gq.q1 AS iqr, gq.q1 - 1.5 * (gq.q3 - gq.q1) AS lower,
       count(*) FILTER (WHERE l.price < gq.q1 - 1.5 * (gq.q3 - gq.q1)) AS n_below
FROM gq JOIN listings l USING (entity) GROUP BY ALL
""", gq=_GQ))
def p15_low_outlier_report(spark, sf):
    return C.low_outlier_report(V.listings(spark, sf), ["entity"], "price")


# P18 ---------------------------------------------------------------------------
@query("p18_reliable_days", rnd=("avg_price",), sql=_L("""
SELECT days_until_event, avg(price) AS avg_price, count(price) AS ticket_count
FROM clean GROUP BY days_until_event HAVING count(price) >= 5
""", clean=V.DUCK_CLEAN))
def p18_reliable_days(spark, sf):
    t = M.price_trends(V.clean_listings(spark, sf)).select("days_until_event", "avg_price", "ticket_count")
    return C.reliable(t, "ticket_count", 5)


# U4 / U5 / U6 ---------------------------------------------------------------------
def _li_keys(spark, sf):
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")


@query("u4_drop_exact_duplicates", sql="SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def u4_drop_exact_duplicates(spark, sf):
    return C.drop_exact_duplicates(_li_keys(spark, sf))


@query("u5_duplicates_after_first", sql="""
SELECT l_orderkey, l_linenumber, count(*) - 1 AS n_extra FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def u5_duplicates_after_first(spark, sf):
    return C.duplicates_after_first(_li_keys(spark, sf))


@query("u6_duplicates_all", sql="""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, CAST(l.l_quantity AS INTEGER) AS l_quantity
FROM lineitem l
WHERE (l.l_orderkey, l.l_linenumber) IN (
  SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
""")
def u6_duplicates_all(spark, sf):
    li = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("l_quantity"))
    return C.duplicates_all(li, ["l_orderkey", "l_linenumber"])


# A19 ---------------------------------------------------------------------------
_LCOLS = ["entity", "event_id", "listing_time", "zone", "price", "quantity", "event_date",
          "days_until_event", "hours_until_event", "day_of_week", "is_weekend_event",
          "event_month", "event_year", "listing_month"]
_NULLS = ",\n".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in _LCOLS)


@query("a19_quality_report", sql=_L(f"""
SELECT {_NULLS},
       count(*) FILTER (WHERE days_until_event < 0) AS negative_days,
       count(*) FILTER (WHERE listing_time > event_date) AS temporal_issues,
       count(*) AS total_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM listings)) AS duplicate_rows
FROM listings
"""))
def a19_quality_report(spark, sf):
    return C.quality_report(V.listings(spark, sf).select(*_LCOLS))


@query("u5_duplicates_expanded", sql="""
SELECT d.l_orderkey, d.l_linenumber FROM (
  SELECT l_orderkey, l_linenumber, count(*) - 1 AS e FROM lineitem
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) d, range(d.e)
""")
def u5_duplicates_expanded(spark, sf):
    """Every copy after the first, expanded in bounded, hash-distributed pieces."""
    return C.duplicates_after_first(_li_keys(spark, sf), expand=True)
