"""Registered queries: market rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market as M
from . import views as V
from .registry import query
from .standins import DUCK_SCORES, scores_standin


@query("a1_price_trends", rnd=("avg_price", "median_price", "std_price", "price_volatility"), sql=V.duck_with("""
SELECT days_until_event, avg(price) AS avg_price, quantile_cont(price, 0.5) AS median_price,
       stddev_samp(price) AS std_price, count(price) AS ticket_count,
       stddev_samp(price) / avg(price) AS price_volatility
FROM clean GROUP BY days_until_event ORDER BY days_until_event
""", clean=V.DUCK_CLEAN))
def a1_price_trends(spark, sf):
    return M.price_trends(V.clean_listings(spark, sf))


@query("a7_market_stats", rnd=("market_median",), sql=V.duck_with("""
SELECT entity, time_bucket(INTERVAL '7 days', listing_time, TIMESTAMP '1970-01-01') AS time_window,
       quantile_cont(price, 0.5) AS market_median, count(price) AS market_size
FROM listings GROUP BY ALL
"""))
def a7_market_stats(spark, sf):
    return M.market_stats(V.listings(spark, sf))


_ORDERS = """
SELECT o_orderpriority AS entity, CAST(month(o_orderdate) AS INTEGER) AS event_month,
       o_totalprice AS price, o_orderdate
FROM orders
"""


def _orders(spark, sf):
    return V.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("entity"), F.month("o_orderdate").alias("event_month"),
        F.col("o_totalprice").alias("price"), "o_orderdate")


@query("a8_price_patterns", rnd=("mean_price:6", "std_price:6"), sql="""
WITH o AS (""" + _ORDERS + """),
top AS (SELECT entity FROM o GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 20)
SELECT entity, event_month, avg(price) AS mean_price, stddev_samp(price) AS std_price,
       min(price) AS min_price, max(price) AS max_price, count(price) AS n
FROM o WHERE entity IN (SELECT entity FROM top) GROUP BY entity, event_month
""")
def a8_price_patterns(spark, sf):
    return M.price_patterns(_orders(spark, sf), "event_month", 20)


@query("a9_entity_summary", rnd=("mean_price:6", "std_price:6"), sql="""
WITH o AS (""" + _ORDERS + """)
SELECT entity, avg(price) AS mean_price, stddev_samp(price) AS std_price, count(*) AS n,
       min(price) AS min_price, max(price) AS max_price
FROM o GROUP BY entity ORDER BY mean_price DESC, entity
""")
def a9_entity_summary(spark, sf):
    return M.entity_summary(_orders(spark, sf))


@query("a9_month_distribution", sql="""
WITH o AS (""" + _ORDERS + """)
SELECT entity, event_month, count(*) AS n FROM o GROUP BY entity, event_month
""")
def a9_month_distribution(spark, sf):
    return M.month_distribution(_orders(spark, sf))


_MONTH_COLS = ",\n".join(f"CAST(count(*) FILTER (WHERE event_month = {m}) AS BIGINT) AS m{m:02d}" for m in range(1, 13))


@query("a10_crosstab_entity_month", sql="""
WITH o AS (""" + _ORDERS + """)
SELECT entity, """ + _MONTH_COLS + """ FROM o GROUP BY entity
""")
def a10_crosstab_entity_month(spark, sf):
    return M.crosstab_months(_orders(spark, sf), "entity", "event_month")


_SHIP = """
SELECT CAST(month(o.o_orderdate) AS INTEGER) AS order_month, CAST(month(l.l_shipdate) AS INTEGER) AS ship_month
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""
_XMONTH_COLS = ",\n".join(
    f"CAST(coalesce(sum(CASE WHEN s.ship_month = {m} THEN 1 ELSE 0 END), 0) AS BIGINT) AS m{m:02d}"
    for m in range(1, 13))


@query("a11_crosstab_month_month", sql="""
WITH s AS (""" + _SHIP + """), months AS (SELECT CAST(range AS INTEGER) AS order_month FROM range(1, 13))
SELECT m.order_month, """ + _XMONTH_COLS + """
FROM months m LEFT JOIN s ON m.order_month = s.order_month GROUP BY m.order_month
""")
def a11_crosstab_month_month(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    s = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.month("o_orderdate").alias("order_month"), F.month("l_shipdate").alias("ship_month"))
    return M.crosstab_month_by_month(s, "order_month", "ship_month")


@query("a22_probability_by_day", rnd=("mean_probability", "std_probability"), sql=V.duck_with("""
SELECT model, days_until_event, avg(probability) AS mean_probability,
       stddev_samp(probability) AS std_probability, count(probability) AS count
FROM scores GROUP BY model, days_until_event
""", scores=DUCK_SCORES))
def a22_probability_by_day(spark, sf):
    return M.probability_by_day(scores_standin(spark, sf))


_CURVE = """
SELECT model, days_until_event, avg(probability) AS mean_probability, count(probability) AS count
FROM scores GROUP BY model, days_until_event
"""


@query("a23_probability_summary", rnd=("avg_probability", "std_probability"), sql=V.duck_with("""
SELECT model, avg(mean_probability) AS avg_probability, stddev_samp(mean_probability) AS std_probability,
       CAST(sum(count) AS BIGINT) AS total_samples, count(*) AS unique_days
FROM curve GROUP BY model
""", scores=DUCK_SCORES, curve=_CURVE))
def a23_probability_summary(spark, sf):
    return M.probability_summary(M.probability_by_day(scores_standin(spark, sf)))


@query("w25_best_day", rnd=("best_value",), sql=V.duck_with("""
SELECT model, best_day, best_value FROM (
  SELECT model, days_until_event AS best_day, mean_probability AS best_value,
         row_number() OVER (PARTITION BY model ORDER BY mean_probability DESC, days_until_event) AS rk
  FROM curve WHERE count >= 5) WHERE rk = 1
""", scores=DUCK_SCORES, curve=_CURVE))
def w25_best_day(spark, sf):
    return M.best_day(M.probability_by_day(scores_standin(spark, sf)))


@query("w25_best_day_30", rnd=("best_value",), sql=V.duck_with("""
SELECT model, best_day, best_value FROM (
  SELECT model, days_until_event AS best_day, mean_probability AS best_value,
         row_number() OVER (PARTITION BY model ORDER BY mean_probability DESC, days_until_event) AS rk
  FROM curve WHERE count >= 5 AND days_until_event <= 30) WHERE rk = 1
""", scores=DUCK_SCORES, curve=_CURVE))
def w25_best_day_30(spark, sf):
    return M.best_day(M.probability_by_day(scores_standin(spark, sf)), max_day=30)
