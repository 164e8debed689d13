"""Registered queries: per-entity features W1-W21 (plus J1, J4, J5).

Each W-ID gets its own query (entity, event_id and that ID's columns) so a
mismatch points at one feature; ``w_all_features`` returns the whole table,
and ``w_all_features_split`` the same table from many more and smaller chunks.
"""

from __future__ import annotations

from ..operators import features as FE
from ..schema import Cols
from . import views as V
from .registry import query

COLS = Cols(tiebreak=("event_id",))

# DuckDB twin of ``features.engineer_features`` on the cleaned listings.
DUCK_FEATURES = """
WITH base AS (
  SELECT *, epoch_us(listing_time) AS ts_us,
         time_bucket(INTERVAL '7 days', listing_time, TIMESTAMP '1970-01-01') AS time_window
  FROM clean),
h AS (
  SELECT *,
    coalesce(CASE WHEN lag(ts_us) OVER w >= ts_us - 172800000000
                  THEN (price - lag(price) OVER w) / lag(price) OVER w END, 0.0) AS price_change_48h,
    CASE WHEN count(price) OVER wb >= 5 THEN price / min(price) OVER wb ELSE 1.0 END AS price_vs_event_min,
    CASE WHEN count(price) OVER wb >= 5 THEN price / quantile_cont(price, 0.5) OVER wb ELSE 1.0 END AS price_vs_event_median,
    CASE WHEN count(price) OVER wb >= 5 THEN price / max(price) OVER wb ELSE 1.0 END AS price_vs_event_max,
    exp(-days_until_event / 30.0) AS demand_pressure,
    1.0 / (days_until_event + 1) AS urgency_factor,
    CASE WHEN max(days_until_event) OVER e = 0 THEN NULL
         ELSE days_until_event / max(days_until_event) OVER e END AS time_to_event_ratio,
    CAST(coalesce(sum(quantity) OVER wb, 0) AS DOUBLE) AS cumulative_quantity,
    CAST(count(quantity) OVER r7 AS DOUBLE) AS listing_volume_7d,
    coalesce(avg(quantity) OVER r7, 0.0) AS avg_quantity_7d,
    coalesce(stddev_samp(price) OVER r7, 0.0) AS price_std_7d,
    stddev_samp(price) OVER r7 / CASE WHEN avg(price) OVER r7 = 0 THEN 1e-6 ELSE avg(price) OVER r7 END AS price_volatility,
    count(price) OVER rs AS event_listing_frequency,
    CASE WHEN count(price) OVER rs > 0 THEN avg(price) OVER rs ELSE price END AS event_avg_price,
    CASE WHEN count(price) OVER rs > 0 THEN stddev_samp(price) OVER rs ELSE 0.0 END AS event_price_std,
    row_number() OVER w - 1 AS prior_listings_count,
    (ts_us - min(ts_us) OVER e) / 86400000000.0 AS days_since_first_listing,
    (max(ts_us) OVER e - min(ts_us) OVER e) / 86400000000.0 AS event_duration_so_far,
    CASE WHEN count(price) OVER wb >= 5 THEN quantile_cont(price, 0.2) OVER wb END AS expanding_p20,
    CASE WHEN count(price) OVER w15 >= 5 THEN stddev_samp(price) OVER w15 END AS hist_volatility_30d,
    CASE WHEN row_number() OVER w - 1 >= 7 AND avg(price) OVER rw <> 0
         THEN stddev_samp(price) OVER rw / avg(price) OVER rw END AS price_stability_7d
  FROM base
  WINDOW w AS (PARTITION BY entity ORDER BY ts_us, event_id),
         wb AS (PARTITION BY entity ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         w15 AS (PARTITION BY entity ORDER BY ts_us, event_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING),
         r7 AS (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW),
         rs AS (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rw AS (PARTITION BY entity ORDER BY ts_us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING),
         e AS (PARTITION BY entity)),
d AS (
  SELECT *,
    coalesce(lag(cumulative_quantity) OVER (PARTITION BY entity ORDER BY ts_us, event_id), 0.0) AS prev_cumulative,
    prior_listings_count / (event_duration_so_far + 1e-6) AS listing_intensity,
    CAST(prior_listings_count < 5 AS INTEGER) AS is_early_listing,
    CAST(days_until_event < 7 AS INTEGER) AS is_last_week,
    price / nullif(expanding_p20, 0.0) AS price_vs_expanding_p20,
    CASE WHEN prior_listings_count = 0 THEN 0.0::DOUBLE END AS price_trend_7d,
    CASE WHEN prior_listings_count = 0 THEN 0.5::DOUBLE END AS inventory_burn_rate
  FROM h),
ms AS (
  SELECT entity, time_window, quantile_cont(price, 0.5) AS market_median, count(price) AS market_size
  FROM base GROUP BY entity, time_window),
pm AS (
  SELECT entity, time_window,
         lag(market_median) OVER (PARTITION BY entity ORDER BY time_window) AS prev_market_median,
         lag(market_size) OVER (PARTITION BY entity ORDER BY time_window) AS prev_market_size
  FROM ms),
features AS (
  SELECT d.*, pm.prev_market_median,
         CAST(coalesce(pm.prev_market_size, 0) AS DOUBLE) AS prev_market_size,
         CASE WHEN pm.prev_market_median IS NOT NULL AND pm.prev_market_median > 0
              THEN d.price / pm.prev_market_median ELSE 1.0 END AS price_vs_prev_market
  FROM d LEFT JOIN pm USING (entity, time_window))
"""

# W-ID -> (columns, columns to round)
GROUPS = {
    "w1_price_change_48h": (["price_change_48h"], []),
    "w2_price_vs_event_min_max": (["price_vs_event_min", "price_vs_event_max"], []),
    "w3_price_vs_event_median": (["price_vs_event_median"], ["price_vs_event_median"]),
    "w4_time_decay": (["demand_pressure", "urgency_factor"], ["demand_pressure"]),
    "w5_time_to_event_ratio": (["time_to_event_ratio"], []),
    "w6_cumulative_quantity": (["cumulative_quantity", "prev_cumulative"], []),
    "w7_volume_7d": (["listing_volume_7d", "avg_quantity_7d"], []),
    "w8_price_std_7d": (["price_std_7d", "price_volatility"], ["price_std_7d", "price_volatility"]),
    "w9_event_history": (["event_listing_frequency", "event_avg_price", "event_price_std"],
                         ["event_avg_price", "event_price_std"]),
    "w10_prior_listings_count": (["prior_listings_count"], []),
    "w11_days_since_first_listing": (["days_since_first_listing"], []),
    "w12_event_duration": (["event_duration_so_far"], []),
    "w13_listing_intensity": (["listing_intensity"], []),
    "w14_phase_flags": (["is_early_listing", "is_last_week"], []),
    "w15_expanding_p20": (["expanding_p20", "price_vs_expanding_p20"], ["expanding_p20", "price_vs_expanding_p20"]),
    "w16_hist_volatility": (["hist_volatility_30d"], ["hist_volatility_30d"]),
    "w17_time_window": (["time_window"], []),
    "w18_prev_market": (["prev_market_median", "prev_market_size"], ["prev_market_median"]),
    "w19_price_vs_prev_market": (["price_vs_prev_market"], ["price_vs_prev_market"]),
    "w20_placeholders": (["price_trend_7d", "inventory_burn_rate"], []),
    "w21_price_stability_7d": (["price_stability_7d"], ["price_stability_7d"]),
}

ALL_FEATURES = [c for cols, _ in GROUPS.values() for c in cols]
ALL_RND = [c for _, r in GROUPS.values() for c in r]


def features(spark, sf, ranges=None, only=None):
    return FE.engineer_features(V.clean_listings(spark, sf), COLS, ranges=ranges, only=only)


def _register(key, cols, rnd):
    sel = ", ".join(["entity", "event_id", *cols])

    @query(key, rnd=rnd, sql=V.duck_with(DUCK_FEATURES + f"SELECT {sel} FROM features", clean=V.DUCK_CLEAN))
    def _q(spark, sf):
        return features(spark, sf, only=cols).select("entity", "event_id", *cols)
    return _q


for _k, (_c, _r) in GROUPS.items():
    _register(_k, _c, _r)

_SEL_ALL = ", ".join(["entity", "event_id", "listing_time", *ALL_FEATURES])


@query("w_all_features", rnd=ALL_RND, sql=V.duck_with(DUCK_FEATURES + f"SELECT {_SEL_ALL} FROM features",
                                                      clean=V.DUCK_CLEAN))
def w_all_features(spark, sf):
    return features(spark, sf).select("entity", "event_id", "listing_time", *ALL_FEATURES)


@query("w_all_features_split", rnd=ALL_RND, sql=V.duck_with(DUCK_FEATURES + f"SELECT {_SEL_ALL} FROM features",
                                                            clean=V.DUCK_CLEAN))
def w_all_features_split(spark, sf):
    """The same table with entities cut into many more chunks than the session's settings would make."""
    return features(spark, sf, ranges=64).select("entity", "event_id", "listing_time", *ALL_FEATURES)


@query("w12_event_duration_strict", sql=V.duck_with("""
WITH b AS (SELECT *, epoch_us(listing_time) AS ts_us FROM clean)
SELECT entity, event_id,
       (ts_us - min(ts_us) OVER (PARTITION BY entity)) / 86400000000.0 AS event_duration_so_far,
       CAST(row_number() OVER (PARTITION BY entity ORDER BY ts_us, event_id) - 1 AS INTEGER)
         / ((ts_us - min(ts_us) OVER (PARTITION BY entity)) / 86400000000.0 + 1e-6) AS listing_intensity
FROM b
""", clean=V.DUCK_CLEAN))
def w12_event_duration_strict(spark, sf):
    """D4 strict mode: duration so far uses the row's own time, not the entity's last listing."""
    f = FE.engineer_features(V.clean_listings(spark, sf), COLS, strict=True)
    return f.select("entity", "event_id", "event_duration_so_far", "listing_intensity")


@query("w3_w15_window_mode", rnd=("price_vs_event_median", "expanding_p20", "price_vs_expanding_p20"),
       sql=V.duck_with(DUCK_FEATURES + "SELECT entity, event_id, price_vs_event_median, expanding_p20, "
                       "price_vs_expanding_p20 FROM features", clean=V.DUCK_CLEAN))
def w3_w15_window_mode(spark, sf):
    """The same growing quantiles through Spark's percentile window."""
    f = FE.window_quantiles(V.clean_listings(spark, sf), COLS)
    return f.select("entity", "event_id", "price_vs_event_median", "expanding_p20", "price_vs_expanding_p20")
