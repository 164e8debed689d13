"""Registered queries: profile tables, top-k, joins, scalar functions
(A3-A6, A12-A18, A20, A26, O1-O4, J2, J3, F1-F11, F13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import profile as P
from ..operators import encode as E
from . import views as V
from .registry import query

_L = V.duck_with
_CLEAN = V.DUCK_CLEAN


# A3 / A4 ---------------------------------------------------------------------------
@query("a3_quantiles", sql=_L("""
SELECT quantile_cont(price, 0.2) AS q20, quantile_cont(price, 0.25) AS q25,
       quantile_cont(price, 0.5) AS q50, quantile_cont(price, 0.75) AS q75 FROM listings
"""), rnd=("q20", "q25", "q50", "q75"))
def a3_quantiles(spark, sf):
    from ..operators.order_stats import group_quantiles
    return group_quantiles(V.listings(spark, sf), [], "price", {"q20": 0.2, "q25": 0.25, "q50": 0.5, "q75": 0.75})


_DESC = """count(price) AS count, avg(price) AS mean, stddev_samp(price) AS std, min(price) AS min,
       quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS p50,
       quantile_cont(price, 0.75) AS p75, max(price) AS max"""
_DESC_RND = ("mean", "std", "p25", "p50", "p75")


@query("a4_describe", rnd=_DESC_RND, sql=_L(f"SELECT {_DESC} FROM listings"))
def a4_describe(spark, sf):
    return P.describe_exact(V.listings(spark, sf), "price")


@query("a4_describe_by_entity", rnd=_DESC_RND, sql=_L(f"SELECT entity, {_DESC} FROM listings GROUP BY entity"))
def a4_describe_by_entity(spark, sf):
    return P.describe_exact(V.listings(spark, sf), "price", by="entity")


# A5 / A14 --------------------------------------------------------------------------
@query("a5_value_counts", sql=_L("SELECT zone, count(*) AS n FROM listings WHERE zone IS NOT NULL GROUP BY zone"))
def a5_value_counts(spark, sf):
    return P.value_counts(V.listings(spark, sf), "zone")


@query("a5_value_counts_normalized", rnd=("share",), sql=_L("""
SELECT zone, count(*) AS n, count(*) / (SELECT count(*) FROM listings WHERE zone IS NOT NULL) AS share
FROM listings WHERE zone IS NOT NULL GROUP BY zone
"""))
def a5_value_counts_normalized(spark, sf):
    return P.value_counts(V.listings(spark, sf), "zone", normalize=True)


@query("a14_quantity_counts", sql=_L("SELECT quantity, count(*) AS n FROM clean WHERE quantity IS NOT NULL GROUP BY quantity", clean=_CLEAN))
def a14_quantity_counts(spark, sf):
    return P.value_counts(V.clean_listings(spark, sf), "quantity")


# A6 --------------------------------------------------------------------------------
@query("a6_mean_by_days", rnd=("mean_price",), sql=_L("SELECT days_until_event, avg(price) AS mean_price FROM clean GROUP BY 1", clean=_CLEAN))
def a6_mean_by_days(spark, sf):
    return P.mean_by(V.clean_listings(spark, sf), "days_until_event")


@query("a6_mean_by_quantity", rnd=("mean_price",), sql=_L("SELECT quantity, avg(price) AS mean_price FROM clean GROUP BY 1", clean=_CLEAN))
def a6_mean_by_quantity(spark, sf):
    return P.mean_by(V.clean_listings(spark, sf), "quantity")


# F9 / A12 --------------------------------------------------------------------------
def _duck_cut(src: str, col: str, bins: int) -> str:
    """SQL twin of ``scalars.cut_right_closed`` plus the bin edges."""
    return f"""
SELECT *, CASE WHEN bin = 1 THEN lo - (hi - lo) * 0.001 ELSE CAST(bin - 1 AS DOUBLE) * w + lo END AS bin_lo,
       CAST(bin AS DOUBLE) * w + lo AS bin_hi
FROM (SELECT *, CASE WHEN g2 < {bins} AND _v > CAST(g2 AS DOUBLE) * w + lo THEN g2 + 1 ELSE g2 END AS bin
  FROM (SELECT *, CASE WHEN g1 > 1 AND _v <= CAST(g1 - 1 AS DOUBLE) * w + lo THEN g1 - 1 ELSE g1 END AS g2
    FROM (SELECT s.*, e.lo, e.hi, e.w, CAST(s.{col} AS DOUBLE) AS _v,
                 coalesce(least({bins}, greatest(1, CAST(ceil((CAST(s.{col} AS DOUBLE) - e.lo) / e.w) AS INTEGER))), 1) AS g1
          FROM {src} s,
               (SELECT lo, hi, (hi - lo) / {float(bins)} AS w FROM
                  (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM {src})) e)))
"""


@query("f9_cut_right_closed", rnd=("bin_lo", "bin_hi"), sql=_L(
    "SELECT event_id, days_until_event, CAST(bin AS INTEGER) AS bin, bin_lo, bin_hi FROM (" + _duck_cut("clean", "days_until_event", 20) + ")",
    clean=_CLEAN))
def f9_cut_right_closed(spark, sf):
    df = P.with_cut(V.clean_listings(spark, sf), "days_until_event", 20)
    return df.select("event_id", "days_until_event", "bin", "bin_lo", "bin_hi")


@query("a12_pivot_zone_days_bins", rnd=("bin_lo", "bin_hi", "mean_value"), sql=_L(
    "SELECT zone, CAST(bin AS INTEGER) AS bin, bin_lo, bin_hi, avg(price) AS mean_value FROM ("
    + _duck_cut("clean", "days_until_event", 20) + ") GROUP BY ALL", clean=_CLEAN))
def a12_pivot_zone_days_bins(spark, sf):
    return P.pivot_binned(V.clean_listings(spark, sf), "zone", "days_until_event", 20)


@query("a12_pivot_zone_days_le_30", rnd=("bin_lo", "bin_hi", "mean_value"), sql=_L(
    "SELECT zone, CAST(bin AS INTEGER) AS bin, bin_lo, bin_hi, avg(price) AS mean_value FROM ("
    + _duck_cut("c30", "days_until_event", 30) + ") GROUP BY ALL",
    clean=_CLEAN, c30="SELECT * FROM clean WHERE days_until_event <= 30"))
def a12_pivot_zone_days_le_30(spark, sf):
    df = V.clean_listings(spark, sf).where("days_until_event <= 30")
    return P.pivot_binned(df, "zone", "days_until_event", 30)


# A13 / F7 --------------------------------------------------------------------------
def _duck_hist(src: str, expr: str, bins: int) -> str:
    return f"""
WITH v AS (SELECT CAST({expr} AS DOUBLE) AS v FROM {src}),
e AS (SELECT lo, hi, (hi - lo) / {float(bins)} AS w FROM (SELECT min(v) AS lo, max(v) AS hi FROM v)),
g AS (SELECT v.v, e.*, least({bins}, greatest(1, coalesce(CAST(floor((v.v - e.lo) / e.w) AS INTEGER) + 1, 1))) AS g1 FROM v, e
      WHERE v.v IS NOT NULL),
g2 AS (SELECT *, CASE WHEN g1 > 1 AND v < CAST(g1 - 1 AS DOUBLE) * w + lo THEN g1 - 1 ELSE g1 END AS g2 FROM g),
b AS (SELECT CASE WHEN g2 < {bins} AND v >= CAST(g2 AS DOUBLE) * w + lo THEN g2 + 1 ELSE g2 END AS bin FROM g2),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(r.range AS INTEGER) AS bin, CAST(r.range - 1 AS DOUBLE) * e.w + e.lo AS bin_lo,
       CASE WHEN r.range = {bins} THEN e.hi ELSE CAST(r.range AS DOUBLE) * e.w + e.lo END AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM range(1, {bins + 1}) r CROSS JOIN e LEFT JOIN c ON c.bin = r.range
WHERE e.lo IS NOT NULL
"""


@query("a13_histogram_price", rnd=("bin_lo", "bin_hi"), sql=_L(_duck_hist("clean", "price", 50), clean=_CLEAN))
def a13_histogram_price(spark, sf):
    return P.histogram(V.clean_listings(spark, sf), "price", 50)


@query("a13_histogram_log_price", rnd=("bin_lo", "bin_hi"), sql=_L(_duck_hist("lp", "lp", 30), clean=_CLEAN,
                                                                  lp="SELECT ln(1 + price) AS lp FROM clean"))
def a13_histogram_log_price(spark, sf):
    df = V.clean_listings(spark, sf).select(S.log1p("price").alias("lp"))
    return P.histogram(df, "lp", 30)


# A15 -------------------------------------------------------------------------------
@query("a15_mean_by_hour_band", rnd=("mean_price",), sql=_L("""
SELECT band, avg(price) AS mean_price, count(*) AS n FROM (
  SELECT price, CASE WHEN hours_until_event >= 0 AND hours_until_event < 24 THEN 0
                     WHEN hours_until_event >= 24 AND hours_until_event < 168 THEN 1
                     WHEN hours_until_event >= 168 AND hours_until_event < 720 THEN 2
                     WHEN hours_until_event >= 720 THEN 3 END AS band FROM listings)
WHERE band IS NOT NULL GROUP BY band
"""))
def a15_mean_by_hour_band(spark, sf):
    return P.mean_by_band(V.listings(spark, sf))


# A16 / A17 / A18 -------------------------------------------------------------------
_TIER = """
SELECT c.*, CASE WHEN price <= m.m THEN 'low' WHEN price > m.m THEN 'high' END AS tier
FROM clean c, (SELECT quantile_cont(price, 0.5) AS m FROM clean) m
"""
_QTIER = """
SELECT c.*, CASE WHEN price <= q.q1 THEN 'q1' WHEN price <= q.q2 THEN 'q2' WHEN price <= q.q3 THEN 'q3'
                 WHEN price > q.q3 THEN 'q4' END AS tier
FROM clean c, (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2,
                      quantile_cont(price, 0.75) AS q3 FROM clean) q
"""


@query("a16_corr_days_price", rnd=("corr",), sql=_L(
    "SELECT corr(days_until_event, price) AS corr, count(*) AS n FROM clean", clean=_CLEAN))
def a16_corr_days_price(spark, sf):
    return P.corr_by(V.clean_listings(spark, sf).withColumn("days_until_event", F.col("days_until_event").cast("double")),
                     "days_until_event", "price")


@query("a16_corr_by_tier", rnd=("corr",), sql=_L(
    "SELECT tier, corr(days_until_event, price) AS corr, count(*) AS n FROM tiered WHERE tier IS NOT NULL GROUP BY tier",
    clean=_CLEAN, tiered=_TIER))
def a16_corr_by_tier(spark, sf):
    t = P.with_price_tier(V.clean_listings(spark, sf)).where("tier IS NOT NULL")
    return P.corr_by(t.withColumn("days_until_event", F.col("days_until_event").cast("double")),
                     "days_until_event", "price", by="tier")


@query("a16_corr_quantity_price", rnd=("corr",), sql=_L(
    "SELECT corr(quantity, price) AS corr, count(*) AS n FROM clean", clean=_CLEAN))
def a16_corr_quantity_price(spark, sf):
    return P.corr_by(V.clean_listings(spark, sf).withColumn("quantity", F.col("quantity").cast("double")),
                     "quantity", "price")


@query("a17_linear_trend_by_tier", rnd=("slope", "intercept"), sql=_L(
    "SELECT tier, regr_slope(price, days_until_event) AS slope, regr_intercept(price, days_until_event) AS intercept, "
    "count(*) AS n FROM tiered WHERE tier IS NOT NULL GROUP BY tier", clean=_CLEAN, tiered=_TIER))
def a17_linear_trend_by_tier(spark, sf):
    t = P.with_price_tier(V.clean_listings(spark, sf)).where("tier IS NOT NULL")
    return P.linear_trend(t.withColumn("days_until_event", F.col("days_until_event").cast("double")),
                          "days_until_event", "price", by="tier")


@query("a18_tier_trend_median", rnd=("mean_price",), sql=_L(
    "SELECT tier, days_until_event, avg(price) AS mean_price FROM tiered WHERE tier IS NOT NULL GROUP BY ALL",
    clean=_CLEAN, tiered=_TIER))
def a18_tier_trend_median(spark, sf):
    return P.price_tier_trend(V.clean_listings(spark, sf), "median")


@query("a18_tier_trend_quartile", rnd=("mean_price",), sql=_L(
    "SELECT tier, days_until_event, avg(price) AS mean_price FROM tiered WHERE tier IS NOT NULL GROUP BY ALL",
    clean=_CLEAN, tiered=_QTIER))
def a18_tier_trend_quartile(spark, sf):
    return P.price_tier_trend(V.clean_listings(spark, sf), "quartile")


# A20 -------------------------------------------------------------------------------
@query("a20_distinct_entities", sql=_L("SELECT DISTINCT entity FROM listings"))
def a20_distinct_entities(spark, sf):
    return P.distinct_values(V.listings(spark, sf), "entity")


@query("a20_distinct_type_brand", sql="SELECT DISTINCT p_type, p_brand FROM part")
def a20_distinct_type_brand(spark, sf):
    return P.distinct_values(V.table(spark, sf, "part"), ["p_type", "p_brand"])


# A26 -------------------------------------------------------------------------------
def _duck_box(src: str, by: str | None) -> str:
    key = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    join = f"JOIN q USING ({by})" if by else ", q"
    return f"""
WITH q AS (SELECT {key}quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
                  quantile_cont(price, 0.75) AS q3 FROM {src} {grp})
SELECT {key}any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
       min(price) FILTER (WHERE price >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
       max(price) FILTER (WHERE price <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
       count(*) FILTER (WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) AS n_outliers,
       count(price) AS n
FROM {src} s {join} {grp}
"""


@query("a26_box_stats", rnd=("q1", "median", "q3"), sql=_L(_duck_box("clean", None), clean=_CLEAN))
def a26_box_stats(spark, sf):
    return P.box_stats(V.clean_listings(spark, sf), "price")


_TOP5 = "SELECT entity FROM clean GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 5"


@query("a26_box_stats_top5", rnd=("q1", "median", "q3"), sql=_L(
    _duck_box("c5", "entity"), clean=_CLEAN, top5=_TOP5,
    c5="SELECT * FROM clean WHERE entity IN (SELECT entity FROM top5)"))
def a26_box_stats_top5(spark, sf):
    c = V.clean_listings(spark, sf)
    top = P.top_entities(c, 5)
    return P.box_stats(P.semi_join_keys(c, F.broadcast(top), "entity"), "price", by="entity")


# O1-O4 / J2 / J3 ---------------------------------------------------------------------
@query("o1_multi_key_sort", sql=_L("""
SELECT entity, listing_time, event_id, row_number() OVER (ORDER BY entity, listing_time, event_id) AS position
FROM listings ORDER BY position
"""))
def o1_multi_key_sort(spark, sf):
    """The sorted rows with their places, so that the order itself is part of the result."""
    ls = V.listings(spark, sf).select("entity", "listing_time", "event_id")
    return P.with_position(ls, ["entity", "listing_time", "event_id"]).orderBy("position")


@query("o2_top_n", sql=_L("SELECT entity, event_id, price FROM clean ORDER BY price DESC, event_id LIMIT 10", clean=_CLEAN))
def o2_top_n(spark, sf):
    return P.top_n(V.clean_listings(spark, sf).select("entity", "event_id", "price"), 10,
                   [F.desc("price"), F.asc("event_id")])


@query("o3_bottom_k_per_entity", sql=_L("""
SELECT entity, event_id, price, CAST(rank AS INTEGER) AS rank FROM (
  SELECT entity, event_id, price, row_number() OVER (PARTITION BY entity ORDER BY price, event_id) AS rank FROM clean)
WHERE rank <= 5
""", clean=_CLEAN))
def o3_bottom_k_per_entity(spark, sf):
    df = V.clean_listings(spark, sf).select("entity", "event_id", "price")
    return P.top_k_per(df, "entity", [F.asc("price"), F.asc("event_id")], 5)


@query("o4_top_entities", rnd=("mean_price",), sql=_L("""
SELECT entity, count(*) AS n, avg(price) AS mean_price FROM clean GROUP BY entity
ORDER BY n DESC, entity LIMIT 10
""", clean=_CLEAN))
def o4_top_entities(spark, sf):
    return P.top_entities(V.clean_listings(spark, sf), 10, value="price")


@query("j2_semi_join_top_entities", sql=_L(
    "SELECT entity, event_id, price FROM clean WHERE entity IN (SELECT entity FROM top5)", clean=_CLEAN, top5=_TOP5))
def j2_semi_join_top_entities(spark, sf):
    c = V.clean_listings(spark, sf)
    return P.semi_join_keys(c, F.broadcast(P.top_entities(c, 5)), "entity").select("entity", "event_id", "price")


_NATION_MONTH = """
SELECT c.c_nationkey AS nation, CAST(month(o.o_orderdate) AS INTEGER) AS event_month,
       avg(o.o_totalprice) AS mean_price, count(*) AS n
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY ALL
"""


@query("j3_densify_months", rnd=("mean_price:6",), sql=f"""
WITH s AS ({_NATION_MONTH}),
k AS (SELECT DISTINCT nation FROM s),
grid AS (SELECT k.nation, CAST(m.range AS INTEGER) AS event_month FROM k CROSS JOIN range(1, 13) m)
SELECT g.nation, g.event_month, s.mean_price, s.n FROM grid g LEFT JOIN s USING (nation, event_month)
""")
def j3_densify_months(spark, sf):
    o = V.table(spark, sf, "orders")
    c = V.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = (o.join(c, o.o_custkey == c.c_custkey)
         .groupBy(F.col("c_nationkey").alias("nation"), F.month("o_orderdate").alias("event_month"))
         .agg(F.avg("o_totalprice").alias("mean_price"), F.count(F.lit(1)).alias("n")))
    return P.densify_months(s, "nation", "event_month")


# F1-F4, F7, F8, F11, F13 ---------------------------------------------------------------
def _duck_std(expr: str, rules) -> str:
    out = f"lower({expr})"
    for needles, repl in rules:
        cond = " OR ".join(f"contains(x, '{n}')" for n in needles)
        out = f"(SELECT CASE WHEN {cond.replace('x', 'v')} THEN '{repl}' ELSE v END FROM (SELECT {out} AS v))"
    return out


# the published rules, after rules whose texts occur in the stand-in columns; later passes see earlier results
_SECTIONS = [(("red", "hot"), "ga floor"), (("ring",), "nmres 7"), *S.SECTION_RULES]
_ZONES = [(("econ", "promo"), "ga"), (("small",), "floor general admission"), *S.ZONE_RULES]


@query("f1_f2_standardize_section", sql=f"""
SELECT p_partkey, lower(p_name) AS lowered, {_duck_std('p_name', _SECTIONS)} AS section
FROM part
""")
def f1_f2_standardize_section(spark, sf):
    p = V.table(spark, sf, "part")
    return p.select("p_partkey", F.lower("p_name").alias("lowered"),
                    S.standardize("p_name", _SECTIONS).alias("section"))


@query("f3_standardize_zone", sql=f"""
SELECT p_partkey, {_duck_std('p_type', _ZONES)} AS zone FROM part
""")
def f3_standardize_zone(spark, sf):
    p = V.table(spark, sf, "part")
    return p.select("p_partkey", S.standardize("p_type", _ZONES).alias("zone"))


@query("f4_file_keys", sql="""
SELECT o_orderkey, name, left(name, length(name) - 6) AS event_name,
       try_strptime(right(name, 6), '%y%m%d') AS event_date
FROM (SELECT o_orderkey, replace(o_orderpriority, ' ', '') || strftime(o_orderdate + INTERVAL 30 YEAR, '%y%m%d') AS name FROM orders)
""")
def f4_file_keys(spark, sf):
    o = V.table(spark, sf, "orders")
    name = F.concat(F.regexp_replace("o_orderpriority", " ", ""),
                    F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 30 YEARS"), "yyMMdd"))
    return o.select("o_orderkey", name.alias("name")).select(
        "o_orderkey", "name", S.file_event("name").alias("event_name"), S.file_date("name").alias("event_date"))


@query("f7_f8_f11_expressions", rnd=("log_price", "demand_pressure", "urgency", "ratio", "band_lo", "band_hi"), sql=_L("""
SELECT event_id, ln(1 + price) AS log_price, exp(-days_until_event / 30.0) AS demand_pressure,
       1.0 / (days_until_event + 1) AS urgency,
       CASE WHEN quantity = 0 THEN NULL ELSE price / quantity END AS ratio,
       CASE WHEN quantity = 0 THEN 1e-6 ELSE CAST(quantity AS DOUBLE) END AS qty_nz,
       g.m - 1.0 * g.s AS band_lo, g.m + 1.0 * g.s AS band_hi
FROM clean JOIN (SELECT entity, avg(price) AS m, stddev_samp(price) AS s FROM clean GROUP BY entity) g USING (entity)
""", clean=_CLEAN))
def f7_f8_f11_expressions(spark, sf):
    c = V.clean_listings(spark, sf)
    g = c.groupBy("entity").agg(F.avg("price").alias("_m"), F.stddev_samp("price").alias("_s"))
    c = c.join(g, "entity")
    lo, hi = S.band(F.col("_m"), F.col("_s"))
    d = F.col("days_until_event")
    return c.select("event_id", S.log1p("price").alias("log_price"), F.exp(-d / F.lit(30.0)).alias("demand_pressure"),
                    (F.lit(1.0) / (d + 1)).alias("urgency"),
                    S.safe_div(F.col("price"), F.col("quantity")).alias("ratio"),
                    S.zero_to(F.col("quantity").cast("double"), 1e-6).alias("qty_nz"),
                    lo.alias("band_lo"), hi.alias("band_hi"))


@query("f13_label_codes", sql="""
WITH v AS (SELECT DISTINCT coalesce(p_type, 'nan') AS value FROM part),
codes AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM v)
SELECT p.p_partkey, codes.code AS p_type_code
FROM part p JOIN codes ON coalesce(p.p_type, 'nan') = codes.value
""")
def f13_label_codes(spark, sf):
    p = V.table(spark, sf, "part")
    codes = E.fit_label_codes(p, "p_type")
    return E.apply_label_codes(p, codes, "p_type").select("p_partkey", "p_type_code")


_WIDE = ", ".join(f'avg(price) FILTER (WHERE bin = {i}) AS "{i}"' for i in range(1, 21))


@query("a12_pivot_wide", rnd=tuple(str(i) for i in range(1, 21)), sql=_L(
    "SELECT zone, " + _WIDE + " FROM (" + _duck_cut("clean", "days_until_event", 20) + ") GROUP BY zone",
    clean=_CLEAN))
def a12_pivot_wide(spark, sf):
    """The reference's shape: one row per zone, one column per bin, empty cells null."""
    return P.pivot_binned(V.clean_listings(spark, sf), "zone", "days_until_event", 20, wide=True)


@query("o3_top_k_per_entity", sql=_L("""
SELECT entity, event_id, price, CAST(rank AS INTEGER) AS rank FROM (
  SELECT entity, event_id, price, row_number() OVER (PARTITION BY entity ORDER BY price DESC, event_id) AS rank FROM clean)
WHERE rank <= 5
""", clean=_CLEAN))
def o3_top_k_per_entity(spark, sf):
    """The 5 dearest listings per entity."""
    df = V.clean_listings(spark, sf).select("entity", "event_id", "price")
    return P.top_k_per(df, "entity", [F.desc("price"), F.asc("event_id")], 5)
