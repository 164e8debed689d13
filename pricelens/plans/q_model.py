"""Registered queries: labels, temporal split, evaluation, savings
(W22-W24, A21, A25, U2, J6, M5, M7-M10, M14, M16-M18, F14, F15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import labels as LB
from ..operators import savings as SV
from ..operators import splits as SP
from ..schema import Cols
from . import views as V
from .registry import query
from .standins import DUCK_SCORES, scores_standin

_L = V.duck_with
_CLEAN = V.DUCK_CLEAN
COLS = Cols(tiebreak=("event_id",))


# W22 / W23 -----------------------------------------------------------------------
@query("w22_good_deal_label", rnd=("current_market_p20",), sql=_L("""
WITH b AS (SELECT *, time_bucket(INTERVAL '7 days', listing_time, TIMESTAMP '1970-01-01') AS time_window FROM clean),
g AS (SELECT entity, time_window, quantile_cont(price, 0.2) AS current_market_p20 FROM b GROUP BY ALL)
SELECT b.entity, b.event_id, b.time_window, g.current_market_p20,
       coalesce(CAST(b.price <= g.current_market_p20 AS INTEGER), 0) AS is_good_deal
FROM b LEFT JOIN g USING (entity, time_window)
""", clean=_CLEAN))
def w22_good_deal_label(spark, sf):
    return LB.with_good_deal_label(V.clean_listings(spark, sf), COLS).select(
        "entity", "event_id", "time_window", "current_market_p20", "is_good_deal")


@query("w23_good_price", rnd=("price_threshold",), sql=_L("""
WITH g AS (SELECT entity, quantile_cont(price, 0.2) AS price_threshold FROM clean GROUP BY entity)
SELECT c.entity, c.event_id, g.price_threshold, coalesce(CAST(c.price <= g.price_threshold AS INTEGER), 0) AS good_price
FROM clean c LEFT JOIN g USING (entity)
""", clean=_CLEAN))
def w23_good_price(spark, sf):
    return LB.with_good_price(V.clean_listings(spark, sf), COLS).select(
        "entity", "event_id", "price_threshold", "good_price")


# W24 / A25 / U2 -----------------------------------------------------------------------
def _duck_split(src: str, key: str, ts: str) -> str:
    return f"""
WITH last AS (SELECT {key}, max({ts}) AS last_listing_time, epoch_us(max({ts})) AS u FROM {src} GROUP BY {key}),
r AS (SELECT min(u) AS lo, max(u) AS hi FROM last)
SELECT {key}, last_listing_time,
       CASE WHEN CAST(u - lo AS DOUBLE) <= CAST(hi - lo AS DOUBLE) * 0.6 THEN 'train'
            WHEN CAST(u - lo AS DOUBLE) <= CAST(hi - lo AS DOUBLE) * 0.8 THEN 'validation'
            ELSE 'test' END AS split
FROM last, r
"""


@query("w24_temporal_split", sql=_L(_duck_split("clean", "entity", "listing_time"), clean=_CLEAN))
def w24_temporal_split(spark, sf):
    return SP.entity_splits(V.clean_listings(spark, sf), COLS)


_LI = "SELECT l_suppkey, l_shipdate FROM lineitem"


@query("w24_temporal_split_lineitem", sql="WITH li AS (" + _LI + ")" + _duck_split("li", "l_suppkey", "l_shipdate").replace("WITH ", ", ", 1))
def w24_temporal_split_lineitem(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate")
    return SP.entity_splits(li, Cols(entity=("l_suppkey",), ts="l_shipdate"))


_SPLIT_ROWS = "SELECT c.*, s.split FROM clean c JOIN (" + _duck_split("clean", "entity", "listing_time") + ") s USING (entity)"


@query("a25_split_summary", sql=_L("""
SELECT split, count(DISTINCT entity) AS n_entities, count(*) AS n_listings,
       min(listing_time) AS first_listing_time, max(listing_time) AS last_listing_time
FROM sr GROUP BY split
""", clean=_CLEAN, sr=_SPLIT_ROWS))
def a25_split_summary(spark, sf):
    return SP.split_summary(SP.temporal_split(V.clean_listings(spark, sf), COLS), COLS)


@query("u2_split_overlaps", sql=_L("""
WITH p AS (SELECT DISTINCT entity, split FROM sr)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_shared
FROM p a JOIN p b USING (entity) WHERE a.split < b.split GROUP BY ALL
""", clean=_CLEAN, sr=_SPLIT_ROWS))
def u2_split_overlaps(spark, sf):
    return SP.leakage_report(SP.temporal_split(V.clean_listings(spark, sf), COLS), COLS)


@query("u2_row_split_overlaps", sql=_L("""
WITH p AS (SELECT DISTINCT entity, CASE WHEN day(listing_time) <= 18 THEN 'train'
                                        WHEN day(listing_time) <= 24 THEN 'validation' ELSE 'test' END AS split FROM clean)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_shared
FROM p a JOIN p b USING (entity) WHERE a.split < b.split GROUP BY ALL
""", clean=_CLEAN))
def u2_row_split_overlaps(spark, sf):
    """A naive split by listing date leaks entities across splits; the report counts them."""
    d = F.dayofmonth("listing_time")
    c = V.clean_listings(spark, sf).withColumn(
        "split", F.when(d <= 18, "train").when(d <= 24, "validation").otherwise("test"))
    return SP.leakage_report(c, COLS)


# M5 / M7 / M8 / M9 / M10 / M14 / M16 / M17 / J6 -----------------------------------------
_S = dict(scores=DUCK_SCORES)
_ENS = """
SELECT entity, event_id, label, 'ensemble' AS model, split, avg(probability) AS probability,
       CAST(avg(probability) >= 0.5 AS INTEGER) AS prediction
FROM scores WHERE model IN ('m1', 'm2') GROUP BY entity, event_id, split, label
"""


@query("m5_ensemble", rnd=("probability",), sql=_L(_ENS, **_S))
def m5_ensemble(spark, sf):
    return EV.ensemble(scores_standin(spark, sf), ["m1", "m2"])


_COUNTS = """
SELECT model, split, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
       count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
       count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
       count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn
FROM scores GROUP BY model, split
"""
_AUC = """
WITH d AS (SELECT model, split, probability, count(*) FILTER (WHERE label = 1) AS n_pos,
                  count(*) FILTER (WHERE label <> 1) AS n_neg FROM scores GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n_pos) OVER (PARTITION BY model, split ORDER BY probability DESC
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_above FROM d)
SELECT model, split, CASE WHEN sum(n_pos) = 0 OR sum(n_neg) = 0 THEN 0.0
                          ELSE sum(n_neg * (pos_above + n_pos * 0.5)) / (CAST(sum(n_pos) AS DOUBLE) * sum(n_neg)) END AS auc
FROM r GROUP BY ALL
"""
_METRICS = """
SELECT c.model, c.split, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, a.auc
FROM counts c JOIN auc a USING (model, split)
"""


@query("m7_metrics", sql=_L(_METRICS, **_S, counts=_COUNTS, auc=_AUC))
def m7_metrics(spark, sf):
    return EV.metrics(scores_standin(spark, sf))


@query("m7_metrics_ensemble", rnd=("auc",), sql=_L(_METRICS, **_S, ens=_ENS,
                                                    counts=_COUNTS.replace("FROM scores", "FROM ens"),
                                                    auc=_AUC.replace("FROM scores", "FROM ens")))
def m7_metrics_ensemble(spark, sf):
    return EV.metrics(EV.ensemble(scores_standin(spark, sf), ["m1", "m2"]))


@query("m8_confusion", sql=_L("""
WITH k AS (SELECT DISTINCT model, split FROM scores),
g AS (SELECT k.model, k.split, c.label, c.prediction FROM k CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(label, prediction)),
n AS (SELECT model, split, label, prediction, count(*) AS n FROM scores GROUP BY ALL)
SELECT g.model, g.split, g.label, g.prediction, coalesce(n.n, 0) AS n FROM g LEFT JOIN n USING (model, split, label, prediction)
""", **_S))
def m8_confusion(spark, sf):
    return EV.confusion(scores_standin(spark, sf))


@query("m9_roc_curve", sql=_L("""
WITH d AS (SELECT model, split, probability, count(*) FILTER (WHERE label = 1) AS n_pos,
                  count(*) FILTER (WHERE label <> 1) AS n_neg FROM scores GROUP BY ALL),
r AS (SELECT *, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp,
             sum(n_pos) OVER (PARTITION BY model, split) AS p, sum(n_neg) OVER (PARTITION BY model, split) AS n
      FROM d WINDOW w AS (PARTITION BY model, split ORDER BY probability DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT model, split, probability AS threshold,
       CASE WHEN n = 0 THEN 0.0 ELSE fp / n END AS fpr, CASE WHEN p = 0 THEN 0.0 ELSE tp / p END AS tpr FROM r
UNION ALL
SELECT DISTINCT model, split, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM scores
""", **_S))
def m9_roc_curve(spark, sf):
    return EV.roc_curve(scores_standin(spark, sf))


@query("m10_best_threshold", sql=_L("""
WITH grid AS (SELECT CAST(range AS INTEGER) AS i, 0.1::DOUBLE + CAST(range AS DOUBLE) * ((0.1::DOUBLE + 0.01::DOUBLE) - 0.1::DOUBLE) AS threshold
              FROM range(0, 90)),
v AS (SELECT model, label, probability FROM scores WHERE split = 'validation'),
acc AS (SELECT v.model, g.i, g.threshold,
               avg(CASE WHEN (v.probability >= g.threshold) = (v.label = 1) THEN 1.0 ELSE 0.0 END) AS a,
               sum(CASE WHEN (v.probability >= g.threshold) = (v.label = 1) THEN 1 ELSE 0 END) AS hits, count(*) AS n
        FROM v CROSS JOIN grid g GROUP BY ALL)
SELECT model, threshold, hits / n AS accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY hits DESC, i) AS rk FROM acc) WHERE rk = 1
""", **_S))
def m10_best_threshold(spark, sf):
    return EV.best_threshold(scores_standin(spark, sf), "validation")


@query("m10_best_threshold_test", sql=_L("""
WITH grid AS (SELECT CAST(range AS INTEGER) AS i, 0.1::DOUBLE + CAST(range AS DOUBLE) * ((0.1::DOUBLE + 0.01::DOUBLE) - 0.1::DOUBLE) AS threshold
              FROM range(0, 90)),
v AS (SELECT model, label, probability FROM scores WHERE split = 'test'),
acc AS (SELECT v.model, g.i, g.threshold,
               avg(CASE WHEN (v.probability >= g.threshold) = (v.label = 1) THEN 1.0 ELSE 0.0 END) AS a,
               sum(CASE WHEN (v.probability >= g.threshold) = (v.label = 1) THEN 1 ELSE 0 END) AS hits, count(*) AS n
        FROM v CROSS JOIN grid g GROUP BY ALL)
SELECT model, threshold, hits / n AS accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY hits DESC, i) AS rk FROM acc) WHERE rk = 1
""", **_S))
def m10_best_threshold_test(spark, sf):
    """Tuned on the test split, as the reference's script does."""
    return EV.best_threshold(scores_standin(spark, sf), "test")


@query("m14_regression_metrics", rnd=("mae", "mse", "rmse", "r2"), sql=_L("""
SELECT model, split, avg(abs(label - probability)) AS mae, avg((label - probability) * (label - probability)) AS mse,
       sqrt(avg((label - probability) * (label - probability))) AS rmse,
       CASE WHEN var_pop(label) = 0 THEN NULL
            ELSE 1.0 - avg((label - probability) * (label - probability)) / var_pop(label) END AS r2
FROM scores GROUP BY model, split
""", **_S))
def m14_regression_metrics(spark, sf):
    s = scores_standin(spark, sf).withColumn("label", F.col("label").cast("double"))
    return EV.regression_metrics(s, "label", "probability", by=("model", "split"))


@query("m16_metrics_long", sql=_L("""
UNPIVOT (""" + _METRICS + """) ON accuracy, precision, recall, f1, auc INTO NAME metric VALUE value
""", **_S, counts=_COUNTS, auc=_AUC))
def m16_metrics_long(spark, sf):
    return EV.metrics_long(EV.metrics(scores_standin(spark, sf)))


@query("m17_class_report", rnd=("precision", "recall", "f1"), sql=_L("""
WITH c AS (""" + _COUNTS + """),
per AS (
  SELECT model, split, '1' AS class, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, tp + fn AS support FROM c
  UNION ALL
  SELECT model, split, '0', CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END,
         CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END,
         CASE WHEN 2 * tn + fn + fp = 0 THEN 0.0 ELSE 2 * tn / (2 * tn + fn + fp) END, tn + fp FROM c)
SELECT * FROM per
UNION ALL SELECT model, split, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per GROUP BY ALL
UNION ALL SELECT model, split, 'weighted avg',
  CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(precision * support) / sum(support) END,
  CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(recall * support) / sum(support) END,
  CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(f1 * support) / sum(support) END, CAST(sum(support) AS BIGINT) FROM per GROUP BY ALL
""", **_S))
def m17_class_report(spark, sf):
    return EV.class_report(scores_standin(spark, sf))


_LBL = "SELECT entity, event_id, CAST(zone = 'purchase' AS INTEGER) AS label FROM clean"


@query("m18_class_weights_balanced", rnd=("weight",), sql=_L("""
SELECT l.entity, l.event_id, l.label,
       (SELECT count(*) FROM l) / ((SELECT count(DISTINCT label) FROM l) * c.nc) AS weight
FROM l JOIN (SELECT label, count(*) AS nc FROM l GROUP BY label) c USING (label)
""", clean=_CLEAN, l=_LBL))
def m18_class_weights_balanced(spark, sf):
    c = V.clean_listings(spark, sf).select("entity", "event_id", (F.col("zone") == "purchase").cast("int").alias("label"))
    return EV.with_class_weights(c, "balanced")


@query("m18_class_weights_fixed", sql=_L("""
SELECT entity, event_id, label, CASE WHEN label = 1 THEN 3.0 ELSE 1.0 END::DOUBLE AS weight FROM l
""", clean=_CLEAN, l=_LBL))
def m18_class_weights_fixed(spark, sf):
    c = V.clean_listings(spark, sf).select("entity", "event_id", (F.col("zone") == "purchase").cast("int").alias("label"))
    return EV.with_class_weights(c, "fixed")


@query("j6_attach_scores", sql=_L("""
SELECT c.entity, c.event_id, c.price,
       max(s.probability) FILTER (WHERE s.model = 'm1') AS m1_probability,
       max(s.prediction) FILTER (WHERE s.model = 'm1') AS m1_prediction,
       max(s.probability) FILTER (WHERE s.model = 'm2') AS m2_probability,
       max(s.prediction) FILTER (WHERE s.model = 'm2') AS m2_prediction
FROM clean c LEFT JOIN scores s USING (entity, event_id) GROUP BY c.entity, c.event_id, c.price
""", clean=_CLEAN, **_S))
def j6_attach_scores(spark, sf):
    c = V.clean_listings(spark, sf).select("entity", "event_id", "price")
    return EV.attach_scores(c, scores_standin(spark, sf), ["m1", "m2"])


# A21 / F14 / F15 ------------------------------------------------------------------------
@query("a21_good_price_averages", rnd=("avg_all_price", "avg_good_price", "avg_not_good_price", "good_share"), sql=_L("""
WITH g AS (SELECT entity, quantile_cont(price, 0.2) AS t FROM clean GROUP BY entity),
x AS (SELECT c.price, coalesce(CAST(c.price <= g.t AS INTEGER), 0) AS good_price FROM clean c LEFT JOIN g USING (entity))
SELECT coalesce(avg(price), 92.84) AS avg_all_price,
       coalesce(avg(price) FILTER (WHERE good_price = 1), 63.04) AS avg_good_price,
       coalesce(avg(price) FILTER (WHERE good_price = 0), 100.70) AS avg_not_good_price,
       avg(CAST(good_price AS DOUBLE)) AS good_share
FROM x
""", clean=_CLEAN))
def a21_good_price_averages(spark, sf):
    return SV.good_price_averages(V.clean_listings(spark, sf), COLS)


# Precision scenarios of the savings grid.
PRECISIONS = [0.5, 0.6, 0.623, 0.701, 0.8]


def _scenarios(spark, sf):
    c = V.table(spark, sf, "customer")
    return c.select("c_custkey", F.col("c_acctbal").alias("budget"),
                    F.explode(F.array(*[F.lit(p) for p in PRECISIONS])).alias("precision"),
                    F.lit(SV.DEFAULT_AVG_GOOD).alias("avg_good_price"),
                    F.lit(SV.DEFAULT_AVG_NOT_GOOD).alias("avg_not_good_price"),
                    F.lit(SV.DEFAULT_AVG_ALL).alias("avg_all_price"))


_SCEN = """
SELECT c_custkey, c_acctbal AS budget, p.precision, 63.04::DOUBLE AS avg_good_price,
       100.70::DOUBLE AS avg_not_good_price, 92.84::DOUBLE AS avg_all_price
FROM customer CROSS JOIN (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.623::DOUBLE), (0.701::DOUBLE), (0.8::DOUBLE)) p(precision)
"""


@query("f14_savings_script", rnd=("random_cost:6", "avg_pred_good", "model_cost:6"), sql="""
WITH s AS (""" + _SCEN + """),
a AS (SELECT *, CAST(trunc(budget / avg_all_price) AS BIGINT) AS random_tickets,
             precision * avg_good_price + (1.0 - precision) * avg_not_good_price AS avg_pred_good FROM s),
b AS (SELECT *, CAST(trunc(random_tickets * 0.2::DOUBLE) AS BIGINT) AS random_good,
             CAST(trunc(budget / avg_pred_good) AS BIGINT) AS model_tickets FROM a),
c AS (SELECT *, CAST(trunc(model_tickets * precision) AS BIGINT) AS model_good FROM b)
SELECT c_custkey, budget, precision, avg_good_price, avg_not_good_price, avg_all_price,
       random_tickets, random_good, random_tickets - random_good AS random_bad,
       random_good * avg_good_price + (random_tickets - random_good) * avg_not_good_price AS random_cost,
       avg_pred_good, model_tickets, model_good, model_tickets - model_good AS model_bad,
       model_good * avg_good_price + (model_tickets - model_good) * avg_not_good_price AS model_cost
FROM c
""")
def f14_savings_script(spark, sf):
    return SV.savings(_scenarios(spark, sf), variant="script")


@query("f15_savings_dashboard", rnd=("random_cost:6", "random_cost_per_ticket", "model_cost:6",
                                     "model_cost_per_ticket", "cost_diff:6", "cost_per_ticket_diff"), sql="""
WITH s AS (""" + _SCEN + """),
a AS (SELECT *, avg_good_price * precision + avg_not_good_price * (1.0 - precision) AS pred,
             CAST(trunc(budget / avg_not_good_price) AS BIGINT) AS random_tickets FROM s),
b AS (SELECT *, CAST(trunc(budget / pred) AS BIGINT) AS model_tickets,
             CAST(trunc(random_tickets * 0.2::DOUBLE) AS BIGINT) AS random_good,
             random_tickets * avg_not_good_price AS random_cost FROM a),
c AS (SELECT *, CAST(trunc(model_tickets * precision) AS BIGINT) AS model_good, model_tickets * pred AS model_cost,
             CASE WHEN random_tickets > 0 THEN random_cost / random_tickets ELSE 0.0 END AS random_cost_per_ticket FROM b),
d AS (SELECT *, CASE WHEN model_tickets > 0 THEN model_cost / model_tickets ELSE 0.0 END AS model_cost_per_ticket FROM c)
SELECT c_custkey, budget, precision, avg_good_price, avg_not_good_price, avg_all_price,
       random_tickets, random_good, random_cost, random_cost_per_ticket,
       model_tickets, model_good, model_cost, model_cost_per_ticket,
       model_tickets - random_tickets AS tickets_diff, model_good - random_good AS good_deals_diff,
       model_cost - random_cost AS cost_diff, model_cost_per_ticket - random_cost_per_ticket AS cost_per_ticket_diff
FROM d
""")
def f15_savings_dashboard(spark, sf):
    return SV.savings(_scenarios(spark, sf), variant="dashboard")
