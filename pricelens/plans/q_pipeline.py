"""Registered queries: the end-to-end model table, training and scoring, and
operators that need it or that format, union or upsert tables
(M1-M6, M11-M13, A2, A24, F10, F12, U1, U3, S4, S6-S10, P4, P5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ml as ML
from ..operators import tree_nodes as N
from ..session import cut_lineage
from ..sources import results as R
from . import views as V
from .pipeline import model_table, train
from .q_features import ALL_FEATURES, ALL_RND, DUCK_FEATURES
from .q_model import _AUC, _COUNTS, _METRICS, COLS, _duck_split
from .standins import DUCK_SCORES
from .registry import query

_TABLE_COLS = ["entity", "event_id", "listing_time", "split", *ALL_FEATURES, "current_market_p20", "is_good_deal"]
_FILLED = [c for c in ALL_FEATURES if c not in ("time_window",)]


def _duck_model_table(columns=tuple(_TABLE_COLS)) -> str:
    fill = ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" if c in _FILLED and c in _FEATURE_SET else c
        for c in columns)
    return V.duck_with(DUCK_FEATURES + """,
sp AS (""" + _duck_split("clean", "entity", "listing_time") + """),
g AS (SELECT entity, time_window, quantile_cont(price, 0.2) AS current_market_p20 FROM features GROUP BY ALL),
lab AS (SELECT f.*, sp.split, g.current_market_p20,
               coalesce(CAST(f.price <= g.current_market_p20 AS INTEGER), 0) AS is_good_deal
        FROM features f JOIN sp USING (entity) LEFT JOIN g USING (entity, time_window))
SELECT """ + fill + " FROM lab", clean=V.DUCK_CLEAN)


# model inputs that the fill turns to DOUBLE (the 24 inputs present in the table)
from ..schema import FEATURE_COLUMNS as _FC  # noqa: E402

_FEATURE_SET = set(_FC)


@query("pipeline_model_table", rnd=(*ALL_RND, "current_market_p20"), sql=_duck_model_table())
def pipeline_model_table(spark, sf):
    return model_table(V.listings(spark, sf), COLS).select(*_TABLE_COLS)


_TRAINED: dict = {}


def _trained(spark, sf):
    """The reference's models on the model table; fitted once per session and folder."""
    return _table_and_models(spark, sf)[1]


def _table_and_models(spark, sf):
    k = (spark.sparkContext.applicationId, sf)  # no later session has the same
    if k not in _TRAINED:
        t = cut_lineage(model_table(V.listings(spark, sf), COLS))
        _TRAINED[k] = t, train(t, models=ML.REFERENCE_MODELS, key=("entity", "event_id"), checkpoint=False)
    return _TRAINED[k]


@query("m6_train_and_score")
def m6_train_and_score(spark, sf):
    """M1-M6: long-form scores of four models and the ensemble (rows only)."""
    t, (fitted, _, _) = _table_and_models(spark, sf)
    return ML.score_all_written(fitted, t, _KEY)


_KEY = ("entity", "event_id")
_MODELS = (*ML.REFERENCE_MODELS, "ensemble")
_TREES = tuple(n for n, m in ML.REFERENCE_MODELS.items() if m.family != "lr")


def _recomputed(spark, t, fitted, feats):
    """(key, model, expected): probabilities from the models' node tables and coefficients, without the learners' code."""
    parts = []
    for name, model in fitted.items():
        if name in _TREES:
            nodes = cut_lineage(N.node_table(spark, model, _scratch(spark, name)))
            w = N.walk(t, nodes, feats, _KEY)
            p = N.probability(ML.REFERENCE_MODELS[name].family, F.col("margin_mean"), F.col("margin_sum"))
        else:
            line = F.lit(float(model.stages[-1].intercept))
            for f, c in zip(feats, model.stages[-1].coefficients.toArray()):
                line = line + F.col(f).cast("double") * F.lit(float(c))
            w, p = t, F.lit(1.0) / (F.lit(1.0) + F.exp(-line))
        part = w.select(*_KEY, F.lit(name).alias("model"), p.alias("expected"))
        parts.append(part.persist() if name in ML.ENSEMBLE_MEMBERS else part)  # the ensemble reads them again
    return reduce(DataFrame.unionByName, parts)


def _with_ensemble(expected):
    members = expected.where(F.col("model").isin(*ML.ENSEMBLE_MEMBERS))
    return expected.unionByName(members.groupBy(*_KEY).agg(F.lit("ensemble").alias("model"), F.avg("expected").alias("expected")))


def _agreement(scores, expected):
    near = F.abs(F.col("probability") - F.col("expected")) <= 1e-9
    return scores.join(expected, [*_KEY, "model"], "left").select(*_KEY, "model", "split", "label", F.coalesce(near, F.lit(False)).alias("agrees"))


def _duck_agreement(models) -> str:
    return f"""
SELECT t.entity, t.event_id, m.model, t.split, CAST(t.is_good_deal AS INTEGER) AS label, TRUE AS agrees
FROM ({_duck_model_table()}) t CROSS JOIN (VALUES {", ".join(f"('{m}')" for m in models)}) AS m(model)"""


@query("m6_scores_recomputed", sql=_duck_agreement(_MODELS))
def m6_scores_recomputed(spark, sf):
    """M1-M6: every row scored by every model, and whether a walk down the node tables (for the logistic regression, its
    line) gives that probability too, to 1e-9."""
    t, (fitted, _, feats) = _table_and_models(spark, sf)
    return _agreement(ML.score_all_written(fitted, t, _KEY), _with_ensemble(_recomputed(spark, t, fitted, feats)))


@query("m11_importances")
def m11_importances(spark, sf):
    fitted, _, feats = _trained(spark, sf)
    return ML.importances(spark, fitted, feats)


def _importances_by_nodes(spark, fitted, feats):
    names = spark.createDataFrame(list(enumerate(feats)), "feature int, name string")
    parts = []
    for name in _TREES:
        nodes = N.node_table(spark, fitted[name], _scratch(spark, name))
        own = names.join(N.importances(nodes, ML.REFERENCE_MODELS[name].family == "rf"), "feature", "left")
        parts.append(own.select(F.lit(name).alias("model"), F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("expected")))
    return reduce(DataFrame.unionByName, parts)


_DUCK_FEATURES = "(VALUES " + ", ".join(f"('{f}')" for f in _FC) + ") AS f(feature)"


@query("m11_importances_recomputed", sql=f"""
SELECT m.model, f.feature, TRUE AS agrees
FROM {_DUCK_FEATURES} CROSS JOIN (VALUES {", ".join(f"('{m}')" for m in _TREES)}) AS m(model)""")
def m11_importances_recomputed(spark, sf):
    """Whether the gains of the nodes add up to each importance, to 1e-9."""
    fitted, _, feats = _trained(spark, sf)
    both = ML.importances(spark, fitted, feats).join(_importances_by_nodes(spark, fitted, feats), ["model", "feature"], "left")
    return both.select("model", "feature", F.coalesce(F.abs(F.col("importance") - F.col("expected")) <= 1e-9, F.lit(False)).alias("agrees"))


def _selection(spark, sf):
    """(inputs, the quick model of the selection), fitted once per session and folder."""
    k = (spark.sparkContext.applicationId, sf, "selection")
    if k not in _TRAINED:
        t = cut_lineage(model_table(V.listings(spark, sf), COLS).where("split = 'train'"))
        feats = [c for c in _FC if c in t.columns]
        _TRAINED[k] = feats, ML.fit_model(t, feats, ML.SELECTION, "is_good_deal")
    return _TRAINED[k]


@query("m12_selected_features")
def m12_selected_features(spark, sf):
    feats, model = _selection(spark, sf)
    return spark.createDataFrame([(f,) for f in ML.select_features(None, feats, model=model)], "feature string")


@query("m12_selection_recomputed", sql=f"SELECT f.feature, TRUE AS agrees FROM {_DUCK_FEATURES}")
def m12_selection_recomputed(spark, sf):
    """Whether the gains of the quick model's nodes keep and drop the same inputs."""
    feats, model = _selection(spark, sf)
    kept = ML.select_features(None, feats, model=model)
    names = spark.createDataFrame([(i, f, f in kept) for i, f in enumerate(feats)], "feature int, name string, kept boolean")
    own = names.join(N.importances(N.node_table(spark, model, _scratch(spark, "selection")), False), "feature", "left")
    agrees = (F.coalesce("importance", F.lit(0.0)) >= ML.MIN_IMPORTANCE) == F.col("kept")
    return own.select(F.col("name").alias("feature"), agrees.alias("agrees"))


@query("m13_random_search")
def m13_random_search(spark, sf):
    """Errors of 20 draws in 5 folds, for a regressor of the good-deal label; ``best`` marks the draw whose model is
    fitted on all rows (rows only)."""
    t = cut_lineage(model_table(V.listings(spark, sf), COLS).where("split = 'train'"))
    _, _, trials = ML.random_search(t, [c for c in _FC if c in t.columns], "is_good_deal")
    return trials


# S9 -------------------------------------------------------------------------
_NEW_NATIONS = """
SELECT n_nationkey, n_name || '_v2' AS n_name, n_regionkey FROM nation WHERE n_regionkey = 0
UNION ALL
SELECT n_nationkey + 100, n_name || '_new', n_regionkey FROM nation WHERE n_regionkey = 1
"""


@query("s9_keyed_upsert", sql=f"""
WITH new AS ({_NEW_NATIONS})
SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM new)
UNION ALL SELECT * FROM new
""")
def s9_keyed_upsert(spark, sf):
    n = V.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    changed = n.where("n_regionkey = 0").select("n_nationkey", F.concat("n_name", F.lit("_v2")).alias("n_name"), "n_regionkey")
    added = n.where("n_regionkey = 1").select((F.col("n_nationkey") + 100).alias("n_nationkey"),
                                             F.concat("n_name", F.lit("_new")).alias("n_name"), "n_regionkey")
    return R.upsert(n, changed.unionByName(added), "n_nationkey")


# P4 / P5 --------------------------------------------------------------------
_NY = "'America/New_York'"


@query("p4_p5_localize", sql=f"""
WITH w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL '90 minutes'
                                   ELSE o_orderdate + INTERVAL '150 minutes' END AS wall FROM orders),
u AS (SELECT *, timezone('UTC', timezone({_NY}, wall)) AS u FROM w),
s AS (SELECT *, CASE WHEN wall IS NULL THEN NULL
                     WHEN timezone({_NY}, timezone('UTC', u)) <> wall THEN 'nonexistent'
                     WHEN timezone({_NY}, timezone('UTC', u - INTERVAL 1 HOUR)) = wall
                       OR timezone({_NY}, timezone('UTC', u + INTERVAL 1 HOUR)) = wall THEN 'ambiguous'
                     ELSE 'ok' END AS status FROM u)
SELECT o_orderkey, wall, status, CASE WHEN status = 'ok' THEN u END AS utc,
       CASE WHEN status = 'ok' THEN timezone({_NY}, timezone('UTC', u)) END AS back
FROM s
""")
def p4_p5_localize(spark, sf):
    """Order dates at 01:30 or 02:30 New York wall time: DST gaps and repeats."""
    o = V.table(spark, sf, "orders")
    wall = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate") + F.expr("INTERVAL '1:30' HOUR TO MINUTE")) \
        .otherwise(F.col("o_orderdate") + F.expr("INTERVAL '2:30' HOUR TO MINUTE"))
    tz = "America/New_York"
    out = o.select("o_orderkey", wall.alias("wall"))
    return out.select("o_orderkey", "wall", S.localize_status("wall", tz).alias("status"),
                      S.localize("wall", tz, "null").alias("utc"),
                      S.to_zone(S.localize("wall", tz, "null"), tz).alias("back"))


# A2 / F10 -------------------------------------------------------------------
@query("a2_trend_maps", sql=V.duck_with("""
, t AS (SELECT days_until_event AS d, avg(price) AS p, count(price) AS n FROM clean GROUP BY 1)
SELECT 'All Events' AS event_key, string_agg(d || ':' || format('{:,.4f}', p) || ':' || n, ' ' ORDER BY d) AS entries FROM t
""".replace(", t AS", "WITH t AS", 1), clean=V.DUCK_CLEAN))
def a2_trend_maps(spark, sf):
    """Day -> mean price and day -> count maps under 'All Events', shown as text in order of days."""
    from ..operators import market as M
    maps = M.trend_maps(M.price_trends(V.clean_listings(spark, sf)))
    days = F.array_sort(F.map_keys("prices"))
    entry = F.transform(days, lambda d: F.concat_ws(":", d, F.format_number(F.element_at("prices", d), 4),
                                                    F.element_at("counts", d)))
    return maps.select("event_key", F.array_join(entry, " ").alias("entries"))


@query("f10_trend_maps_long", rnd=("avg_price",), sql=V.duck_with("""
SELECT 'All Events' AS event_key, days_until_event, avg(price) AS avg_price, count(price) AS ticket_count
FROM clean GROUP BY days_until_event
""", clean=V.DUCK_CLEAN))
def f10_trend_maps_long(spark, sf):
    """Maps back to parallel columns: the round trip of A2 equals the long trend table."""
    from ..operators import market as M
    return M.trend_maps_long(M.trend_maps(M.price_trends(V.clean_listings(spark, sf))))


# A24 / U3 / F12 ---------------------------------------------------------------
@query("a24_importance_table")
def a24_importance_table(spark, sf):
    """Mean importance per feature across the trained tree models (rows only)."""
    from ..operators import profile as P
    fitted, _, feats = _trained(spark, sf)
    imp = ML.importances(spark, fitted, feats).select("model", "feature", "importance")
    return P.importance_table(imp)


@query("a24_importance_table_recomputed", sql=f"SELECT f.feature, TRUE AS agrees FROM {_DUCK_FEATURES}")
def a24_importance_table_recomputed(spark, sf):
    """Whether the mean over the models' node tables is each mean importance, to 1e-9."""
    from ..operators import profile as P
    fitted, _, feats = _trained(spark, sf)
    mean = _importances_by_nodes(spark, fitted, feats).groupBy("feature").agg(F.avg("expected").alias("expected"))
    both = P.importance_table(ML.importances(spark, fitted, feats).select("model", "feature", "importance")).join(mean, "feature", "left")
    return both.select("feature", F.coalesce(F.abs(F.col("mean_importance") - F.col("expected")) <= 1e-9, F.lit(False)).alias("agrees"))


@query("u3_missing_features", sql=f"""
SELECT feature FROM (
  SELECT unnest([{", ".join(f"'{f}'" for f in _FC)}]) AS feature, unnest(counts) AS n
  FROM (SELECT [{", ".join(f"count({f})" for f in _FC)}] AS counts FROM ({_duck_model_table(tuple(_FC))}) t))
WHERE n = 0""")
def u3_missing_features(spark, sf):
    """Expected model inputs that the model table has no column or no value of (empty when complete)."""
    from ..operators import clean as C
    t = model_table(V.listings(spark, sf), COLS)
    return C.inputs_without_values(t, _FC)


@query("f12_display_formats", sql="""
SELECT c_custkey, p.precision, '$' || format('{:,.2f}', c_acctbal * p.precision) AS cost_text,
       format('{:,.1f}', p.precision * 100) || '%' AS precision_text,
       format('{:,}', CAST(trunc(c_acctbal / 7) AS BIGINT)) AS tickets_text
FROM customer CROSS JOIN (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.623::DOUBLE), (0.701::DOUBLE), (0.8::DOUBLE)) p(precision)
""")
def f12_display_formats(spark, sf):
    """Money, percent and thousands formats over the savings scenarios of every customer."""
    from .q_model import _scenarios
    s = _scenarios(spark, sf)
    return s.select("c_custkey", "precision", S.fmt_money(F.col("budget") * F.col("precision")).alias("cost_text"),
                    S.fmt_percent("precision").alias("precision_text"),
                    S.fmt_thousands((F.col("budget") / 7).cast("long")).alias("tickets_text"))


# U1 -------------------------------------------------------------------------
@query("u1_union_by_name", sql="""
SELECT c_custkey AS party_key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier
""")
def u1_union_by_name(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("party_key"), F.col("c_name").alias("name"),
                                              F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
                                              F.col("c_mktsegment").alias("segment"))
    s = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("party_key"), F.col("s_name").alias("name"),
                                              F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return c.unionByName(s, allowMissingColumns=True)


# Sinks written under the shared checkpoint folder and read back
def _scratch(spark, name: str) -> str:
    import uuid
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/roundtrip-{name}-{uuid.uuid4().hex[:8]}"


_CSV_COLS = ["timestamp", "zone", "section", "row", "quantity", "price", "event_date", "event_name",
             "listing_time", "days_until_event", "hours_until_event", "day_of_week", "is_weekend_event",
             "event_month", "event_year", "listing_month", "EVENT_MONTH_DUP"]


@query("s4_s7_csv_round_trip", sql=V.duck_with("""
SELECT entity AS event_name, price, quantity, days_until_event, listing_time,
       CAST(event_date AS TIMESTAMP) AS event_date
FROM listings
"""))
def s4_s7_csv_round_trip(spark, sf):
    """Listings written as the processed CSV (S7) and read back with its schema."""
    from ..sources import listings as L
    ls = V.listings(spark, sf)
    out = ls.select(F.date_format("listing_time", S.LISTING_TIME_FORMAT).alias("timestamp"), "zone",
                    F.lit(None).cast("string").alias("section"), F.lit(None).cast("double").alias("row"),
                    "quantity", "price", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
                    F.col("entity").alias("event_name"),
                    F.date_format("listing_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("listing_time"),
                    "days_until_event", "hours_until_event", "day_of_week", "is_weekend_event", "event_month",
                    "event_year", "listing_month", F.col("event_month").cast("string").alias("EVENT_MONTH_DUP"))
    path = _scratch(spark, "csv")
    R.write_table(out, path, "csv")
    back = L.read_listing_csv(spark, path)
    return back.select("event_name", "price", "quantity", "days_until_event", "listing_time", "event_date")


_FILE = "'User' || user_id || strftime(TIMESTAMP '2024-01-20 00:00:00' + to_days(CAST(user_id % 15 AS INT)), '%y%m%d')"


@query("s1_s3_json_round_trip", sql=f"""
SELECT 'User' || user_id AS event_name, TIMESTAMP '2024-01-20 00:00:00' + to_days(CAST(user_id % 15 AS INT)) AS event_date,
       strftime(ts, '%m-%d-%y / %I:%M %p') AS timestamp, 'Balcón ' || event_type AS section, value AS price, NULL::VARCHAR AS reason
FROM events WHERE user_id % 10 <> 7
UNION ALL
SELECT DISTINCT {_FILE} || '.json', NULL, NULL, NULL, NULL, 'unparsable' FROM events WHERE user_id % 10 = 7
""")
def s1_s3_json_round_trip(spark, sf):
    """Events as one JSON array per user, every third file in Latin-1 and every tenth cut short; scanned back (S1, S2) with the
    charset chosen by validity (S3), and the files that don't parse as rejects."""
    from ..sources import listings as L
    ev = V.table(spark, sf, "events")
    date = F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'") + F.make_dt_interval((F.col("user_id") % 15).cast("int"))
    broken, latin1 = F.col("user_id") % 10 == 7, F.col("user_id") % 3 == 1
    rows = ev.select(F.concat(F.lit("User"), F.col("user_id"), F.date_format(date, "yyMMdd")).alias("_name"),
                     latin1.alias("_latin1"), broken.alias("_broken"), F.date_format("ts", S.LISTING_TIME_FORMAT).alias("timestamp"),
                     F.col("event_type").alias("zone"), F.concat(F.lit("Balcón "), "event_type").alias("section"), F.lit("").alias("row"),
                     F.lit(1).alias("quantity"), F.col("value").alias("price"))
    path = _scratch(spark, "json")
    L.write_listing_json(rows, path, "_name", "_latin1", "_broken")
    back, rejects = L.read_listing_json_any_encoding(spark, path)
    cols = ("event_name", "event_date", "timestamp", "section", F.col("price").cast("double").alias("price"))
    return (back.select(*cols, F.lit(None).cast("string").alias("reason"))
            .unionByName(rejects.select(F.col("file").alias("event_name"), "reason"), allowMissingColumns=True))


@query("s6_listing_time_fallback", sql="SELECT event_id, ts AS listing_time FROM events")
def s6_listing_time_fallback(spark, sf):
    """A table with ``created_at`` only gets ``listing_time`` from it."""
    from ..sources.listings import coalesce_listing_time
    ev = V.table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"))
    return coalesce_listing_time(ev).select("event_id", "listing_time")


@query("s8_s10_metrics_document", rnd=("value",), sql=V.duck_with("""
UNPIVOT (""" + _METRICS + """)
ON accuracy, precision, recall, f1, auc INTO NAME metric VALUE value
""", scores=DUCK_SCORES, counts=_COUNTS, auc=_AUC))
def s8_s10_metrics_document(spark, sf):
    """Metrics of the stand-in scores written as the nested JSON document (S8) and scanned back."""
    from ..operators import evaluate as EV
    from .standins import scores_standin
    path = _scratch(spark, "metrics")
    R.write_document(R.metrics_document(EV.metrics_long(EV.metrics(scores_standin(spark, sf)))), path)
    return R.read_metrics(spark, path)


@query("s8_s10_probability_document", rnd=("mean_probability", "std_probability"), sql=V.duck_with("""
SELECT model, days_until_event, avg(probability) AS mean_probability, stddev_samp(probability) AS std_probability, count(probability) AS count
FROM scores GROUP BY model, days_until_event
""", scores=DUCK_SCORES))
def s8_s10_probability_document(spark, sf):
    """The probability curves as the document of parallel arrays per model (S8), scanned back to rows."""
    from ..operators import market as M
    from .standins import scores_standin
    path = _scratch(spark, "probabilities")
    R.write_document(R.probability_document(M.probability_by_day(scores_standin(spark, sf))), path)
    return R.read_probabilities(spark, path).toDF("model", "days_until_event", "mean_probability", "std_probability", "count")


@query("s8_s10_importance_document", rnd=("importance",), sql=V.duck_with("""
SELECT model, 'day_' || days_until_event AS feature, sum(probability) / sum(sum(probability)) OVER (PARTITION BY model) AS importance
FROM scores GROUP BY model, days_until_event
""", scores=DUCK_SCORES))
def s8_s10_importance_document(spark, sf):
    """Shares per model (of the scores, by day, in place of learned importances) as the nested document (S8), scanned back."""
    from .standins import scores_standin
    path = _scratch(spark, "importances")
    per = scores_standin(spark, sf).groupBy("model", F.concat(F.lit("day_"), "days_until_event").alias("feature")).agg(F.sum("probability").alias("s"))
    whole = per.groupBy("model").agg(F.sum("s").alias("all"))
    shares = per.join(whole, "model").select("model", "feature", (F.col("s") / F.col("all")).alias("importance"))
    R.write_document(R.importance_document(shares), path)
    return R.read_importances(spark, path)


@query("m15_save_and_reload")
def m15_save_and_reload(spark, sf):
    """The chosen model saved with its parameter document (M15) and loaded back; its scores (rows only)."""
    t, (fitted, _, feats) = _table_and_models(spark, sf)
    return ML.score_written(_reloaded(spark, fitted, feats), t, "random_forest", _KEY)


def _reloaded(spark, fitted, feats):
    path = _scratch(spark, "model")
    ML.save_model(fitted, "random_forest", path, feats)
    return ML.load_model(path, "random_forest")


@query("m15_reload_recomputed", sql=_duck_agreement(["random_forest"]))
def m15_reload_recomputed(spark, sf):
    """Whether the model that was saved and loaded back scores every row as the fitted model's node table does, to 1e-9."""
    t, (fitted, _, feats) = _table_and_models(spark, sf)
    scores = ML.score_written(_reloaded(spark, fitted, feats), t, "random_forest", _KEY)
    return _agreement(scores, _recomputed(spark, t, {"random_forest": fitted["random_forest"]}, feats))
