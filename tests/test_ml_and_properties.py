"""Model training (M1-M6, M11-M13, M15), label encoding (F13) and properties of splits, features and labels."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pricelens.operators import encode as E
from pricelens.operators import features as FE
from pricelens.operators import labels as LB
from pricelens.operators import ml as ML
from pricelens.operators import splits as SP
from pricelens.plans import views as V
from pricelens.plans.pipeline import model_table, train
from pricelens.schema import Cols

COLS = Cols(tiebreak=("event_id",))


def small_models(trees: int = 20, depth: int = 5) -> dict:
    """The same four families with small settings, for checks."""
    return {
        "random_forest": ML.ModelSpec("rf", {"numTrees": trees, "maxDepth": depth}, "fixed"),
        "gradient_boost": ML.ModelSpec("gbt", {"maxIter": trees // 2, "maxDepth": depth, "stepSize": 0.1}),
        "weighted_boost": ML.ModelSpec("gbt", {"maxIter": trees // 2, "maxDepth": depth, "stepSize": 0.05,
                                            "minInfoGain": 0.1}, "fixed"),
        "logistic_regression": ML.ModelSpec("lr", {"maxIter": 100}, "balanced"),
    }


@pytest.fixture(scope="module")
def table(spark):
    return model_table(V.listings(spark, SF_SMALL), COLS).cache()


def test_train_score_and_importances(spark, table, tmpdir_path):
    fitted, scores, feats = train(table, models=small_models(trees=6, depth=3), key=("entity", "event_id"))
    n = table.count()
    assert scores.count() == 5 * n
    assert set(r["model"] for r in scores.select("model").distinct().collect()) == {
        "random_forest", "gradient_boost", "weighted_boost", "logistic_regression", "ensemble"}
    p = scores.agg(F.min("probability"), F.max("probability")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0
    imp = ML.importances(spark, fitted, feats)
    assert imp.where("model = 'random_forest'").count() == len(feats)
    ML.save_model(fitted, "random_forest", tmpdir_path, feats)
    back = ML.load_model(tmpdir_path, "random_forest")
    assert back.transform(table.limit(3)).count() == 3
    with pytest.raises(ValueError):
        ML.save_model(fitted, "nope", tmpdir_path, feats)


def test_feature_selection_and_search(spark, table):
    tr = table.where("split = 'train'")
    feats = [c for c in ("price_vs_event_min", "price_change_48h", "event_avg_price", "days_since_first_listing") if c in tr.columns]
    keep = ML.select_features(tr, feats, spec=ML.ModelSpec("gbt", {"maxIter": 5, "maxDepth": 3}))
    assert set(keep) <= set(feats) and keep
    space = {"stepSize": [0.1, 0.2], "maxDepth": [2, 3], "maxIter": [3], "subsamplingRate": [1.0],
             "featureSubsetStrategy": ["1.0"], "minInstancesPerNode": [1]}
    model, best, trials = ML.random_search(tr.withColumn("y", F.col("price")), feats, "y", n_iter=2, folds=2, space=space)
    assert set(best) == set(space)
    got = trials.orderBy("draw", "fold").collect()
    assert [(r.draw, r.fold) for r in got] == [(0, 0), (0, 1), (1, 0), (1, 1)] and len({r.parameters for r in got}) == 2
    mean = [(got[2 * d].mse + got[2 * d + 1].mse) / 2 for d in (0, 1)]
    assert all(r.best == (r.draw == mean.index(min(mean))) for r in got) and json.loads(next(r.parameters for r in got if r.best)) == best
    again = ML.search_trials(tr.withColumn("y", F.col("price")).repartition(3), feats, "y", n_iter=2, folds=2, space=space, threads=1)[1]
    assert [r.mse for r in again.orderBy("draw", "fold").collect()] == pytest.approx([r.mse for r in got], rel=0.05)  # any number of threads
    assert model.transform(tr).where("prediction IS NULL").count() == 0


def test_boosted_steps_take_no_task_for_each_small_partition(spark, monkeypatch):
    df = spark.range(600).selectExpr("CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 11 AS DOUBLE) AS b", "CAST(id % 7 + id % 11 > 9 AS INT) AS y")
    spec, seen = ML.ModelSpec("gbt", {"maxIter": 3, "maxDepth": 2}), []

    class Seen(ML.Pipeline):
        def fit(self, t):
            seen.append((t.rdd.getNumPartitions(), t.count()))
            return super().fit(t)

    monkeypatch.setattr(ML, "Pipeline", Seen)
    got = [ML.fit_model(df.repartition(n), ["a", "b"], spec, "y").stages[-1].featureImportances.toArray() for n in (60, 1)]
    assert seen == [(1, 600), (1, 600)] and got[0] == pytest.approx(got[1])
    monkeypatch.setattr(ML, "FEWEST_ROWS", 100)
    ML.fit_model(df.repartition(60), ["a", "b"], spec, "y")
    assert seen[-1] == (spark.sparkContext.defaultParallelism, 600)
    monkeypatch.setattr(ML, "MOST_ROWS", 100)  # 600 rows on 4 cores: two rounds of tasks, none above the bound
    assert ML._step_tasks(600, 4) == 8 and ML._step_tasks(0, 4) == 1


def test_trials_take_no_task_for_each_partition_of_the_table(spark, monkeypatch):
    df = spark.range(600).selectExpr("CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 11 AS DOUBLE) AS b", "CAST(id % 7 + id % 11 AS DOUBLE) AS y")
    space, seen = {"maxDepth": [2], "maxIter": [2]}, []

    class Seen(ML.GBTRegressor):
        def fit(self, t):
            seen.append((t.rdd.getNumPartitions(), t.count()))
            return super().fit(t)

    monkeypatch.setattr(ML, "GBTRegressor", Seen)
    monkeypatch.setattr(ML, "ROWS_PER_PARTITION", 200)
    ML.random_search(df.repartition(12), ["a", "b"], "y", folds=2, space=space)
    assert [n for n, _ in seen] == [1, 1, 3] and sum(r for _, r in seen[:2]) == seen[2][1] == 600  # the last fit has the cores for itself
    monkeypatch.setattr(ML, "ROWS_PER_TRIAL_TASK", 300)  # no task gets more rows than the bound
    ML.search_trials(df.repartition(12), ["a", "b"], "y", folds=2, space=space)
    assert [n for n, _ in seen[3:]] == [2, 2]


def test_search_space_is_the_references():
    draws = ML._draws(ML.SEARCH_SPACE, 20, ML.SEED)
    assert len({tuple(sorted(d.items())) for d in draws}) == 20 and all(d[k] in v for d in draws for k, v in ML.SEARCH_SPACE.items())
    assert len(ML._draws({"maxDepth": [1, 2]}, 20, 1)) == 2


def test_queries_train_with_the_reference_settings(spark, monkeypatch):
    from pricelens.plans import q_pipeline as Q
    seen, table = {}, spark.createDataFrame([("train", 1.0, 1)], "split string, price double, is_good_deal int")
    monkeypatch.setattr(Q, "_TRAINED", {})
    monkeypatch.setattr(Q, "model_table", lambda *a: table)
    monkeypatch.setattr(Q, "train", lambda t, models, **k: seen.update(models=models))
    monkeypatch.setattr(ML, "fit_model", lambda t, feats, spec, label: seen.update(spec=spec) or 1 / 0)
    monkeypatch.setattr(ML, "random_search", lambda *a, **k: seen.update(search=(a[2:], k)) or (None, {}, table))
    Q._trained(spark, "/root/testdata/sf0.001")
    with pytest.raises(ZeroDivisionError):
        Q.m12_selected_features(spark, "/root/testdata/sf0.001")
    assert seen["models"] == ML.REFERENCE_MODELS and seen["spec"].params["maxIter"] == 100
    assert Q.m13_random_search(spark, "/root/testdata/sf0.001") is table
    assert seen["search"] == (("is_good_deal",), {})  # 20 draws and 5 folds are the function's own


def test_inputs_without_values_reads_rows(spark):
    from pricelens.operators import clean as C
    df = spark.createDataFrame([(1, None, 2.0), (None, None, 3.0)], "a int, b int, c double")
    assert [r.feature for r in C.inputs_without_values(df, ["c", "z", "b", "a"]).collect()] == ["b", "z"]


def test_label_codes_fit_on_train_only(spark):
    tr = spark.createDataFrame([("b",), ("a",), (None,)], "zone string")
    te = spark.createDataFrame([("a",), ("z",)], "zone string")
    codes = E.fit_label_codes(tr, "zone")
    assert {r["value"]: r["code"] for r in codes.collect()} == {"a": 0, "b": 1, "nan": 2}
    got = {r["zone"]: r["zone_code"] for r in E.apply_label_codes(te, codes, "zone").collect()}
    assert got == {"a": 0, "z": 3}  # unseen value -> k


def test_split_is_disjoint_and_covers(spark):
    ls = V.clean_listings(spark, SF_SMALL)
    s = SP.temporal_split(ls, COLS)
    assert s.count() == ls.count()
    assert SP.leakage_report(s, COLS).count() == 0
    assert {r["split"] for r in s.select("split").distinct().collect()} <= {"train", "validation", "test"}


def test_features_do_not_look_ahead_in_strict_mode(spark):
    ls = V.clean_listings(spark, SF_SMALL)
    cut = ls.agg(F.expr("percentile(unix_micros(CAST(listing_time AS TIMESTAMP)), 0.5)")).first()[0]
    early = ls.where(F.expr(f"unix_micros(CAST(listing_time AS TIMESTAMP)) <= {cut}"))
    cols = [c for c in FE.engineer_features(early, COLS, strict=True).columns if c not in ("prev_market_median", "prev_market_size", "price_vs_prev_market", "time_to_event_ratio")]
    a = FE.engineer_features(early, COLS, strict=True).select(*cols)
    b = FE.engineer_features(ls, COLS, strict=True).join(early.select("event_id"), "event_id", "left_semi").select(*cols)
    # the cut moves the chunks' borders, so sums may differ in the last bits
    near = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes]
    assert a.select(*near).exceptAll(b.select(*near)).count() == 0


def test_label_share_at_least_20_percent(spark):
    lab = LB.with_good_deal_label(V.clean_listings(spark, SF_SMALL), COLS)
    g = lab.groupBy("entity", "time_window").agg(F.avg("is_good_deal").alias("share"), F.count(F.lit(1)).alias("n"))
    assert g.where("n >= 5 AND share < 0.2").count() == 0


def test_run_workflow(spark, tmpdir_path):
    from pricelens.plans.pipeline import run_workflow
    raw = os.path.join(tmpdir_path, "raw")
    os.makedirs(raw)
    base = dt.datetime(2022, 9, 1, 19, 0)
    # last listing times at 0, 0.6, 0.8 and 1.0 of the range: one entity per split at least
    for e, day, n in (("Alpha", "221001", 40), ("Beta", "221015", 52), ("Gamma", "221101", 56), ("Delta", "221105", 60)):
        rows = [{"timestamp": (base + dt.timedelta(hours=7 * i)).strftime("%m-%d-%y / %I:%M %p"), "zone": "GA",
                 "section": "GA", "row": "", "quantity": 1 + i % 3, "price": 40 + (i * 7) % 23} for i in range(n)]
        with open(os.path.join(raw, f"{e}{day}.json"), "w") as f:
            json.dump(rows, f)
    out_dir = os.path.join(tmpdir_path, "out")
    os.makedirs(os.path.join(out_dir, "visualization_data"))
    with open(os.path.join(out_dir, "visualization_data", "part-0.txt"), "w") as f:
        json.dump({"kept": {"x": 1}}, f)   # an existing document: its other keys must survive
    paths = run_workflow(spark, raw, out_dir, models=small_models(trees=4, depth=3), select=None)
    doc = json.loads(spark.read.text(paths["model_metrics"]).first()["value"])
    assert "ensemble" in doc and set(doc["ensemble"]) <= {"validation", "test"}
    meta = json.loads(spark.read.text(paths["metadata"]).first()["value"])
    assert len(meta["feature_columns"]) == 24
    viz = json.loads(spark.read.text(paths["visualization_data"]).first()["value"])
    assert "All Events" in viz["event_stats"] and viz["kept"] == {"x": 1}


def test_label_codes_many_values_match_sorted_order(spark):
    import random
    rnd = random.Random(5)
    vals = list({"".join(rnd.choice("abcxyzé0") for _ in range(rnd.randint(1, 6))) for _ in range(3000)})
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "zone string")
    codes = {r["value"]: r["code"] for r in E.fit_label_codes(df, "zone").collect()}
    expected = sorted(set(vals) | {"nan"}, key=lambda s: s.encode("utf-8"))
    assert codes == {v: i for i, v in enumerate(expected)}
