"""Hand-computed edge cases."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from pricelens.functions import scalars as S
from pricelens.operators import clean as C
from pricelens.operators import evaluate as EV
from pricelens.operators import features as FE
from pricelens.operators import profile as P
from pricelens.operators import savings as SV
from pricelens.operators import splits as SP
from pricelens.plans.views import with_calendar
from pricelens.schema import Cols

COLS = Cols(tiebreak=("event_id",))
T0 = dt.datetime(2024, 1, 4, 0, 0)  # a Thursday
SCHEMA = "entity string, event_id long, listing_time timestamp_ntz, event_date timestamp_ntz, zone string, quantity int, price double"


def listings(spark, rows):
    return with_calendar(spark.createDataFrame(rows, SCHEMA))


def feats(spark, rows, **kw):
    out = FE.engineer_features(listings(spark, rows), COLS, **kw).orderBy("entity", "listing_time", "event_id")
    return out.collect()


def hist_rows(n, entity="e", start=T0, step=dt.timedelta(hours=1), prices=None):
    prices = prices or [10.0 * (i + 1) for i in range(n)]
    ev = start + dt.timedelta(days=40)
    return [(entity, i, start + i * step, ev, "ga", 1, prices[i]) for i in range(n)]


def test_history_minimum_and_eighth_row(spark):
    r = feats(spark, hist_rows(9))
    for i in range(5):
        assert r[i]["price_vs_event_min"] == 1.0 and r[i]["price_vs_event_median"] == 1.0
        assert r[i]["expanding_p20"] is None
    assert r[4]["hist_volatility_30d"] is None
    assert r[5]["price_vs_event_min"] == pytest.approx(6.0)
    assert r[5]["price_vs_event_median"] == pytest.approx(2.0)
    assert r[5]["price_vs_event_max"] == pytest.approx(1.2)
    assert r[5]["expanding_p20"] == pytest.approx(18.0)
    assert r[5]["price_vs_expanding_p20"] == pytest.approx(60 / 18)
    assert r[5]["hist_volatility_30d"] == pytest.approx(15.811388300841896)
    assert r[6]["price_stability_7d"] is None
    assert r[7]["price_stability_7d"] == pytest.approx(21.602468994692867 / 40)
    assert [x["prior_listings_count"] for x in r] == list(range(9))
    assert r[0]["cumulative_quantity"] == 0 and r[3]["cumulative_quantity"] == 3
    assert r[3]["prev_cumulative"] == 2
    assert r[0]["price_trend_7d"] == 0.0 and r[0]["inventory_burn_rate"] == 0.5
    assert r[1]["price_trend_7d"] is None


def test_frame_edges(spark):
    us = dt.timedelta(microseconds=1)
    t1 = T0 + dt.timedelta(hours=48)
    t2 = T0 + dt.timedelta(hours=96) + us
    t3 = T0 + dt.timedelta(days=7)
    t4 = t1 + dt.timedelta(days=7) - us
    ev = T0 + dt.timedelta(days=40)
    rows = [("e", 0, T0, ev, "ga", 1, 100.0), ("e", 1, t1, ev, "ga", 1, 110.0), ("e", 2, t2, ev, "ga", 1, 121.0),
            ("e", 3, t3, ev, "ga", 1, 50.0), ("e", 4, t4, ev, "ga", 1, 60.0),
            ("e", 5, t4 + dt.timedelta(hours=1), ev, "ga", 2, 70.0), ("e", 6, t4 + dt.timedelta(hours=1), ev, "ga", 2, 80.0)]
    r = feats(spark, rows)
    assert r[1]["price_change_48h"] == pytest.approx(0.1)   # exactly 48 h: inclusive
    assert r[2]["price_change_48h"] == 0.0                  # 48 h + 1 us: too old
    assert r[3]["listing_volume_7d"] == 3                   # exactly 7 d back is outside (left-open)
    assert r[4]["listing_volume_7d"] == 4                   # 7 d - 1 us back is inside
    # equal times: both peers see the same strict history and both are in each other's 7-day frame
    assert r[5]["event_listing_frequency"] == r[6]["event_listing_frequency"] == 5
    assert r[5]["listing_volume_7d"] == r[6]["listing_volume_7d"]
    assert r[0]["event_avg_price"] == 100.0 and r[0]["event_price_std"] == 0.0
    assert r[1]["event_price_std"] is None                  # std of one earlier value


def test_bucket_edges_and_prev_market(spark):
    ev = dt.datetime(2024, 3, 1)
    wed = dt.datetime(2024, 1, 3, 23, 59)
    thu = dt.datetime(2024, 1, 4, 0, 0)
    later = dt.datetime(2024, 1, 18, 12, 0)  # skips the week of 2024-01-11
    rows = [("e", 0, wed, ev, "ga", 1, 10.0), ("e", 1, thu, ev, "ga", 1, 20.0), ("e", 2, thu + dt.timedelta(hours=1), ev, "ga", 1, 40.0),
            ("e", 3, later, ev, "ga", 1, 90.0), ("f", 4, thu, ev, "ga", 1, 5.0)]
    r = {x["event_id"]: x for x in feats(spark, rows)}
    assert r[0]["time_window"] == dt.datetime(2023, 12, 28)
    assert r[1]["time_window"] == dt.datetime(2024, 1, 4)
    assert r[0]["prev_market_median"] is None and r[0]["prev_market_size"] == 0
    assert r[1]["prev_market_median"] == 10.0 and r[1]["prev_market_size"] == 1
    assert r[3]["prev_market_median"] == 30.0 and r[3]["prev_market_size"] == 2   # previous bucket with data
    assert r[3]["price_vs_prev_market"] == pytest.approx(3.0)
    assert r[4]["price_vs_prev_market"] == 1.0                                     # one-week entity


def test_zero_edges(spark):
    ev = dt.datetime(2024, 1, 10)
    rows = [("e", 0, ev, ev, "ga", 1, 10.0), ("e", 1, ev + dt.timedelta(hours=2), ev, "ga", 0, 5.0),
            ("e", 2, ev + dt.timedelta(hours=3), ev, "ga", 1, 0.0), ("e", 3, ev + dt.timedelta(hours=4), ev, "ga", 1, None)]
    df = listings(spark, rows)
    assert C.filter_valid(df).count() == 1
    q = C.quality_report(df).first()
    assert q["null_price"] == 1 and q["total_rows"] == 4 and q["temporal_issues"] == 3
    r = FE.engineer_features(df.where("event_id = 0"), COLS).first()
    assert r["time_to_event_ratio"] is None  # 0 / 0


def test_day_sign_truncation(spark):
    ev = dt.datetime(2024, 1, 10)
    rows = [("e", i, ev + dt.timedelta(days=d), ev, "ga", 1, 1.0) for i, d in enumerate((0.5, 1.5, -0.5))]
    df = listings(spark, rows).orderBy("event_id")
    assert [r["days_until_event"] for r in df.collect()] == [0, -1, 0]
    assert sorted(r["event_id"] for r in C.filter_nonneg_days(df).collect()) == [0, 2]


def test_dst(spark):
    df = spark.createDataFrame([(dt.datetime(2022, 11, 6, 1, 30),), (dt.datetime(2022, 3, 13, 2, 30),),
                                (dt.datetime(2022, 6, 1, 12, 0),)], "w timestamp_ntz")
    r = df.select(S.localize_status("w", "America/New_York").alias("s"), S.localize("w", "America/New_York", "null").alias("u")).collect()
    assert [x["s"] for x in r] == ["ambiguous", "nonexistent", "ok"]
    assert r[0]["u"] is None and r[1]["u"] is None and r[2]["u"] == dt.datetime(2022, 6, 1, 16, 0)


def test_dst_gap_raises(spark):
    import pytest
    df = spark.createDataFrame([(dt.datetime(2022, 3, 13, 2, 30),)], "w timestamp_ntz")
    with pytest.raises(Exception, match="skips"):
        df.select(S.localize("w", "America/New_York")).collect()


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (3, "b")], "k int, v string")
    assert C.drop_exact_duplicates(df).count() == 3
    after = {(r["k"], r["v"]): r["n_extra"] for r in C.duplicates_after_first(df).collect()}
    assert after == {(1, "a"): 2, (2, None): 1}
    assert C.duplicates_after_first(df, expand=True).count() == 3
    assert C.duplicates_all(df, ["k", "v"]).count() == 5  # nulls compare equal


def test_cut_and_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "v double")
    cut = [r["bin"] for r in P.with_cut(df, "v", 2).orderBy("v").collect()]
    assert cut == [1, 1, 2]  # right-closed, min in the first bin
    h = {r["bin"]: r["n"] for r in P.histogram(df, "v", 2).collect()}
    assert h == {1: 1, 2: 2}  # left-closed, last bin closed


def test_split_edges(spark):
    rows = []
    for name, hours in (("a", 0), ("b", 60), ("c", 80), ("d", 100)):
        rows.append((name, len(rows), T0 + dt.timedelta(hours=hours), T0 + dt.timedelta(days=30), "ga", 1, 1.0))
    s = {r["entity"]: r["split"] for r in SP.entity_splits(listings(spark, rows), COLS).collect()}
    assert s == {"a": "train", "b": "train", "c": "validation", "d": "test"}


def scores(spark, rows):
    return spark.createDataFrame(rows, "entity string, event_id long, label int, model string, split string, probability double, prediction int")


def test_score_edges(spark):
    tie = scores(spark, [("a", 1, 1, "m", "test", 0.5, 1), ("a", 2, 0, "m", "test", 0.5, 1)])
    assert EV.auc(tie).first()["auc"] == 0.5
    one = scores(spark, [("a", 1, 1, "m", "test", 0.2, 0), ("a", 2, 1, "m", "test", 0.9, 1)])
    assert EV.auc(one).first()["auc"] == 0.0
    nopos = scores(spark, [("a", 1, 1, "m", "test", 0.2, 0), ("a", 2, 0, "m", "test", 0.3, 0)])
    m = EV.metrics(nopos).first()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.0, 0.5)
    s = scores(spark, [("a", i, y, "m", "test", p, int(p >= 0.5)) for i, (y, p) in enumerate(((0, .1), (0, .4), (1, .35), (1, .8)))])
    assert EV.auc(s).first()["auc"] == pytest.approx(0.75)
    cm = {(r["label"], r["prediction"]): r["n"] for r in EV.confusion(s).collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 1}
    g = scores(spark, [("a", 1, 0, "m", "validation", 0.2, 0), ("a", 2, 1, "m", "validation", 0.6, 1)])
    b = EV.best_threshold(g).first()
    assert b["accuracy"] == 1.0 and b["threshold"] == 0.1 + 11 * ((0.1 + 0.01) - 0.1)


def test_roc_points(spark):
    s = scores(spark, [("a", i, y, "m", "test", p, 0) for i, (y, p) in enumerate(((0, .1), (0, .4), (1, .35), (1, .8)))])
    pts = sorted((r["fpr"], r["tpr"]) for r in EV.roc_curve(s).collect())
    assert pts == [(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]


def test_metric_identity(spark):
    rows = ([("a", i, 1, "m", "test", 0.9, 1) for i in range(1813)] + [("a", i, 0, "m", "test", 0.9, 1) for i in range(1097)]
            + [("a", i, 1, "m", "test", 0.1, 0) for i in range(536)])
    m = EV.metrics(scores(spark, rows)).first()
    assert round(m["precision"], 5) == 0.62302 and round(m["recall"], 5) == 0.77182


def test_savings_golden(spark):
    df = spark.createDataFrame([(100000.0, 0.701, 63.04, 100.70, 92.84)],
                               "budget double, precision double, avg_good_price double, avg_not_good_price double, avg_all_price double")
    r = SV.savings(df).first()
    assert (r["random_tickets"], r["random_good"], r["random_bad"]) == (1077, 215, 862)
    assert r["random_cost"] == pytest.approx(100357.00)
    assert (r["model_tickets"], r["model_good"], r["model_bad"]) == (1345, 942, 403)
    assert r["model_cost"] == pytest.approx(99965.78)
    d = SV.savings(df, variant="dashboard").first()
    assert d["random_tickets"] == 993 and d["random_good"] == 198
    assert d["cost_diff"] == pytest.approx(d["model_cost"] - d["random_cost"])
    zero = spark.createDataFrame([(1000.0, 0.5, 0.0, 0.0, 0.0)], df.schema)
    z = SV.savings(zero, variant="dashboard").first()
    assert z["random_tickets"] == int(1000 / 100.70)  # zero prices fall back to the defaults


def test_reference_baseline_savings_per_ticket():
    # 100.70 - (0.6230 * 63.04 + 0.3770 * 100.70) = 23.46 (reference README figure)
    assert round(100.70 - (0.6230 * 63.04 + 0.3770 * 100.70), 2) == 23.46


@pytest.mark.parametrize("session_tz", ["America/Los_Angeles", "Europe/Berlin", "Asia/Kolkata", "America/New_York"])
def test_zone_functions_ignore_session_zone(spark, session_tz):
    df = spark.createDataFrame([(dt.datetime(2022, 11, 6, 1, 30),), (dt.datetime(2022, 3, 13, 2, 30),),
                                (dt.datetime(2022, 6, 1, 12, 0),)], "w timestamp_ntz")
    tz = "America/New_York"
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", session_tz)
        r = df.select(S.localize_status("w", tz).alias("s"), S.localize("w", tz, "null").alias("u"),
                      S.to_zone(S.localize("w", tz, "null"), tz).alias("b")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [x["s"] for x in r] == ["ambiguous", "nonexistent", "ok"]
    assert r[2]["u"] == dt.datetime(2022, 6, 1, 16, 0) and r[2]["b"] == dt.datetime(2022, 6, 1, 12, 0)


def test_duplicate_expansion_in_pieces(spark):
    df = spark.createDataFrame([(1, "a")] * 23 + [(2, "b")] * 2 + [(3, "c")], "k int, v string")
    out = C.duplicates_after_first(df, expand=True, chunk=5)
    got = {(r["k"], r["v"]): r["n"] for r in out.groupBy("k", "v").count().withColumnRenamed("count", "n").collect()}
    assert got == {(1, "a"): 22, (2, "b"): 1}


def test_scores_of_repeated_keys_keep_every_row(spark):
    from pricelens.operators import evaluate as EV
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 6.0), ("a", 2, 7.0), ("b", 1, 8.0), (None, 1, 9.0)], "entity string, event_id int, price double")
    scores = spark.createDataFrame([("a", 1, "m", 0.1, 0), ("a", 1, "m", 0.9, 1), ("a", 2, "m", 0.5, 1), (None, 1, "m", 0.3, 0), ("a", 1, "n", 0.2, 0),
                                    ("a", 1, "other", 0.7, 1)], "entity string, event_id int, model string, probability double, prediction int")
    got = {r["price"]: r for r in EV.attach_scores(df, scores, ["m", "n"]).collect()}
    assert [got[p]["m_probability"] for p in (5.0, 6.0, 7.0, 8.0, 9.0)] == [0.1, 0.9, 0.5, None, 0.3]
    assert [got[p]["n_probability"] for p in (5.0, 6.0)] == [0.2, None] and len(got) == 5
    # by row id, whatever the keys say
    ids = df.withColumn("row_id", F.col("price").cast("long"))
    by_id = spark.createDataFrame([(i, "m", i / 10, 1) for i in (5, 6, 7, 8, 9)], "row_id long, model string, probability double, prediction int")
    assert all(r["m_probability"] == r["row_id"] / 10 for r in EV.attach_scores(ids, by_id, ["m"]).collect())


def test_positions_follow_the_order(spark):
    from pricelens.operators import profile as P
    df = spark.createDataFrame([(None if i % 10 == 3 else i % 7, i) for i in range(200)], "a int, b int").repartition(7)
    got = {(r["a"], r["b"]): r["position"] for r in P.with_position(df, ["a", "b"]).collect()}
    want = sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [got[k] for k in want] == list(range(1, 201)) and P.with_position(df.limit(0), ["a"]).collect() == []
