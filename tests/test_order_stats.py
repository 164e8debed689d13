"""Exact quantiles and running totals over ordered ranges, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.operators.order_stats import agg_with_quantiles, group_quantiles
from pricelens.operators.prefix import with_prefix_totals

PROBS = {"a": 0.0, "b": 0.2, "c": 0.5, "d": 0.75, "e": 1.0}


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_of_skewed_groups(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("hot", float(v)) for v in rng.integers(0, 50, 700)] + [(None, float(v)) for v in rng.standard_normal(31)]
    rows += [("one", 4.5), ("nulls", None), ("two", 1.0), ("two", 2.0), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in group_quantiles(df, ["g"], "v", PROBS).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-12)
    both = {r.g: r for r in agg_with_quantiles(df, ["g"], "v", {"m": 0.5}, F.count("v").alias("n")).collect()}
    assert both["nulls"].n == 0 and both["nulls"].m is None and both[None].n == 31


@pytest.mark.parametrize("accuracy", [50, 400, 10_000])
def test_quantiles_between_sketched_bounds(spark, accuracy):
    """Groups above ``accuracy`` rows are cut to their bounds; the values stay exact."""
    rng = np.random.default_rng(accuracy)
    parts = {"even": rng.permutation(12_000).astype(float), "few": rng.integers(0, 3, 9_000).astype(float), "skew": rng.exponential(9, 15_000) ** 3,
             "same": np.full(5_000, 7.25), "far": np.append(rng.standard_normal(8_000), [np.inf, -np.inf, -0.0, 0.0]), "small": rng.standard_normal(37)}
    rows = [(g, float(x)) for g, vs in parts.items() for x in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    probs = {**PROBS, "p501": 0.501, "p999": 0.999}
    got = {r.g: r for r in group_quantiles(df, ["g"], "v", probs, accuracy).collect()}
    for g, vs in parts.items():
        for name, p in probs.items():
            ordered, place = np.sort(vs), (len(vs) - 1) * p
            low, high = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
            assert got[g][name] == (low if place % 1 == 0 else pytest.approx((1 - place % 1) * low + place % 1 * high, rel=1e-12))
    whole = group_quantiles(df.where("g = 'skew'"), [], "v", {"m": 0.5}, accuracy).first()
    assert whole.m == pytest.approx(np.quantile(parts["skew"], 0.5), rel=1e-12)


def test_only_cells_between_bounds_meet(spark):
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_013).cast("double").alias("v"), F.lit("hot").alias("g"))
    plan = group_quantiles(df, ["g"], "v", {"m": 0.5}, 1000)
    assert "Checkpoint" not in plan._jdf.queryExecution().optimizedPlan().toString() and plan.first().m == np.quantile(np.arange(60_000) * 7919 % 60_013, 0.5)


def test_quantiles_of_a_whole_column_of_unique_values(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    row = group_quantiles(df, [], "v", PROBS).first()
    values = np.arange(20_000) * 7919 % 20_011
    assert all(row[n] == pytest.approx(np.quantile(values, p)) for n, p in PROBS.items())
    # no range, and so no task, holds a share of the rows that stays the same with more ranges
    ranged = with_prefix_totals(df, [F.col("v")], {"n": F.lit(1)}, ranges=16)
    assert [r.n for r in ranged.orderBy("v").collect()] == list(range(20_000))
    assert group_quantiles(df.limit(0), [], "v", {"a": 0.5}).first().a is None


def test_no_whole_group_buffer_in_plans(spark):
    from pricelens.plans import load_all
    for key in ("a1_price_trends", "a3_quantiles", "p14_iqr_filter", "w22_good_deal_label", "a26_box_stats"):
        plan = load_all()[key].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan.lower()


def test_running_totals_per_range(spark):
    df = spark.createDataFrame([(i % 7, i, float(i)) for i in range(200)], "g int, i int, v double")
    got = with_prefix_totals(df, [F.col("g"), F.col("i")], {"before": F.col("v")}, ranges=6).orderBy("g", "i").collect()
    want = np.cumsum([0.0, *[r.v for r in got]])[:-1]
    assert np.allclose([r.before for r in got], want)
    assert with_prefix_totals(df.limit(0), [F.col("g")], {"before": F.col("v")}).collect() == []
