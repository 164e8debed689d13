"""Chunked features: the same for any number of ranges, any input partitioning, null and tied keys."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pricelens.operators import features as FE
from pricelens.operators import growing
from pricelens.plans import views as V
from pricelens.plans.q_features import ALL_FEATURES
from pricelens.plans.views import with_calendar
from pricelens.schema import Cols
from test_bruteforce import SCHEMA, T0, brute, make_rows

COLS = Cols(tiebreak=("event_id",))


def rounded(df):
    return df.select("event_id", *[F.round(c, 9).alias(c) if t == "double" else F.col(c).alias(c)
                                   for c, t in df.select(*ALL_FEATURES).dtypes])


@pytest.mark.parametrize("ranges", [1, 40])
def test_any_number_of_ranges(spark, ranges):
    ls = V.clean_listings(spark, SF_SMALL)
    a = rounded(FE.engineer_features(ls, COLS))
    b = rounded(FE.engineer_features(ls, COLS, ranges=ranges))
    assert b.count() == a.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_features_do_not_depend_on_input_partitioning(spark):
    """Recomputed tasks (after a lost executor) see other partitionings; results must not change."""
    ls = V.clean_listings(spark, SF_SMALL)
    a = rounded(FE.engineer_features(ls, COLS))
    b = rounded(FE.engineer_features(ls.repartition(7, "event_id"), COLS))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_only_some_features(spark):
    ls = V.clean_listings(spark, SF_SMALL)
    whole = FE.engineer_features(ls, COLS).cache()
    for only in (["demand_pressure", "prev_market_size", "is_last_week"], ["price_std_7d", "listing_intensity"]):
        some = FE.engineer_features(ls, COLS, only=only)
        assert set(some.columns) == {*ls.columns, *only}
        a, b = (x.select("event_id", *only).replace(float("nan"), None) for x in (some, whole))
        r = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes]
        assert a.select(*r).exceptAll(b.select(*r)).count() == 0


def hot_rows(n, weeks, seed=0, prices=None):
    """One entity with most rows, dense in time, and a few small ones."""
    rng = np.random.default_rng(seed)
    gaps = np.maximum(1, rng.exponential(weeks * 7 * 1440 / n, n)).astype(int)
    spec = [("hot", gaps.tolist(), (prices if prices is not None else rng.integers(500, 90_000, n) / 100).tolist(), rng.integers(0, 5, n).tolist())]
    spec += [(f"s{k}", [700, 900, 4000], [5.0, 6.0, 7.0], [1, 2, 3]) for k in range(3)]
    return make_rows(spec)


@pytest.mark.parametrize("ranges", [17])
def test_hot_entity_against_brute_force(spark, ranges):
    rows = hot_rows(260, 5)
    expected = brute(rows)
    for r in FE.engineer_features(with_calendar(spark.createDataFrame(rows, SCHEMA)), COLS, ranges=ranges).collect():
        for k, v in expected[r.event_id].items():
            assert (r[k] is None) == (v is None) and (v is None or r[k] == pytest.approx(v, rel=1e-9, abs=1e-9)), (k, r.event_id)


def test_equal_prices_have_no_deviation_across_chunks(spark):
    rows = hot_rows(120, 3, prices=np.full(120, 61.37))
    got = FE.engineer_features(with_calendar(spark.createDataFrame(rows, SCHEMA)), COLS, ranges=15).where("entity = 'hot'").collect()
    assert all(r.price_std_7d == pytest.approx(0, abs=1e-9) and (r.event_price_std or 0) == pytest.approx(0, abs=1e-6) for r in got)


def test_context_of_a_hot_entity_does_not_grow_with_time(spark):
    """The earlier prices that chunks are given: about as many for 40 weeks as for 10, and bounded per chunk."""
    sizes = {}
    for weeks in (10, 40):
        rows = hot_rows(3000, weeks, prices=np.random.default_rng(1).permutation(3000) + 0.25)
        base = FE.deal(FE.with_time_keys(with_calendar(spark.createDataFrame(rows, SCHEMA)), COLS), COLS, 12)
        chunks = FE.summarise(base, COLS)
        narrow = FE.join_null_safe(base, chunks.select("entity", FE.CHUNK, FE.GID), ["entity", FE.CHUNK], "inner")
        given = growing.context(narrow, chunks, ["entity"], FE.GID, "price", [0.5, 0.2], ranges=12)
        per = [r["count"] for r in given.groupBy(FE.GID).count().collect()]
        sizes[weeks] = (sum(per), max(per))
    assert sizes[40][0] <= 1.3 * sizes[10][0] and sizes[40][1] <= 1.5 * sizes[10][1]
    assert sizes[40][1] <= 4 * 3009 / 12 + 4 * 3009 / 12  # two values per row and quantile, and the ranges they stand in


def test_null_and_repeated_keys(spark):
    """Null entities and tie-breaks, equal times and repeated rows: every row stays, with the features of its place."""
    t = lambda h: T0 + dt.timedelta(hours=h)
    ev = T0 + dt.timedelta(days=60)
    rows = [(None if k % 3 == 0 else "e", None if k % 2 else k // 4, t(k // 3), ev, "ga", 1, 10.0 + k) for k in range(60)]
    rows += rows[:6]
    df = with_calendar(spark.createDataFrame(rows, SCHEMA))
    for ranges in (1, 9):
        got = FE.engineer_features(df, COLS, ranges=ranges).collect()
        assert len(got) == len(rows)
        for e in (None, "e"):
            own = sorted((r.listing_time, r.event_id is not None, r.event_id or 0, r.price, r.prior_listings_count, r.price_vs_event_median, r.expanding_p20) for r in got if r.entity == e)
            for i, (*_, price, place, median, p20) in enumerate(own):
                earlier = [x[3] for x in own[:i]]
                assert place == i
                assert median == pytest.approx(price / np.quantile(earlier, 0.5) if i >= 5 else 1.0)
                assert (p20 is None) == (i < 5) and (i < 5 or p20 == pytest.approx(np.quantile(earlier, 0.2)))
        assert all(r.prev_market_size is not None for r in got)


def test_no_rows(spark):
    empty = with_calendar(spark.createDataFrame([], SCHEMA))
    assert FE.engineer_features(empty, COLS).collect() == []


def test_one_instant_with_half_the_rows(spark):
    """An instant may be cut into any number of chunks: features of its rows hold all of its rows, and no chunk is larger than others."""
    rng = np.random.default_rng(4)
    minutes = sorted([*rng.integers(0, 30 * 1440, 200).tolist(), *[15 * 1440] * 240, *[22 * 1440 + 7] * 40])
    t = [T0 + dt.timedelta(minutes=m) for m in minutes]
    prices = (rng.integers(500, 90_000, len(t)) / 100).tolist()
    rows = [("hot", i, t[i], T0 + dt.timedelta(days=60), "ga", int(i % 4), prices[i]) for i in range(len(t))]
    rows += [("small", 1000 + i, t[i], T0 + dt.timedelta(days=60), "ga", 1, 5.0) for i in range(3)]
    df = with_calendar(spark.createDataFrame(rows, SCHEMA))
    for ranges in (1, 13):
        base = FE.deal(FE.with_time_keys(df, COLS), COLS, ranges)
        sizes = sorted(r["count"] for r in base.groupBy(FE.CHUNK).count().collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
        got = {r.event_id: r for r in FE.engineer_features(df, COLS, ranges=ranges).where("entity = 'hot'").collect()}
        week = dt.timedelta(days=7)
        for i, now in enumerate(t):
            r = got[i]
            past = [p for x, p in zip(t, prices) if x < now]
            seven = [p for x, p in zip(t, prices) if now - week < x <= now]
            stable = [p for x, p in zip(t, prices) if now - week <= x < now]
            assert r.event_listing_frequency == len(past) and r.listing_volume_7d == len(seven) and r.prior_listings_count == i
            assert r.event_avg_price == pytest.approx(np.mean(past) if past else prices[i])
            assert r.avg_quantity_7d == pytest.approx(np.mean([j % 4 for j, x in enumerate(t) if now - week < x <= now]))
            assert r.price_std_7d == pytest.approx(np.std(seven, ddof=1) if len(seven) > 1 else 0.0)
            want = np.std(stable, ddof=1) / np.mean(stable) if i >= 7 and len(stable) > 1 else None
            assert (r.price_stability_7d is None) == (want is None) and (want is None or r.price_stability_7d == pytest.approx(want))
            if i >= 5:
                assert r.price_vs_event_median == pytest.approx(prices[i] / np.median(prices[:i]))


def test_dense_week_costs_no_more_than_a_long_one():
    """A million points in one week: the ranges hold half of them each, and are answered from an index."""
    import time

    import pandas as pd
    from pricelens.operators import instants as I
    rng = np.random.default_rng(6)
    n, seconds = 1_000_000, {}
    for name, span in (("week", 7 * 86_400), ("years", 7 * 86_400 * 200)):
        at = np.sort(rng.choice(span * 1000, n, replace=False)) * 1000
        p = rng.random(n)
        pdf = pd.DataFrame({"_g": 1, "_role": I.POINT, "_at": at, "n": 1.0, "mean": p, "m2": 0.0, "nq": 1.0, "sq": 2.0, "_og": 1, "_oat": at})
        started = time.perf_counter()
        got = I.answer(pdf, FE.WEEK_US)
        seconds[name] = time.perf_counter() - started
        for i in (0, 17, n // 2, n - 1):
            seven = p[(at > at[i] - FE.WEEK_US) & (at <= at[i])]
            assert got["_week_n"][i] == len(seven) == got["_nq"][i] and got["_past_n"][i] == i
            assert got["_week_mean"][i] == pytest.approx(seven.mean()) and got["_week_m2"][i] == pytest.approx(seven.var() * len(seven), abs=1e-9)
    assert seconds["week"] < 5 * seconds["years"] + 5


def test_index_of_equal_values_has_no_deviation():
    from pricelens.operators import instants as I
    n = 777
    points = (np.ones(n), np.full(n, 61.37), np.zeros(n))
    low, high = np.zeros(n, int), np.arange(n)
    (m,) = I.over_ranges(points, [(low, high)])
    assert (m[0] == high).all() and (m[2] == 0).all() and (m[1][1:] == 61.37).all()
