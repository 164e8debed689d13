"""Features against a brute-force, row-by-row reading of the reference's algorithms.

The DuckDB oracles check that the Spark plans equal SQL written from the
same reading; this file checks the reading itself: a plain Python loop per
entity, as the reference computes it, on random small tables (unique times).
"""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pricelens.operators import features as FE
from pricelens.plans.views import with_calendar
from pricelens.schema import Cols

COLS = Cols(tiebreak=("event_id",))
T0 = dt.datetime(2024, 1, 1)
H48 = dt.timedelta(hours=48)
D7 = dt.timedelta(days=7)
SCHEMA = "entity string, event_id long, listing_time timestamp_ntz, event_date timestamp_ntz, zone string, quantity int, price double"


def std(xs):
    return statistics.stdev(xs) if len(xs) > 1 else None


def brute(rows):
    """rows: (entity, id, t, event_date, zone, q, p) -> {id: feature dict}."""
    out = {}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for e, rs in by.items():
        rs.sort(key=lambda r: r[2])
        ts = [r[2] for r in rs]
        ps = [r[6] for r in rs]
        qs = [r[5] for r in rs]
        t0, tmax = ts[0], ts[-1]
        week = lambda t: math.floor((t - dt.datetime(1970, 1, 1)).total_seconds() / D7.total_seconds())
        buckets = sorted({week(t) for t in ts})
        bstats = {b: (statistics.median([p for t, p in zip(ts, ps) if week(t) == b]),
                      sum(1 for t in ts if week(t) == b)) for b in buckets}
        prev_b = {b: bstats[buckets[i - 1]] if i else None for i, b in enumerate(buckets)}
        for i, r in enumerate(rs):
            t, p = ts[i], ps[i]
            f = {}
            cand = [j for j in range(i) if ts[j] >= t - H48]
            f["price_change_48h"] = (p - ps[cand[-1]]) / ps[cand[-1]] if cand else 0.0
            hist = ps[:i]
            ok = len(hist) >= 5
            f["price_vs_event_min"] = p / min(hist) if ok else 1.0
            f["price_vs_event_median"] = p / float(np.quantile(hist, 0.5)) if ok else 1.0
            f["price_vs_event_max"] = p / max(hist) if ok else 1.0
            f["cumulative_quantity"] = float(sum(qs[:i]))
            f["prev_cumulative"] = float(sum(qs[:i - 1])) if i else 0.0
            win = [j for j in range(i + 1) if ts[j] > t - D7]
            f["listing_volume_7d"] = float(len(win))
            f["avg_quantity_7d"] = statistics.mean(qs[j] for j in win)
            s7 = std([ps[j] for j in win])
            m7 = statistics.mean(ps[j] for j in win)
            f["price_std_7d"] = s7 if s7 is not None else 0.0
            f["price_volatility"] = s7 / (m7 if m7 != 0 else 1e-6) if s7 is not None else None
            h = [ps[j] for j in range(len(rs)) if ts[j] < t]
            f["event_listing_frequency"] = len(h)
            f["event_avg_price"] = statistics.mean(h) if h else p
            f["event_price_std"] = (std(h) if h else 0.0)
            f["prior_listings_count"] = i
            f["days_since_first_listing"] = (t - t0).total_seconds() / 86400
            f["event_duration_so_far"] = (tmax - t0).total_seconds() / 86400
            f["expanding_p20"] = float(np.quantile(hist, 0.2)) if ok else None
            last15 = ps[max(0, i - 15):i]
            f["hist_volatility_30d"] = std(last15) if len(last15) >= 5 else None
            stab = None
            if i >= 7:
                past = [ps[j] for j in range(i) if ts[j] >= t - D7]
                if past and statistics.mean(past) != 0 and len(past) > 1:
                    stab = statistics.stdev(past) / statistics.mean(past)
            f["price_stability_7d"] = stab
            pb = prev_b[week(t)]
            f["prev_market_median"] = pb[0] if pb else None
            f["prev_market_size"] = float(pb[1]) if pb else 0.0
            f["price_vs_prev_market"] = p / pb[0] if pb and pb[0] > 0 else 1.0
            out[r[1]] = f
    return out


def make_rows(spec):
    rows, i = [], 0
    for e, gaps, prices, qs in spec:
        t = T0
        for g, p, q in zip(gaps, prices, qs):
            t = t + dt.timedelta(minutes=g)
            rows.append((e, i, t, T0 + dt.timedelta(days=60), "ga", q, p))
            i += 1
    return rows


def compare(spark, rows, **kw):
    exp = brute(rows)
    got = FE.engineer_features(with_calendar(spark.createDataFrame(rows, SCHEMA)), COLS, **kw).collect()
    assert len(got) == len(exp)
    for r in got:
        e = exp[r["event_id"]]
        for k, v in e.items():
            g = r[k]
            if v is None or g is None:
                assert v is None and g is None, (k, r["event_id"], v, g)
            else:
                assert g == pytest.approx(v, rel=1e-9, abs=1e-9), (k, r["event_id"], v, g)


entity = st.integers(min_value=1, max_value=24).flatmap(lambda n: st.tuples(
    st.lists(st.integers(min_value=1, max_value=4000), min_size=n, max_size=n),
    st.lists(st.integers(min_value=100, max_value=20000).map(lambda c: c / 100), min_size=n, max_size=n),
    st.lists(st.integers(min_value=0, max_value=4), min_size=n, max_size=n)))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(entity, min_size=1, max_size=3))
def test_features_match_brute_force(spark, ents):
    spec = [(f"e{k}", g, p, q) for k, (g, p, q) in enumerate(ents)]
    compare(spark, make_rows(spec))


def test_features_match_brute_force_seeded(spark):
    rng = np.random.default_rng(7)
    spec = []
    for k in range(4):
        n = int(rng.integers(20, 60))
        spec.append((f"s{k}", rng.integers(1, 3000, n).tolist(), (rng.integers(500, 30000, n) / 100).tolist(),
                     rng.integers(0, 5, n).tolist()))
    rows = make_rows(spec)
    compare(spark, rows)
    compare(spark, rows, ranges=25)  # chunks of a few rows
