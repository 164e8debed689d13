"""The growing-quantile operator against brute force (numpy quantile of all earlier values)."""

import numpy as np
import pandas as pd
import pytest

from pricelens.operators.quantiles import _batch_quantiles, growing_quantiles


def brute(pdf, order):
    out = {}
    for g, core in pdf[pdf._role == 0].groupby("g"):
        core = core.sort_values(order, kind="stable")
        c = pdf[(pdf._role == 1) & (pdf.g == g)]
        ctx = np.repeat(c._hv.to_numpy(), c._hf.to_numpy().astype(int))
        keys = [tuple(x) for x in core[order].to_numpy()]
        vals = core._v.to_numpy()
        for i, k in enumerate(keys):
            if (g, k) in out:
                continue
            e = vals[:i]
            ms = np.concatenate((ctx, e[~np.isnan(e)]))
            out[(g, k)] = (np.quantile(ms, 0.5), np.quantile(ms, 0.2)) if len(ms) else (np.nan, np.nan)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_batch_matches_brute_force(seed):
    rng = np.random.default_rng(seed)
    rows, ctx = [], []
    for g in range(int(rng.integers(1, 6))):
        for i in range(int(rng.integers(0, 30))):
            v = np.nan if rng.random() < 0.1 else float(rng.integers(0, 12)) / 2
            rows.append((f"g{g}", int(rng.integers(0, 10)) if seed % 2 else i, i, v, 0, np.nan, 0))
        if seed % 3 == 0:
            ctx += [(f"g{g}", None, None, np.nan, 1, float(rng.integers(0, 12)) / 2, int(rng.integers(1, 4)))
                    for _ in range(int(rng.integers(0, 4)))]
    if not rows:
        return
    pdf = pd.DataFrame(rows + ctx, columns=["g", "t", "tb", "_v", "_role", "_hv", "_hf"])
    order = ["t"] if seed % 2 else ["t", "tb"]
    exp = brute(pdf, order)
    got = _batch_quantiles(pdf, ["g"], order, ["a", "b"], [0.5, 0.2])
    assert len(got) == len(exp)
    for _, r in got.iterrows():
        ea, eb = exp[(r.g, tuple(r[c] for c in order))]
        assert (np.isnan(ea) and np.isnan(r.a)) or abs(r.a - ea) < 1e-9
        assert (np.isnan(eb) and np.isnan(r.b)) or abs(r.b - eb) < 1e-9


def test_operator_on_spark_with_context(spark):
    rows = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, None), ("a", 4, 40.0), ("b", 1, 7.0)],
                                 "g string, t long, p double")
    ctx = spark.createDataFrame([("a", 5.0, 2)], "g string, _hv double, _hf long")
    got = {(r["g"], r["t"]): r["m"] for r in growing_quantiles(rows, ["g"], ["t"], "p", {"m": 0.5}, ctx).collect()}
    assert got[("a", 1)] == 5.0            # context {5, 5}
    assert got[("a", 2)] == 5.0            # {5, 5, 10}
    assert got[("a", 3)] == 7.5            # {5, 5, 10, 20}
    assert got[("a", 4)] == 7.5            # the null adds nothing
    assert got[("b", 1)] is None           # no earlier value


def test_groups_spanning_arrow_batches(spark):
    """Tiny Arrow batches force every group across batch boundaries (the carry-over path)."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    rng = np.random.default_rng(11)
    rows = [(f"g{g}", int(t), float(rng.integers(0, 40)) / 4) for g in range(6) for t in range(int(rng.integers(5, 60)))]
    df = spark.createDataFrame(rows, "g string, t long, p double")
    w = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    exp = {(r["g"], r["t"]): (r["m"], r["q"]) for r in df.select(
        "g", "t", F.percentile("p", F.lit(0.5)).over(w).alias("m"),
        F.percentile("p", F.lit(0.2)).over(w).alias("q")).collect()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = growing_quantiles(df.repartition(2), ["g"], ["t"], "p", {"m": 0.5, "q": 0.2}).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(exp)
    for r in got:
        em, eq = exp[(r["g"], r["t"])]
        assert (em is None and r["m"] is None) or abs(r["m"] - em) < 1e-9
        assert (eq is None and r["q"] is None) or abs(r["q"] - eq) < 1e-9
