"""Moments over ranges of time, from an index of merged moments.

A group holds points (a time and the count, mean and squared deviations of what happened then) in order of time. The
index has, level by level, the moments of 2^k points in a row; any range is a few of these, one per bit of its
length, merged in order. So n points answer n ranges in n log n steps, however dense the ranges are, and moments are
merged, never taken from each other: equal values have deviation 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import whole_groups

try:  # ship this module's code with the task, so executors need only numpy and pandas
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001  (older cloudpickle: the package must be installed on executors)
    pass

MOMENT = ("n", "mean", "m2")
POINT, ASK = 0, 1  # roles of a row: a point of its group, or a question to it
INPUT = f"_g long, _role int, _at long, {', '.join(f'{c} double' for c in (*MOMENT, 'nq', 'sq'))}, _og long, _oat long"
FRAMES = ("_past", "_week", "_stable")
OUTPUT = "_og long, _oat long, _g long, _role int, " + ", ".join(f"{f}_{m} double" for f in FRAMES for m in MOMENT) + ", _nq double, _sq double"

Moments = tuple[np.ndarray, np.ndarray, np.ndarray]


def merged(a: Moments, b: Moments) -> Moments:
    """Moments of both parts, element by element; a part with count 0 has mean and squared deviations 0."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    mean = np.where(a[0] > 0, a[1] + gap * share, np.where(b[0] > 0, b[1], 0.0))
    return n, mean, a[2] + b[2] + gap * gap * a[0] * share


def over_ranges(points: Moments, ranges: list[tuple[np.ndarray, np.ndarray]]) -> list[Moments]:
    """Moments of the points ``low`` to ``high`` (exclusive), for each list of ranges."""
    low = np.concatenate([r[0] for r in ranges])
    left = np.maximum(np.concatenate([r[1] for r in ranges]) - low, 0)
    out = tuple(np.zeros(len(low)) for _ in MOMENT)
    level, size = points, 1
    while left.any():
        odd = np.flatnonzero(left & 1)
        part = merged(tuple(x[odd] for x in out), tuple(x[low[odd]] for x in level))
        for x, new in zip(out, part):
            x[odd] = new
        low[odd] += size
        left >>= 1
        level = merged(tuple(x[:-size] for x in level), tuple(x[size:] for x in level)) if left.any() else level
        size *= 2
    cuts = np.cumsum([len(r[0]) for r in ranges])[:-1]
    return list(zip(*[np.split(x, cuts) for x in out]))


def answer(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """Frames of whole groups. A point has the moments of its group before its time, in the ``width`` up to its time and in
    the ``width`` before it; a question has, as the last two, those of the group after its time and since it."""
    pdf = pdf.sort_values(["_g", "_role", "_at"], kind="stable", ignore_index=True)
    role, at = pdf["_role"].to_numpy(), pdf["_at"].to_numpy()
    _, group = np.unique(pdf["_g"].to_numpy(), return_inverse=True)
    is_point = role == POINT
    points = tuple(pdf[c].to_numpy(float)[is_point] for c in MOMENT)
    pg, pt = group[is_point], at[is_point]
    first, last = np.searchsorted(pg, group), np.searchsorted(pg, group, side="right")
    # places among the points, by (group, time): times as ranks make one sorted key
    times = np.unique(np.concatenate((pt, at, at - width)))
    key = lambda g, t: g * (len(times) + 1) + np.searchsorted(times, t)
    own = key(pg, pt)
    from_ = lambda t, side: np.searchsorted(own, key(group, t), side=side)
    here, after = from_(at, "left"), from_(at, "right")
    begin = np.where(is_point, at - width, at)
    past = (first, np.where(is_point, here, first))
    week = (from_(begin, "right"), np.where(is_point, after, last))
    stable = (from_(begin, "left"), np.where(is_point, here, last))
    out = {c: pdf[c] for c in ("_og", "_oat", "_g", "_role")}
    for name, m in zip(FRAMES, over_ranges(points, [past, week, stable])):
        out |= {f"{name}_{c}": x for c, x in zip(MOMENT, m)}
    for name in ("nq", "sq"):
        total = np.concatenate(([0.0], np.cumsum(pdf[name].to_numpy(float)[is_point])))
        out[f"_{name}"] = total[np.maximum(week[1], week[0])] - total[week[0]]
    return pd.DataFrame(out)


def answers(rows: DataFrame, width: int) -> DataFrame:
    """Frames (``OUTPUT``) of the points and questions in ``rows`` (``INPUT``); times of a group's points are distinct."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["_g"]):
            yield answer(pdf, width)

    return rows.repartition("_g").sortWithinPartitions("_g").mapInPandas(run, OUTPUT)


def folded(found: DataFrame, fold) -> DataFrame:
    """One row per owner (_og, _oat): its own frames, and the answers of other groups merged by ``fold`` in order of the groups."""
    frame = lambda f: F.struct(*[F.col(f"{f}_{m}").alias(m) for m in MOMENT]).alias(f)
    mine = F.max(F.when(F.col("_role") == POINT, F.struct(*[frame(f) for f in FRAMES], "_nq", "_sq"))).alias("own")
    asked = F.when(F.col("_role") == ASK, F.struct("_g", frame("_week"), frame("_stable"), "_nq", "_sq"))
    whole = found.groupBy("_og", "_oat").agg(mine, F.array_sort(F.collect_list(asked)).alias("x"))
    total = lambda c: F.aggregate("x", F.lit(0.0), lambda a, v: a + v[c])
    return whole.select("_og", "_oat", "own.*", fold(F.transform("x", lambda v: v["_week"])).alias("_a"), fold(F.transform("x", lambda v: v["_stable"])).alias("_s"),
                        total("_nq").alias("_c_nq"), total("_sq").alias("_c_sq"))
