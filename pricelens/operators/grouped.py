"""Sorted partitions read as whole groups, for operators that answer a group's rows with numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

try:  # ship this module's code with the task, so executors need only numpy and pandas
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001  (older cloudpickle: the package must be installed on executors)
    pass


def new_key(frame: pd.DataFrame) -> np.ndarray:
    """Whether each row's key differs from the row's before it (null equals null); true for the first."""
    out = np.zeros(len(frame), dtype=bool)
    out[:1] = True
    for c in frame.columns:
        v, null = frame[c].to_numpy(), frame[c].isna().to_numpy()
        out[1:] |= (null[1:] != null[:-1]) | (~null[1:] & ~null[:-1] & (v[1:] != v[:-1]))
    return out


def whole_groups(batches: Iterator[pd.DataFrame], group: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Batches of a partition sorted by ``group``, cut between groups: an unfinished last group waits for the next batch."""
    group = list(group)
    pending: list[pd.DataFrame] = []  # pieces of the last group so far
    for pdf in batches:
        if not len(pdf):
            continue
        starts = np.flatnonzero(new_key(pdf[group]))
        if pending:
            joint = pd.concat([pending[-1].tail(1), pdf.head(1)])
            if not new_key(joint[group])[1]:
                starts = starts[1:]
        if len(starts):  # a group begins here, so all before it are complete
            done = pd.concat([*pending, pdf[:starts[-1]]], ignore_index=True)
            if len(done):
                yield done
            pending = [pdf[starts[-1]:]]
        else:
            pending.append(pdf)
    if pending:
        yield pd.concat(pending, ignore_index=True)
