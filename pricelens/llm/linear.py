"""Linear support vector machines on hashed n-gram indicators, for the classifiers of this package."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import broadcast_if_small, chunks, word_hashes

BITS = 18
DIMS = 1 << BITS
SIZES = (1, 2, 3, 4)  # bytes per n-gram
REPEATS = 3           # runs of words equal to the one before, up to this long, are indicators of their own


def _ids(code: np.ndarray, salt: int) -> np.ndarray:
    """Feature numbers of 32-bit codes; another order of codes for each salt."""
    mixed = (code ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    mixed ^= mixed >> np.uint32(13)
    return (mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def features(texts: list[bytes], words: bool = True) -> Iterator[np.ndarray]:
    """For each text the sorted numbers of the byte n-grams, words and runs of repeated words in it."""
    seen = np.zeros(DIMS, bool)
    longest = max(SIZES)
    for a, b in chunks(texts):
        part = texts[a:b]
        buf = np.frombuffer(b"".join(t + bytes(longest) for t in part), np.uint8).astype(np.uint32)
        code, grams = np.zeros(len(buf), np.uint32), {}
        for n in range(1, longest + 1):  # zero bytes stand between texts; an n-gram with one is none
            code = code + (np.append(buf[n - 1:], np.zeros(n - 1, np.uint32)) << np.uint32(8 * (n - 1)))
            if n in SIZES:
                grams[n] = _ids(code, n)
        hashes, bounds = word_hashes(part) if words else (np.zeros(0, np.uint64), np.zeros(len(part) + 1, np.int64))
        begin = 0
        for i, t in enumerate(part):
            for n, ids in grams.items():
                if len(t) >= n:
                    seen[ids[begin:begin + len(t) - n + 1]] = True
            begin += len(t) + longest
            w = hashes[bounds[i]:bounds[i + 1]]
            if len(w):
                seen[_ids((w >> np.uint64(32)).astype(np.uint32), 101)] = True
                same = w[1:] == w[:-1]
                for k in range(1, REPEATS + 1):
                    if same.any():
                        seen[_ids(np.array([k], np.uint32), 102)] = True
                    same = same[1:] & same[:-1]
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found.astype(np.int32)


@dataclass
class Svm:
    """Margin of a text: the weights of its features, over the length of its scaled vector, and a bias.

    ``square`` holds the scales' squares; it is left out where all are one. Pickled are the weights that aren't zero.
    """
    weight: np.ndarray
    square: np.ndarray | None
    bias: float

    def __getstate__(self):
        at = np.flatnonzero(self.weight).astype(np.int32)
        return at, self.weight[at], self.square, self.bias

    def __setstate__(self, state):
        at, weight, self.square, self.bias = state
        self.weight = np.zeros(DIMS)
        self.weight[at] = weight

    def margin(self, ids: np.ndarray) -> float:
        norm = float(np.sqrt(len(ids) if self.square is None else self.square[ids].sum())) if len(ids) else 0.0
        return (float(self.weight[ids].sum()) / norm if norm else 0.0) + self.bias


def log_count_ratio(rows: list[np.ndarray], positive: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Naive Bayes log ratio of each indicator's share among positive and negative texts."""
    count = lambda keep: np.bincount(np.concatenate([np.zeros(0, np.int32), *[r for r, k in zip(rows, keep) if k]]), minlength=DIMS) + alpha
    p, q = count(positive), count(~positive)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_svm(rows: list[np.ndarray], positive: np.ndarray, scale: np.ndarray, cost: float = 1.0,
            rounds: int = 20, seed: int = 0) -> Svm:
    """Hinge loss by dual coordinate descent over unit vectors of scaled indicators."""
    w, bias = np.zeros(DIMS), 0.0
    sign = np.where(positive, 1.0, -1.0)
    x = []
    for r in rows:
        v = scale[r]
        norm = np.sqrt((v * v).sum())
        x.append(v / norm if norm else v)
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], x[i]
            slope = sign[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - slope / (float(v @ v) + 1), 0.0), cost)  # 1: the bias is a feature of every text
            step = (new - alpha[i]) * sign[i]
            if step:
                w[r] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return Svm(w * scale, None if (scale == 1).all() else scale * scale, bias)


def fit_sigmoid(margins: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a * margin + b))), by Newton's method with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margins + b)
        g, h = weight * (p - positive), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margins).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def class_sample(ids: DataFrame, per_class: int) -> DataFrame:
    """About ``per_class`` (id, label) of each label, and no more: those with the least hashes of the id.

    The share by which a label is thinned follows from its count, so that only about twice as many rows as
    are kept meet in one task per label.
    """
    ids = ids.distinct()
    counts = broadcast_if_small(ids.groupBy("label").count())  # so that thinning comes before the rows of a label meet
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    thin = ids.join(counts, "label").withColumn("_draw", draw).filter(F.col("_draw") * F.col("count") < 2.0 * per_class)
    order = Window.partitionBy("label").orderBy("_draw", "id")
    return thin.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_class).select("id", "label", "count")


def sampled_texts(docs: DataFrame, doc_id: str, text: str, sample: DataFrame) -> DataFrame:
    """(label, count, text) of the sampled ids, one text per id."""
    picked = F.broadcast(sample)  # bounded: per_class rows of each label
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(picked, "id")
    return rows.groupBy("id", "label", "count").agg(F.min("text").alias("text")).drop("id")


def as_bool(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))
