"""Nearest neighbours by randomly rotated one-bit codes.

Each vector is rotated by a fixed random orthogonal matrix and kept as the signs of its coordinates, packed to
bits, with two scalars: its length and how well the signs agree with it. Inner products are estimated
from bits and scalars; each estimate has an error bound (``WIDTH`` standard deviations), and only vectors whose upper bound
reaches the best ``k`` known so far are compared exactly. The ``k`` rows of the highest estimates in a block are compared first, so that
the others meet a high floor; fewer than ``k`` rows leave none out. The queries meet all rows in cells of one block
of queries and one block of rows, both bounded, that Spark deals out; a cell returns its ``k`` best per query. Rows travel with their vectors: at 64
dimensions the bounds of one-bit codes leave many rows to compare (22 % of 10,256 given ones), which are more bytes per query, if fetched
one by one, than the block's vectors are.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor rows without an
id; vectors are compared with those of the same length only; equal rows count once, and rows of one id
are one candidate with its nearest vector; ties go to the smaller id; an empty table, or one without queries, gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOURS = 20
QUERY_EVERY = 20
WIDTH = 1.9       # standard deviations of an estimate that its bounds allow for
BLOCK = 4096      # queries that are compared at once
ROW_BLOCK = 32768  # rows of a cell: the more, the higher the floor that the others must reach; half as many queries has
                   # a cell: a row is sent once for each block of queries
TILE = 1024       # rows that are estimated at once
PAIRS = 1 << 17   # exact products made at once
SEED = 11

_CODED = "dim int, id long, vector array<double>, code binary, length double, agree double"
_FOUND = "query_id long, vec_id long, score double"


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated rows, their lengths, and the signs' inner product with the rotated unit vector."""
    length = np.linalg.norm(x, axis=1)
    turned = (x / length[:, None]) @ rotation(x.shape[1]).T
    return np.packbits(turned >= 0, axis=1), length, np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])


def _coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for dim, g in f.groupby("dim"):
            x = np.stack(g["vector"].to_numpy()).astype(float)
            bits, length, agree = encode(x)
            yield pd.DataFrame({"dim": dim, "id": g["id"].to_numpy(), "vector": list(x), "code": [b.tobytes() for b in bits],
                                "length": length, "agree": agree})


class Best:
    """The k best (score, id) found so far for each of n queries."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.floor[query]
        q = np.concatenate([self.query, query[keep]])
        s = np.concatenate([self.score, score[keep]])
        i = np.concatenate([self.id, ids[keep]])
        order = np.lexsort((-s, i, q))
        q, s, i = q[order], s[order], i[order]
        first = np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1]))[:len(q)]  # each id once
        q, s, i = q[first], s[first], i[first]
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        begin = np.searchsorted(q, q)
        rank = np.arange(len(q)) - begin
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        top = rank < self.k
        self.query, self.score, self.id = q[top], s[top], i[top]


def search(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, bits: np.ndarray,
           length: np.ndarray, agree: np.ndarray, k: int = NEIGHBOURS, width: float = WIDTH) -> tuple[Best, int]:
    """The k best rows of x for each query, and how many pairs were compared exactly."""
    dim = x.shape[1]
    turned = (queries @ rotation(dim).T).astype(np.float32) / np.sqrt(dim)
    query_length = np.linalg.norm(queries, axis=1)
    spread = length * np.sqrt(np.maximum(1 - agree**2, 0)) / agree * (width / np.sqrt(max(dim - 1, 1)))
    best, exact = Best(len(queries), k), 0

    order = np.argsort(query_ids, kind="stable")

    def own_cells(asks: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``asks`` (rising) and ``part`` where a query meets a row of its own id."""
        place = np.full(len(queries), -1)
        place[asks] = np.arange(len(asks))
        low, high = (np.searchsorted(query_ids[order], part, side=side) for side in ("left", "right"))
        size = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        q, r = place[order[at]], np.repeat(np.arange(len(part)), size)
        return q[q >= 0], r[q >= 0]

    # the error of an estimate is a product of a query's length and a row's spread: one more coordinate
    reach = np.column_stack([turned, query_length.astype(np.float32)])
    asks = np.arange(len(queries))

    def tiles() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, upper bounds and the spreads in them, of a tile; a query's own rows have no bound."""
        for a in range(0, len(x), TILE):
            part = slice(a, a + TILE)
            signs = np.unpackbits(bits[part], axis=1, count=dim).astype(np.float32) * 2 - 1
            codes = np.column_stack([signs * (length[part] / agree[part]).astype(np.float32)[:, None], spread[part].astype(np.float32)])
            high = reach @ codes.T
            high[own_cells(asks, ids[part])] = -np.inf
            yield a, high, codes[:, -1]

    def compare(qi: np.ndarray, xi: np.ndarray) -> None:
        nonlocal exact
        exact += len(qi)
        for b in range(0, len(qi), PAIRS):
            q, r = qi[b:b + PAIRS], xi[b:b + PAIRS]
            best.add(q, (queries[q] * x[r]).sum(axis=1), ids[r])

    # the rows of the highest estimates are compared first: the k-th of their scores is a floor for all rows
    top, row = np.zeros((len(queries), 0), np.float32), np.zeros((len(queries), 0), np.int64)
    for a, high, wide in tiles():
        high -= reach[:, -1:] * wide
        some = np.argpartition(high, -k, axis=1)[:, -k:] if high.shape[1] > k else np.broadcast_to(np.arange(high.shape[1]), high.shape)
        top, row = np.column_stack([top, np.take_along_axis(high, some, axis=1)]), np.column_stack([row, some + a])
        if top.shape[1] > k:
            some = np.argpartition(top, -k, axis=1)[:, -k:]
            top, row = np.take_along_axis(top, some, axis=1), np.take_along_axis(row, some, axis=1)
    qi, place = np.nonzero(top > -np.inf)
    compare(qi, row[qi, place])
    for a, high, _ in tiles():
        floor = (best.floor - 1e-6).astype(np.float32)
        qi, xi = np.divmod(np.flatnonzero(high >= floor[:, None]), high.shape[1])
        free = high[qi, xi] > -np.inf
        compare(qi[free], xi[free] + a)
    return best, exact


def _cell(k: int, width: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x, ids, code = np.stack(right["vector"].to_numpy()), right["id"].to_numpy(), np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
        out = []
        for a in range(0, len(left), BLOCK):
            part = left[a:a + BLOCK]
            query_ids = part["id"].to_numpy()
            best, _ = search(np.stack(part["vector"].to_numpy()), query_ids, x, ids, code, right["length"].to_numpy(), right["agree"].to_numpy(), k, width)
            out.append(pd.DataFrame({"query_id": query_ids[best.query], "vec_id": best.id, "score": best.score}))
        return pd.concat(out)
    return run


def usable(vector: Column) -> Column:
    big = float(np.finfo(np.float64).max)
    finite = F.forall(vector, lambda x: F.coalesce((x >= -big) & (x <= big), F.lit(False)))  # NaN is above all
    return (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS,
            width: float = WIDTH, block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that ``is_query`` marks."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector"))).distinct().withColumn("dim", F.size("vector"))
    # a row per length of vectors
    blocks = rows.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("row_blocks"),
                                     F.ceil(F.count_if("asks") / (block // 2)).cast("int").alias("query_blocks"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    coded = rows.select("dim", "id", "vector").mapInPandas(_coded, _CODED).join(blocks, "dim")
    index = (coded.filter("query_blocks > 0").withColumn("row_block", own("row_blocks"))
             .withColumn("query_block", every("query_blocks")))
    queries = (rows.filter("asks").join(blocks, "dim").withColumn("query_block", own("query_blocks"))
               .withColumn("row_block", every("row_blocks")))
    cell = ["dim", "query_block", "row_block"]
    found = (queries.select(*cell, "id", "vector").groupBy(*cell)
             .cogroup(index.select(*cell, "id", "vector", "code", "length", "agree").groupBy(*cell))
             .applyInPandas(_cell(k, width), _FOUND))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
