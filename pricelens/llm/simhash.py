"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made once per document. Distinct fingerprints are dealt into tiles by the population
counts of their four 16-bit quarters; two tiles are compared only if the quarters' counts differ by no
more than the radius together, since each differing bit changes one count by one. Tiles are cut into blocks
of bounded size, so that a crowded tile is spread over many tasks. A pair of blocks is compared with
numpy's exclusive-or and bit counts, a few rows at a time, and returns a spanning forest of its links,
never all pairs. Components of the forest are the components of all links.

Defined cases: null, empty and blank texts have fingerprint zero, which links like any other; fewer words
than a shingle are one shingle; repeated rows and equal texts share a fingerprint; a null doc_id is a
document like any other but names a component only if all its documents have none; an empty table gives an empty result.
Very long texts are hashed whole, in pieces. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import encode
from pricelens.llm.components import components
from pricelens.session import cut_lineage

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCK = 4096      # fingerprints of a tile that are compared together
PIECE = 1 << 16   # shingles whose bits are unpacked at once
QUARTERS = 4


def _set_bits(words: list[bytes], shingle: int) -> tuple[np.ndarray, int]:
    """How many of the shingles' hashes have each bit (from bit 63 down), and the number of shingles."""
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for a in range(0, n, PIECE):
        part = words[a:a + PIECE + shingle - 1] if len(words) >= shingle else words
        rows = zip(*[part[i:] for i in range(shingle)]) if len(words) >= shingle else [part]
        hashes = np.array([digest(x, SEED) for x in map(b" ".join, rows)], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return total, n


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the whole text."""
    words = encode([text])[0].lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    total, n = _set_bits(words, shingle)
    return int(np.packbits(total * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per document."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "fp": [fingerprint(t, shingle) for t in f["text"]]})

    rows = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.col(text).alias("text"))
    return (rows.mapInPandas(run, "doc_id string, fp long")
            .select(F.col("doc_id").cast("long").alias("doc_id"), "fp"))


def _quarter_counts(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int") for i in range(QUARTERS)]


def _tile(counts: list[Column]) -> Column:
    out = counts[0]
    for c in counts[1:]:
        out = out * 17 + c
    return out


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of the quarters' counts between a tile and those to compare it with, itself included."""
    near = product(range(-radius, radius + 1), repeat=QUARTERS)
    return [s for s in near if sum(map(abs, s)) <= radius and s >= (0,) * QUARTERS]


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two blocks (or within one): each member to its root."""
    nodes = a if same else np.concatenate([a, b])
    root = np.arange(len(nodes))
    shift = 0 if same else len(a)
    step = max(1, (1 << 20) // max(1, len(b)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(a), step):
        i0, j0 = np.nonzero(np.bitwise_count(a[i:i + step, None] ^ b[None, :]) <= radius)
        i0 = i0 + i
        if same:
            i0, j0 = i0[j0 > i0], j0[j0 > i0]
        if not len(i0):
            continue
        found.append((i0, j0 + shift))
        if sum(len(x[0]) for x in found) > 1 << 20:  # fold them into the forest, so that they stay few
            root = _merge(root, found)
            found = []
    root = _merge(root, found)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _merge(root: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable, after adding links."""
    if not found:
        return root
    i = np.concatenate([x[0] for x in found])
    j = np.concatenate([x[1] for x in found])
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Spanning forest (u, v) of the links between distinct fingerprints (column fp)."""
    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pairs = [_forest(np.asarray(a, np.int64).view(np.uint64), np.asarray(a if same else b, np.int64).view(np.uint64),
                             radius, same) for a, b, same in zip(f["home"], f["visitors"], f["same"], strict=True)]
            yield pd.DataFrame({k: np.concatenate([p[n] for p in pairs] or [np.zeros(0, np.uint64)]).view(np.int64)
                                for n, k in enumerate("uv")})

    counts = _quarter_counts(F.col("fp"))
    own = fps.select("fp", F.array(*counts).alias("counts"), _tile(counts).alias("tile"))
    # one row per tile, of which there are at most 17 ** 4
    tiles = cut_lineage(own.groupBy("tile").count().select("tile", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    own = (own.join(F.broadcast(tiles), "tile")
           .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    # a pair of tiles is named by its lower tile, then its upper one; a row is home in the lower one
    steps = [s for s in _steps(radius)]
    valid = lambda xs: F.forall(xs, lambda x: (x >= 0) & (x <= 16))

    def near(sign: int) -> Column:
        moved = [F.array(*[F.col("counts")[i] + sign * s[i] for i in range(QUARTERS)]) for s in steps]
        kept = F.filter(F.array(*moved), valid)
        return F.transform(kept, lambda x: _tile([x[i] for i in range(QUARTERS)]))

    other = F.broadcast(tiles.select(F.col("tile").alias("other"), F.col("blocks").alias("other_blocks")))
    cut = lambda first, last: F.explode(F.sequence(first, last))
    home = (own.withColumn("other", F.explode(near(1))).join(other, "other")
            .withColumn("other_block", cut(F.when(F.col("other") == F.col("tile"), F.col("block")).otherwise(F.lit(0)),
                                           F.col("other_blocks") - 1))
            .select("tile", "block", "other", "other_block", "fp", F.lit(True).alias("is_home")))
    visit = (own.withColumn("other", F.explode(near(-1))).join(other, "other")
             .withColumn("other_block", F.explode(
                 F.when(F.col("other") != F.col("tile"), F.sequence(F.lit(0), F.col("other_blocks") - 1))
                 .when(F.col("block") > 0, F.sequence(F.lit(0), F.col("block") - 1))
                 .otherwise(F.array().cast("array<int>"))))
             .select(F.col("other").alias("tile"), F.col("other_block").alias("block"), F.col("tile").alias("other"),
                     F.col("block").alias("other_block"), "fp", F.lit(False).alias("is_home")))
    cells = (home.unionByName(visit).groupBy("tile", "block", "other", "other_block")
             .agg(F.collect_list(F.when(F.col("is_home"), F.col("fp"))).alias("home"),  # a block, no more
                  F.collect_list(F.when(~F.col("is_home"), F.col("fp"))).alias("visitors"))
             .withColumn("same", (F.col("tile") == F.col("other")) & (F.col("block") == F.col("other_block")))
             .filter((F.size("home") > 0) & (F.col("same") & (F.size("home") > 1) | (F.size("visitors") > 0))))
    return cells.select("home", "visitors", "same").mapInPandas(compare, "u long, v long")


def cluster(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp): the smallest doc_id reachable over links."""
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    members = components(links(distinct.select("fp"), radius, block))
    named = (distinct.join(members.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("component", F.coalesce("component", "fp")))
    named = cut_lineage(named)
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) per document."""
    fps = cut_lineage(fingerprints(docs, doc_id, text, shingle))  # made once, narrow
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return cluster(fps, radius, block).select("doc_id", hexed.alias("fingerprint"), "component_id")
