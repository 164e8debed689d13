"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"  # a word: a run without ASCII white space

#: white space of ``WORD`` by byte, and A-Z to a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; -1 (no fold) for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(-1).cast("long"))


def unused(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as make it no column's name (which Spark compares without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, cells: Column | None = None) -> DataFrame:
    """``df``, written once, with a broadcast hint only if it has at most ``max_rows`` rows (or ``cells``, summed);
    beyond that the join that follows is left to shuffle, with adaptive skew handling."""
    df = cut_lineage(df)
    size = df.agg(F.sum(cells) if cells is not None else F.count("*")).first()[0] or 0
    return F.broadcast(df) if size <= max_rows else df


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that every bit of ``x`` reaches every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[bytes], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes together (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(texts) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts in order, and where each text's words begin
    (one entry more than texts)."""
    buf = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    space = _SPACE[buf]
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    lengths = np.flatnonzero(inside & np.append(space[1:], True)) - starts + 1
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(at)) - np.repeat(begin, lengths)
    power = np.full(int(lengths.max()), _MULTIPLIER, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    words = mix64(np.add.reduceat(_BYTE_VALUE[buf[at]] * power[place], begin) + lengths.astype(np.uint64))
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    return words, bounds
