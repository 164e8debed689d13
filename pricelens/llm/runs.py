"""Periodic runs of words, by enumeration of maximal pairs over each text's tree of repeated word strings.

A run is a stretch of words with smallest period ``q``, at least ``max(min_length, min_exponent * q)`` long,
that cannot be extended with that period. With ``l`` words equal at ``i`` and ``i + q``, but neither one word earlier nor
later (a maximal pair), the stretch of ``l + q`` words from ``i`` has period ``q`` and cannot be extended. So the maximal
pairs with ``l >= (min_exponent - 1) * q`` and ``l + q >= min_length`` are the runs, and no extension is needed.

* Suffixes are sorted by prefix doubling, many texts in one array (a text's words never equal another's). A suffix that
  shares its first 2^k words with no other is settled and leaves; after four rounds only those that
  share 16 words with another one of their text are left, usually a few per cent.
* The ranks of all rounds give the longest common prefix of neighbours, and a stack turns these, bottom up,
  into the tree of intervals with a common prefix. An interval has its positions in order, each with its left-word class:
  the word before it. Shorter lists go into longer ones.
* Positions of an interval with ``l`` common words that are at most ``l / 2`` apart lie on a grid: its step is the smallest
  period of those words, and every place of the grid between two positions is a position too. All of the grid but its
  last one share more than ``l`` words and hence one child interval, and all but its first have one left-word class.
  So a maximal pair within that distance is a pair of *neighbours*, and the distance is the smallest period;
  other pairs of an interval, however many, need no look.

Texts are independent of each other: no shuffle, and a lost task is run again alone. Memory is 4 bytes a word of a block of
texts for each doubling round; a text is never cut, so a block has one text at least.

Defined cases: a null or empty text has no words and no runs; a text shorter than ``min_length`` has none; repeated rows
get equal results; an empty table gives an empty result. All columns are kept, and ``runs`` and ``collapsed`` replaced.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import chunks, encode

MIN_LENGTH = 24
MIN_EXPONENT = 3  # three or more: what is said above on neighbours needs it
BLOCK_BYTES = 1 << 21
RESULT = "runs array<struct<start:long,length:long,period:long>>, collapsed string"
Run = tuple[int, int, int]  # start, length, period


def word_codes(texts: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts with -1 behind each text, and where each text begins (one entry more)."""
    codes: defaultdict[bytes, int] = defaultdict()
    codes.default_factory = codes.__len__
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    flat = np.full(int(bounds[-1]), -1, np.int64)
    inside = np.ones(len(flat), bool)
    inside[bounds[1:] - 1] = False
    flat[inside] = np.fromiter((codes[w] for t in texts for w in t), np.int64, int(inside.sum()))
    return flat, bounds


def sorted_suffixes(flat: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes that have ``least`` or more words in common with another one of their text, in order (some with fewer
    may be among them), and the ranks of each round.

    In round k two ranks are equal if and only if the suffixes are of one text and their first 2^k words are equal.
    """
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = text_of * (flat.max(initial=0) + 2) + flat + 1
    rank = np.empty(len(flat), np.int32)
    rounds, h, shared = [], 1, np.zeros(0, np.int64)
    tied, slots = np.arange(len(flat)), np.arange(len(flat))
    while len(tied):
        turn = np.argsort(key)
        tied, key = tied[turn], key[turn]
        first = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(first) - 1
        rank[tied] = slots[first][group]  # a group's rank is the place of its first member
        rounds.append(rank.copy())
        many = np.bincount(group)[group] > 1
        tied, slots = tied[many], slots[many]
        if h <= least:
            shared = tied
        key = rank[tied].astype(np.int64) * (len(flat) + 1) + rank[tied + h]  # no end of a text is passed: -1 is there once
        h *= 2
    return shared[np.argsort(rank[shared])], rounds


def common_prefix(a: np.ndarray, b: np.ndarray, rounds: Sequence[np.ndarray]) -> np.ndarray:
    """Number of words that the suffixes at ``a`` and ``b`` begin with alike, pair by pair."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        length += (rounds[k][a + length] == rounds[k][b + length]).astype(np.int64) << k
    return length


def maximal_pairs(places: Sequence[int], common: Sequence[int], flat: Sequence[int], min_length: int = MIN_LENGTH,
                  min_exponent: int = MIN_EXPONENT) -> set[tuple[int, int, int]]:
    """Maximal pairs that are runs, as (place, distance, words in common), from suffixes in order.

    ``common[k]`` is the number of words that ``places[k - 1]`` and ``places[k]`` begin with alike.
    """
    least = -(-min_length * (min_exponent - 1) // min_exponent)
    found: set[tuple[int, int, int]] = set()

    def look(x: int, y: int, words: int) -> None:
        d = y - x
        if (d * (min_exponent - 1) <= words and d + words >= min_length
                and flat[x - 1] != flat[y - 1] and flat[x + words] != flat[y + words]):
            found.add((x, d, words))

    def merge(a: list[int], b: list[int], words: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        if len(b) * 8 < len(a):
            for x in b:
                insort(a, x)
            for x in b:
                at = bisect_left(a, x)
                for i in (at, at + 1):
                    if 0 < i < len(a):
                        look(a[i - 1], a[i], words)
        else:
            a += b
            a.sort()
            for x, y in zip(a, a[1:]):
                look(x, y, words)
        return a

    stack: list[tuple[int, list[int]]] = []  # open intervals: words in common, positions
    for k in range(1, len(places) + 1):
        words = common[k] if k < len(places) else 0
        held = [places[k - 1]]
        while stack and stack[-1][0] > words:
            depth, positions = stack.pop()
            held = merge(positions, held, depth)
        if words < least:
            continue
        if stack and stack[-1][0] == words:
            held = merge(stack.pop()[1], held, words)
        stack.append((words, held))
    return found


def runs_of(texts: Sequence[Sequence[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[Run]]:
    """Runs of each text, given as words, by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    flat, bounds = word_codes(texts)
    places, rounds = sorted_suffixes(flat, bounds, -(-min_length * (min_exponent - 1) // min_exponent))
    if len(places):
        common = np.concatenate(([0], common_prefix(places[:-1], places[1:], rounds)))
        found = sorted(maximal_pairs(places.tolist(), common.tolist(), flat.tolist(), min_length, min_exponent))
        owners = np.searchsorted(bounds, [x for x, _, _ in found], side="right") - 1
        for (x, d, words), i in zip(found, owners.tolist()):
            out[i].append((x - int(bounds[i]), d + words, d))
    return out


def collapse(words: Sequence[bytes], runs: Sequence[Run]) -> bytes:
    """The words but those that a run holds behind its first period, joined by one space."""
    if runs:
        gone = np.zeros(len(words), bool)
        for start, length, period in runs:
            gone[start + period:start + length] = True
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    return b" ".join(words)


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` with the runs of its texts, by start and period, and the texts collapsed to one period of each."""
    if min_exponent < 3:
        raise ValueError("min_exponent must be 3 or more")

    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        raw, runs, short = encode(texts), [], []
        for start, stop in chunks(raw, BLOCK_BYTES):
            words = [t.split() for t in raw[start:stop]]  # of bytes: at ASCII white space
            for w, r in zip(words, runs_of(words, min_length, min_exponent)):
                runs.append([dict(zip(("start", "length", "period"), x)) for x in r])
                short.append(collapse(w, r).decode("utf-8", "surrogatepass"))
        return pd.DataFrame({"runs": runs, "collapsed": short})

    return docs.drop("runs", "collapsed").withColumn("_scanned", scan(F.col(text))).select("*", "_scanned.*").drop("_scanned")


def strongest(runs: Column) -> Column:
    """The run with the most repeats, compared exactly; ties: smallest start, then period. Null without a run."""
    more = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    order = lambda a, b: (F.when(more(a, b) != 0, -F.signum(more(a, b))).when(a["start"] != b["start"], F.signum(a["start"] - b["start"]))
                          .otherwise(F.signum(a["period"] - b["period"])).cast("int"))
    return F.get(F.array_sort(runs, order), F.lit(0))
