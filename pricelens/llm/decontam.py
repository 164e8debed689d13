"""Benchmark decontamination by a BM25 index of the test items, searched with block-max skipping.

The items (pieces of them, if long) are indexed by term; a term's impact on an item is its BM25 weight as a share
of the item's own score, so that one threshold holds for all. Items stand in blocks, and each posting list has
the largest impact per block. Every passage of a document (overlapping windows of words) is a query. As in
WAND, terms are split by their bounds: the commonest terms of an item, whose impacts together stay below
``COMMON``, can't lift it over the threshold alone, so they are not walked; a block is opened only if its bound over
the passage's other terms, plus what the common ones can add, reaches the threshold. Opened blocks are scored
exactly; items above the threshold are verified by the five-word shingles of the question and of the answer, each by itself: a passage
that asks the question and answers otherwise holds no item.

Defined cases: null and empty texts have no passages and no leaks; null and empty items are left out; equal items are
reported each; repeated documents get equal results; items of fewer words than a shingle are one shingle; an empty
table gives an empty result, and without items nothing leaks. Extra columns are kept; one named like an output is replaced. Benchmarks above
``SHARD_BYTES`` are searched in shards of about that size, each broadcast by itself, with term counts and mean length of the whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.session import cut_lineage

WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
THRESHOLD = 0.6     # share of an item's own score that a passage must reach
COMMON = 0.3        # share that an item's commonest terms may have together, to be left unwalked
OVERLAP = 0.8       # share of an item's shingles that the passage must hold, and of its question's and answer's
SHINGLE = 5
STEP = 64           # words; a passage has twice as many, and an indexed piece of an item so many at most
BLOCK = 8           # items
SHARD_BYTES = 32 << 20
HITS = "array<struct<item_id:string,score:double,question_overlap:double,answer_overlap:double,overlap:double>>"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


def answer_start(text: str) -> int:
    """Where the last sentence begins: it is taken for the answer if items don't name one."""
    ends = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text.rstrip())]
    return ends[-1] if ends else len(text)


def pieces_of(item: str, question: str, answer: str):
    """(item, words, how many of them are the question's) of the pieces of an item."""
    q, a = words_of(question), words_of(answer)
    both = q + a
    for i in range(0, len(both), STEP):
        start = max(0, min(i, len(both) - STEP))  # the last piece is whole too
        yield item, both[start:start + STEP], max(0, min(len(q) - start, STEP))


class Index:
    """Inverted index of (item id, question, answer)."""

    def __init__(self, items: list[tuple[str, str, str]], total: tuple[Counter, int, float] | None = None):
        # item, words, how many of them are the question's
        self.pieces: list[tuple[str, list[str], int]] = [p for x in items for p in pieces_of(*x)]
        self.pieces.sort(key=lambda p: " ".join(p[1]))
        counts = [Counter(w) for _, w, _ in self.pieces]
        own = Counter(t for c in counts for t in c)
        # pieces that hold a term, all pieces, and their mean length; of the whole benchmark, if these items are a part of it
        shared, n, mean = total or (own, len(counts), sum(map(len, (p[1] for p in self.pieces))) / max(1, len(counts)))
        self.term = {t: n for n, t in enumerate(own)}
        self.impact: list[dict[int, float]] = []
        walked: dict[int, dict[int, float]] = defaultdict(dict)
        self.spare = np.zeros(-(-len(counts) // BLOCK))  # what a block's unwalked terms can add
        for p, c in enumerate(counts):
            size = sum(c.values())
            raw = {self.term[t]: np.log1p((n - shared[t] + 0.5) / (shared[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean))
                   for t, f in c.items()}
            whole = sum(raw.values())
            impact = {t: x / whole for t, x in raw.items()}
            self.impact.append(impact)
            left = 0.0
            for t in sorted(impact, key=lambda t: (impact[t], t)):
                if left + impact[t] <= COMMON:
                    left += impact[t]
                else:
                    block = walked[t]
                    block[p // BLOCK] = max(block.get(p // BLOCK, 0.0), impact[t])
            self.spare[p // BLOCK] = max(self.spare[p // BLOCK], left)
        # posting lists over blocks, one after another
        order = [walked.get(t, {}) for t in range(len(self.term))]
        self.begin = np.concatenate(([0], np.cumsum([len(x) for x in order]))).astype(np.int64)
        self.block = np.array([b for x in order for b in sorted(x)], np.int64)
        self.block_max = np.array([x[b] for x in order for b in sorted(x)])

    def opened(self, terms: np.ndarray) -> list[tuple[int, int]]:
        """(passage, block) pairs whose bound reaches the threshold, from the term number of each word (-1: none)."""
        if not len(self.pieces):
            return []
        step = np.arange(len(terms)) // STEP
        last = max(0, (len(terms) - 1) // STEP - 1)  # passage i has the words of steps i and i + 1
        good = np.flatnonzero(terms >= 0)
        good = good[self.begin[terms[good] + 1] > self.begin[terms[good]]]
        t, s, n = terms[good], step[good], len(self.term)
        keys = np.unique(np.concatenate([np.minimum(s, last) * n + t, np.clip(s - 1, 0, last) * n + t]))
        passage, t = keys // n, keys % n
        size = self.begin[t + 1] - self.begin[t]
        at = np.repeat(self.begin[t] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        cell, which = np.unique(np.repeat(passage, size) * len(self.spare) + self.block[at], return_inverse=True)
        bound = np.bincount(which, self.block_max[at], len(cell)) + self.spare[cell % len(self.spare)]
        return [divmod(int(c), len(self.spare)) for c in cell[bound >= THRESHOLD - 1e-9]]

    def leaks(self, text: str | None) -> list[dict]:
        """The items that some passage of the text holds, each with its best scores."""
        words = words_of(text) if text else []
        if not words:
            return []
        best: dict[str, dict] = {}
        terms = np.fromiter((self.term.get(w, -1) for w in words), np.int64, len(words))
        for passage, block in self.opened(terms):
            a, b = passage * STEP, (passage + 2) * STEP
            own = set(terms[a:b].tolist())
            held = None
            for p in range(block * BLOCK, min(len(self.pieces), (block + 1) * BLOCK)):
                score = sum(x for t, x in self.impact[p].items() if t in own)
                if score < THRESHOLD:
                    continue
                held = held or set(shingles(words[a:b])) | {tuple(words[i:i + n]) for n in range(1, SHINGLE) for i in range(a, min(b, len(words)) - n + 1)}
                item, piece, cut = self.pieces[p]
                share = lambda xs: sum(x in held for x in xs) / len(xs) if xs else 1.0  # noqa: B023, E731
                all_of, asked, answered = (share(shingles(x)) for x in (piece, piece[:cut], piece[cut:]))
                if min(all_of, asked, answered) >= OVERLAP and all_of >= best.get(item, {"overlap": 0.0})["overlap"]:
                    best[item] = {"item_id": item, "score": score, "question_overlap": asked, "answer_overlap": answered, "overlap": all_of}
        return [best[k] for k in sorted(best)]


def split_item(item: str, question: str, answer: str | None) -> tuple[str, str, str]:
    at = answer_start(question)
    return (item, question, answer) if answer is not None else (item, question[:at], question[at:])


def _terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(shard, term, pieces with it), and per shard a null term with the number of pieces and of their words."""
    for f in frames:
        count: Counter = Counter()
        words: Counter = Counter()
        for k, item, question, answer in zip(f["shard"], f["id"], f["question"], f["answer"]):
            for _, piece, _ in pieces_of(*split_item(item, question, answer)):
                count.update((k, t) for t in {*piece, None})
                words[k, None] += len(piece)
        yield pd.DataFrame([(k, t, c, words[k, t]) for (k, t), c in count.items()], columns=["shard", "term", "pieces", "words"])


def shards(items: DataFrame, item_id: str = "item_id", question: str = "text", answer: str | None = None):
    """Indexes of the benchmark's items, each of bounded size."""
    rows = items.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(question), F.lit("")).alias("question"),
                        (F.coalesce(F.col(answer), F.lit("")) if answer else F.lit(None).cast("string")).alias("answer"))
    size = rows.agg(F.sum(F.length("question") + F.coalesce(F.length("answer"), F.lit(0)))).first()[0] or 0
    n = -(-size // SHARD_BYTES)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "question"), F.lit(max(1, n))))
    if n > 1:
        terms = cut_lineage(rows.mapInPandas(_terms, "shard long, term string, pieces long, words long"))
        whole = terms.filter("term IS NULL").agg(F.sum("pieces"), F.sum("words")).first()
        per_term = terms.filter("term IS NOT NULL").groupBy("term").agg(F.sum("pieces").alias("pieces"))
    for k in range(n):
        part = rows.filter(F.col("shard") == k).collect()  # about SHARD_BYTES
        cut = [split_item(r.id, r.question, r.answer) for r in part]
        total = None
        if n > 1:
            own = terms.filter((F.col("shard") == k) & F.col("term").isNotNull()).select("term").distinct()
            total = Counter({r.term: r.pieces for r in own.join(per_term, "term").collect()}), whole[0], whole[1] / max(1, whole[0] or 0)
        yield Index(sorted((x for x in cut if words_of(x[1] + " " + x[2])), key=lambda x: (x[0] or "", x[1])), total)


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "leaks", item_id: str = "item_id",
               question: str = "text", answer: str | None = None) -> DataFrame:
    """``docs`` with an array of the items that leak into the text."""
    found = F.array().cast(HITS)
    for index in shards(items, item_id, question, answer):
        found = F.concat(found, _leaks_by(docs.sparkSession.sparkContext.broadcast(index))(F.col(text)))
    return docs.withColumn(out, found)


def _leaks_by(index: Broadcast):
    @F.pandas_udf(HITS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([index.value.leaks(t) for t in texts], dtype=object)
    return run
