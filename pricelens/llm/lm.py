"""Language-model scoring by deleted interpolation.

The model mixes the bigram and unigram maximum-likelihood estimates and the uniform distribution, with
weights for each bucket of the context's frequency. The weights are learned by expectation-maximisation on held-out
counts: those of one fold of the training documents, against all counts less the fold's (deleted).

Documents are dealt into blocks by hash; equal rows are sent once per batch of their task, with their number. A block counts its distinct n-grams and sends them, sorted and packed,
to buckets by hash range; a bucket adds up the counts of all blocks and sends back to each block the totals of
the n-grams it asked for, in the same order. Then a block scores its texts by itself. So an n-gram moves once per
block that has it, however frequent it is, no count table is broadcast, and no task holds more than one
block or bucket. Only the corpus totals and the weights (a row per bucket of frequency) pass the driver.

Defined cases: a null or empty text is its end token alone; with a null doc_id a document is in the training
part; repeated rows are counted and scored each; without training documents the model is uniform and the base score 0;
an empty table gives an empty result. Only the named columns are read. Very long texts stay whole: a text
larger than a block is a block's only one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import chunks, fold, mix64, word_hashes
from pricelens.session import cut_lineage

FOLDS = 10
TEST_FOLD = 0        # not learned from
HELD_OUT_FOLD = 1    # of the training documents: the mixture weights are learned on it
BLOCK_BYTES = 8 << 20  # of text
LEVELS = 41          # buckets of context frequency: never seen, then by powers of two
BINS = 64            # per axis, of the estimates' logarithms on which the weights are learned
ROUNDS = 50
FLOOR = 1e-4         # least weight of a component
SHARE = 2            # blocks for each bucket: a block's distinct n-grams are fewer than its tokens
SOME = 4096          # equal rows that are made of one at a time
END = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0xD1342543DE82EF95)

_PIECES = "block int, bucket int, n int, items binary, counts binary"
_TOTALS = "block int, bucket int, n int, totals binary, rest binary"
_SCORES = "doc_id string, times long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def pack(numbers: np.ndarray, rising: bool = False) -> bytes:
    """Compressed bytes of unsigned numbers; rising ones as differences."""
    x = np.ascontiguousarray(numbers, dtype=np.uint64)
    x = np.diff(x, prepend=np.uint64(0)) if rising else x
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    x = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if rising else x


def pack_rows(blocks: pa.Array, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of each block as one compressed value."""
    number = blocks.to_numpy(zero_copy_only=False)
    order = np.argsort(number, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
        if len(part):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_batch(rows.take(pa.array(part)))
            yield pa.record_batch({"block": pa.array([number[part[0]]], pa.int32()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:  # equal rows once, with their number
            rows = pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([([], "count_all")])
            rows = rows.rename_columns([*batch.schema.names, "times"]).combine_chunks().to_batches()[0]
            yield from pack_rows(rows.column("block"), rows.drop_columns(["block"]))


def unpack_rows(f: pd.DataFrame) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in f["rows"])


@dataclass
class Grams:
    """Distinct n-grams of a block in order."""
    items: np.ndarray
    first: np.ndarray    # a token with the n-gram
    which: np.ndarray    # for each token, its n-gram
    trained: np.ndarray  # count in training documents


class Block:
    def __init__(self, rows: pa.Table):
        train, times = rows["train"].to_numpy(), rows["times"].to_numpy()
        tokens, self.sizes = self._tokens(rows["text"].to_pylist())
        self.starts = np.cumsum(self.sizes) - self.sizes
        learn = np.repeat(np.where(train, times, 0), self.sizes)
        before = np.roll(tokens, 1)
        before[self.starts] = END  # a text begins after an end
        two = mix64(before * _STEP + tokens)
        del before
        self.grams = {2: self._distinct(two, learn)}
        del two
        one = self.grams[1] = self._distinct(tokens, learn)
        self.context = np.roll(one.which, 1)
        self.context[self.starts] = np.searchsorted(one.items, END)

    @staticmethod
    def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = [t or b"" for t in texts]
        parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in chunks(texts):
            words, bounds = word_hashes(texts[a:b])
            parts.append(np.insert(words, bounds[1:], END))
            sizes.append(np.diff(bounds) + 1)
        return np.concatenate(parts), np.concatenate(sizes)

    @staticmethod
    def _distinct(values: np.ndarray, learn: np.ndarray) -> Grams:
        items, first, which = np.unique(values, return_index=True, return_inverse=True)
        return Grams(items, first.astype(np.int32), which.astype(np.int32), np.bincount(which, learn, len(items)).astype(np.int64))


def _bucket(items: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by hash range: rising with the item."""
    return ((items >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pieces(buckets: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        block, rows = Block(unpack_rows(f)), []
        for n, g in block.grams.items():
            cuts = np.searchsorted(_bucket(g.items, buckets), np.arange(buckets + 1))
            rows += [(f["block"].iloc[0], b, n, pack(g.items[i:j], True), pack(g.trained[i:j]))
                     for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
        return pd.DataFrame(rows, columns=["block", "bucket", "n", "items", "counts"])
    return run


def _add_up(held_out: int):
    """For each block's piece the totals of its n-grams over all blocks, and for the first ``held_out`` blocks, which are the held-out fold, also those
    over the others. Block -1 has the bucket's own sums: tokens, types, tokens outside the fold."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        items = [unpack(x, True) for x in f["items"]]
        counts = np.concatenate([unpack(x) for x in f["counts"]]).astype(np.int64)
        _, which = np.unique(np.concatenate(items), return_inverse=True)
        size = np.array([len(x) for x in items])
        outside = np.repeat(f["block"].to_numpy() >= held_out, size)
        sums = np.bincount(which, weights=counts).astype(np.int64)
        rest = np.bincount(which, counts * outside, len(sums)).astype(np.int64)
        n, bucket = f["n"].iloc[0], f["bucket"].iloc[0]
        rows = [(b, bucket, n, pack(sums[w]), pack(rest[w]) if b < held_out else None)
                for b, w in zip(f["block"], np.split(which, np.cumsum(size)[:-1]), strict=True)]
        own = pack(np.array([counts.sum(), np.count_nonzero(sums), counts[outside].sum()]))
        return pd.DataFrame([*rows, (-1, bucket, n, own, None)], columns=["block", "bucket", "n", "totals", "rest"])
    return run


def _totals(f: pd.DataFrame, column: str = "totals") -> dict[int, np.ndarray]:
    f = f.sort_values(["n", "bucket"])
    return {n: np.concatenate([unpack(x) for x in g[column]]).astype(np.int64) for n, g in f.groupby("n")}


def _level(count: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0 if never seen."""
    return np.frexp(np.maximum(count, 0).astype(float))[1]


def _estimates(two, context, one, tokens: float) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and unigram maximum-likelihood estimates."""
    return two / np.maximum(context, 1), one / max(tokens, 1)


def _events(tokens: int):
    """``tokens``: those outside the fold. Held-out counts: per frequency bucket and bins of the two estimates, how many tokens fall there."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block, rest = Block(unpack_rows(left)), _totals(right, "rest")
        one, two = block.grams[1], block.grams[2]
        context, word = rest[1][block.context[two.first]], rest[1][one.which[two.first]]
        p2, p1 = _estimates(rest[2], context, word, tokens)
        out = pd.DataFrame({"level": _level(context)})
        for k, p in (("two", p2), ("one", p1)):
            with np.errstate(divide="ignore"):
                out[f"log_{k}"] = np.where(p > 0, np.log(p), 0) * two.trained
                out[f"bin_{k}"] = np.where(p > 0, np.clip(1 - 2 * np.log2(p), 1, BINS - 1), 0).astype(int)
        out["n"] = two.trained
        return out[out["n"] > 0].groupby(["level", "bin_two", "bin_one"], as_index=False).sum()
    return run


def learn_weights(events: pd.DataFrame, vocabulary: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per frequency bucket, by expectation-maximisation."""
    weights = np.tile([0.3, 0.6, 0.1], (LEVELS, 1))
    events = events[events["n"] > 0]
    if len(events):
        n, level = events["n"].to_numpy(float), events["level"].to_numpy(int)
        p = [np.where(events[f"bin_{k}"] > 0, np.exp(events[f"log_{k}"] / n), 0) for k in ("two", "one")]
        p = np.stack([*p, np.full(len(n), 1 / (vocabulary + 1))], axis=1)
        for _ in range(ROUNDS):
            share = weights[level] * p
            share *= (n / share.sum(axis=1))[:, None]
            summed = np.stack([np.bincount(level, share[:, k], LEVELS) for k in range(3)], axis=1)
            seen = summed.sum(axis=1) > 0
            weights[seen] = summed[seen] / summed[seen].sum(axis=1, keepdims=True)
            weights = np.maximum(weights, FLOOR)
            weights /= weights.sum(axis=1, keepdims=True)
    weights[0, 0] = 0  # no bigram estimate after a context never seen
    return weights / weights.sum(axis=1, keepdims=True)


def _scores(weights: np.ndarray, tokens: int, vocabulary: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        texts = unpack_rows(left)
        block, total = Block(texts), _totals(right)
        one, two = block.grams[1], block.grams[2]
        base = np.log10((total[1] + 0.1) / (tokens + 0.1 * (vocabulary + 1)))[one.which]
        context, word = total[1][block.context[two.first]], total[1][one.which[two.first]]
        p2, p1 = _estimates(total[2], context, word, tokens)
        mix = weights[_level(context)].copy()
        if not tokens:
            mix[:] = (0, 0, 1)
        model = np.log10(mix[:, 0] * p2 + mix[:, 1] * p1 + mix[:, 2] / (vocabulary + 1))[two.which]
        known = (total[1] > 0)[one.which]
        return pd.DataFrame({"doc_id": texts["doc_id"].to_pandas(), "times": texts["times"].to_numpy(), "held_out": ~texts["train"].to_numpy(), "n_tokens": block.sizes,
                             "n_known": np.add.reduceat(known, block.starts, dtype=np.int64),
                             "base_score": np.add.reduceat(base, block.starts),
                             "score": np.add.reduceat(model, block.starts)})
    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document."""
    part = fold(F.col(doc_id), FOLDS)
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
                       (part != TEST_FOLD).alias("train"), (part == HELD_OUT_FOLD).alias("weighs"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    own = max(1, round(size / FOLDS / block_bytes))       # blocks of the held-out fold, then the others
    blocks = own + max(1, -(-size // block_bytes) - own)
    spread = F.xxhash64("doc_id", "text")
    rows = rows.withColumn("block", F.when(F.col("weighs"), F.pmod(spread, F.lit(own)))
                           .otherwise(F.pmod(spread, F.lit(blocks - own)) + own).cast("int"))
    packed = rows.select("block", "doc_id", "text", "train").mapInArrow(_packed, "block int, rows binary")
    dealt = packed.groupBy("block")
    pieces = dealt.applyInPandas(_pieces(-(-int(blocks) // SHARE)), _PIECES)
    totals = cut_lineage(pieces.groupBy("n", "bucket").applyInPandas(_add_up(own), _TOTALS))
    # a row per bucket of unigrams, which are as many as blocks: added up without a copy on the driver
    sums = totals.filter("block = -1 AND n = 1").select("totals").mapInPandas(
        lambda fs: (pd.DataFrame([unpack(x).astype(np.int64) for x in f["totals"]], columns=["tokens", "types", "rest"]) for f in fs),
        "tokens long, types long, rest long").agg(F.sum("tokens"), F.sum("types"), F.sum("rest")).first()
    tokens, types, rest = (int(x or 0) for x in sums)
    asked = totals.filter("block >= 0").groupBy("block")
    weighing = rows.filter("weighs").select("block", "doc_id", "text", "train").mapInArrow(_packed, "block int, rows binary")
    events = (weighing.groupBy("block").cogroup(totals.filter((F.col("block") >= 0) & (F.col("block") < own)).groupBy("block"))
              .applyInPandas(_events(rest), "level int, bin_two int, bin_one int, log_two double, log_one double, n long"))
    events = events.groupBy("level", "bin_two", "bin_one").agg(*[F.sum(c).alias(c) for c in ("log_two", "log_one", "n")])
    weights = learn_weights(events.toPandas(), types)  # at most LEVELS * BINS * BINS rows
    out = dealt.cogroup(asked).applyInPandas(_scores(weights, tokens, types), _SCORES)
    some = F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / SOME))  # equal rows again, some at a time
    out = out.withColumn("_some", F.explode(some)).withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(SOME).cast("long"), F.col("times") - F.col("_some") * SOME))))
    return out.select(F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "held_out", "n_tokens", "n_known",
                      F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
