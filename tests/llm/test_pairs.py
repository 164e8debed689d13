"""SimHash groups, nearest neighbours and connected components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pricelens.llm import ann, components, simhash

DOCS = "doc_id long, text string, lang string"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, fps, radius=2):
    group = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and group[i] != group[j]:
                    low, high = sorted((group[i], group[j]))
                    group = [low if g == high else g for g in group]
                    changed = True
    return [min((ids[j] for j in range(len(ids)) if group[j] == group[i]), default=None) for i in range(len(ids))]


def test_fingerprint_is_the_stated_one():
    for text in [None, "", "  \n\t", "One", "one TWO", "Ä ä É e", "a b c d " * 50, "x y z w v", "\x1cq r s t"]:
        assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)
    long = " ".join(str(i % 977) for i in range(simhash.PIECE * 2 + 5))  # several pieces
    assert simhash.fingerprint(long) % (1 << 64) == brute_fingerprint(long)


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(list("abcdefghij"), 60)) for _ in range(12)]
    texts = [None, "", " ", "one", "One", *base, *base, *[b + " tail" for b in base], *[b.upper() for b in base[:3]]]
    rows = [(int(i) * 3 % 101, t, "en") for i, t in enumerate(texts)]
    rows += rows[:2] + rows[7:9]  # repeated rows
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], brute_groups([r[0] for r in rows], fps), strict=True))
    assert sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("block", [3, 4096])
def test_tiles_find_all_links_even_if_cut_into_small_blocks(spark, block):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    fps = {int(s) for s in seeds} | {int(s ^ (1 << int(a)) ^ (1 << int(b))) for s in seeds for a, b in rng.integers(0, 63, (12, 2))}
    fps |= {0, 1, 3, 7, -1}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    got = {r.doc_id: r.component_id for r in simhash.cluster(spark.createDataFrame(rows, "doc_id long, fp long"), block=block).collect()}
    want = brute_groups([i for i, _ in rows], [f % (1 << 64) for _, f in rows])
    assert [got[i] for i, _ in rows] == want


def test_links_of_a_crowded_group_are_a_forest():
    near = np.unique(np.array([(1 << a) | (1 << b) for a in range(40) for b in range(40)], np.uint64))
    u, v = simhash._forest(near, near, 2, True)
    assert len(u) == len(near) - 1 == len(set(u)) and len(set(v)) == 1  # all hang together
    u, v = simhash._forest(near[:400], near[400:], 2, False)
    assert len(u) == len(set(u)) < len(near)


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_null_ids_are_documents(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (None, "quite other words than those")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(None, 5), (5, 5), (None, None)], key=str)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100)}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_nearest(rows, every, k):
    ok = {}
    for i, v, _ in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = []
    for q in sorted(i for i in ok if i % every == 0):
        scores = {j: max((float((a * b).sum()) for a in ok[q] for b in vs if len(a) == len(b)), default=None) for j, vs in ok.items() if j != q}
        best = sorted(((-s, j) for j, s in scores.items() if s is not None))[:k]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return out


def vectors(n, dim, seed):
    x = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    return [(i, [float(v) for v in x[i]], 1) for i in range(n)]


def test_nearest_with_ties_nulls_and_repeats(spark):
    rows = vectors(60, 8, 3)
    rows += [(1000 + i, rows[4][1], 2) for i in range(30)]  # ties
    rows += [(2000, None, 0), (2020, [], 0), (2040, [0.0] * 8, 0), (2060, [float("nan")] + [1.0] * 7, 0), (2080, [None] + [1.0] * 7, 0),
             (2100, [float("inf")] + [1.0] * 7, 0), (None, rows[0][1], 0), (3000, [1.0, 2.0], 0), (3001, [2.0, 1.0], 0)]
    rows += rows[:20]  # repeated rows
    df = spark.createDataFrame(rows, VECTORS).withColumn("dim", F.lit("clash")).repartition(4)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, width=8.0, block=16)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = sorted(tuple(r) for r in got.collect())
    want = brute_nearest(rows, 20, ann.NEIGHBOURS)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def test_recall_with_production_width(spark):
    rows = vectors(3000, 64, 4)
    got = ann.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, block=512).collect()
    want = {w[0:1] + w[2:3] for w in brute_nearest(rows, 20, 20)}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) / len(want) >= 0.95
    assert len(got) == len(want)


def test_error_bounds_hold_and_choose():
    x = np.random.default_rng(5).standard_normal((4000, 64))
    bits, length, agree = ann.encode(x)
    best, exact = ann.search(x[:20], np.arange(20), x, np.arange(4000), bits, length, agree, 20)
    assert exact < 0.5 * 20 * 4000
    assert bits.shape == (4000, 8) and np.allclose(length, np.linalg.norm(x, axis=1))


def test_groups_of_equal_vectors_fill_the_answer():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((8, 64)), 250, axis=0)[rng.permutation(2000)]
    queries = rng.standard_normal((1000, 64))
    best, _ = ann.search(queries, np.arange(10_000, 11_000), x, np.arange(2000), *ann.encode(x), 20)
    assert (np.bincount(best.query, minlength=1000) == 20).all()
    true = queries @ x.T
    assert np.allclose(best.score, true[best.query, best.id])
    kth = np.sort(true, axis=1)[:, -20]
    assert (best.score >= kth[best.query] - 1e-9).mean() > 0.95


def test_nothing_to_search(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert ann.nearest(empty, F.col("vec_id") % 20 == 0).collect() == []
    one = spark.createDataFrame([(1, [1.0], 0), (3, [2.0], 0)], VECTORS)
    assert ann.nearest(one, F.col("vec_id") % 20 == 0).collect() == []


def test_recall_of_fifty_thousand_rows():
    """Recall of a cell-wise search at the production width, against exact products of all rows."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((50_000, 64)) * rng.uniform(0.5, 2, (50_000, 1)) + 0.1
    ids, asks = np.arange(len(x)), np.arange(0, len(x), 500)
    found = {int(i): [] for i in asks}
    for a in range(0, len(x), ann.BLOCK):
        part = slice(a, a + ann.BLOCK)
        best, _ = ann.search(x[asks], asks, x[part], ids[part], *ann.encode(x[part]), 20)
        for q, s, i in zip(best.query, best.score, best.id):
            found[int(asks[q])].append((-s, int(i)))
    hit = 0
    for i in asks:
        score = x @ x[i]
        score[i] = -np.inf
        want = set(np.argsort(-score)[:20].tolist())
        hit += len(want & {j for _, j in sorted(found[int(i)])[:20]})
    assert hit / (20 * len(asks)) >= 0.95


def test_the_best_rows_are_met_first():
    """Rows in rising order of their scores: the floor is high before the rows below it are met."""
    rng = np.random.default_rng(8)
    x, query = rng.standard_normal((8000, 64)), rng.standard_normal((1, 64))
    x = x[np.argsort(x @ query[0])]
    best, exact = ann.search(query, np.array([-1]), x, np.arange(8000), *ann.encode(x), 20)
    assert set(best.id) == set(range(7980, 8000)) and exact < 0.75 * len(x)
