"""Periodic runs against brute force, on random, looped and hard texts."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pricelens.llm import queries, runs


def brute_runs(words, min_length=24, min_exponent=3):
    """For each period, the longest stretches that keep it; a period counts if no smaller one has the stretch."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i:
                length = j - i + q
                if length >= max(min_length, min_exponent * q) and (i, length) not in seen:
                    out.append((i, length, q))
                seen.add((i, length))
            i = j + 1
    return sorted(out)


def some_texts(rng, count):
    texts = []
    for _ in range(count):
        letters = rng.choice([1, 2, 3, 30])
        words = [str(rng.randrange(letters)) for _ in range(rng.choice([5, 40, 120]))]
        for _ in range(rng.choice([0, 1, 3])):
            a, p = rng.randrange(len(words)), rng.choice([1, 2, 5, 8, 11])
            loop = [words[a:a + p][i % len(words[a:a + p])] for i in range(rng.choice([20, 30, 60]))]
            words[a:a] = loop
        texts.append(words)
    return texts


@pytest.mark.parametrize("limits", [(24, 3), (1, 3), (10, 4)])
def test_runs_against_brute_force(limits):
    rng = random.Random(3)
    texts = some_texts(rng, 400) + [["a"] * 200, ["a", "b"] * 50, (["a"] * 7 + ["b"]) * 9, [], ["x"], ["a", "a"] * 3]
    fib = ["a", "ab"]
    while len(fib) < 13:
        fib.append(fib[-1] + fib[-2])
    texts.append(list(fib[-1]))
    passage = [f"w{i}" for i in range(40)]
    texts.append([w for i in range(60) for w in [f"before{i % 7}", *passage]])
    got = runs.runs_of([[w.encode() for w in t] for t in texts], *limits)
    assert got == [brute_runs(t, *limits) for t in texts]
    assert sum(map(len, got)) > 100


def test_blocks_do_not_matter():
    rng = random.Random(4)
    texts = [[w.encode() for w in t] for t in some_texts(rng, 50)] * 2
    assert runs.runs_of(texts) == [runs.runs_of([t])[0] for t in texts]


def looped(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_query_rows(spark, tmp_path):
    rng = random.Random(9)
    spaces = [" ", "\n", "\t ", "\x0b", "\x0c\r"]
    docs = [(i, "".join(w + rng.choice(spaces) for w in words)) for i, words in enumerate(some_texts(rng, 300))]
    docs += [(None, "a " * 30), (301, None), (302, ""), (303, " \n"), (304, "é ü " * 40), (304, "é ü " * 40), (-5, "x " * 100_000), (306, "a\x1cb " * 30)]
    path = str(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("runs", F.lit(1)).repartition(3).write.parquet(path + "/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12(spark, path).collect()), key=str)
    want = []
    for doc_id, text in docs:
        words = looped(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        found = [(0, 100_000, 1)] if doc_id == -5 and len(set(words)) == 1 else brute_runs(words)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
        want.append((doc_id, len(found), *best, found and 1000 * best[1] // best[2] or None,
                     digest("".join("%d,%d,%d\n" % r for r in found)), digest(" ".join(kept))))
    assert got == sorted(want, key=str)
    assert sum(len(looped(i, t.split())) > 0 and looped(i, t.split()) != t.split() for i, t in docs if t) > 5


def test_operator_keeps_columns_and_takes_nothing(spark):
    df = spark.createDataFrame([(1, "a " * 30, "kept")], "doc_id long, body string, text string").withColumn("collapsed", F.lit("clash"))
    r = runs.find_runs(df, "body").first()
    assert (r.text, r.collapsed, [tuple(x) for x in r.runs]) == ("kept", "a", [(0, 30, 1)])
    assert runs.find_runs(df.limit(0), "body").collect() == []
    with pytest.raises(ValueError):
        runs.find_runs(df, min_exponent=2)
