"""Classifiers, language models, secrets and leaks against brute force, round trips and held-out accuracy."""

import base64
import gzip
import hashlib
import os
import re
import urllib.parse
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import decontam, langid, linear, lm, quality, secret_scan
from pricelens.llm.common import encode, word_hashes

SF = "/root/testdata/sf0.01"


def test_word_hashes_tell_words_apart():
    texts = encode(["One two\tTWO", "", None, "été one\n", "  x  ", "a" * 5000 + " one"])
    words, bounds = word_hashes(texts)
    plain = [t.lower().split() for t in texts]
    assert list(np.diff(bounds)) == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(dict(zip(flat, words.tolist()))) == len(set(flat)) == len(set(words.tolist()))
    assert dict(zip(flat, words.tolist())) == dict(zip(reversed(flat), reversed(words.tolist())))


# --- quality and language

def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score(docs.withColumn("score", F.lit("clash")), labels)
    assert set(got.columns) == {*docs.columns, "held_out", "score", "predicted"}
    rows = got.join(labels, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "some text"), (4, "x " * 50_000), (4, "x " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert {r.predicted for r in quality.score(docs, one).collect()} == {1}
    assert quality.score(docs.limit(0), none).collect() == []
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, quality int")
    assert quality.score(docs, both).count() == 5


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predict(docs).filter("held_out").select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(30)] + [(100 + i, "der hund und die katze " * 3, "de") for i in range(30)]
    rows += [(200 + i, "qux zyx " * 4, "qq") for i in range(30)]  # a family of its own
    rows += [(300, None, "en"), (301, "", "en"), (302, "123 !?", None), (None, "the dog", None), (303, "the cat " * 40_000, None), (303, "the cat " * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    got = langid.predict(df).select("doc_id", "lang", "lang_pred", "score").collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 300)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (300, 301, 302))
    assert {r.lang_pred for r in langid.predict(df.filter("lang is null")).collect()} == {"und"}
    assert langid.predict(df.limit(0)).collect() == []


def test_many_languages_make_a_model_that_grows_with_them():
    import pickle
    rng = np.random.default_rng(3)
    sizes = {}
    for n in (10, 40):
        langs = [f"x{i}" for i in range(n)]
        letters = {x: [chr(0x61 + int(c)) for c in rng.integers(0, 26, 6)] for x in langs}
        made = lambda x: " ".join("".join(rng.choice(letters[x], 5)) for _ in range(30))  # noqa: B023, E731
        texts = [(made(x), x) for x in langs for _ in range(8)]
        model = langid.Model(list(linear.features(langid.prepared([t for t, _ in texts]), words=False)), [x for _, x in texts])
        asked = [(made(x), x) for x in langs for _ in range(3)]
        got = [langid.Model.predict(model, ids) for ids in linear.features(langid.prepared([t for t, _ in asked]), words=False)]
        assert np.mean([g[0] == x for g, (_, x) in zip(got, asked)]) > 0.9 and all(0 <= g[1] <= 1 for g in got)
        packed = pickle.dumps(model)
        again = pickle.loads(packed)
        ids = next(linear.features(langid.prepared([asked[0][0]]), words=False))
        assert again.predict(ids) == model.predict(ids)
        sizes[n] = len(packed) / n
    assert sizes[40] < 4.5 * sizes[10] and sizes[40] < 1 << 20  # each machine holds the features of the sample, no pair of languages is one


def test_hinge_solution_is_near_the_optimum():
    """The dual solution's primal value against the dual's: the gap is small, so the weights are the hinge loss's."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 300, 30) + (60 if i % 2 else 0)).astype(np.int32) for i in range(120)]
    y = np.arange(120) % 2 == 1
    svm = linear.fit_svm(rows, y, np.ones(linear.DIMS), rounds=400)
    sign = np.where(y, 1.0, -1.0)
    x = np.zeros((120, 401))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(len(r))
    x[:, 400] = 1
    value = lambda w: 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum()
    ours = value(np.append(svm.weight[:400], svm.bias))
    w, best = np.zeros(401), np.inf
    for t in range(1, 20_001):  # plain subgradient descent
        w -= (w - ((sign * (x @ w) < 1) * sign) @ x) / t
        if t % 100 == 0:
            best = min(best, value(w))
    assert ours <= best * 1.01


def test_sample_is_bounded_and_repeatable(spark):
    ids = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("label"))
    a, b = (sorted(map(tuple, linear.class_sample(ids.repartition(n), 60).collect())) for n in (2, 7))
    assert a == b
    assert [sum(r[1] == k for r in a) for k in ("rare", "common")] == [50, 60]


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 500, 40) + (500 if i % 2 else 0)).astype(np.int32) for i in range(200)]
    y = np.arange(200) % 2 == 1
    svm = linear.fit_svm(rows, y, linear.log_count_ratio(rows, y))
    assert all((svm.margin(r) > 0) == k for r, k in zip(rows, y))


# --- language model

def brute_lm(rows):
    """Base score, counts and the mixture with the operator's own weights held to one."""
    import binascii
    part = lambda i, n: binascii.crc32(str(i).encode()) % n if i is not None else -1
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for _, t in rows]
    train = [part(i, 10) != 0 for i, _ in rows]
    count = {}
    for t, k in zip(toks, train):
        for w in t if k else []:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    return [(i, not k, len(t), sum(w in count for w in t), n, sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t))
            for (i, _), t, k in zip(rows, toks, train)]


LM_ROWS = [(i, " ".join(["The", "cat", "sat", "ON", "the", "mat", "dog", "Été"][(i * k) % 8] for k in range(i % 23))) for i in range(120)]
LM_ROWS += [(500, None), (501, ""), (None, "the cat"), (7, LM_ROWS[7][1]), (502, "never seen words here"), (503, "the " * 100_000)]


@pytest.mark.parametrize("block", [2000, 1 << 22])
def test_base_score_and_counts(spark, block):
    df = spark.createDataFrame(LM_ROWS, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in lm.score(df, block_bytes=block).collect()), key=str)
    want = sorted(brute_lm(LM_ROWS), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_model_score_does_not_depend_on_buckets_and_sums_to_one(spark, monkeypatch):
    weights = np.tile([0.5, 0.3, 0.2], (lm.LEVELS, 1))
    weights[0] = [0, 0.6, 0.4]
    monkeypatch.setattr(lm, "learn_weights", lambda events, vocabulary: weights)
    df = spark.createDataFrame(LM_ROWS, "doc_id long, text string")
    a, b = (sorted(((r.doc_id, r.n_tokens, round(r.score, 6)) for r in lm.score(df, block_bytes=n).collect()), key=str) for n in (3000, 1 << 22))
    assert a == b
    # the words after "the", the end and an unknown word share one probability mass
    import binascii
    kept = [(i, t) for i, t in LM_ROWS if i is None or binascii.crc32(str(i).encode()) % 10]
    toks = [[*(t or "").lower().split(), None] for _, t in kept]
    ones, twos = {}, {}
    for t in toks:
        for p, w in zip([None, *t], t):
            ones[w] = ones.get(w, 0) + 1
            twos[p, w] = twos.get((p, w), 0) + 1
    n, v = sum(ones.values()), len(ones)
    prob = lambda p, w: 0.5 * twos.get((p, w), 0) / ones[p] + 0.3 * ones.get(w, 0) / n + 0.2 / (v + 1)
    assert abs(sum(prob("the", w) for w in ones) + prob("the", "unseen") - 1) < 1e-9
    want = sum(np.log10(prob(p, w)) for p, w in zip([None, "the", "cat"], ["the", "cat", None]))
    got = next(r.score for r in lm.score(df).collect() if r.doc_id is None)
    assert abs(got - want) < 1e-6


def test_learned_scores_do_not_depend_on_blocks(spark):
    """The mixture is learned on the whole held-out fold against the rest, whatever the blocks; scores follow a plain computation."""
    import binascii
    import pandas as pd
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 40) % 50)) for i in range(400)] + [(9, "w1 w2 w3")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    a, b = (sorted((r.doc_id, r.n_tokens, r.base_score, r.score) for r in lm.score(df, block_bytes=n).collect()) for n in (3000, 1 << 22))
    assert len(a) == len(rows) and np.allclose(a, b, rtol=1e-9)
    part = {i: binascii.crc32(str(i).encode()) % 10 for i, _ in rows}
    toks = [(part[i], [*t.split(), None]) for i, t in rows]

    def counts(want):
        one, two = {}, {}
        for k, t in toks:
            for p, w in zip([None, *t], t) if want(k) else ():
                one[w] = one.get(w, 0) + 1
                two[p, w] = two.get((p, w), 0) + 1
        return one, two, sum(one.values())

    one, two, n = counts(lambda k: k not in (0, lm.HELD_OUT_FOLD))
    events = []
    for pair, times in counts(lambda k: k == lm.HELD_OUT_FOLD)[1].items():
        c, w = one.get(pair[0], 0), one.get(pair[1], 0)
        ps = [two.get(pair, 0) / max(c, 1), w / n]
        bins = [int(np.clip(1 - 2 * np.log2(p), 1, lm.BINS - 1)) if p else 0 for p in ps]
        events.append((int(lm._level(np.array([c]))[0]), *bins, *[np.log(p) * times if p else 0.0 for p in ps], times))
    events = pd.DataFrame(events, columns=["level", "bin_two", "bin_one", "log_two", "log_one", "n"]).groupby(["level", "bin_two", "bin_one"], as_index=False).sum()
    one, two, n = counts(lambda k: k != 0)
    weights = lm.learn_weights(events, len(one))
    for (i, text), got in zip(sorted(rows), a):
        total = 0
        for p, w in zip([None, *text.split()], [*text.split(), None]):
            c = one.get(p, 0)
            mix = weights[int(lm._level(np.array([c]))[0])]
            total += np.log10(mix @ [two.get((p, w), 0) / max(c, 1), one.get(w, 0) / n, 1 / (len(one) + 1)])
        if [t for j, t in rows if j == i] == [text]:
            assert got[3] == pytest.approx(total, rel=1e-9)


def test_equal_rows_are_sent_once(spark, monkeypatch):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pylist([{"block": 1, "doc_id": d, "text": t, "train": True} for d, t in [("1", b"a"), (None, b"a"), ("1", b"a"), (None, b"a"), ("1", b"b")]])
    import pandas as pd
    sent = [lm.unpack_rows(pd.DataFrame({"rows": r.column("rows").to_pylist()})).to_pylist() for r in lm._packed(iter([batch]))]
    assert sorted((str(x["doc_id"]), x["text"], x["times"]) for p in sent for x in p) == [("1", b"a", 2), ("1", b"b", 1), ("None", b"a", 2)]
    monkeypatch.setattr(lm, "SOME", 7)
    df = spark.createDataFrame([(5, "x y")] * 100 + [(6, "z")], "doc_id long, text string")
    got = lm.score(df).collect()
    assert len(got) == 101 and len(set(got)) == 2 and got[0].train_tokens in (300, 302)


def test_weights_are_learned_by_expectation_maximisation():
    import pandas as pd
    events = pd.DataFrame({"level": [3, 3], "bin_two": [5, 0], "bin_one": [9, 9], "n": [90, 10]})
    events["log_two"] = np.log(0.5) * events["n"] * (events["bin_two"] > 0)
    events["log_one"] = np.log(0.01) * events["n"]
    w = lm.learn_weights(events, 1000)
    assert np.allclose(w.sum(axis=1), 1) and w[0, 0] == 0
    # unseen bigrams are a tenth of the tokens: so is the weight of the other components
    assert 0.85 < w[3, 0] < 0.93 and w[3, 1] > w[3, 2]


def test_language_model_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(empty).collect() == []
    held = spark.createDataFrame([(i, "a b") for i in range(3000)], "doc_id long, text string").filter("crc32(cast(doc_id as string)) % 10 = 0")
    rows = lm.score(held).collect()
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-12 and abs(r.score) < 1e-12 for r in rows)


def test_packing_round_trip():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (lm.unpack(lm.pack(x, True), True) == x).all() and (lm.unpack(lm.pack(x[::-1])) == x[::-1]).all()


# --- secrets

def brute_base(text):
    kinds = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
             "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    fits = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    return sorted((m.start(), list(kinds).index(k), k, m.end()) for k, p in kinds.items() for m in re.finditer(p, text, re.A) if fits[k](m))


SECRETS = ["password=hunter2secret99", "AKIA" + "Q" * 16, "f" * 40, "PassWord: 'abcdefgh'", "token: secret: abcdefgh", "api_key=short",
           "paſſword=abcdefghij", "toKen=abcdefgh1234"]


@pytest.mark.parametrize("text", [" ".join(SECRETS), "\U0001f600 " + SECRETS[0], SECRETS[4], *SECRETS, ""])
def test_base_spans(text):
    got = [(s, k, e) for k, s, e, base in secret_scan.scan(text) if base]
    assert got == [(s, k, e) for s, k, _, e in brute_base(text)]


@pytest.mark.parametrize("wrap", [
    urllib.parse.quote, lambda t: urllib.parse.quote(urllib.parse.quote(t)), lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    lambda t: base64.b64encode(t.encode()).decode(), lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
    lambda t: base64.urlsafe_b64encode(zlib.compress(base64.b64encode(t.encode()))).decode(),
    lambda t: base64.b64encode(urllib.parse.quote(base64.b64encode(t.encode()).decode()).encode()).decode(),
    lambda t: base64.b64encode(zlib.compress(gzip.compress(t.encode()))).decode()])
def test_hidden_secrets_are_found_where_they_came_from(wrap):
    secret = "say password=hunter2secret99 now"
    text = f"before é {wrap(secret)} after {wrap(secret)}"
    spans = [(s, e) for k, s, e, base in secret_scan.scan(text) if k == 0 and not base]
    assert len(spans) == 2
    for s, e in spans:
        assert 9 <= s < e <= len(text) and text[s:e] in wrap(secret)
    assert "hunter2" not in secret_scan.redact(text, spans, "#") and secret_scan.redact(text, spans, "#").count("#") == 2


def packed_text():
    return zlib.compress("say password=hunter2secret99 now, für alle".encode())


@pytest.mark.parametrize("hide", [
    lambda: base64.b64encode(zlib.compress(gzip.compress(packed_text()))).decode(),
    lambda: base64.b64encode(zlib.compress(gzip.compress(zlib.compress(packed_text())))).decode(),
    lambda: urllib.parse.quote(packed_text()), lambda: "".join(f"%{c:02x}" for c in gzip.compress(packed_text())),
    lambda: "".join(f"\\u{c:04x}" for c in packed_text()), lambda: "".join(f"\\x{c:02x}" for c in packed_text()),
    lambda: base64.b64encode(b"password=hunter2secret99 \xff").decode(), lambda: base64.b64encode("f\xfcr password=hunter2secret99".encode("latin-1")).decode(),
    lambda: base64.b64encode("password=hunter2secret99".encode("utf-16")).decode(), lambda: base64.b64encode("password=hunter2secret99".encode("utf-16-be")).decode(),
    *[lambda n=n: "w" * n + "/" + base64.b64encode(b"password=hunter2secret99").decode() for n in range(1, 5)],
    lambda: "keys_" + base64.urlsafe_b64encode(packed_text()).decode(),
    lambda: base64.encodebytes(b"some words before that fill up the line " * 3 + b"password=hunter2secret99").decode() + "--- (end)",
    lambda: base64.b64encode(packed_text()[:-1] + b"\0").decode()])
def test_deeper_and_broken_layers(hide):
    text = f"before {hide()} after"
    spans = [(s, e) for k, s, e, base in secret_scan.scan(text) if k == 0 and not base]
    assert spans and all(7 <= s < e <= len(text) - 6 for s, e in spans)
    left = secret_scan.redact(text, spans, "#")
    assert not [x for x in secret_scan.scan(left) if x[0] == 0]


def test_cycles_and_junk_end():
    for text in ["%25" * 2000, "%2525252525", "\\u005cu0041", "A" * 10_000, base64.b64encode(zlib.compress(b"x" * 100_000)).decode(), "%ff%fe%00", "\\ud800 %"]:
        secret_scan.scan(text)


def test_big_packed_data_is_scanned_whole(monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE", 1 << 12)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1 << 6)
    data = "".join(f"line {i} é\n" for i in range(3000)) + "password=hunter2secret99"
    assert [k for k, *_ in secret_scan.scan(base64.b64encode(gzip.compress(data.encode())).decode())] == [0]


@pytest.mark.parametrize("wrap", [
    lambda c: "%" + "25" * 20_000 + f"{ord(c):02x}", lambda c: "\\" + "u005c" * 8_000 + f"u{ord(c):04x}", lambda c: "\\" + "x5C" * 8_000 + f"x{ord(c):02x}",
    lambda c: "%" + "25" * 2 + f"{ord(c):02x}", lambda c: "\\u005cu" + f"{ord(c):04x}"])
def test_escapes_of_escapes_are_undone_in_one_step(wrap):
    import time
    text = "xx " + wrap("p") + "assword=hunter2secret99 yy"
    started = time.perf_counter()
    spans = [(s, e) for k, s, e, base in secret_scan.scan(text) if k == 0]
    assert spans == [(3, len(text) - 3)] and time.perf_counter() - started < 1


def test_unpacked_data_are_held_a_piece_at_a_time():
    """A text that unpacks to a gigabyte, scanned in a process of its own: the secret is found, in bounded memory."""
    import subprocess
    import sys
    code = """
import base64, resource, zlib
from pricelens.llm import secret_scan
pack, parts = zlib.compressobj(9), []
for i in range(1024):
    parts.append(pack.compress(b"%41 nothing here\\n" * 65536))
parts += [pack.compress(b"password=hunter2secret99"), pack.flush()]
text = base64.b64encode(b"".join(parts)).decode()
assert len(text) < 10_000_000
assert (0, 0, len(text), False) in secret_scan.scan(text)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=900, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) < 500


def test_secret_queries_columns(spark):
    rows = [(1, None), (2, ""), (3, SECRETS[0]), (3, SECRETS[0]), (None, "x" * 300_000 + " " + "a" * 32)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = secret_scan.find_secrets(df).select("doc_id", secret_scan.digest(F.col("spans")).alias("d")).collect()
    assert sorted((str(r.doc_id), r.d) for r in got) == sorted([("1", ""), ("2", ""), ("3", "assign:0:24"), ("3", "assign:0:24"), ("None", "hex:300001:300033")])
    masked = [r.text for r in secret_scan.mask_secrets(df).collect()]
    assert masked[:4] == [None, "", "[secret]", "[secret]"]
    assert secret_scan.find_secrets(df.limit(0)).collect() == []


def test_op6_digest_of_base(spark):
    from pricelens.llm.queries import LLM
    for r in LLM["op6_secret_scan"].run(spark, SF).filter("n_assign + n_access + n_hex > 0").limit(50).collect():
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() or r.spans.count(",") + 1 > r.n_assign + r.n_access + r.n_hex


# --- benchmark leaks

def test_question_and_answer_are_verified_apart(spark):
    question = " ".join(f"q{i}" for i in range(50)) + "?"
    items = spark.createDataFrame([(1, question, "the answer is forty two of them")], "item_id long, q string, a string")
    texts = [f"{question} the answer is forty two of them", f"{question} something else stands here as the reply", "the answer is forty two of them",
             f"so: {question} the answer is forty two of them. and more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.question_overlap, x.answer_overlap) for x in r.leaks] for r in decontam.find_leaks(docs, items, question="q", answer="a").collect()}
    assert got == {0: [(1.0, 1.0)], 1: [], 2: [], 3: [(1.0, 1.0)]}


def test_leaks_match_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, int(x.item_id)) for r in decontam.find_leaks(docs, items).collect() for x in r.leaks}
    kept = [(r.item_id, decontam.shingles(decontam.words_of(r.text))) for r in items.collect()]
    want = set()
    for r in docs.collect():
        own = set(decontam.shingles(decontam.words_of(r.text)))
        want |= {(r.doc_id, i) for i, s in kept if sum(x in own for x in s) >= 0.8 * len(s)}
    assert got == want and want


def test_leak_edges(spark):
    item = "What is the capital of the far and foggy northern land of rivers? It is the old town by the sea."
    long_item = " ".join(f"w{i}" for i in range(300))
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "two words"), (6, long_item)], "item_id long, text string")
    texts = [None, "", "nothing of it", f"x y z {item.upper()} more", "filler " * 1000 + item, item.replace("capital", "centre"), "two words", long_item, long_item[:900]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").withColumn("leaks", F.lit("clash"))
    got = sorted((r.doc_id, sorted(x.item_id for x in r.leaks)) for r in decontam.find_leaks(docs, items).collect())
    assert got == [(0, []), (1, []), (2, []), (3, ["1", "2"]), (3, ["1", "2"]), (4, ["1", "2"]), (5, got[6][1]), (6, ["5"]), (7, ["6"]), (8, ["6"])]
    assert all(not r.leaks for r in decontam.find_leaks(docs, items.limit(0)).collect())
    assert decontam.find_leaks(docs.limit(0), items).collect() == []


def test_shards_find_the_same(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    find = lambda: {(r.doc_id, x.item_id) for r in decontam.find_leaks(docs, items).collect() for x in r.leaks}
    whole = find()
    monkeypatch.setattr(decontam, "SHARD_BYTES", 2000)
    assert find() == whole


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    # items without their last word: scores below 1, which tell the weights of terms apart
    texts = [(i, " ".join(r.text.split()[:-1])) for i, r in enumerate(items.orderBy("item_id").collect())]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    find = lambda: {(r.doc_id, x.item_id): x.score for r in decontam.find_leaks(docs, items).collect() for x in r.leaks}
    whole = find()
    monkeypatch.setattr(decontam, "SHARD_BYTES", 2000)
    parts = find()
    assert parts.keys() == whole.keys() and any(x < 1 for x in whole.values())
    assert all(abs(parts[k] - x) < 1e-9 for k, x in whole.items())


def test_skipping_opens_every_block_that_reaches_the_threshold():
    rng = np.random.default_rng(3)
    vocabulary = [f"t{i}" for i in range(80)]
    items = [(str(i), " ".join(rng.choice(vocabulary, 30)), "") for i in range(50)]
    index = decontam.Index(items)
    for _ in range(40):
        words = list(rng.choice(vocabulary, 300))
        terms = np.array([index.term.get(w, -1) for w in words])
        opened = set(index.opened(terms))
        for passage in range(max(1, -(-len(words) // decontam.STEP) - 1)):
            own = set(terms[passage * decontam.STEP:(passage + 2) * decontam.STEP])
            for p, impact in enumerate(index.impact):
                if sum(x for t, x in impact.items() if t in own) >= decontam.THRESHOLD:
                    assert (passage, p // decontam.BLOCK) in opened
