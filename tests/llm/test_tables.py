"""URL filter, HTML extraction, source mix and the pipeline against brute force."""

import html as references
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricelens.llm import decontam, html_extract, mixing, secret_scan, url_filter

SF = "/root/testdata/sf0.01"

# --- URL filter

LABELS = "doc_id long, quality int, toxic int"
PAGES = "page_id long, url string"


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(r), r, a) for a, r in url_filter.RULES for h, p in [r.split("/", 1)]
           if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fit)[1:] if fit else None


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x?q=1#z", "https://example.net", "https://example.net?/en/", "x://net/", "x://subnet/",
        "x://a.net/q", "x://example.com/de/1", "x://b.example.com/DE/1", "x://example.org/fr/", "x://org/fr/a", "x://example.net/en/#a://b", "x://É.net/",
        "a://b://c.net/", "x://example.net/en", "x://h\n.net/a\nb"]


def test_stated_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(4, URLS[4])], PAGES).withColumn("host", F.lit("clash"))
    got = url_filter.judge(df, spark.createDataFrame([], LABELS)).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, fit = brute_url(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, fit and fit[0], fit[1] if fit else "allow"), r.url


def test_mined_rules(spark):
    pages = [(i, f"https://{'spam-farm' if i % 3 == 0 else 'good'}.example.info/{'win' if i % 6 == 0 else 'a'}/{i}") for i in range(300)]
    labels = [(i, 0 if i % 3 == 0 else 1, 0) for i in range(300)] + [(3, 1, 1), (None, 0, 0), (9999, 0, 0)]
    df, marks = spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)
    got = url_filter.judge(df, marks).collect()
    assert all((r.verdict == "block") == (r.page_id % 3 == 0) and r.rule is None for r in got)
    joined = df.join(marks, df.page_id == marks.doc_id).select("url", (F.col("quality") == 0).alias("bad"))
    rules = url_filter.mine_rules(joined).collect()
    assert all(r.confidence >= url_filter.MIN_CONFIDENCE for r in rules)
    assert not any(set(a.tokens) < set(b.tokens) and a.confidence >= b.confidence for a in rules for b in rules)
    # each rule's numbers by counting
    rows = joined.select("bad", url_filter.tokens_of(F.col("url")).alias("own")).collect()
    for r in rules:
        has = [x.bad for x in rows if set(r.tokens) <= set(x.own)]
        assert r.support == sum(has) and r.confidence == pytest.approx(sum(has) / len(has))


def brute_rules(rows, share):
    """Every set of tokens that is a rule, and of these the ones that no part of is as sure."""
    from itertools import combinations
    least = max(url_filter.MIN_SUPPORT, url_filter.MIN_ROWS / len(rows)) * len(rows)
    tokens = sorted({t for own, _ in rows for t in own})
    sure = {}
    for r in range(1, 5):
        for c in combinations(tokens, r):
            has = [bad for own, bad in rows if set(c) <= own]
            if sum(has) >= least and sum(has) / len(has) >= url_filter.MIN_CONFIDENCE:
                sure[frozenset(c)] = sum(has) / len(has)
    return {c: v for c, v in sure.items() if not any(sure.get(c - {t}, 0) >= v for t in c)}


def test_rules_equal_those_of_all_sets(spark):
    import random
    rng = random.Random(2)
    urls = []
    for i in range(400):
        path = rng.choice(["win/prize/now", "win/prize/now/x", "news/today", "news/x", "prize/x", "shop"])
        urls.append((f"https://{rng.choice('ab')}.org/{path}", rng.random() < (0.9 if "win" in path else 0.65 if path == "prize/x" else 0.2)))
    df = spark.createDataFrame(urls, "url string, bad boolean")
    rows = [(set(r.own), b) for r, (_, b) in zip(df.select(url_filter.tokens_of(F.col("url")).alias("own")).collect(), urls)]
    want = brute_rules(rows, 0)
    mined = url_filter.mine_rules(df)
    got = {}
    for r in mined.collect():
        from itertools import product
        for c in product(*r.classes):
            got[frozenset(c)] = r.confidence
    assert set(got) == set(want) and all(abs(got[c] - want[c]) < 1e-12 for c in want) and any(len(c) > 1 for r in mined.collect() for c in r.classes)
    asked = [u for u, _ in urls] + ["https://z.org/now", "https://z.org/now/x", "https://a.org/win", "https://z.org/shop"]
    hits = {r.url: r.confidence for r in url_filter.fired(spark.createDataFrame([(u,) for u in asked], "url string"), mined).collect()}
    own = {r.url: set(r.own) for r in spark.createDataFrame([(u,) for u in asked], "url string").select("url", url_filter.tokens_of(F.col("url")).alias("own")).collect()}
    best = {u: max((v for c, v in want.items() if c <= t), default=None) for u, t in own.items()}
    assert {u: hits.get(u) for u in own} == best


def test_urls_of_many_tokens(spark):
    long = "/".join(f"part{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    pages = [(i, f"https://a.org/{long if i % 20 == 0 else 'page'}/{i}") for i in range(2000)]
    labels = [(i, 0 if i % 20 == 0 else 1, 0) for i in range(2000)]
    got = url_filter.judge(spark.createDataFrame(pages, PAGES).withColumn("_url", F.lit("kept")).withColumn("_Confidence", F.lit(1)), spark.createDataFrame(labels, LABELS)).collect()
    assert all((r.verdict == "block") == (r.page_id % 20 == 0) and r._url == "kept" and r._Confidence == 1 for r in got)


def test_url_filter_of_nothing(spark):
    assert url_filter.judge(spark.createDataFrame([], PAGES), spark.createDataFrame([], LABELS)).collect() == []


# --- HTML extraction

def plain_article(html):
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)
    body = re.sub(r"</?b>", "", m[1].replace("<br>", " "))
    blocks = [" ".join(references.unescape(x).split()) for x in re.split(r"<[^>]+>", re.sub(r"<[a-z/!][^<>]*\Z", "", body))]
    return "\n\n".join(b for b in blocks if b)


def test_articles_of_given_pages(spark):
    got = html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len(got) == 250
    assert all(r.text == plain_article(r.html) and r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"),
    ("<nav>x</nav><article><h1>T</h1><p>a <b>b</b><br>c&nbsp;d</p><!-- no --><script>var a='</p>';</script></article><footer>f</footer>", "T\n\na b c d"),
    ("<article><header><h1>T</h1></header><aside>s</aside><form>f<input>g</form><div class='ad'>x</div><p>y</p><section class=comments><p>c</p></section></article>", "y"),
    ("<article><p class='search-result'>a</p><div class='social-history'>b</div><p class=discussion>c</p><p class='form-x'>d</p><div class=adventure>e</div></article>", "a\n\nb\n\nc\n\nd\n\ne"),
    ("<article><div class='left-sidebar'>s</div><div id='ad_top'>x</div><div class='box cookie-banner'>n</div><div class=related>r</div><p>y</p></article>", "y"),
    ("<header>h</header><div id='sidebar'>s</div><main><p>m</p></main><div class='cookie-notice'>n</div>", "m"),
    ("<article><p>one</article><article><p>two", "one\n\ntwo"), ("<article>cut &am", "cut &am"), ("<article>cut <b", "cut"), ("<article>1 < 2 > 0 &lt;b&gt;</article>", "1 < 2 > 0 <b>"),
    ("<article><p title='a>b'>x</p><style>p{}</style><noscript>n</noscript></article>", "x"), ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc d"),
    ("<ARTICLE><P>Up</P></ARTICLE>tail", "Up"), ("<article><script>never closed <p>x</article>", ""), ("<div role=navigation>n</div><p>x</p>", "x"),
    ("<article><p>" + "long " * 200_000 + "</article>", "long " * 199_999 + "long")])
def test_markup(html, text):
    assert html_extract.main_text(html, None) == text


def test_repeated_runs_of_open_pages(spark):
    line = "Read our weekly letter and win a prize in the great lottery of the town"
    pages = [(i, "http://a.org/x", f"<html><body><div>{line}</div><p>unique words {i} of page number {i * 7}</p><div>{line}!</div></body></html>") for i in range(5)]
    pages += [(50, "http://b.org/", f"<div>{line}</div><p>alone</p>"), (51, "http://a.org/y", f"<article><p>{line}</p></article>"), (52, None, None), (0, *pages[0][1:])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for n in (0, html_extract.MAX_CELLS):  # by shuffle, and by broadcast
        html_extract.MAX_CELLS, kept = n, html_extract.MAX_CELLS
        got = html_extract.extract(df).collect()
        html_extract.MAX_CELLS = kept
        assert len(got) == 9
        for r in got:
            i = r.page_id
            want = {50: f"{line}\n\nalone", 51: line, 52: ""}.get(i, f"unique words {i} of page number {i * 7}" + f"\n\n{line}!" * 0)
            assert r.text == want
    assert html_extract.extract(df.limit(0)).collect() == []


def test_suffixes_cover_what_brute_force_finds():
    from pricelens.llm.common import word_hashes
    words = word_hashes([b"a b c d e f g h i j a b c d e f g h z"])[0]
    p = html_extract.prefixes(words)
    same = {(i, j) for i in range(len(p)) for j in range(len(p)) if i < j and p[i] == p[j]}
    assert same == {(0, 10)}


def test_copies_of_an_open_page_keep_their_text(spark):
    line = "Read our weekly letter and win a prize in the great lottery of the town"
    copy = "a page that was put under many names and is still one page and no boilerplate at all"
    pages = [(i, f"http://a.org/{i}", f"<div>{line}</div><p>{copy}</p>") for i in range(6)]
    pages += [(10 + i, f"http://a.org/{10 + i}", f"<div>{line}</div><p>page number {i} {line} {i} with own words</p>") for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**dict.fromkeys(range(6), copy), **{10 + i: f"page number {i} {i} with own words" for i in range(3)}}


def test_repeated_runs_of_articles(spark):
    line = "Read our weekly letter and win a prize in the great lottery of the town"
    some = "three of the ten articles quote these very words of a poem that all know"
    body = [f"<p>own words {i} begin it</p><p>{line}</p>" + (f"<p>{some}</p>" if i < 3 else "") + f"<p>and {i} ends it</p>" for i in range(10)]
    pages = [(i, "http://a.org/x", f"<nav>{line}</nav><article>{b}</article>") for i, b in enumerate(body)]
    pages += [(20 + i, "http://a.org/y", f"<p>{line}</p><p>open {i}</p>") for i in range(2)]  # the menus hold the line too
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {i: f"own words {i} begin it\n\n" + (f"{some}\n\n" if i < 3 else "") + f"and {i} ends it" for i in range(10)}
    assert got == {**want, 20: "open 0", 21: "open 1"}


# --- source mix

def brute_targets(sizes, weights=(1, 2, 3)):
    """Share by weight, cap, and share the excess again until none is above; exact fractions."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, Fraction(sum(sizes.values())), list(order)
    while free:
        whole = sum(weight[s] for s in free)
        share = {s: left * weight[s] / whole for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = Fraction(3 * sizes[s])
            left -= target[s]
            free.remove(s)
    return target


def test_mix_targets_and_copies(spark):
    text = lambda n: " ".join(["w"] * n)
    rows = [(i, text(n), s) for i, (n, s) in enumerate([(900, "big")] * 40 + [(5, "tiny"), (3, "ż"), (7, "Z"), (2, None), (0, "empty"), (1, "\U0001f600"), (1, "\uffee")] + [(30, "mid")] * 50)]
    rows += [(1000, None, "mid"), (1001, "", None), (None, text(4), "mid"), (0, text(900), "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash")).repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        rate = float(want[r.source]) / sizes[r.source] if sizes[r.source] else 0
        assert int(rate + 1e-9) <= r.copies <= int(rate) + 1 and r.copies <= 3 and r.taken == r.copies * r.size
    again = sorted(((r.doc_id, r.copies) for r in mixing.mix(df.repartition(2)).collect()), key=str)
    assert again == sorted(((r.doc_id, r.copies) for r in got), key=str)
    assert mixing.emit(mixing.mix(df)).count() == sum(r.copies for r in got)


def test_mix_comes_near_the_targets(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.03)


@pytest.mark.parametrize("null_id", [True, False])
def test_mix_of_repeated_rows(spark, null_id):
    """Equal rows, and other texts that the draw can't tell apart, are taken to within a document of the target, however they are dealt."""
    one = None if null_id else 5
    rows = [(one, "a b c", "x")] * 700 + [(one, f"{i} b c", "x") for i in range(300)] + [(i, "w " * 300, "y") for i in range(50)] + [(1, "v v", "y"), (1, "v v", "y")]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts).withColumn("_number", F.lit("clash"))
        got = mixing.mix(df.drop("_number")).collect()
        assert len(got) == len(rows)
        mine = [r for r in got if r.source == "x"]
        assert mine[0].target % 3000 != 0 and abs(sum(r.taken for r in mine) - mine[0].target) <= 3
        assert {r.copies for r in mine} <= {int(mine[0].target // 3000), int(mine[0].target // 3000) + 1}
        assert len({r.copies for r in got if r.doc_id == 1 and r.size == 2}) <= 2


def test_mix_of_repeated_rows_equals_sql(spark, tmp_path):
    import duckdb
    from pricelens.llm import queries
    rows = [(i % 40 if i % 3 else None, "w " * (i % 4), ["a", "b", None, "c"][i % 7 % 4]) for i in range(900)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(queries.OP8_SQL).fetchall()
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in queries.op8(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((a, b, c, round(t, 6), k) for a, b, c, t, k in want), key=str)


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    assert [(r.size, r.target, r.taken) for r in mixing.mix(spark.createDataFrame([(1, None, None)], schema)).collect()] == [(0, 0.0, 0)]


def test_mix_uses_no_python(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- pipeline

def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.collect()
        assert {r.doc_id for r in after} <= set(before)
        if i < 4:
            assert docs.columns == columns and len(after) == len({r.doc_id for r in after})
            assert all(r.n_chars == len(r.text) for r in after)
        seen.append((name, len(before), len(after)))
        if i == 1:
            from test_pairs import brute_fingerprint, brute_groups  # noqa: F401
            fps = {brute_fingerprint(r.text) for r in after}
            assert len(fps) == len(after)
        if i == 2:
            items = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            index = decontam.Index([(str(k), t, "") for k, t in enumerate(items)])
            gone = set(before) - {r.doc_id for r in after}
            assert gone == {k for k, t in before.items() if index.leaks(t)}
        if i == 3:
            assert all(not secret_scan.scan(r.text) for r in after if "[secret]" in r.text)
            assert all((r.text == before[r.doc_id]) == (not secret_scan.scan(before[r.doc_id])) for r in after)
    assert [n for n, _, _ in seen] == [n for n, _ in corpus_pipeline.STAGES]
    assert all(a > 0 for _, _, a in seen)


def test_run_is_the_stages_in_a_row(spark):
    a = corpus_pipeline.run(spark, SF)
    b = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.copy_no, r.size) for r in df.select("doc_id", "copy_no", "size").collect())
    assert key(a) == key(b)


def test_one_of_a_group_without_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    a, b = ("the quick brown fox jumps over the lazy dog by the river", "an entirely other text about the weather in the north today")
    rows = [(None, a, "en", "x", 1), (None, a, "de", "y", 2), (7, a, "en", "x", 1), (None, b, "en", "x", 1), (None, b, "en", "z", 1)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("7", a), ("None", b)]


def test_one_of_a_group_with_repeated_ids(spark):
    """Rows are what is compared: a copy goes although its id also stands for another text, and that text stays."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    a, b, c = ("the quick brown fox jumps over the lazy dog by the river", "an entirely other text about the weather in the north today", "short but not the same")
    rows = [(3, a, "en", "x", 1), (5, b, "en", "x", 1), (5, a, "en", "x", 1), (5, b, "fr", "y", 1), (9, c, "en", "x", 1), (None, c, "en", "x", 1), (2, c, "en", "x", 1)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(2, c), (3, a), (5, b)]


def test_stages_take_nulls_and_nothing(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, None, None, None, 0), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "token=abcdefgh12 and more", "en", "a", 25)]
    for data in (rows, []):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, spark.createDataFrame(data, schema), SF).collect()


def test_windows_in_many_buckets_and_a_full_filter(spark, monkeypatch):
    """Small buckets, short cells and a filter that lets most windows pass change nothing."""
    line = "Read our weekly letter and win a prize in the great lottery of the town"
    pages = [(i, f"http://h{i % 3}.org/{i}", f"<div>{line} now</div><p>{' '.join(f'w{i * j % 97}' for j in range(60))}</p><nav>{line}</nav>"
              + (f"<article><p>{line}</p><p>own {i}</p></article>" if i % 5 == 0 else "")) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    want = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert want[5] == "own 5" and line not in want[7] and want[7].startswith("w0 w7 ")
    for name, value in (("BUCKET", 64), ("CELL_BITS", 1), ("MAX_FILTER", 1 << 10), ("FLUSH", 500), ("PARSE_BYTES", 300)):
        monkeypatch.setattr(html_extract, name, value)
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want


def test_packed_numbers():
    import numpy as np
    rng = np.random.default_rng(1)
    for high in (5, 70_000, 1 << 24):
        x = np.sort(rng.integers(0, high, 500)).astype(np.uint64)
        assert (html_extract._unpack(html_extract._pack(x)) == x.astype(np.int64)).all()
    x = np.array([0, 0, 65534, 65535, 131070, 131070, 500_000], np.uint64)
    assert html_extract._unpack(html_extract._pack(x)).tolist() == x.tolist() and html_extract._unpack(html_extract._pack(x[:0])).tolist() == []
