"""Main text of web pages: markup, and substrings that repeat over a host's pages.

A page is cut into blocks of text, each marked by the markup around it: inside the article, in a zone
that is never main text (menus, headers, footers, sidebars, notices, adverts, forms, comments), or open. The words of every
page make two streams, the article's and the rest's, which are the host's text to be searched. A substring of ``LENGTH`` words or more
that stands on ``MIN_PAGES`` pages of a host or more, of distinct main texts, is repeated, and what it covers is boilerplate.

In a suffix array such substrings are runs of suffixes with an equal prefix. A word lies in a repeated substring exactly if
it lies in a window of ``LENGTH`` words that is repeated: each window of a repeated substring stands on all its pages, and a
repeated window is such a substring itself. So suffixes need no order beyond their first ``LENGTH`` words, and are dealt by those
(as 64-bit hashes of host, stream and words) instead of sorted; the covered words are the same.

Markup decides what may go. Without an article, covered runs are cut out of the open blocks; zones go, but count as places where a
window stands. With an article, all outside it goes, and of its own words those covered by windows of at least ``ARTICLE_SHARE`` of the host's articles
(and ``MIN_PAGES``): markup has called them main text, so that a passage a few articles share stays. A run is cut if it is a whole
block or has ``LENGTH`` words in it; the rest of a block stays.

The windows of a host are never in one place:

1. a first reading counts words and finds the hosts with pages without an article; only there can the words outside articles matter;
2. a second one deals the windows to buckets by hash, as sorted cells of about ``CELL_BITS`` bits more than there are windows, which take
   about two bytes each; a bucket (of about ``BUCKET`` windows, so more windows make more buckets) tells which cells can be repeated. They make a
   filter of ``FILTER_BITS`` bits for each, ``MAX_FILTER`` in all: it lets some windows too many through, more where it is full, and loses none;
3. a third one keeps the windows that pass, packed per page; they are dealt by (host, window) and counted exactly, and a page gets back
   the positions that it has covered;
4. the last one cuts them out.

Pages are parsed anew each time: blocks kept in the shared folder would take as much disk as the pages, and parsing is the smaller part.

Defined cases: null and empty html has empty text; a null URL's host is empty; unclosed, cut off and nested markup is read as
far as it goes; pages of equal main text (the article, or else the open words) count as one; an empty table gives an
empty result. Extra columns are kept, and those named like an output are replaced. Texts are read whole.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import broadcast_if_small, chunks, encode, mix64, word_hashes
from pricelens.llm.url_filter import host_of
from pricelens.session import write_shared

LENGTH = 8       # words of a repeated substring, at least
MIN_PAGES = 3    # distinct pages that hold it, at least
MAX_CELLS = 2_000_000  # numbers in the pages' lists of positions that are broadcast, at most; more are joined by shuffle
ARTICLE_SHARE = 0.5  # share of a host's articles that hold what is cut out of one, at least
CELL_BITS = 7    # cells there are for each window, as a power of two
BUCKET = 1 << 21  # windows of a bucket, about
FILTER_BITS = 16  # bits of the filter for each cell that can be repeated
MAX_FILTER = 1 << 31  # bits of the filter, at most (256 MB)
FLUSH = 1 << 22  # windows that a task packs together
PARSE_BYTES = 1 << 21  # html of the pages whose words are hashed together

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z/!?][^<>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = frozenset("script style noscript template textarea title svg math iframe object select option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ZONES = frozenset("nav footer aside form menu dialog button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
SPACE = frozenset("br td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CONTAINERS = frozenset("div section ul ol dl table figure details article header center".split())  # may be zones by name; paragraphs may not
#: names of zones as a whole class or id, or as its first or last part
HEADS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored banner sidebar nav navbar navigation breadcrumb
    breadcrumbs masthead footer cookie cookies gdpr comments newsletter pagination pager popup modal""".split())
#: names of zones as a whole class or id only
NAMES = HEADS | frozenset("""sponsors promo promotion side aside menu header consent notice notices notification alert comment respond discussion
    disqus subscribe subscription signup login share sharing social related recommended overlay widget search form""".split())
BODIES = frozenset("articlebody article-body article-content post-content entry-content post-body story-body main-content".split())
ARTICLE, ZONE, OPEN = 0, 1, 2
_PART = re.compile(r"[-_:]+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(text)}


def _kind(tag: str, attrs: str, inside: bool) -> int | None:
    """Whether an element opens an article (ARTICLE) or a zone without main text (ZONE)."""
    given = _attributes(attrs) if attrs else {}
    classes = f"{given.get('class', '')} {given.get('id', '')}".split()
    if tag in ZONES or tag == "header" or "hidden" in given or given.get("role") in ROLES:
        return ZONE
    if given.get("itemprop") == "articlebody" or BODIES & set(classes):
        return ARTICLE
    if tag in CONTAINERS and any(_is_zone(c) and not (inside and c == "header") for c in classes):
        return ZONE
    return ARTICLE if tag in ("article", "main") or given.get("role") in ("main", "article") else None


def _is_zone(name: str) -> bool:
    parts = [x for x in _PART.split(name) if x]
    return name in NAMES or len(parts) > 1 and (parts[0] in HEADS or parts[-1] in HEADS)


def blocks_of(html: str | None) -> list[tuple[int, str]]:
    """(mark, text) of the page's blocks, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int | None]] = []
    parts: list[str] = []
    zones = articles = at = 0
    raw = ""

    def close() -> None:
        text = " ".join(references.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((ZONE if zones else ARTICLE if articles else OPEN, text))

    for m in TOKEN.finditer(html or ""):
        if m.start() < at:
            continue
        tag = (m[2] or "").lower()
        if not raw:
            parts.append(html[at:m.start()])
        at = m.end()
        if raw:
            if m[1] and tag == raw:
                raw = ""
            continue
        if not tag:
            continue
        if tag in SPACE:
            parts.append(" ")
        if tag not in INLINE and tag not in SPACE:
            close()
        if m[1]:
            if any(t == tag for t, _ in stack):
                close_all = tag not in INLINE  # an inline element's end closes no block
                for i in range(len(stack) - 1, -1, -1):
                    t, kind = stack[i]
                    if t != tag and not close_all and t not in INLINE:
                        break
                    if kind is not None and t in INLINE:
                        close()
                    zones -= kind == ZONE
                    articles -= kind == ARTICLE
                    del stack[i]
                    if t == tag:
                        break
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            raw, at = tag, end.start() if end else len(html)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            kind = _kind(tag, m[3], articles > 0)
            if kind is not None and tag in INLINE:
                close()
            stack.append((tag, kind))
            zones += kind == ZONE
            articles += kind == ARTICLE
    if not raw:
        parts.append((html or "")[at:])
    close()
    return out


def _words(blocks: list[tuple[int, str]], *marks: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the blocks with these marks, in a row, and which block each is of."""
    own = [i for i, (mark, _) in enumerate(blocks) if mark in marks]
    words, bounds = word_hashes(encode(blocks[i][1] for i in own))
    return words, np.repeat(own, np.diff(bounds)) if own else np.zeros(0, np.int64)


def _marked(blocks: list[tuple[int, str]]) -> bool:
    return any(mark == ARTICLE for mark, _ in blocks)


def prefixes(words: np.ndarray) -> np.ndarray:
    """Hash of the first ``LENGTH`` words of each suffix that has so many."""
    n = len(words) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(LENGTH):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i:n + i])
    return out


def main_text(html: str | None, covered: list[int] | None) -> str:
    """The text, given where in the article's stream, or else the rest's, a repeated substring begins."""
    blocks = blocks_of(html)
    kind = ARTICLE if _marked(blocks) else OPEN
    if covered is None or not len(covered):
        return "\n\n".join(t for mark, t in blocks if mark == kind)
    words, block = _words(blocks, ARTICLE) if kind == ARTICLE else _words(blocks, OPEN, ZONE)
    hit = np.zeros(len(words) + 1, np.int64)
    begin = np.array(covered, np.int64)
    np.add.at(hit, begin, 1)
    np.add.at(hit, begin + LENGTH, -1)
    inside = np.cumsum(hit[:-1]) > 0
    out = []
    for i, (mark, text) in enumerate(blocks):
        if mark != kind:
            continue
        a, b = np.searchsorted(block, [i, i + 1])
        if inside[a:b].any():
            text = _cut(text, inside[a:b])
        if text:
            out.append(text)
    return "\n\n".join(out)


def _cut(text: str, inside: np.ndarray) -> str:
    """A block without its covered runs of ``LENGTH`` words or more; nothing if all is covered."""
    if inside.all():
        return ""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    keep = np.ones(len(inside), bool)
    for a, b in edges.reshape(-1, 2):
        keep[a:b] = b - a < LENGTH
    return " ".join(w for w, k in zip(text.split(" "), keep) if k)  # blocks hold single spaces only


class Streams(NamedTuple):
    """The streams of a batch of pages, one after the other."""
    words: np.ndarray   # hashes
    begin: np.ndarray   # where each stream begins (one entry more)
    page: np.ndarray    # the row of each stream's page
    kind: np.ndarray    # ARTICLE, or OPEN for the rest
    place: np.ndarray   # hash of host and kind
    text: np.ndarray    # of each page: hash of its main text
    marked: np.ndarray  # of each page: whether markup shows an article


def _streams(hosts: np.ndarray, htmls, both: np.ndarray) -> Streams:
    """Streams of pages: the article's where there is one, and the rest's where there is none or ``both`` are wanted."""
    texts, marks, owner, page, kind, marked = [], [], [], [], [], []
    for i, html in enumerate(htmls):
        blocks = blocks_of(html)
        marked.append(_marked(blocks))
        for k, wanted in ((ARTICLE, marked[-1]), (OPEN, both[i] or not marked[-1])):
            if wanted:
                own = [(mark, t) for mark, t in blocks if (mark == ARTICLE) == (k == ARTICLE)]
                texts += [t for _, t in own]
                marks += [mark for mark, _ in own]
                owner += [len(page)] * len(own)
                page.append(i)
                kind.append(k)
    page, kind, marked = np.array(page, np.int64), np.array(kind, np.int64), np.array(marked, bool)
    words, bounds = word_hashes(encode(texts))
    size = np.bincount(np.repeat(np.array(owner, np.int64), np.diff(bounds)), minlength=len(page)) if len(page) else np.zeros(0, np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    # the main text is the article, or else the open blocks: a sum over its words, each by its place there
    main = np.repeat(np.array(marks, np.int64), np.diff(bounds)) != ZONE if len(texts) else np.zeros(0, bool)
    main &= np.repeat((kind == ARTICLE) | ~marked[page], size) if len(page) else main
    count = np.concatenate(([0], np.cumsum(main)))
    at = (count[:-1] - np.repeat(count[begin[:-1]], size))[main]
    power = np.cumprod(np.full(int(at.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    of = np.repeat(page, size)[main]
    text = np.zeros(len(marked), np.uint64)
    np.add.at(text, of, mix64(words[main] + power[at]) * power[at])
    text = mix64(text + np.bincount(of, minlength=len(marked)).astype(np.uint64)) if len(marked) else text
    place = mix64(hosts[page].view(np.uint64) + (kind + 1).astype(np.uint64))
    return Streams(words, begin, page, kind, place, text, marked)


def _windows(s: Streams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's hash, its stream, and where in the stream it begins."""
    w = prefixes(s.words)
    stream = np.repeat(np.arange(len(s.page)), np.diff(s.begin))[:len(w)]
    at = np.arange(len(w))
    inside = at + LENGTH <= s.begin[1:][stream]
    w, stream, at = w[inside], stream[inside], at[inside]
    return mix64(w + s.place[stream]), stream, at - s.begin[stream]


def _batches(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for start, stop in chunks([h or "" for h in frame["html"]], PARSE_BYTES):
        yield frame[start:stop]


def _survey(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers of words, and the hosts that have pages without an article."""
    for f in frames:
        words, open_hosts = 0, set()
        for host, html in zip(f["host"], f["html"]):
            blocks = blocks_of(html)
            words += sum(t.count(" ") + 1 for _, t in blocks)
            if not _marked(blocks):
                open_hosts.add(host)
        yield pd.DataFrame({"host": pd.array([None, *open_hosts], "Int64"), "words": [words] + [0] * len(open_hosts)})


def _pack(values: np.ndarray) -> bytes:
    """Sorted numbers by their gaps, of two bytes; the largest of these stands for a gap that goes on."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.int64)
    more, rest = np.divmod(gaps, 0xFFFF)
    out = np.full(int(more.sum()) + len(gaps), 0xFFFF, np.uint16)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    gaps = np.frombuffer(packed, np.uint16)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 0xFFFF]


def _cells(bits: int, bucket_bits: int):
    """(bucket, packed low bits of its cells); a cell is given as often as distinct texts of the task hold it, up to ``MIN_PAGES``."""
    low = np.uint64(bits - bucket_bits)

    def flush(held: list[np.ndarray]) -> pd.DataFrame:
        every = np.sort(np.concatenate(held))
        every = every[np.arange(len(every)) - np.searchsorted(every, every) < MIN_PAGES]
        own, begin = np.unique(every >> low, return_index=True)
        parts = np.split(every & ((np.uint64(1) << low) - np.uint64(1)), begin[1:])
        return pd.DataFrame({"bucket": own.astype(np.int32), "low": [_pack(x) for x in parts]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        for frame in frames:
            for f in _batches(frame):
                s = _streams(f["host"].to_numpy(), f["html"], f["both"].to_numpy())
                window, stream, _ = _windows(s)
                keys = list(zip(s.text[s.page].tolist(), s.place.tolist()))
                new = np.array([k not in seen and not seen.add(k) for k in keys], bool)  # a copy is given once
                window, stream = window[new[stream]] >> np.uint64(64 - bits), stream[new[stream]]
                order = np.lexsort((window, stream))
                window, stream = window[order], stream[order]
                first = np.append(True, (window[1:] != window[:-1]) | (stream[1:] != stream[:-1])) if len(window) else np.zeros(0, bool)
                held.append(window[first])
            if sum(map(len, held)) >= FLUSH:
                yield flush(held)
                held.clear()
                seen.clear()
        if sum(map(len, held)):
            yield flush(held)

    return run


def _often(group: pd.DataFrame) -> pd.DataFrame:
    """A bucket's cells that are given ``MIN_PAGES`` times."""
    low = np.sort(np.concatenate([_unpack(x) for x in group["low"]]))
    often = np.unique(low[MIN_PAGES - 1:][low[MIN_PAGES - 1:] == low[:len(low) - MIN_PAGES + 1]])
    return pd.DataFrame({"bucket": group["bucket"].iloc[:1].to_numpy(), "n": [len(often)], "low": [_pack(often.astype(np.uint64))]})


def _filter(often: DataFrame, bits: int, bucket_bits: int) -> tuple[int, np.ndarray]:
    """(bits of a place, the filter as bytes): a cell's place are its first bits. Its size is bounded, whatever the data."""
    n = often.agg(F.sum("n")).first()[0] or 0
    size = min(bits, max(bucket_bits + 3, int(n * FILTER_BITS).bit_length()), MAX_FILTER.bit_length() - 1)
    shift = bits - size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for bucket, low in zip(f["bucket"], f["low"]):
                part = np.zeros(1 << (size - bucket_bits), bool)
                part[_unpack(low) >> shift] = True
                yield pd.DataFrame({"bucket": [bucket], "bits": [zlib.compress(np.packbits(part).tobytes(), 1)]})

    out = np.zeros((1 << bucket_bits, 1 << (size - bucket_bits - 3)), np.uint8)
    for r in often.filter("n > 0").mapInPandas(run, "bucket int, bits binary").toLocalIterator():
        out[r.bucket] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return size, out.ravel()


def suffixes(pages: DataFrame) -> DataFrame:
    """The windows that can be repeated, per stream: (place, kind, page, text, windows, at) from (page, host, html). ``place`` is of host and
    stream, ``text`` of the page's main text, and ``at`` is empty where markup alone decides. Each article has a row."""
    survey = write_shared(pages.select("host", "html").mapInPandas(_survey, "host long, words long"))
    n = survey.agg(F.sum("words")).first()[0] or 0
    bits = min(62, int(n).bit_length() + CELL_BITS + 1)
    bucket_bits = max(0, int(n // BUCKET).bit_length())
    hosts = broadcast_if_small(survey.filter("host IS NOT NULL").select(F.col("host").alias("_open")).distinct())
    pages = (pages.join(hosts, F.col("host") == F.col("_open"), "left")
             .select("page", "host", "html", F.col("_open").isNotNull().alias("both")))
    cells = pages.select("host", "html", "both").mapInPandas(_cells(bits, bucket_bits), "bucket int, low binary")
    often = write_shared(cells.groupBy("bucket").applyInPandas(_often, "bucket int, n long, low binary"))
    size, whole = _filter(often, bits, bucket_bits)
    shared = pages.sparkSession.sparkContext.broadcast(whole)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f in _batches(frame):
                s = _streams(f["host"].to_numpy(), f["html"], f["both"].to_numpy())
                window, stream, at = _windows(s)
                place = window >> np.uint64(64 - size)
                passed = np.flatnonzero(shared.value[place >> np.uint64(3)] >> (7 - (place & np.uint64(7)).astype(np.uint8)) & 1)
                window, stream, at = window[passed].view(np.int64), stream[passed], at[passed].astype(np.int32)
                cuts = np.searchsorted(stream, np.arange(1, len(s.page)))
                windows, ats = (np.split(x, cuts) if len(s.page) else [] for x in (window, at))
                cut = (s.kind == ARTICLE) | ~s.marked[s.page]
                keep = [i for i in range(len(s.page)) if s.kind[i] == ARTICLE or len(windows[i])]
                yield pd.DataFrame({
                    "place": s.place.view(np.int64)[keep], "kind": s.kind[keep].astype(np.int32), "page": f["page"].to_numpy()[s.page[keep]],
                    "text": s.text.view(np.int64)[s.page[keep]], "windows": [windows[i] if cut[i] else np.unique(windows[i]) for i in keep],
                    "at": [ats[i] if cut[i] else np.zeros(0, np.int32) for i in keep]})

    return pages.mapInPandas(run, "place long, kind int, page long, text long, windows array<long>, at array<int>")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars."""
    @F.pandas_udf("string")
    def run(htmls: pd.Series, covered: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, c) for h, c in zip(htmls, covered)], dtype=object)

    page = F.xxhash64(page_id, url, html)
    host = F.xxhash64(F.coalesce(host_of(F.col(url)), F.lit("")))
    found = write_shared(suffixes(pages.select(page.alias("page"), host.alias("host"), F.col(html).alias("html"))))
    articles = (found.filter(F.col("kind") == ARTICLE).select("place", "text").distinct()
                .groupBy("place").agg(F.count("*").alias("articles")))
    count = (found.select("place", "text", F.explode("windows").alias("window")).distinct()
             .groupBy("place", "window").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_PAGES))
    repeated = (count.join(articles, "place", "left")  # null for streams outside articles
                .filter(F.col("articles").isNull() | (F.col("n") >= ARTICLE_SHARE * F.col("articles"))).select("place", "window"))
    positions = found.filter(F.size("at") > 0).select("place", "page", F.explode(F.arrays_zip("windows", "at")).alias("x"))
    covered = (positions.select("place", "page", F.col("x.windows").alias("window"), "x.at").join(repeated, ["place", "window"])
               .groupBy("page").agg(F.collect_set("at").alias("covered"))  # a page's own words
               .select(F.col("page").alias("_page"), F.col("covered").alias("_covered")))
    covered = broadcast_if_small(covered, MAX_CELLS, F.size("_covered") + 2)
    out = pages.withColumn("_key", page).join(covered, F.col("_key") == F.col("_page"), "left")
    out = out.withColumn("text", run(F.col(html), F.col("_covered"))).drop("_key", "_page", "_covered")
    return out.withColumn("n_chars", F.length("text").cast("long"))
