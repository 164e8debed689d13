"""Secret scan with a recursive decoding worklist.

Each text is scanned as it is (the base), then every layer it hides: percent and Unicode escapes are undone in
place, base64 runs (also over several lines, and at each of the four offsets, as other text may stand before them) are decoded, and what is compressed
is unpacked, wherever in a layer it begins. Bytes that aren't UTF-8 are a layer too, one character per byte, and bytes with zeros are read as UTF-16 besides.
Layers go to a worklist until none is new;
a layer seen before (by hash) is not scanned again, which also ends cycles. The worklist is a stack of open layers, each of which
makes its next layer when the last one and all within it are done, so that unpacked data are held a piece at a time. An escape sign that is itself escaped,
any number of times, is undone in one step. Each character of a layer knows its
span in the document, so that a finding in a layer is reported at the span it came from.

Defined cases: a word at the start of the line after base64 counts as more of it; a packed stream inside another is followed to the end of the other's
piece; null and empty texts have no spans; equal findings of several layers are reported once; repeated
rows get equal results; very long texts are scanned whole, and unpacked data in overlapping pieces of bounded
size; an empty table gives an empty result. Extra columns are kept; one named like an output is replaced.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kinds, in the order in which spans with one start are listed
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_VALUE, MIN_ACCESS = 8, 16

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")  # base64 broken over lines
MIN_RUN = 16       # characters of base64, without line ends
NOT_RUN = re.compile(r"[^A-Za-z0-9+/_-]+")
#: escape signs that are escaped again and again: %2525..41, and \\u005cu005c..u0041 or \\x5cx5c..x41
NESTED = re.compile(r"%(?:25){2,}(?=[0-9A-Fa-f]{2})|\\(?:u005[cC])+(?=u[0-9A-Fa-f]{4})|\\(?:x5[cC])+(?=x[0-9A-Fa-f]{2})")
WIDE = re.compile("%[89A-Fa-f]")  # an escaped byte beyond ASCII
PACKED = re.compile(rb"(?=\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78])")  # where gzip or zlib data may begin
PIECE = 1 << 22    # bytes of unpacked data that are scanned together
OVERLAP = 1 << 16  # bytes by which consecutive pieces overlap
SPAN = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind's number, start, end) of the plain findings of one layer."""
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_VALUE:
                yield 0, m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                yield 1, m.start(), m.end()
    for m in HEX.finditer(text):
        yield 2, m.start(), m.end()


class Layer:
    """A text whose character i came from [start[i], end[i]) of the document."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.start, self.end = text, start, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a:b].min()), int(self.end[a:b].max()))

    def one_run(self) -> tuple[int, int] | None:
        """The run that all of the layer came from, if it is known to be one."""
        if self.start is None or not len(self.start) or self.start.strides[0]:
            return None
        return int(self.start[0]), int(self.end[0])

    def key(self) -> tuple:
        """Names the layer: its text and, where all of it came from one run, that run (the text may hide elsewhere too)."""
        mark = hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest()
        if self.start is None:
            return (mark,)
        run = self.one_run()
        if run is None and (self.start == self.start[0]).all() and (self.end == self.end[0]).all():
            run = int(self.start[0]), int(self.end[0])
        return (mark, *(run or ()))


def _escaped(m: re.Match, as_bytes: bool = False) -> list[tuple[str, int, int]] | None:
    """(character, start, end) in the escapes' run, or null if they aren't text."""
    run = m.group()
    if m.re is NESTED:
        return [(run[0], 0, len(run))]
    if run[0] == "%":
        data, width = bytes.fromhex(run.replace("%", "")), 3
        try:
            chars = data.decode("latin-1" if as_bytes else "utf-8")
        except UnicodeDecodeError:
            as_bytes = True
        if as_bytes:
            chars = data.decode("latin-1")
            return [(c, 3 * i, 3 * i + 3) for i, c in enumerate(chars)]
        out, at = [], 0
        for c in chars:
            size = len(c.encode()) * width
            out.append((c, at, at + size))
            at += size
        return out
    if run[1] == "u" and run[2] != "{":
        units = bytes.fromhex(run.replace("\\u", ""))
        chars = units.decode("utf-16-be", "replace")
        out, at = [], 0
        for c in chars:
            size = 12 if ord(c) > 0xFFFF else 6
            out.append((c, at, at + size))
            at += size
        return out
    code = int(run.strip("\\uUx{}"), 16) if run[1] != "x" else int(run[2:], 16)
    return [(chr(code), 0, len(run))] if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else None


def unescape(layer: Layer, pattern: re.Pattern, as_bytes: bool = False) -> Layer | None:
    """The layer with its escapes undone in place, to one character per byte if ``as_bytes``; null if it has none."""
    text, parts, starts, ends, at = layer.text, [], [], [], 0
    whole = layer.one_run()
    here = lambda a, b: (np.arange(a, b), np.arange(a + 1, b + 1)) if layer.start is None else (layer.start[a:b], layer.end[a:b])
    for m in pattern.finditer(text):
        if (chars := _escaped(m, as_bytes)) is None:
            continue
        parts += [text[at:m.start()], "".join(c for c, _, _ in chars)]
        if whole is None:
            s, e = here(at, m.start())
            spans = [layer.span(m.start() + a, m.start() + b) for _, a, b in chars]
            starts += [s, np.array([x[0] for x in spans])]
            ends += [e, np.array([x[1] for x in spans])]
        at = m.end()
    if not parts:
        return None
    new = "".join([*parts, text[at:]])
    if whole is not None:
        return next(_held(iter([new]), *whole), None)
    s, e = here(at, len(text))
    return Layer(new, np.concatenate([*starts, s]), np.concatenate([*ends, e]))


def _texts(data: bytes) -> Iterator[str]:
    """Readings of bytes: UTF-8, or one character per byte if they aren't or may be packed; UTF-16 if they hold zeros."""
    try:
        text = data.decode()
        yield text
        if not text.isascii() and next(_begins(data), None) is not None:
            yield data.decode("latin-1")
    except UnicodeDecodeError:
        yield data.decode("latin-1")
        if len(data) >= PIECE:  # bytes of a character cut at either edge
            yield data.decode("utf-8", "replace")
    if b"\0" in data:
        for a in (0, 1):
            yield data[a:].decode("utf-16-le", "replace")


def _begins(data: bytes) -> Iterator[int]:
    for m in PACKED.finditer(data):
        a = m.start()
        if data[a] == 0x1F or a + 1 < len(data) and (data[a] << 8 | data[a + 1]) % 31 == 0 and not data[a + 1] & 32:
            yield a


def _pieces(data: bytes | memoryview) -> Iterator[tuple[bytes, int]]:
    """What gzip or zlib data unpacks to, in overlapping pieces, and how many of its bytes were read."""
    unpack, tail, rest = zlib.decompressobj(47), b"", data  # 47: gzip or zlib by its header
    try:
        while len(rest) and not unpack.eof:
            out = unpack.decompress(rest, PIECE)
            rest = unpack.unconsumed_tail
            if not out:
                break
            yield tail + out, len(data) - len(rest) - len(unpack.unused_data)
            tail = out[-OVERLAP:]
    except zlib.error:  # what stands before the fault
        if not tail:
            unpack, out = zlib.decompressobj(47), b""
            for a in range(0, len(data), 8):
                try:
                    out += unpack.decompress(data[a:a + 8])
                except zlib.error:
                    break
                if len(out) > PIECE:
                    yield out, a
                    out = out[-OVERLAP:]
            if out:
                yield out, a


def _held(texts: Iterator[str], a: int, b: int) -> Iterator[Layer]:
    """Layers whose characters all come from [a, b) of the document."""
    for t in texts:
        if t:
            yield Layer(t, np.broadcast_to(np.int64(a), len(t)), np.broadcast_to(np.int64(b), len(t)))


def unpack(layer: Layer) -> Iterator[Layer]:
    """Layers in the base64 runs of a layer; their characters all come from the whole run."""
    for pattern in (BASE64, LINES):
        for m in pattern.finditer(layer.text):
            run = NOT_RUN.sub("", m.group()).translate({45: "+", 95: "/"})
            if len(run) < MIN_RUN:
                continue
            for offset in range(4):
                part = run[offset:]
                part = part[:-1] if len(part) % 4 == 1 else part
                try:
                    data = base64.b64decode(part + "=" * (-len(part) % 4), validate=True)
                except (binascii.Error, ValueError):
                    continue
                yield from _held(_texts(data), *layer.span(m.start(), m.end()))


def inflate(layer: Layer) -> Iterator[Layer]:
    """Layers in the gzip or zlib data of a layer that has one character per byte."""
    data = layer.text.encode("latin-1", "replace")
    view = memoryview(data)
    for a in _begins(data):
        for piece, size in _pieces(view[a:]):
            yield from _held(_texts(piece), *layer.span(a, a + max(1, size)))


def _inner(layer: Layer, plain: bool = False) -> Iterator[Layer]:
    """The layers right inside a layer, each made when it is asked for."""
    if NESTED.search(layer.text):  # the layers between differ by the number of signs only
        steps = [(NESTED, False)]
    else:
        steps = [(p, False) for p, sign in ((PERCENT, "%"), (ESCAPE, "\\")) if sign in layer.text]
        steps += [(PERCENT, True)] if WIDE.search(layer.text) else []
    yield from filter(None, (unescape(layer, p, as_bytes) for p, as_bytes in steps))
    yield from unpack(layer)
    if not plain:
        yield from inflate(layer)


def scan(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(kind's number, start, end, whether the plain text shows it), by start, then kind, then end."""
    if not text:
        return []
    found: dict[tuple[int, int, int], bool] = {(s, k, e): True for k, s, e in matches(text)}
    first = Layer(text)
    open_, seen = [_inner(first, plain=True)], {first.key()}
    while open_:
        layer = next(open_[-1], None)
        if layer is None:
            open_.pop()
        elif layer.text and (key := layer.key()) not in seen:
            seen.add(key)
            for k, a, b in matches(layer.text):
                s, e = layer.span(a, b)
                found.setdefault((s, k, e), False)
            open_.append(_inner(layer))
    return [(k, s, e, base) for (s, k, e), base in sorted(found.items())]


def redact(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """The text with every span replaced by the mask; spans that touch or overlap are replaced once."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end, base) in code points."""
    @F.pandas_udf(SPAN)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in scan(t)] for t in texts], dtype=object)

    return docs.withColumn(out, run(F.col(text)))


def mask_secrets(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with the spans of its secrets masked in the text."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, [(s, e) for _, s, e, _ in scan(t)], mask) if t else t for t in texts], dtype=object)

    return docs.withColumn(text, run(F.col(text)))


def digest(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
