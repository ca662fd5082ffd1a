"""Operator 5: secret scans with a recursive decoding worklist.

Every text is scanned as it stands, and so is each layer that can be unwrapped from it: percent-encoded stretches,
\\u escapes, base64 (also glued to its neighbours or wrapped over lines) and, below base64, every zlib and gzip stream.
Layers go onto a worklist until nothing new unwraps; a layer whose content was seen before in the same place is not
unwrapped again, which ends cycles. A find in a layer is mapped to the stretch of the original text that carries it: to
the characters themselves for the character-wise encodings, to the whole encoded run below base64.

A run is decoded at each of its four alignments, so that whatever part of it is base64 comes out whole; other bytes of
a layer don't hinder the scan. A stream whose content is over PIECE bytes is scanned in pieces that overlap by OVERLAP, as it
unpacks, and a broken one as far as it goes; streams within it are fed from it as it goes on, at any depth, so that none
ends at a piece's border. A large one that a large content holds is known by the digest of all it unpacks to, so that only one
that was gone over whole is not again, and is then unpacked anew from where it begins. Large ones cost time, not memory. Only
finds and base64 runs longer than OVERLAP that lie over the border of two pieces can be cut.

Cases: null text is empty and has no spans; repeated rows are scanned each; an empty table gives an empty result;
other columns of the input are ignored. Spans are code points, end exclusive.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What every assignment has, so that most texts skip the slow search.
STEMS = ("passw", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[\x20\t]*\r?\n[\x20\t>]*)+[A-Za-z0-9+/_-]+={0,2}")
BREAK = re.compile(r"[\x20\t]*\r?\n[\x20\t>]*")
#: First bytes of gzip and zlib streams.
STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]", re.S)
#: Compressed bytes that are unpacked at once, the least size of a content that is taken in pieces and of a piece, and what it shares with the next.
CHUNK, PIECE, OVERLAP = 1 << 12, 1 << 22, 1 << 16


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of one layer, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(s in low for s in STEMS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


class _Part(bytes):
    """A piece of a content; streams in it are unpacked with the content, not with the piece."""


def _feed(d, data: bytes):
    """(what the bytes unpack to as far as they go, whether that is all): what comes before an error counts."""
    before = d.copy()
    try:
        return d.decompress(data), d.eof
    except zlib.error:
        got = b""
        with contextlib.suppress(zlib.error):
            for k in range(len(data)):
                got += before.decompress(data[k : k + 1])
        return got, True


class _Content:
    """What a stream unpacks to, gone over as often as wanted: the stream begins at a place in bytes or in another content."""

    def __init__(self, within, at: int):
        self.within, self.at = within, at

    def __iter__(self):
        d, skip = zlib.decompressobj(47), self.at
        for data in self.within if isinstance(self.within, _Content) else (self.within,):
            if skip >= len(data):
                skip -= len(data)
                continue
            for i in range(skip, len(data), CHUNK):
                got, over = _feed(d, data[i : i + CHUNK])
                yield got
                if over:
                    return
            skip = 0


class _Stream:
    """A stream that is unpacked as its bytes come: its content if that is small, else its digest."""

    def __init__(self, at: int):
        self.at, self.d, self.digest = at, zlib.decompressobj(47), hashlib.md5()
        self.held, self.large, self.over, self.left = bytearray(), False, False, 0

    def feed(self, data) -> None:
        """Takes the bytes up to the stream's end; left: how many are none of it."""
        for i in range(0, len(data), CHUNK):
            if self.over:
                return
            got, self.over = _feed(self.d, data[i : i + CHUNK])
            self.digest.update(got)
            if not self.large:
                self.held += got
                if len(self.held) >= PIECE:
                    self.large, self.held = True, bytearray()
            if self.d.eof:
                self.left = len(data) - min(i + CHUNK, len(data)) + len(self.d.unused_data)


def _large(content: _Content, seen: set[bytes]):
    """A large content in pieces, then what the streams within it hold; contents in seen, by digest, are not gone over again."""
    held, new, tail, at, open_streams, large = bytearray(), 0, b"", 0, [], []
    for got in content:
        held += got
        new += len(got)
        if new >= PIECE:
            yield _Part(held)
            held, new = held[-OVERLAP:], 0
        for s in open_streams:
            s.feed(got)
        both = tail + got
        for m in STREAM.finditer(both):
            if m.end() > len(tail):
                open_streams.append(_Stream(at - len(tail) + m.start()))
                open_streams[-1].feed(both[m.start() :])
        yield from (bytes(s.held) for s in open_streams if s.over and s.held)
        large += [s for s in open_streams if s.over and s.large]
        open_streams = [s for s in open_streams if not s.over]
        tail, at = both[-2:], at + len(got)
    if new:
        yield _Part(held)
    yield from (bytes(s.held) for s in open_streams if s.held)
    for s in large + [s for s in open_streams if s.large]:
        if s.digest.digest() not in seen:
            seen.add(s.digest.digest())
            yield from _large(_Content(content, s.at), seen)


def _unpacked(raw: bytes):
    """The content of each gzip or zlib stream in the bytes as far as it unpacks; in parts if it is large, with those of streams within it."""
    view, at, seen = memoryview(raw), 0, set()
    while m := STREAM.search(raw, at):
        s = _Stream(m.start())
        s.feed(view[m.start() :])
        at = len(raw) - s.left if s.d.eof else m.start() + 1
        if s.held:
            yield bytes(s.held)
        elif s.large and s.digest.digest() not in seen:
            seen.add(s.digest.digest())
            yield from _large(_Content(raw, m.start()), seen)


def _replaced(text: str, where, pattern: re.Pattern, decode):
    """The text with each match decoded in place, and where each of its characters comes from."""
    parts, at = [], 0
    spans = [] if where is None or isinstance(where, list) else None
    for m in pattern.finditer(text):
        got = decode(m[0])
        parts += [text[at : m.start()], *(c for c, _ in got)]
        if spans is not None:
            spans += [_span(where, i, i + 1) for i in range(at, m.start())]
            spans += [_span(where, m.start() + a, m.start() + b) for _, (a, b) in got]
        at = m.end()
    parts.append(text[at:])
    if spans is not None:
        spans += [_span(where, i, i + 1) for i in range(at, len(text))]
    return "".join(parts), None, where if spans is None else spans


def _span(where, start: int, end: int) -> tuple[int, int]:
    """The stretch of the original for a stretch of a layer: where is None for the original, a list by character, or one stretch for all."""
    if where is None:
        return start, end
    return (where[start][0], where[end - 1][1]) if isinstance(where, list) else where


def _percent(run: str):
    raw = bytes.fromhex(run.replace("%", ""))
    out, i = [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4 if raw[i] >> 3 == 30 else 0
        try:
            out.append((raw[i : i + n].decode("utf-8") if n else raw[i : i + 1].decode("latin-1"), (3 * i, 3 * (i + max(n, 1)))))
        except UnicodeDecodeError:
            out.append((raw[i : i + 1].decode("latin-1"), (3 * i, 3 * i + 3)))
            n = 1
        i += max(n, 1)
    return [x for x in out if x[0]]


def _escapes(run: str):
    units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
    out, i = [], 0
    while i < len(units):
        pair = 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000
        code = 0x10000 + ((units[i] & 0x3FF) << 10 | units[i + 1] & 0x3FF) if pair else units[i]
        out.append((chr(code) if pair or not 0xD800 <= code < 0xE000 else "�", (6 * i, 6 * (i + 1 + pair))))
        i += 1 + pair
    return out


def _from_base64(run: str):
    """The bytes of a run at each of the four places where its base64 may begin."""
    core = run.rstrip("=").replace("-", "+").replace("_", "/")
    for skip in range(4):
        part = core[skip : len(core) - (len(core) - skip) % 4 if (len(core) - skip) % 4 == 1 else len(core)]
        if part:
            yield base64.b64decode(part + "=" * (-len(part) % 4))


def _below(text: str, raw: bytes | None, where):
    """(content, its bytes or None, where it comes from) of each layer right below one."""
    for mark, pattern, decode in (("%", PERCENT, _percent), ("\\u", ESCAPES, _escapes)):
        if mark in text and pattern.search(text):
            yield _replaced(text, where, pattern, decode)
    runs = [(m, m[0]) for m in BASE64.finditer(text)]
    if "\n" in text:
        runs += [(m, BREAK.sub("", m[0])) for m in WRAPPED.finditer(text)]
    for m, run in runs:
        for inner in _from_base64(run):
            yield inner.decode("utf-8", "replace"), inner, _span(where, m.start(), m.end())
    for inner in _unpacked(raw) if raw else ():
        yield inner.decode("utf-8", "replace"), None if isinstance(inner, _Part) else inner, where


def layers(text: str):
    """(content, where it comes from) of every layer below the text, each once."""
    seen, work = {text}, [_below(text, None, None)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        content, raw, where = layer
        # Places matter below base64 only, where equal contents stand for different runs.
        key = (hashlib.md5(raw).digest(), where) if raw is not None else hashlib.md5(content.encode("utf-8", "surrogatepass")).digest() + repr(where if isinstance(where, tuple) else "").encode()
        if key not in seen:  # else a cycle, or the same by another way
            seen.add(key)
            yield content, where
            work.append(_below(content, raw, where))


def secrets_of(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """(base spans, all spans with their depth flag: 0 as it stands, 1 unwrapped), each sorted by start, then kind."""
    text = text or ""
    base = sorted(((s, k, e) for s, e, k in scan(text)))
    every = {(s, k, e): 0 for s, k, e in base}
    for layer, where in layers(text):
        for s, e, k in scan(layer):
            a, b = _span(where, s, e)
            every.setdefault((a, k, b), 1)
    return [(s, e, k) for s, k, e in base], [(s, e, k, every[s, k, e]) for s, k, e in sorted(every)]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[x[2]]}:{x[0]}:{x[1]}" for x in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int,unwrapped:boolean>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, counts and digest of the base spans, all spans as a string and as structs), a row per row of docs; no shuffle."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b["text"]:
                base, every = secrets_of(t)
                n = [sum(x[2] == k for x in base) for k in range(3)]
                found = [{"kind": KINDS[k], "start": s, "end": e, "unwrapped": bool(u)} for s, e, k, u in every]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), found))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])
            out.insert(0, "id", b["id"])
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.selectExpr(f"`{id_col}` as id", f"`{text}` as text")
    return d.mapInPandas(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
