"""Secret scans with a recursive decoding worklist."""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table, text_batches

#: Fixed patterns of the base kinds, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32}")
KEYWORDS = ("passw", "secret", "token", "api")
#: What the layers of one document that are held may add up to: so much and as often its length. Compressed data beyond
#: that are read in windows, which overlap, up to MOST_STREAMED bytes a document; what is left wrapped then is counted.
MOST_UNPACKED, MOST_TIMES = 1 << 26, 8
MOST_STREAMED, WINDOW, OVERLAP = 1 << 30, 1 << 23, 1 << 20
#: The shortest base64 that can hold a finding: 32 equal digits in zlib.
LEAST_BASE64 = 15
BASE64 = (re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{%d,}={0,2}" % LEAST_BASE64), re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{%d,}={0,2}" % LEAST_BASE64))
#: Lines that end and go on with characters of base64.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
URL_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: A mark of layers left wrapped among the kinds, and the lines of a text whose escapes are left.
REFUSED = -1
ESCAPED_LINE = re.compile(r"(?m)^.*(?:%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}).*$")
UNICODE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})")
#: Runs that may be URL escapes of compressed data, and how such data begin.
PRINTABLE = re.compile(r"[!-~]+")
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x9c\xda]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings: leftmost, non-overlapping within a kind; short ones are dropped."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    at = LONG_HEX.search(text)
    while at:
        # The run of hexadecimal digits around the first 32 that match starts there, as the search is leftmost.
        run = HEX.match(text, at.start())
        found.append((run.start(), 2, run.end()))
        at = LONG_HEX.search(text, run.end())
    return sorted(found)


DAMAGED = (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError)


def _text(raw: bytes) -> str:
    """raw as UTF-8, or each byte as a character: findings are ASCII, so bytes that are no text hide none around them."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _decompressor(raw: bytes) -> Callable | None:
    """What unwraps data of raw's magic number."""
    if raw[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if raw[:1] == b"\x78":
        return zlib.decompressobj
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    return None


def _member(new: Callable, raw: bytes, most: int) -> tuple[bytes, bytes, bool]:
    """(inside, after, whole) of the stream that raw begins with; of damaged data what comes before the damage."""
    try:
        d = new()
        return d.decompress(raw, most), d.unused_data, True
    except DAMAGED:
        d, out, size = new(), [], 0
    try:
        for k in range(len(raw)):
            out.append(d.decompress(raw[k : k + 1]))
            size += len(out[-1])
            if size >= most:
                break
    except DAMAGED:
        pass
    return b"".join(out)[:most], raw, False


def _stream(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What pieces hold, unwrapped as long as it begins as compressed data do, a window at a time; ends at damage."""
    first = next(pieces, b"")
    if not _decompressor(first):
        yield first
        yield from pieces
        return

    def inside(data: bytes) -> Iterator[bytes]:
        while new := _decompressor(data):
            d = new()
            while not d.eof:
                try:
                    out = d.decompress(data, WINDOW)
                except DAMAGED:
                    return
                if out:
                    yield out
                data = getattr(d, "unconsumed_tail", b"")
                if not data and not d.eof and not out and (data := next(pieces, b"")) == b"":
                    return
            data = d.unused_data.lstrip(b"\0") or next(pieces, b"")
        yield data
        yield from pieces

    yield from _stream(inside(first))


class Unpacker:
    """Unwraps compressed bytes by their magic numbers, within one document's allowance.

    cut counts what it refused, and refused has the spans of it in the document, as findings have them.
    """

    def __init__(self, room: int, streamed: int = MOST_STREAMED):
        self.room, self.streamed, self.cut, self.known, self.refused = room, streamed, 0, {}, []

    def takes(self, size: int) -> bool:
        fits = size <= self.room
        self.room -= size if fits else 0
        return fits

    def _inside(self, raw: bytes) -> tuple[bytes, bytes]:
        """What all streams one after another at the start of raw hold, and the bytes after them; at most one byte more than there is room for."""
        out, size = [], 0
        while size <= self.room and (new := _decompressor(raw)):
            part, after, whole = _member(new, raw, self.room + 1 - size)
            out.append(part)
            size += len(part)
            if not whole:
                break
            # Streams may be padded.
            raw = after.lstrip(b"\0")
        return b"".join(out), raw

    def kinds(self, raw: bytes) -> frozenset[int]:
        """Kinds found in data that are too large to hold, read in windows; REFUSED among them if not all could be read.

        A finding or a layer in them of more than OVERLAP bytes may be cut by a window.
        """
        found, tail = set(), b""
        for part in (piece[k : k + WINDOW] for piece in _stream(iter([raw])) for k in range(0, len(piece), WINDOW)):
            self.streamed -= len(part)
            if self.streamed < 0:
                self.cut += 1
                return frozenset({*found, REFUSED})
            inner = Unpacker(MOST_TIMES * WINDOW, self.streamed)
            found |= {kind for _, kind, _ in all_spans(_text(tail + part), inner)[1]}
            found |= {REFUSED} if inner.cut else set()
            self.streamed, self.cut = inner.streamed, self.cut + inner.cut
            tail = (tail + part)[-OVERLAP:]
        return frozenset(found)

    def texts(self, raw: bytes) -> list[str | frozenset[int]]:
        """raw as texts, unwrapped until nothing is compressed: what streams hold, and what is beside them; kinds if too large."""
        out, seen, work = [], {raw}, [raw]
        while work:
            data = work.pop()
            inside, rest = self._inside(data)
            if inside and inside not in seen and not self.takes(len(inside)):
                out.append(self.kinds(data))
                continue
            if rest:
                out.append(_text(rest) if self.takes(len(rest)) else self.kinds(rest))
            if inside and inside not in seen:
                seen.add(inside)
                work.append(inside)
        return out

    def run(self, core: str) -> list[str | frozenset[int]]:
        """The texts in a base64 run without padding; the layers of a text repeat its runs, and each is unwrapped once."""
        if core not in self.known:
            # One character over stands for no byte.
            core_ = core[: len(core) - (len(core) % 4 == 1)].replace("-", "+").replace("_", "/")
            self.known[core] = self.texts(base64.b64decode(core_ + "=" * (-len(core_) % 4)))
        return self.known[core]

    def escaped(self, run: str) -> list[str | frozenset[int]]:
        """The texts in compressed data that a run holds in URL escapes."""
        out, raw, at = [], unquote_to_bytes(run), 0
        while m := MAGIC.search(raw, at):
            at = m.end()
            try:
                begins = bool(_decompressor(raw[m.start() : m.start() + 6])().decompress(raw[m.start() : m.start() + 4096], 1))
            except DAMAGED:
                continue
            if begins:
                out += self.texts(raw[m.start() :])
                break
        return out


def allowance(text: str) -> Unpacker:
    return Unpacker(MOST_UNPACKED + MOST_TIMES * len(text))


class Origin:
    """Where the characters of a decoded text start in the text it comes from: decoded and original starts of its pieces."""

    def __init__(self) -> None:
        self.inner, self.outer = [], []

    def add(self, inner: int, outer: int) -> None:
        self.inner.append(inner)
        self.outer.append(outer)

    def __getitem__(self, place: int) -> int:
        k = bisect_right(self.inner, place) - 1
        return self.outer[k] + place - self.inner[k]


def _decoded(text: str, escapes: re.Pattern, decode: Callable[[re.Match], list[tuple[str, int]]]) -> tuple[str, Origin] | None:
    """The whole text with its escapes replaced by the (character, size) pairs they stand for; None if it has none."""
    out, origin, at, place = [], Origin(), 0, 0
    for m in escapes.finditer(text):
        origin.add(at, place)
        out.append(text[place : m.start()])
        at, place = at + m.start() - place, m.start()
        for char, size in decode(m):
            origin.add(at, place)
            out.append(char)
            at, place = at + 1, place + size
    if not out:
        return None
    origin.add(at, place)
    out.append(text[place:])
    return "".join(out), origin


def _url(m: re.Match) -> list[tuple[str, int]]:
    """Escapes that are no UTF-8 stand for bytes."""
    raw = unquote_to_bytes(m[0])
    try:
        return [(c, 3 * len(c.encode("utf-8"))) for c in raw.decode("utf-8")]
    except UnicodeDecodeError:
        return [(c, 3) for c in raw.decode("latin-1")]


def _unicode(m: re.Match) -> list[tuple[str, int]]:
    code = int(m[1] or m[2] or m[3] or m[4], 16)
    # What no character has as its number stands for itself.
    return [(chr(code), len(m[0]))] if code < 0x110000 else [(c, 1) for c in m[0]]


def base64_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, run without padding) of base64 in either alphabet, on one line or wrapped.

    Wrapped lines are of one width but for a shorter last; each such block is a run. As its first line may be of another
    width and widths may vary, it is also one with the line before it, and so are all lines together.
    """
    for kind in BASE64:
        for m in kind.finditer(text):
            yield m.start(), m.end(), m[0].rstrip("=")
    for m in WRAPPED.finditer(text) if "\n" in text else ():
        lines = [(x.start() + m.start(), x[0]) for x in LINE.finditer(m[0])]
        blocks, k = {(0, len(lines))}, 0
        while k < len(lines) - 1:
            width, to = len(lines[k][1]), k + 1
            while to < len(lines) and len(lines[to][1]) == width:
                to += 1
            short = to < len(lines) and len(lines[to][1]) < width
            blocks |= {(k, to + short), (max(k - 1, 0), to + short)}
            # The shorter line may as well begin the next block.
            k = to
        for k, to in sorted(blocks):
            core = "".join(line for _, line in lines[k:to])
            if to - k > 1 and len(core) >= LEAST_BASE64:
                yield lines[k][0], m.end() if to == len(lines) else lines[to - 1][0] + len(lines[to - 1][1]), core


def layers(text: str, unpack: Unpacker) -> Iterator[tuple[int, int, str | frozenset[int], Origin | None]]:
    """(start, end, decoded, origin): the whole text without URL escapes, without Unicode escapes, and each base64 run.

    Text around an escape stays with it, as a finding may reach over both. origin has the place of each decoded
    character and of the end; None if they stand for the run as a whole. decoded is the kinds found in it if it was too
    large to hold.
    """
    if "%" in text and (more := _decoded(text, URL_ESCAPES, _url)):
        yield 0, len(text), *more
        for m in PRINTABLE.finditer(text):
            if "%" in m[0]:
                for out in unpack.escaped(m[0]):
                    yield m.start(), m.end(), out, None
    if ("\\u" in text or "\\x" in text) and (more := _decoded(text, UNICODE_ESCAPE, _unicode)):
        yield 0, len(text), *more
    for start, end, core in base64_runs(text):
        for out in unpack.run(core):
            if out != "":
                yield start, end, out, None


def all_spans(text: str, unpack: Unpacker | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all) spans of a text; a finding in a layer has the span that the layer's characters stand for.

    A worklist unwraps every different layer once, until none is new, so cycles end. An allowance bounds what layers that
    are held add up to, and compressed data beyond it are read in windows; what is refused at last, of texts made to
    unpack without end, is known by its spans. Both are then carried outwards, to all places a layer is
    wrapped in, until no text gets a new one.
    """
    base = base_spans(text)
    unpack = unpack or allowance(text)
    found, wraps, work = {text: set(base)}, {}, [text]
    while work:
        layer = work.pop()
        for start, end, inner, origin in layers(layer, unpack):
            if isinstance(inner, frozenset):
                found[layer] |= {(start, kind, end) for kind in inner}
                continue
            if inner not in found:
                # What a run holds has its room already.
                if origin is not None and not unpack.takes(len(inner)):
                    unpack.cut += 1
                    found[layer] |= {(m.start(), REFUSED, m.end()) for m in ESCAPED_LINE.finditer(layer)}
                    continue
                found[inner] = set(base_spans(inner))
                work.append(inner)
            wraps.setdefault(inner, []).append((layer, start, end, origin))
    work = [layer for layer in wraps if found[layer]]
    while work:
        inner = work.pop()
        for layer, start, end, origin in wraps.get(inner, []):
            new = {(start, k, end) if origin is None else (start + origin[s], k, start + origin[e]) for s, k, e in found[inner]} - found[layer]
            if new:
                found[layer] |= new
                work.append(layer)
    unpack.refused = sorted(s for s in found[text] if s[1] == REFUSED)
    return base, sorted(s for s in found[text] if s[1] != REFUSED)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each union of overlapping spans replaced by the mark."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """All columns of docs, with found: counts of base kinds, base and spans as text, the redacted text, and n_cut.

    n_cut counts the layers left wrapped, as all of their document would exceed its allowance. They are redacted too:
    a base64 run, or the lines with escapes.

    Spans are kind:start:end by start, then kind, then end, in code points, the end exclusive. Null counts as empty;
    ties and repeated rows are rows of their own; an empty table gives no rows. A column named found is replaced.
    """
    text_batches(docs.sparkSession)

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, base string, spans string, redacted string, n_cut bigint")
    def found(texts: pd.Series) -> pd.DataFrame:
        whole = [t or "" for t in texts]
        unpackers = [allowance(t) for t in whole]
        spans = [all_spans(t, u) for t, u in zip(whole, unpackers, strict=True)]
        out = {f"n_{name}": [sum(x[1] == k for x in base) for base, _ in spans] for k, name in enumerate(KINDS)}
        out |= {"base": [_named(b) for b, _ in spans], "spans": [_named(s) for _, s in spans]}
        # Only texts with a finding or a refused layer travel back.
        out["redacted"] = [redact(t, [*s, *u.refused]) if s or u.refused else None for t, (_, s), u in zip(whole, spans, unpackers, strict=True)]
        out["n_cut"] = [u.cut for u in unpackers]
        return pd.DataFrame(out).astype({name: "int64" for name in out if name.startswith("n_")})

    return docs.withColumn("found", found(F.coalesce("text", F.lit(""))))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found.*")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_cut")


QUERIES = {"op5_secrets": op5_secrets}
ORACLES: dict[str, str] = {}
