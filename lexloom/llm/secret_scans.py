"""Secret scans with a recursive decoding worklist.

Each text is a layer. A layer is scanned for the three kinds; then everything encoded in it is unwrapped (URL escapes,
\\u, \\x and octal escapes, base64, gzip/zlib/bz2/xz streams) into child layers that carry a map back to the code points of the
text, until no new layer appears. Bytes that are not UTF-8 are layers too, byte by byte, so streams are found behind every
decoder, at any position and within each other; bytes of which every other one is zero are UTF-16. Base64 runs are read from each
of four characters and over line breaks, real ones, escaped ones and quotes joined by a plus sign. A digest of each layer stops cycles. Spans found in deeper layers are reported at the
code points that encode them, unless a base span of the same kind covers them already.

Defined results: null or empty text has no spans; repeated rows are scanned each for itself; a null doc_id is kept.
A map over whole texts: no shuffle. A compressed stream is scanned to its end, over MAX_LAYER bytes in chunks that share
half, one at a time; something encoded within such a stream is decoded whole if it is shorter than half a chunk.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import common

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
#: Maximal runs, so the least length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6
MAX_LAYER = 1 << 26
URL = re.compile(r"%[0-9A-Fa-f]{2}")
#: Exactly four digits after a bare \u, whatever follows; up to six stand in braces only.
ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\[0-3][0-7]{2}")
HIGH_ESCAPE = re.compile(r"\\x[89a-fA-F][0-9A-Fa-f]|\\u00[89a-fA-F][0-9A-Fa-f]|\\[23][0-7]{2}")
BYTE_ESCAPE = re.compile(ESCAPE.pattern + r"""|\\[abfnrtv0\\'"]""")
SHORT = {"a": b"\a", "b": b"\b", "f": b"\f", "n": b"\n", "r": b"\r", "t": b"\t", "v": b"\v", "0": b"\0", "\\": b"\\", "'": b"'", '"': b'"'}
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: What a run is broken by: a line's end, one that is written as an escape, or quotes joined by a plus sign.
BREAK = r"""(?:\r?\n[ \t]*+|(?:\\r)?\\n|["']\s*+\+\s*+["'])"""
WRAP = re.compile(BREAK)
WRAPPED = re.compile(rf"[A-Za-z0-9+/_-]++(?:{BREAK}[A-Za-z0-9+/_-]++)++={{0,2}}")
BEFORE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++{BREAK}\Z")
#: Where a run wrapped over lines of under 16 characters may begin, and the least length of such a line.
NARROW = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{4,15}}{BREAK}(?=[A-Za-z0-9+/_-])")
#: Heads of zlib streams: method 8, any window, no dictionary, and a check that both bytes are a multiple of 31.
_ZLIB = "".join(f"|{re.escape(chr(c))}[{''.join(re.escape(chr(f)) for f in range(256) if (c * 256 + f) % 31 == 0 and not f & 32)}]" for c in range(0x08, 0x79, 16))
#: Heads of gzip, bz2, xz and zlib streams; behind those of unusual windows, which may be letters, soon something that isn't one.
STREAM = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]|(?:" + _ZLIB[1:].encode("latin-1") + rb")(?=[\x00-\xff]{0,23}[\x00-\x08\x0e-\x1f\x7f-\xff])")
STREAM_TEXT = re.compile(STREAM.pattern.decode("latin-1"))
#: Bytes without any of these hold no secret and nothing to decode.
HOLDS = re.compile(rb"AKIA|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)|%[0-9A-Fa-f]{2}|\\[uUx]|\\[0-3][0-7]{2}|[A-Za-z0-9+/_-]{16}|" + STREAM.pattern)

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"


def _line_run(text: str, start: int) -> int:
    """Where the wrapped run begins that holds the run at a position: lines before it that are shorter runs belong to it."""
    while m := BEFORE.search(text, max(0, start - 200), start):
        start = m.start()
    return start


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base match in one layer."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


class Layer:
    """A text with, for each of its code points, the range of the original text that encodes it."""

    def __init__(self, text: str, lo: np.ndarray, hi: np.ndarray) -> None:
        self.text, self.lo, self.hi = text, lo, hi

    @classmethod
    def root(cls, text: str) -> Layer:
        at = np.arange(len(text), dtype=np.int64)
        return cls(text, at, at + 1)

    def span(self, start: int, end: int) -> tuple[int, int]:
        if _flat(self.lo):
            return int(self.lo[0]), int(self.hi[0])
        return int(self.lo[start:end].min()), int(self.hi[start:end].max())


def _flat(at: np.ndarray) -> bool:
    """True of one range for all: what a compressed stream holds, and all that is decoded from it, takes no memory for ranges."""
    return at.strides == (0,)


def _wide(data: bytes) -> str | None:
    """UTF-16 in which way round, if every other byte is mostly zero."""
    if len(data) < 8 or b"\0" not in data:
        return None
    zero = np.frombuffer(data, np.uint8) == 0
    even, odd = zero[::2].mean(), zero[1::2].mean()
    return "utf-16-le" if odd > 0.6 > 0.2 > even else "utf-16-be" if even > 0.6 > 0.2 > odd else None


def _layers(data: bytes, lo: np.ndarray, hi: np.ndarray) -> Iterator[Layer]:
    """The layers of bytes with their ranges: as UTF-8 or UTF-16, or byte by byte where they are not UTF-8 or may hold a stream."""
    if order := _wide(data):
        even = data[: len(data) // 2 * 2]
        units = even.decode(order, "replace")
        if 2 * len(units) == len(even):  # without pairs of surrogates a character is two bytes
            yield Layer(units, lo[: len(even) : 2] if not _flat(lo) else np.broadcast_to(lo[0], len(units)), hi[1 : len(even) : 2] if not _flat(hi) else np.broadcast_to(hi[0], len(units)))
    try:
        text = data.decode()
    except UnicodeDecodeError:
        text = None
    if text is None or (len(text) < len(data) and STREAM.search(data)):
        yield Layer(data.decode("latin-1"), lo, hi)
    if not text:
        return
    if _flat(lo):
        yield Layer(text, np.broadcast_to(lo[0], len(text)), np.broadcast_to(hi[0], len(text)))
    else:
        starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        yield Layer(text, np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts))


def _replaced(layer: Layer, pattern: re.Pattern, unit) -> Iterator[Layer]:
    """The layers with every match of pattern turned into the bytes that unit() gives for it."""
    data, lo, hi, at, flat = [], [], [], 0, _flat(layer.lo)

    def plain(a: int, b: int) -> None:
        raw = layer.text[a:b].encode("utf-8", "surrogatepass")
        if raw:
            data.append(raw)
            if not flat:
                first = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
                lo.append(layer.lo[a:b][first])
                hi.append(layer.hi[a:b][first])

    for m in pattern.finditer(layer.text):
        raw = unit(m[0])
        if raw is None:
            continue
        plain(at, m.start())
        data.append(raw)
        if not flat:
            a, b = layer.span(m.start(), m.end())
            lo.append(np.full(len(raw), a))
            hi.append(np.full(len(raw), b))
        at = m.end()
    if not at:
        return
    plain(at, len(layer.text))
    raw = b"".join(data)
    if flat:
        yield from _layers(raw, np.broadcast_to(layer.lo[0], len(raw)), np.broadcast_to(layer.hi[0], len(raw)))
    else:
        yield from _layers(raw, np.concatenate(lo), np.concatenate(hi))


def _code(found: str) -> int:
    return int(found[1:], 8) if found[1] in "0123" else int(found[2:].strip("{}"), 16)


def _escape(found: str) -> bytes | None:
    code = _code(found)
    return chr(code).encode() if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _escape_byte(found: str) -> bytes | None:
    """As _escape(), but codes under 256 are bytes, and the short escapes of a byte string count."""
    if len(found) == 2:
        return SHORT[found[1]]
    code = _code(found)
    return bytes([code]) if code < 0x100 else _escape(found)


def _pieces(raw: bytes, at: int, most: int = 1 << 20) -> Iterator[tuple[bytes, int]]:
    """What the compressed stream at a position holds, piece by piece, with the end of the input read so far. Members of
    one kind that follow directly belong to it; a stream that breaks off gives what it holds until there. Only a stream that
    comes to its end gives an empty piece last."""
    kind = None
    members = (b"\x1f", b"B", b"\xfd")
    while (m := STREAM.match(raw, at)) and (kind is None or kind == m[0][:1] and kind in members):
        kind = m[0][:1]
        zipped = kind == b"\x1f" or kind not in members
        d: Any = zlib.decompressobj(31 if kind == b"\x1f" else 15) if zipped else bz2.BZ2Decompressor() if kind == b"B" else lzma.LZMADecompressor()
        while not d.eof:
            data = d.unconsumed_tail if zipped else b""
            if not data and (zipped or d.needs_input):
                data = raw[at : at + (1 << 16)]
                at += len(data)
            try:
                out = d.decompress(data, most)
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                return
            if not out and not data:
                return
            if out:
                yield out, at - len(d.unused_data)
        at -= len(d.unused_data)
    if kind:
        yield b"", at


def _streams(layer: Layer) -> Iterator[Layer]:
    """What the compressed streams of a layer hold, wherever they begin; over MAX_LAYER bytes in chunks that share half."""
    raw = layer.text.encode("latin-1", "replace")
    at = 0
    while m := STREAM.search(raw, at):
        at = m.start() + 1
        held, size, end, out, most = [], 0, 0, b"", min(1 << 20, MAX_LAYER)
        for out, end in _pieces(raw, m.start(), most):
            size += len(out)
            held = [*held, out] if size <= MAX_LAYER else []
        if not size:
            continue
        a, b = layer.span(m.start(), end)
        if not out:  # it came to its end, so no head of a stream is lost in it
            at = end
        if size <= MAX_LAYER:
            yield from _layers(b"".join(held), np.broadcast_to(a, size), np.broadcast_to(b, size))
            continue
        held.clear()
        chunk, new = bytearray(), 0
        for out, _ in _pieces(raw, m.start(), most):
            chunk += out
            new += len(out)
            if len(chunk) >= MAX_LAYER:
                yield from _layers(bytes(chunk), np.broadcast_to(a, len(chunk)), np.broadcast_to(b, len(chunk)))
                del chunk[: len(chunk) - MAX_LAYER // 2]
                new = 0
        if new:
            yield from _layers(bytes(chunk), np.broadcast_to(a, len(chunk)), np.broadcast_to(b, len(chunk)))


def _base64(layer: Layer, start: int, end: int) -> Iterator[Layer]:
    """A run decoded from each of its first four characters, as a path, a word or a label may be glued to its front.
    Of the shifted ones and of bytes that are not text only those that hold anything to find or to decode."""
    found = layer.text[start:end]
    body = WRAP.sub("", found).rstrip("=").replace("-", "+").replace("_", "/")
    flat = _flat(layer.lo)
    if not flat:
        inside = np.ones(end - start, bool)
        for m in WRAP.finditer(found):
            inside[m.start() : m.end()] = False
        where = np.arange(start, end)[inside & (np.frombuffer(found.encode(), np.uint8) != ord("="))]
    for shift in range(4):
        part = body[shift:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        try:
            data = base64.b64decode(part + "=" * (-len(part) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        if not data or ((shift or not _is_text(data)) and not HOLDS.search(data) and not _wide(data)):
            continue
        if flat:
            lo, hi = np.broadcast_to(layer.lo[0], len(data)), np.broadcast_to(layer.hi[0], len(data))
        else:
            first = np.arange(len(data)) * 4 // 3 + shift
            lo, hi = layer.lo[where[first]], layer.hi[where[np.minimum(first + 1, len(where) - 1)]].copy()
            if (len(part) + len(found) - len(found.rstrip("="))) % 4 == 0 and len(part) + shift == len(body):
                hi[-1] = layer.hi[end - 1]  # with its padding
        yield from _layers(data, lo, hi)


def _is_text(data: bytes) -> bool:
    """Valid UTF-8 and mostly printable."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return False
    return sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.9 * len(text)


def children(layer: Layer) -> Iterator[Layer]:
    """The layers one step below."""
    if "%" in layer.text:
        yield from _replaced(layer, URL, lambda s: bytes([int(s[1:], 16)]))
    if "\\" in layer.text:
        yield from _replaced(layer, ESCAPE, _escape)
        if HIGH_ESCAPE.search(layer.text):
            yield from _replaced(layer, BYTE_ESCAPE, _escape_byte)
    if STREAM_TEXT.search(layer.text):
        yield from _streams(layer)
    last = -1
    for m in BASE64.finditer(layer.text):
        yield from _base64(layer, m.start(), m.end())
        # the lines that a run is wrapped over, as one run
        if m.start() >= last and (w := WRAPPED.match(layer.text, _line_run(layer.text, m.start()))):
            last = w.end()
            yield from _base64(layer, w.start(), w.end())
    last = -1
    for m in NARROW.finditer(layer.text):
        if m.start() >= last and (w := WRAPPED.match(layer.text, m.start())):
            last = w.end()
            lines = WRAP.split(w[0].rstrip("="))
            # of equal lines that are all short, but for the last one
            if len(lines[0]) * (len(lines) - 1) + len(lines[-1]) == sum(map(len, lines)) >= 16 and len(lines[-1]) <= len(lines[0]):
                yield from _base64(layer, w.start(), w.end())


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans and added spans of a text as (start, kind, end), and the number of layers."""
    base = scan(text)
    added: set[tuple[int, int, int]] = set()
    n = 1
    if "%" in text or "\\" in text or BASE64.search(text) or NARROW.search(text) or STREAM_TEXT.search(text):
        seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
        # depth first: of a stream in chunks one chunk is held at a time
        work = [children(Layer.root(text))]
        covers = {k: sorted((s, e) for s, kind, e in base if kind == k) for k in range(3)}
        while work:
            child = next(work[-1], None)
            if child is None:
                work.pop()
                continue
            key = hashlib.blake2b(child.text.encode("utf-8", "surrogatepass"), digest_size=16).digest() + int(child.lo[0]).to_bytes(8, "little")
            if key in seen or key[:16] in seen:
                continue
            seen.add(key)
            n += 1
            for start, kind, end in scan(child.text):
                a, b = child.span(start, end)
                # base spans of a kind don't overlap, so that only the last one that begins before can hold it
                near = bisect_right(covers[kind], (a, len(text) + 1)) - 1
                if near < 0 or covers[kind][near][1] < b:
                    added.add((a, kind, b))
            work.append(children(child))
    return base, sorted(added), n


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _rows(ids: list, texts: list[str]) -> dict:
    out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
    for i, text in zip(ids, texts, strict=True):
        base, added, n = find_secrets(text)
        out["doc_id"].append(i)
        for k, name in enumerate(KINDS):
            out[f"n_{name}"].append(sum(1 for x in base if x[1] == k))
        out["base_sha256"].append(hashlib.sha256(digest(base).encode()).hexdigest())
        out["spans"].append(digest(base + added))
        out["n_layers"].append(n)
    return out


def secret_scans(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document with its counts by kind, the digest of the base spans and all spans."""
    return common.map_texts(df, _rows, SCHEMA, text, key)


def mask(text: str, spans: str, fill: str = "[SECRET]") -> str:
    """text with every span of a spans string replaced; spans that overlap become one."""
    parts = sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in spans.split(",") if x))
    out, at = [], 0
    for s, e in parts:
        if s >= at:
            out += [text[at:s], fill]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans(common.documents(spark, sf_dir))


QUERIES = {"op4_secret_scans": op4_secret_scans}
ORACLES: dict[str, str] = {}
