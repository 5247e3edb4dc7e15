"""Secrets in texts, also under nested encodings.

Method: a worklist of layers. The text is the first; each layer is scanned, then unwrapped once by every
decoder that applies: percent escapes, Unicode escapes (of four forms, and octal), 16-bit characters, base64, and compressed bytes
(gzip with all its members, zlib, bzip2, xz; bare deflate where base64 begins with it) inside those and inside each other. Bytes that are no clean text are a layer too, with a character for each
byte (Latin-1); compressed bytes may begin anywhere in it, and may stand partly literal, partly escaped. What comes out
is a new layer with a map back to the text, and goes on the list unless the same layer was seen for the same place, so
that cycles end. The list runs empty at the fixpoint.

Escapes of escapes lose a few characters a layer, so that a text may hold as many layers as characters. The first ``DEEP`` layers of
escapes in a row are layers like others; what is still escaped then comes off at once, in one pass with a stack, which takes linear time: an
escape whose characters are complete becomes its character, which may complete another. The layers between are not scanned.

Memory: inflated layers stand for one run of the text and need no map of their characters; compressed bytes are read, and
layers searched and digested, in pieces of a megabyte. A stream that inflates to ``most`` characters takes about twice
as many bytes while it is unwrapped. Escaped layers have a map of eight bytes a character.

Defined results: null is the empty text, which has no spans. Positions are code points of the text, the end
exclusive. A secret in a decoded layer gets the span of the characters that encode it: exact for escapes,
both bytes of 16-bit characters, whole groups of four for base64 (counted from each of the first four characters of a run, and over line ends), the whole encoded run for compressed bytes. ``complete`` is false if a
document's layers have more than ``most`` newly decoded characters in all, those that a layer keeps from the one before not
counted. A layer beyond that is still scanned as far as it was decoded, but not unwrapped; all others are.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexure.llm.common import arrow_map, column, record, slices, texts_of

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_HEXES = "[0-9A-Fa-f]"
_ESCAPES = rf"[\\%]u{_HEXES}{{4}}|\\x{_HEXES}{{2}}|\\U00(?:0{_HEXES}|10){_HEXES}{{4}}|\\u\{{0{{0,6}}(?:10|{_HEXES})?{_HEXES}{{1,4}}\}}|\\[0-3][0-7]{{2}}"
_ESCAPE = re.compile(f"(?:{_ESCAPES})+")
_ONE_ESCAPE = re.compile(rf"[\\%]u({_HEXES}{{4}})|\\x({_HEXES}{{2}})|\\U({_HEXES}{{8}})|\\u\{{({_HEXES}+)\}}|\\([0-3][0-7]{{2}})")
#: Escapes of any depth are made of these characters; the forms end so.
_NESTED = re.compile(r"[%\\0-9A-Fa-fxuU{}]{3,}+")
_ENDS_ESCAPE = re.compile(rf"(?:{_ESCAPES}|%{_HEXES}{{2}})$")
DEEP = 6
#: Characters of 16 bits with a zero byte, in either order.
_WIDE = re.compile("(?:[\x09-\xff]\x00){8,}|(?:\x00[\x09-\xff]){8,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: Runs on successive lines, also where the line ends are escaped. A run is tried from its beginning only and never given back, so that long ones take linear time.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:\r?\n|\\r\\n|\\n)[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
#: Short lines, at least three; those of one length, and a shorter one after them, are joined.
_NARROW = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,15}(?:(?:\r?\n|\\r\\n|\\n)[\x20\t]*[A-Za-z0-9+/_-]{1,15}){2,}={0,2}(?![A-Za-z0-9+/_-])")
_WRAP = re.compile(r"(?:\r?\n|\\r\\n|\\n)[\x20\t]*")
_TO_STANDARD = str.maketrans("-_", "+/")
_PRINTS = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f-\x9f�]*")
#: Compressed bytes begin so inside others (zlib with its usual window); and the beginnings as escapes show them.
_STARTS = ("\x1f\x8b\x08", "x\x01", "x^", "x\x9c", "x\xda", "BZh", "\xfd7zXZ\x00")
_STREAM = re.compile("|".join(map(re.escape, _STARTS)))
_ESCAPED_STREAM = re.compile(r"(?:%|\\x|\\u00)(?:1f(?:%|\\x|\\u00)8b|9c|da|01|5e|fd)|(?:x|78)\^|BZh", re.IGNORECASE)
_BYTE = re.compile("[\x00-\xff]+")
_PERCENT_BYTE = re.compile(r"%([0-9A-Fa-f]{2})")
_FORM_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|\+")
_ESCAPE_BYTE = re.compile(r"\\(?:(?:x|u00)([0-9A-Fa-f]{2})|([abfnrtv0'\"\\]))")
_SHORT = dict(zip("abfnrtv0'\"\\", "\a\b\f\n\r\t\v\0'\"\\", strict=True))
#: What decoded base64 that is no text must hold to be looked at: the least that can hold a secret, or a beginning.
_MEANT = re.compile(rb"[\x20-\x7e]{12,}|\x1f\x8b\x08|x[\x01^\x9c\xda]|BZh[1-9]1AY|\xfd7zXZ\x00|(?:[\x20-\x7e]\x00){12,}|(?:\x00[\x20-\x7e]){12,}")
#: Text, start and end in the document of each character (none for the document itself, one of each where all characters
#: stand for the same run), and how many characters are newly decoded.
Layer = tuple[str, np.ndarray | int | None, np.ndarray | int | None, int]
STEP = 1 << 20


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the secrets in plain sight."""
    out = []
    if any(w in low for low in (text[at : at + STEP + 8].lower() for at in range(0, len(text), STEP)) for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


class _Deflate:
    """zlib's object with what bzip2's and xz's tell: how many bytes it has not used."""

    def __init__(self, bits: int) -> None:
        self.inner = zlib.decompressobj(bits)

    def __call__(self, data: bytes, most: int) -> tuple[bytes, int]:
        out = self.inner.decompress(data, most)
        return out, len(self.inner.unused_data) + len(self.inner.unconsumed_tail)

    @property
    def eof(self) -> bool:
        return self.inner.eof


class _Blocks:
    """bzip2 or xz: these hold back input of their own, which they are asked for with no more of it."""

    def __init__(self, inner: bz2.BZ2Decompressor | lzma.LZMADecompressor) -> None:
        self.inner = inner

    def __call__(self, data: bytes, most: int) -> tuple[bytes, int]:
        out = bytearray(self.inner.decompress(data, most))
        while not self.inner.eof and not self.inner.needs_input and len(out) < most:
            out += self.inner.decompress(b"", most - len(out))
        return bytes(out), len(self.inner.unused_data) if self.inner.eof else 0

    @property
    def eof(self) -> bool:
        return self.inner.eof


def _opener(head: bytes) -> Callable[[], _Deflate | _Blocks] | None:
    """What opens bytes that begin with ``head``."""
    if head[:2] == b"\x1f\x8b":
        return lambda: _Deflate(31)
    if head[:3] == b"BZh" and head[3:10] in (b"%d1AY&SY" % n for n in range(1, 10)):
        return lambda: _Blocks(bz2.BZ2Decompressor())
    if head[:6] == b"\xfd7zXZ\0":
        return lambda: _Blocks(lzma.LZMADecompressor(memlimit=256 << 20))
    zlib_head = len(head) > 2 and head[0] & 15 == 8 and head[0] >> 4 <= 7 and (head[0] << 8 | head[1]) % 31 == 0
    return (lambda: _Deflate(15)) if zlib_head else None


def _inflate(piece: Callable[[int, int], bytes], most: int, ended: bool = False) -> tuple[bytearray, int] | None:
    """The content of compressed bytes, if they are such, up to ``most`` bytes and one, and how many bytes it took.

    ``piece`` gives the bytes of a place and number, so that long runs are never copied whole; the first are few, as most
    beginnings are none. A damaged stream gives what comes before the damage. ``ended``: only if it comes to its end.
    """
    head, step = piece(0, 10), 64
    make = _opener(head)
    if make is None:
        return None
    gzip = head[:2] == b"\x1f\x8b"
    out, used = bytearray(), 0
    while True:
        member, before = make(), len(out)
        while not member.eof and len(out) <= most and (data := piece(used, step)):
            step = min(4 * step, STEP)
            try:
                new, left = member(data, most + 1 - len(out))
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                break
            out += new
            used += len(data) - left
        if ended and not member.eof and len(out) <= most:
            del out[before:]
        if not gzip or not member.eof or len(out) > most or piece(used, 2) != b"\x1f\x8b":
            return (out, used) if out else None


def _bare(data: bytes, most: int) -> tuple[bytearray, int] | None:
    """The content of deflated bytes without a head, if they come to their end and hold what is meant to be read."""
    inner = zlib.decompressobj(-15)
    try:
        out = bytearray(inner.decompress(data, most + 1))
    except zlib.error:
        return None
    whole = inner.eof and len(inner.unused_data) <= 2 or len(out) > most
    return (out, len(data)) if whole and len(out) >= 12 and (_MEANT.search(out) or _plain(out) is not None) else None


def _from(data: bytes) -> Callable[[int, int], bytes]:
    return lambda at, size: data[at : at + size]


def _plain(data: bytes | bytearray) -> str | None:
    """The text that the bytes spell, if they spell one without control characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and _PRINTS.fullmatch(text) else None


def _at(layer: Layer, start: int, end: int) -> tuple[int, int]:
    """The span in the document of a part of a layer."""
    _, low, high, _ = layer
    if low is None:
        return start, end
    return (low, high) if isinstance(low, int) else (int(low[start]), int(high[start:end].max()))


def _layer(data: bytes | bytearray, low: np.ndarray | int, high: np.ndarray | int) -> Layer:
    """A layer of bytes with a map of each: their text, or a character for each byte."""
    if (text := _plain(data)) is None:
        return data.decode("latin-1"), low, high, len(data)
    if len(text) < len(data) and not isinstance(low, int):
        at = np.cumsum([0, *(len(c.encode()) for c in text)])
        low, high = low[at[:-1]], high[at[1:] - 1]
    return text, low, high, len(text)


def _whole(data: bytes | bytearray, layer: Layer, start: int, end: int) -> Layer:
    return _layer(data, *_at(layer, start, end))


def _replaced(layer: Layer, parts: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Layer:
    """A layer with parts (start, end, new text, first and last character of the layer for each new one) put in."""
    text, low, high, _ = layer
    out, last = [], 0
    for start, end, new, _, _ in parts:
        out += [text[last:start], new]
        last = end
    joined, fresh = "".join([*out, text[last:]]), sum(len(x[2]) for x in parts)
    if isinstance(low, int):
        return joined, low, high, fresh
    firsts, lasts, last = [], [], 0
    for start, end, _, a, b in parts:
        between = np.arange(last, start, dtype=np.int32)
        firsts += [between, a]
        lasts += [between, b]
        last = end
    rest = np.arange(last, len(text), dtype=np.int32)
    first, final = np.concatenate([*firsts, rest]), np.concatenate([*lasts, rest])
    return (joined, first, final + 1, fresh) if low is None else (joined, low[first], high[final], fresh)


def _spread(text: str, start: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last character of the layer for each character, whose every byte took ``step`` characters."""
    sizes = np.fromiter((len(c.encode()) for c in text), np.int32, len(text)) if not text.isascii() else np.ones(len(text), np.int32)
    ends = start + step * np.cumsum(sizes, dtype=np.int32)
    return ends - step * sizes, ends - 1


def _byte_view(layer: Layer, token: re.Pattern, of: Callable[[re.Match], str]) -> Layer:
    """The layer with each escaped byte as one character."""
    text, low, high, _ = layer
    new, count = token.subn(of, text)
    if isinstance(low, int):
        return new, low, high, count
    at = np.fromiter((x for m in token.finditer(text) for x in m.span()), np.int32, 2 * count).reshape(-1, 2)
    inside = np.zeros(len(text) + 1, np.int8)
    inside[at[:, 0] + 1] += 1
    inside[at[:, 1]] -= 1
    first = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0).astype(np.int32)
    final = first.copy()
    final[np.searchsorted(first, at[:, 0])] = at[:, 1] - 1
    return (new, first, final + 1, count) if low is None else (new, low[first], high[final], count)


def _unpercent(layer: Layer, most: int) -> Iterator[Layer]:
    parts = []
    for m in _PERCENT.finditer(layer[0]):
        data = binascii.unhexlify(m[0].replace("%", ""))
        inner = _inflate(_from(data), most)
        if inner is not None:
            new = _whole(inner[0], layer, m.start(), m.end())
            del inner
            yield new
        elif (text := _plain(data)) is not None:
            parts.append((m.start(), m.end(), text, *_spread(text, m.start(), 3)))
        else:
            firsts = np.arange(m.start(), m.end(), 3, dtype=np.int32)
            parts.append((m.start(), m.end(), data.decode("latin-1"), firsts, firsts + 2))
    if parts:
        yield _replaced(layer, parts)
    if _ESCAPED_STREAM.search(layer[0]):
        yield from _inflated(_byte_view(layer, _PERCENT_BYTE, lambda m: chr(int(m[1], 16))), most)
        if "+" in layer[0]:
            yield from _inflated(_byte_view(layer, _FORM_BYTE, lambda m: chr(int(m[1], 16)) if m[1] else " "), most)


def _unescape(layer: Layer, most: int) -> Iterator[Layer]:
    parts = []
    for m in _ESCAPE.finditer(layer[0]):
        units, firsts, lasts = array("I"), array("i"), array("i")
        for x in _ONE_ESCAPE.finditer(layer[0], m.start(), m.end()):
            code = int(x[5], 8) if x[5] else int(x[1] or x[2] or x[3] or x[4], 16)
            if units and 0xDC00 <= code < 0xE000 and 0xD800 <= units[-1] < 0xDC00:
                units[-1] = 0x10000 + ((units[-1] - 0xD800) << 10) + code - 0xDC00
                lasts[-1] = x.end() - 1
            else:
                units.append(code)
                firsts.append(x.start())
                lasts.append(x.end() - 1)
        if max(units) < 256 and (inner := _inflate(_from(bytes(units)), most)) is not None:
            new = _whole(inner[0], layer, m.start(), m.end())
            del inner
            yield new
        text = units.tobytes().decode("utf-32-le", "surrogatepass")
        parts.append((m.start(), m.end(), text, np.frombuffer(firsts, np.int32), np.frombuffer(lasts, np.int32)))
    if parts:
        yield _replaced(layer, parts)
    if _ESCAPED_STREAM.search(layer[0]):
        yield from _inflated(_byte_view(layer, _ESCAPE_BYTE, lambda m: chr(int(m[1], 16)) if m[1] else _SHORT[m[2]]), most)


def _flat(layer: Layer) -> Iterator[Layer]:
    """The layer without any escapes: in each run of the characters that escapes are made of, each that is complete becomes its character, until none is."""
    text, parts = layer[0], []
    for m in _NESTED.finditer(text):
        if "%" not in m[0] and "\\" not in m[0]:
            continue
        codes, firsts, lasts, raw = array("I"), array("i"), array("i"), bytearray()
        for at in range(m.start(), m.end()):
            codes.append(ord(text[at]))
            firsts.append(at)
            lasts.append(at)
            raw.append(0)
            while (found := _completed(codes)) is not None:
                size, code = found
                first, last = firsts[-size], lasts[-1]
                del codes[-size:], firsts[-size:], lasts[-size:], raw[-size:]
                codes.append(code)
                firsts.append(first)
                lasts.append(last)
                raw.append(size == 3)
        if len(codes) == m.end() - m.start():
            continue
        parts.append((m.start(), m.end(), *_spelled(codes, np.frombuffer(firsts, np.int32), np.frombuffer(lasts, np.int32), raw)))
    if parts:
        yield _replaced(layer, parts)


def _completed(codes: array) -> tuple[int, int] | None:
    """The length and the character of the escape that the last characters are, if they are one."""
    last = codes[-1]
    if last > 125 or not (48 <= last <= 57 or 65 <= last <= 70 or 97 <= last <= 102 or last == 125):
        return None
    tail = "".join(map(chr, codes[-14:]))
    m = _ENDS_ESCAPE.search(tail)
    if m is None:
        return None
    one = m[0]
    if one[0] == "%" and one[1] not in "uU":
        return 3, int(one[1:], 16)
    x = _ONE_ESCAPE.fullmatch(one)
    return len(one), int(x[5], 8) if x[5] else int(x[1] or x[2] or x[3] or x[4], 16)


def _spelled(codes: array, firsts: np.ndarray, lasts: np.ndarray, raw: bytearray) -> tuple[str, np.ndarray, np.ndarray]:
    """The text of the characters: bytes of percent escapes that spell one in UTF-8 are joined, and so are halves of surrogate pairs."""
    out, keep, final = [], [], []
    at, n = 0, len(codes)
    while at < n:
        code, size = codes[at], 1
        if raw[at] and 0xC2 <= code < 0xF5:
            wide = 2 + (code >= 0xE0) + (code >= 0xF0)
            if at + wide <= n and all(raw[at : at + wide]) and max(codes[at : at + wide]) < 256:
                try:
                    code, size = ord(bytes(codes[at : at + wide]).decode()), wide
                except UnicodeDecodeError:
                    pass
        elif 0xD800 <= code < 0xDC00 and at + 1 < n and 0xDC00 <= codes[at + 1] < 0xE000:
            code, size = 0x10000 + ((code - 0xD800) << 10) + codes[at + 1] - 0xDC00, 2
        out.append(chr(code))
        keep.append(at)
        final.append(at + size - 1)
        at += size
    return "".join(out), firsts[keep], lasts[final]


def _unwide(layer: Layer) -> Iterator[Layer]:
    """The layer with characters of two bytes as one."""
    parts = []
    for m in _WIDE.finditer(layer[0]):
        firsts = np.arange(m.start(), m.end(), 2, dtype=np.int32)
        parts.append((m.start(), m.end(), m[0].replace("\0", ""), firsts, firsts + 1))
    if parts:
        yield _replaced(layer, parts)


def _inflated(layer: Layer, most: int) -> Iterator[Layer]:
    """The content of compressed bytes that begin anywhere in a layer; at its very start also if they are cut off or have a rare head."""
    text = layer[0]
    if not any(x in text for x in _STARTS) and not (text and ord(text[0]) & 15 == 8):
        return
    for run in _BYTE.finditer(text):
        first, end = run.span()
        starts, last = (m.start() for m in _STREAM.finditer(text, first, end)), first
        for at in chain([] if first or _STREAM.match(text) else [0], starts):
            if at < last:
                continue
            inner = _inflate(lambda n, size: text[at + n : min(at + n + size, end)].encode("latin-1"), most, ended=at > 0 and text[at] == "x")  # noqa: B023
            if inner is not None:
                last = at + inner[1]
                new = _whole(inner[0], layer, at, last)
                del inner
                yield new


def _unbase64(layer: Layer, most: int) -> Iterator[Layer]:
    text = layer[0]
    for m in _BASE64.finditer(text):
        yield from _aligned(layer, m[0], m.start(), None, most)
    narrow = _NARROW.finditer(text) if "\n" in text or "\\n" in text else ()
    for starts, ends in chain((x for m in _WRAPPED.finditer(text) for x in [_lines(m)]), (x for m in narrow for x in _even(*_lines(m)))):
        joined = "".join(text[a:b] for a, b in zip(starts, ends, strict=True))
        yield from _aligned(layer, joined, 0, np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)]), most)


def _lines(m: re.Match) -> tuple[list[int], list[int]]:
    """Where the lines of a match begin and end."""
    wraps = [x.span() for x in _WRAP.finditer(m.string, m.start(), m.end())]
    return [m.start(), *(e for _, e in wraps)], [*(s for s, _ in wraps), m.end()]


def _even(starts: list[int], ends: list[int]) -> Iterator[tuple[list[int], list[int]]]:
    """Of successive lines, the stretches of two or more of one length, with the shorter one that follows."""
    size = [e - s for s, e in zip(starts, ends, strict=True)]
    at = 0
    while at < len(size):
        end = at + 1
        while end < len(size) and size[end] == size[at]:
            end += 1
        if end - at > 1:
            last = end + (end < len(size) and size[end] < size[at])
            yield starts[at:last], ends[at:last]
        at = end


def _aligned(layer: Layer, run: str, start: int, places: np.ndarray | None, most: int) -> Iterator[Layer]:
    """What a run decodes to from each of its first four characters, as others may be glued before it. ``places``: of its characters in the layer, if they do not follow each other from ``start``."""
    whole = run.rstrip("=").translate(_TO_STANDARD)
    for skip in range(min(4, len(whole) - 1)):
        body = whole[skip:]
        body = body[:-1] if len(body) % 4 == 1 else body
        data = binascii.a2b_base64(body + "=" * (-len(body) % 4))
        inner = _inflate(_from(data), most)
        if inner is None and not _MEANT.search(data) and (skip or _plain(data) is None):
            inner = _bare(data, most)
            if inner is None:
                continue
        _, low, high, _ = layer
        if places is None:
            places = np.arange(start, start + len(run))
        firsts = skip + np.arange(len(data)) // 3 * 4
        ends = places[np.minimum(firsts + 4, len(run)) - 1]
        firsts = places[firsts]
        if inner is not None:
            new = _whole(inner[0], layer, int(firsts[0]), int(places[-1]) + 1)
            del inner
            yield new
        elif isinstance(low, int):
            yield _layer(data, low, high)
        else:
            yield _layer(data, (firsts if low is None else low[firsts]).astype(np.int32), (ends + 1 if high is None else high[ends]).astype(np.int32))


def _digest(text: str) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for at in range(0, len(text), STEP):
        h.update(text[at : at + STEP].encode("utf-8", "surrogatepass"))
    return h.digest()


def _unwrapped(layer: Layer, depth: int, most: int) -> Iterator[tuple[Layer, int]]:
    """The layers right under one, each with how many layers of escapes in a row it is under. ``depth``: of the layer itself."""
    text = layer[0]
    if depth < DEEP:
        escapes = [_unpercent(layer, most)] if "%" in text else []
        escapes += [_unescape(layer, most)] if "\\" in text or "%u" in text else []
    else:
        escapes = [_flat(layer)] if "%" in text or "\\" in text else []
    for new in chain(*escapes):
        yield new, depth + 1
    for new in chain(_unwide(layer) if "\0" in text else (), _inflated(layer, most), _unbase64(layer, most)):
        yield new, 0


def find_secrets(text: str | None, most: int = 1 << 28) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], bool]:
    """Spans in plain sight, all spans, and whether all layers were unwrapped; spans as ``scan`` has them, sorted."""
    text = text or ""
    base = sorted(scan(text))
    found = set(base)
    work: list[tuple[Layer, int]] = [((text, None, None, 0), 0)]
    seen: set[tuple] = set()
    spent, complete = 0, True
    while work:
        layer, depth = work.pop()
        for new, deeper in _unwrapped(layer, depth, most):
            mark = (_digest(new[0]), *(_at(new, 0, len(new[0])) if new[0] else (0, 0)))
            if mark in seen:
                continue
            seen.add(mark)
            fresh = new[3]
            for start, kind, end in scan(new[0]):
                a, b = _at(new, start, end)
                found.add((a, kind, b))
            if spent + fresh > most:
                complete = False
                continue
            spent += fresh
            work.append((new, deeper))
    return base, sorted(found), complete


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex and base_sha256 of the spans in plain sight; spans: all, joined; n_hidden; complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [find_secrets(t) for t in column(batch, "text").to_pylist()]
            counts = [[sum(s[1] == k for s in base) for base, _, _ in rows] for k in range(3)]
            yield record(
                "doc_id:long n_assign:long n_access:long n_hex:long base_sha256:string spans:string n_hidden:long complete:boolean",
                column(batch, "doc_id"), *counts, [hashlib.sha256(show(base).encode()).hexdigest() for base, _, _ in rows], [show(every) for _, every, _ in rows], [len(every) - len(base) for base, every, _ in rows], [ok for _, _, ok in rows],
            )

    return arrow_map(texts_of(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_hidden long, complete boolean")
