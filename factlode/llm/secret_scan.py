"""Secrets in texts and in what texts encode: a worklist of decoded layers, each scanned again and mapped back."""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from factlode.llm.rows import map_slices, text_rows

# The contract's kinds in their order. Longer forms of the last two match what remains after the length rule.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: The shortest secret, such as token=abcdef, has 12 bytes: 16 characters of base64 and 24 hexadecimal digits.
HEX_BYTES = re.compile(r"(?:[0-9A-Fa-f]{2}){12,}")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{24,}")
#: Runs that go on in the next lines, possessive so that no run is read twice.
LINE = re.compile(r"[A-Za-z0-9+/_-]++={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+(?:\r\n?|\n)[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
GZIP, ZLIB = b"\x1f\x8b\x08", (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
HEADER = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: What is readable of decoded bytes: stretches of UTF-8 of at least the length of the shortest secret.
READABLE = re.compile(
    rb"(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}+")
#: Compressed layers are inflated and scanned in windows of this many bytes. Neighbouring windows share OVERLAP bytes, and blanks in a row
#: beyond BLANKS are left out where windows meet, so that no pattern is cut by a window's end.
WINDOW, OVERLAP = 1 << 20, 1 << 14
BLANKS = re.compile(rb"\x20{64,}+")


@dataclass(frozen=True)
class Layer:
    """A decoded text. starts and ends give, for each of its characters, the span of the original text it comes from."""

    text: str
    starts: np.ndarray
    ends: np.ndarray


def scan(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, number of the kind) of the base spans."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            yield m.start(), m.end(), 0
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield m.start(), m.end(), 1
    for m in HEX.finditer(text):
        yield m.start(), m.end(), 2


def _url(layer: Layer) -> Layer | None:
    """All percent sequences that are UTF-8, decoded at once; each character keeps the span of its bytes."""
    return _replaced(layer, PERCENT, lambda m: _utf8(bytes.fromhex(m.replace("%", "")), 3))


def _unicode(layer: Layer) -> Layer | None:
    def decode(match: str):
        code = int(match.strip("\\ux{}"), 16)
        return [(chr(code), 0, len(match))] if code < 0x110000 and not 0xD800 <= code < 0xE000 else None

    return _replaced(layer, ESCAPE, decode)


def _utf8(data: bytes, width: int) -> list[tuple[str, int, int]] | None:
    """Characters with their place, if each byte takes `width` characters of the encoded form."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    made, at = [], 0
    for c in text:
        size = len(c.encode())
        made.append((c, at * width, (at + size) * width))
        at += size
    return made


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    pieces, starts, ends, last = [], [], [], 0
    for m in pattern.finditer(layer.text):
        made = decode(m[0])
        if made is None:
            continue
        pieces += [layer.text[last : m.start()], *(c for c, _, _ in made)]
        starts += [layer.starts[last : m.start()], layer.starts[[m.start() + a for _, a, _ in made]]]
        ends += [layer.ends[last : m.start()], layer.ends[[m.start() + b - 1 for _, _, b in made]]]
        last = m.end()
    if not pieces:
        return None
    return Layer("".join([*pieces, layer.text[last:]]), np.concatenate([*starts, layer.starts[last:]]), np.concatenate([*ends, layer.ends[last:]]))


def _inflated(data: bytes, chunk: int = WINDOW) -> Iterator[bytes]:
    """The content of gzip or zlib bytes, piece by piece; what comes before a damaged place counts."""
    reader, rest = zlib.decompressobj(wbits=47), data
    while rest and not reader.eof:
        try:
            piece = reader.decompress(rest, chunk)
        except zlib.error:
            return
        rest = reader.unconsumed_tail
        if piece:
            yield piece
        elif not rest:
            return


def _packed_end(data: bytes) -> int:
    """How many of the bytes belong to the compressed stream at their start."""
    reader, rest = zlib.decompressobj(wbits=47), data
    try:
        while rest and not reader.eof:
            reader.decompress(rest, WINDOW)
            rest = reader.unconsumed_tail
    except zlib.error:
        return len(data)
    return len(data) - len(reader.unused_data) if reader.eof else len(data)


def _windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces joined to windows that overlap: memory holds one of them, however far a layer inflates."""
    held = b""
    for piece in pieces:
        held += piece
        if len(held) >= WINDOW + OVERLAP:
            yield held
            held = BLANKS.sub(b" " * 64, held[-4 * OVERLAP :])[-OVERLAP:]
    if held:
        yield held


def _stretch(text: str, start: int, end: int) -> Layer:
    """A text all of whose characters come from one span."""
    return Layer(text, np.broadcast_to(np.int32(start), len(text)), np.broadcast_to(np.int32(end), len(text)))


def _unpacked(data: bytes, start: int, end: int) -> Iterator[Layer]:
    """Readable stretches of a compressed layer, and of compressed layers right inside it, window by window."""
    streams, depth = [_inflated(data)], 0
    first = next(streams[0], b"")
    while first[:2] in ZLIB or first[:3] == GZIP:  # a stream inside a stream: inflated as it comes
        streams.append(_reinflated(first, streams[-1]))
        inner = next(streams[-1], b"")
        depth += 1
        if not inner or depth > 64 and inner == first:
            break
        first = inner
    for window in _windows(_chained(first, streams[-1])):
        for m in READABLE.finditer(window):
            yield _stretch(m[0].decode(), start, end)


def _chained(first: bytes, more: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from more


def _reinflated(first: bytes, more: Iterator[bytes]) -> Iterator[bytes]:
    reader = zlib.decompressobj(wbits=47)
    for piece in _chained(first, more):
        rest = piece
        while rest and not reader.eof:
            try:
                out = reader.decompress(rest, WINDOW)
            except zlib.error:
                return
            rest = reader.unconsumed_tail
            if out:
                yield out
            elif not rest:
                break
        if reader.eof:
            return


def _opened(layer: Layer, data: bytes, places: np.ndarray, per: tuple[int, int]) -> Iterator[Layer]:
    """Layers that bytes hold, which are written in the characters at these places, `per` characters for so many bytes: compressed
    streams wherever one begins, and every readable stretch of the rest, so that a few other bytes do not hide it."""
    span = lambda at, to: (at * per[0] // per[1], min(-(-to * per[0] // per[1]), len(places)) - 1)
    at = 0
    for m in HEADER.finditer(data):
        if m.start() < at:
            continue
        end = m.start() + _packed_end(data[m.start() :])
        first, last = span(m.start(), end)
        layers = _unpacked(data[m.start() : end], int(layer.starts[places[first]]), int(layer.ends[places[last]]))
        made = next(layers, None)
        if made is not None:
            yield made
            yield from layers
            at = end
    for m in READABLE.finditer(data):
        text = m[0].decode()
        encoded = np.frombuffer(m[0], dtype=np.uint8)
        begins = np.flatnonzero((encoded & 0xC0) != 0x80) + m.start()
        stops = np.append(begins[1:], m.end())
        lasts = np.minimum(-(-stops * per[0] // per[1]), len(places)) - 1
        yield Layer(text, layer.starts[places[begins * per[0] // per[1]]], layer.ends[places[lasts]])


def _line_ranges(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring lines that may be one block: all lines, and each series of lines of equal length, with and without the
    lines before and after. The longest come first."""
    n, i = len(sizes), 0
    yield from ((a, b) for a, b in ((0, n), (0, n - 1), (1, n), (1, n - 1)) if b - a > 1)
    while i < n:
        j = i + 1
        while j < n and sizes[j] == sizes[i]:
            j += 1
        yield from ((a, b) for a, b in ((i - 1, j + 1), (i, j + 1), (i - 1, j), (i, j)) if a >= 0 and b <= n and b - a > 1)
        i = j


def _wrapped(layer: Layer) -> Iterator[Layer]:
    """Layers of blocks of base64 or hexadecimal bytes that are broken into lines. What a longer block showed isn't opened again."""
    for m in WRAPPED.finditer(layer.text):
        lines = [(x.start(), x.end()) for x in LINE.finditer(layer.text, m.start(), m.end())]
        if sum(b - a for a, b in lines) < 16:
            continue
        before = [0]
        for a, b in lines:
            before.append(before[-1] + b - a)
        whole, tried = [], set()
        for i, j in _line_ranges([b - a for a, b in lines]):
            size = before[j] - before[i]
            if size < 16 or (i, j) in tried:
                continue
            tried.add((i, j))
            digits = "".join(layer.text[a:b] for a, b in lines[i:j])
            places = np.concatenate([np.arange(a, b) for a, b in lines[i:j]])
            for decode, per in ((_from_base64, (4, 3)), (_from_hex, (2, 1))):
                if any(a <= i and j <= b and p == per and (before[i] - before[a]) % per[0] == 0 for a, b, p in whole):
                    continue
                if per == (2, 1) and not HEX_BYTES.fullmatch(digits):
                    continue
                data = decode(digits)
                found = False
                for made in _opened(layer, data, places, per):
                    found = True
                    yield made
                if found:
                    whole.append((i, j, per))


def _blocks(layer: Layer) -> Iterator[Layer]:
    """Layers of each run of base64 or hexadecimal digits. Its alphabet also holds what stands before a block, such as the slashes of a
    path, so a run is decoded from each of the places at which a group of digits can begin: four for base64, two for hexadecimal."""
    for pattern, decode, per in ((BASE64, _from_base64, (4, 3)), (HEX_RUN, _from_hex, (2, 1))):
        for m in pattern.finditer(layer.text):
            for shift in range(min(per[0], len(m[0]))):
                yield from _opened(layer, decode(m[0][shift:]), np.arange(m.start() + shift, m.end()), per)
    if "\n" in layer.text or "\r" in layer.text:
        yield from _wrapped(layer)


def _from_base64(run: str) -> bytes:
    """The bytes of all whole groups and of the digits that are left."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    return binascii.a2b_base64(body[: len(body) - (len(body) % 4 == 1)] + "=" * (-len(body) % 4 % 3))


def _from_hex(run: str) -> bytes:
    return bytes.fromhex(run[: len(run) // 2 * 2])


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each as sorted (start, kind number, end) of the text itself.

    Layers wait in a worklist until none is left. A layer whose content came up before is not opened again, so layers that decode into
    each other end; a span found in a layer counts from the first to the last original character it comes from.
    """
    base = sorted((a, k, b) for a, b, k in scan(text))
    found, seen = set(base), {hashlib.blake2b(text.encode(), digest_size=16).digest()}
    work = [Layer(text, np.arange(len(text), dtype=np.int32), np.arange(1, len(text) + 1, dtype=np.int32))]
    while work:
        layer = work.pop()
        new = [made for made in (_url(layer), _unicode(layer)) if made] if "%" in layer.text or "\\" in layer.text else []
        for made in [*new, *_blocks(layer)]:
            # the same content elsewhere in the text is another layer, the same content in the same place is a cycle
            if not made.text:
                continue
            key = hashlib.blake2b(f"{made.starts[0]}:{made.ends[-1]}:".encode() + made.text.encode(), digest_size=16).digest()
            if key in seen:
                continue
            seen.add(key)
            found.update((int(made.starts[a]), k, int(made.ends[b - 1])) for a, b, k in scan(made.text))
            work.append(made)
    return base, sorted(found)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, then n_decoded (spans that only decoded layers show), one row for each row.

    Spans are code points of the text, end exclusive, by start, kind and end. A null text counts as empty. Null ids, repeated rows and
    further columns change nothing. Compressed layers of any size are inflated window by window; all spans in one are its own whole span.
    """

    def make():
        def work(part):
            columns = {name: [] for name in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded")}
            for text in part["text"]:
                base, spans = find_secrets(text or "")
                for k, name in enumerate(KINDS):
                    columns[f"n_{name}"].append(sum(1 for s in base if s[1] == k))
                columns["base_sha256"].append(hashlib.sha256(_written(base).encode()).hexdigest())
                columns["spans"].append(_written(spans))
                columns["n_decoded"].append(len(spans) - len(base))
            return {"doc_id": part["doc_id"], **columns}

        return work

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long"
    return map_slices(text_rows(docs, id_column, text_column), schema, make)
