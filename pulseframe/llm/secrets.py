"""Secret scans with a worklist of decoded layers.

A text is scanned, then unwrapped: a copy of it with all URL escapes decoded in place, a copy with all Unicode escapes
decoded in place, each of its base64 tokens (also those that are wrapped at line ends; from each of the first four characters on, since what stands before a token may
be of its characters, too), and what compressed bytes among tokens or escapes unpack to become layers, which are scanned and unwrapped in turn until no layer yields another. Layers that were seen before are not entered again,
so cycles (as in archives that hold themselves) end. A text and its copies are a family: what has been found at some place of the family's
text, or taken from it as a token, is not reported or decoded again for a copy, nor is what touches no decoded character. Each layer knows which span of the original text
its characters came from; what is found in a layer is reported at that span, under kind@layer names such as assign@base64.

Escapes of escapes are decoded a level at a time up to LEVELS; a text with more of them gets one more copy, named deep, in which
all that is left is decoded at once, so a text of n characters costs a multiple of n, however its escapes are nested.

Bytes that aren't UTF-8 become a character each (a lone surrogate), so they hide nothing around them; broken compressed data is
unpacked up to the break, and all members of gzip data are unpacked. Gzip's and zlib's data are known wherever they begin; a gzip header whose names
don't end is none. Unpacked data streams through windows of WINDOW bytes that overlap by
OVERLAP, so its size doesn't count, not even that of archives nested in archives; a window that begins inside a base64 token begins
at a whole number of its quanta. What a window can't show is compressed data that a token longer than the window holds beyond its end.
From BOMB bytes on, unpacking ends and the place is reported as a span bomb@layer, so that it doesn't pass unseen.

Defined cases: null text counts as empty; no spans give zero counts, the SHA-256 of the empty string and an empty
list; repeated rows are scanned each; an empty table gives no rows; other columns are ignored. Texts are
scanned whole; memory is a multiple of the text and of a window.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import LOWER_ASCII, columns, table, texts, with_fields

# Fixed patterns of the base kinds and the least length of what they must hold.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # greedy runs: the same as runs of which short ones are dropped
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_HEX_MAP = bytes(49 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
SPACE = re.compile(r"\s")
BASE64_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
_B64_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
_B64_MAP = bytes(49 if b in _B64_BYTES else 32 for b in range(256))
_B64_PLAIN = str.maketrans("-_", "+/")
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")
LONE = re.compile("[\ud800-\udc7f\udd00-\udfff]")
#: Packed bytes that are unpacked at once, and the most they unpack to at once.
CHUNK, PIECE = 1 << 16, 1 << 20
#: Unpacked bytes that are scanned at once, those shared with the next window, and those at which unpacking ends.
WINDOW, OVERLAP, BOMB = 4 << 20, 1 << 18, 1 << 30
#: Decodings of escapes one after the other that are scanned each.
LEVELS = 6

Span = tuple[str, int, int]


def base_spans(text: str, raw: bytes | None = None) -> list[Span]:
    """(kind, start, end) of the base kinds in one layer; raw: the text in UTF-8, if it is at hand."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    low, found = raw.translate(LOWER_ASCII), []
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if b"1" * 24 in raw.translate(_HEX_MAP):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text of a family; up maps a span of the family's own text to one of the original text.

    Decoded character at[i] came from [starts[i], ends[i]) of the family's text; the others were copied.
    """

    def __init__(self, text: str, name: str = "", up: Callable[[int, int], tuple[int, int]] = lambda s, e: (s, e)):
        self.text, self.name, self.up, self.level = text, name, up, 0
        self.at: list[int] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.spans: set[Span] = set()
        self.tokens: set[tuple[str, int, int]] = set()

    def _from(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.at, i) - 1
        if k < 0:
            return i, i + 1
        if self.at[k] == i:
            return self.starts[k], self.ends[k]
        start = self.ends[k] + i - self.at[k] - 1
        return start, start + 1

    def place(self, start: int, end: int) -> tuple[int, int]:
        """The span of the family's text."""
        return self._from(start)[0], self._from(end - 1)[1]

    def outer(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text."""
        return self.up(*self.place(start, end))

    def windows(self) -> Iterator[tuple[int, int]]:
        """Stretches between copied white space that hold decoded characters."""
        decoded, last, k = set(self.at), 0, 0
        for end in (*(m.start() for m in SPACE.finditer(self.text) if m.start() not in decoded), len(self.text)):
            if k < len(self.at) and self.at[k] < end:
                yield last, end
                k = bisect_right(self.at, end - 1)
            last = end + 1

    def touched(self, start: int, end: int) -> bool:
        """Whether a decoded character is in the span."""
        return bisect_left(self.at, start) != bisect_left(self.at, end)

    def found(self, raw: bytes | None = None) -> list[Span]:
        """Base spans; of a copy those with decoded characters, also in windows, where no match that starts before hides them."""
        spans = base_spans(self.text, raw)
        if self.at:
            for a, e in self.windows():
                spans += [(kind, a + s, a + t) for kind, s, t in base_spans(self.text[a:e])]
            spans = [x for x in spans if self.touched(*x[1:])]
        return spans

    def named(self, name: str) -> str:
        return f"{self.name}.{name}" if self.name else name

    def copy(self, name: str, decoded: Iterator[tuple[int, int, str]]) -> Layer | None:
        """This text with characters for some of its spans, in ascending order; None if there are none."""
        parts, size, last, k = [], 0, 0, 0
        out = Layer("", self.named(name), self.up)
        out.spans, out.tokens, out.level = self.spans, self.tokens, self.level + 1
        for start, end, ch in decoded:
            while k < len(self.at) and self.at[k] < start:
                if self.at[k] >= last:
                    out.at.append(size + self.at[k] - last)
                    out.starts.append(self.starts[k])
                    out.ends.append(self.ends[k])
                k += 1
            parts += self.text[last:start], ch
            size += start - last + 1
            a, e = self.place(start, end)
            out.at.append(size - 1)
            out.starts.append(a)
            out.ends.append(e)
            last = end
        if not parts:
            return None
        for i in range(k, len(self.at)):
            if self.at[i] >= last:
                out.at.append(size + self.at[i] - last)
                out.starts.append(self.starts[i])
                out.ends.append(self.ends[i])
        out.text = "".join(parts) + self.text[last:]
        return out


def _text(data: bytes) -> str:
    """UTF-8; each byte that isn't is a character of its own."""
    return data.decode("utf-8", "surrogateescape")


def _width(ch: str) -> int:
    """Bytes that _text made the character of."""
    return 1 if ch < "\x80" or "\udc80" <= ch <= "\udcff" else len(ch.encode("utf-8", "surrogatepass"))


def _url(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, character) of the URL escapes."""
    for m in URL_RUN.finditer(text):
        at = m.start()
        for ch in _text(bytes.fromhex(m[0].replace("%", ""))):
            n = 3 * _width(ch)
            yield at, at + n, ch
            at += n


def _unicode(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, character) of the Unicode escapes."""
    for m in ESCAPE.finditer(text):
        yield *m.span(), chr(int(m[1] or m[2], 16))


_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")


def _escape_length(chars: list[str]) -> int:
    """The length of the escape that the characters end with; 0 if they don't."""
    for n, mark in ((3, "%"), (4, "\\x"), (6, "\\u")):
        end = chars[-n:]
        if len(end) == n and end[: len(mark)] == list(mark) and _HEX_DIGITS.issuperset(end[len(mark) :]):
            return n
    return 0


def _deep(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, character) of all escapes, those that decoding makes included: a stack whose end is decoded as soon as it is an escape."""
    for m in re.finditer(r"[%\\]\S*", text):
        chars, starts, ends = [], array("q"), array("q")
        for i in range(*m.span()):
            chars.append(text[i])
            starts.append(i)
            ends.append(i + 1)
            while chars[-1] in _HEX_DIGITS and (n := _escape_length(chars)):
                code = int("".join(chars[-2:] if n < 6 else chars[-4:]), 16)
                chars[-n:] = [_text(bytes([code])) if n == 3 else chr(code)]
                ends[-n] = ends[-1]
                del starts[1 - n :], ends[1 - n :]
        for x in zip(starts, ends, chars):
            if x[1] - x[0] > 1:
                yield x


def _copies(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if layer.level == LEVELS:
        if ("%" in text or "\\" in text) and (out := layer.copy("deep", _deep(text))):
            yield out
        return
    if layer.level > LEVELS:
        return
    if "%" in text and (out := layer.copy("url", _url(text))):
        yield out
    if ("\\u" in text or "\\x" in text) and (out := layer.copy("unicode", _unicode(text))):
        yield out


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What the members of gzip or zlib data hold, up to where it breaks, in pieces of bounded size."""
    data = b""
    while True:
        while len(data) < 3 and (more := next(chunks, None)) is not None:
            data += more
        if not MAGIC.match(data):
            return
        squeeze = zlib.decompressobj(47)
        while not squeeze.eof:
            if not data and (data := next(chunks, b"")) == b"":
                return
            try:
                out = squeeze.decompress(data[:CHUNK], PIECE)
            except zlib.error:
                yield from _up_to_break(squeeze, data[:CHUNK])
                return
            data = (squeeze.unused_data if squeeze.eof else squeeze.unconsumed_tail) + data[CHUNK:]
            if out:
                yield out
        data = data.lstrip(b"\0")  # padding between members
        while not data and (more := next(chunks, None)) is not None:
            data = more.lstrip(b"\0")


def _up_to_break(squeeze, data: bytes) -> Iterator[bytes]:
    """What bytes up to the broken one still give; the stream is asked byte by byte."""
    try:
        for i in range(len(data)):
            if out := squeeze.decompress(data[i : i + 1], PIECE):
                yield out
    except zlib.error:
        return


def _pieces(data: bytes | memoryview) -> Iterator[bytes]:
    for i in range(0, len(data), CHUNK):
        yield bytes(data[i : i + CHUNK])


def unpack(data: bytes | memoryview) -> tuple[int, int] | None:
    """How many bytes the members of gzip or zlib data at the start of data take, and how many the whole ones do (1 at least); None if it is neither."""
    data, at, end, sure, some = memoryview(data), 0, 0, 1, 0
    while MAGIC.match(data[at : at + 3]):
        squeeze, left, begin, whole = zlib.decompressobj(47), b"", at, False
        while True:
            if not left:
                left, at = bytes(data[at : at + CHUNK]), min(at + CHUNK, len(data))
            if not left:
                break
            before = squeeze.copy()
            try:
                some += len(squeeze.decompress(left, PIECE))
            except zlib.error:
                at -= len(left)
                try:
                    for i in range(len(left)):
                        some += len(before.decompress(left[i : i + 1], PIECE))
                        at += 1
                except zlib.error:
                    pass
                break
            if squeeze.eof:
                at, whole = at - len(squeeze.unused_data), True
                break
            if some > BOMB:
                return len(data), len(data)
            left = squeeze.unconsumed_tail
        end = max(at, begin + 1)
        if not whole:
            break
        sure = end
        while data[at : at + 1] == b"\0":
            at += 1  # padding between members
    return (end, sure) if some else None


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The stream in windows that overlap; one that begins inside a base64 token begins at a whole number of its quanta."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        if len(held) >= WINDOW:
            yield bytes(held)
            start = len(held) - OVERLAP
            start -= (start - len(held[:start].rstrip(_B64_BYTES))) % 4
            del held[:start]
    yield bytes(held)


@dataclass
class Search:
    """What a search has found, the layers that it has seen, and the bytes that it has unpacked."""

    found: set[Span] = field(default_factory=set)
    seen: set = field(default_factory=set)
    unpacked: int = 0


def _zips(data: bytes | memoryview, whole: tuple[int, int], name: str, search: Search) -> Iterator[Layer]:
    """A layer for each window of what packed data holds, and of each further level of packing; any character depends on all of the data."""
    seen, depth = set(), 1
    while True:
        chunks = _pieces(data)
        for _ in range(depth):
            chunks = _inflated(chunks)
        digest, head = hashlib.sha256(), b""
        for window in _windows(chunks):
            search.unpacked += len(window)
            if search.unpacked > BOMB:
                search.found.add((f"bomb@{name}", *whole))
                return
            head = head or window[:3]
            digest.update(window)
            yield Layer(_text(window), name, lambda s, e: whole)
        if digest.digest() in seen or not MAGIC.match(head):
            return  # data that unpacks to itself is unpacked once
        seen.add(digest.digest())
        depth, name = depth + 1, f"{name}.zip"


class _Headers:
    """Tells which gzip magics of some bytes begin a header that ends in them; its names end at zero bytes, whose places are found once for all of them."""

    def __init__(self, data: bytes):
        self.data = data
        self.zeros: np.ndarray | None = None

    def whole(self, at: int) -> bool:
        data = self.data
        if data[at] != 0x1F:
            return True  # zlib's are two bytes
        if len(data) < at + 10 or data[at + 3] & 0xE0:
            return False
        end, flags = at + 10, data[at + 3]
        if flags & 4:  # a field with its length before it
            end += 2 + int.from_bytes(data[end : end + 2], "little")
        for flag in (8, 16):  # name, comment
            if flags & flag:
                if self.zeros is None:
                    self.zeros = np.flatnonzero(np.frombuffer(data, np.uint8) == 0)
                k = int(np.searchsorted(self.zeros, end))
                if k == len(self.zeros):
                    return False
                end = int(self.zeros[k]) + 1
        return end + (2 if flags & 2 else 0) < len(data)


def _packed(layer: Layer, search: Search) -> Iterator[Layer]:
    """Compressed bytes among decoded escapes: those of UTF-8, or characters below 256 as bytes."""
    if not layer.at:
        return
    text = LONE.sub("?", layer.text)
    for data, width in ((text.encode("utf-8", "surrogateescape"), _width), (text.encode("latin-1", "replace"), lambda c: 1)):
        pos, view, offsets, headers = 0, memoryview(data), [], _Headers(data)
        while m := MAGIC.search(data, pos):
            pos = m.start() + 1
            if not headers.whole(m.start()) or (got := unpack(view[m.start() :])) is None:
                continue
            pos += got[1] - 1
            offsets = offsets or list(accumulate(map(width, text), initial=0))
            start, end = bisect_right(offsets, m.start()) - 1, bisect_left(offsets, m.start() + got[0])
            token = ("zip", *layer.place(start, end))
            if token in layer.tokens or not layer.touched(start, end):
                continue
            layer.tokens.add(token)
            yield from _zips(view[m.start() : m.start() + got[0]], layer.outer(start, end), layer.named("zip"), search)


def _base64_place(layer: Layer, runs: list[tuple[int, int]], skipped: int, size: int, text: str) -> Callable[[int, int], tuple[int, int]]:
    """Maps spans of the text that so many characters of a token hold, after those skipped; runs: where its parts begin in the token and in the layer."""
    offsets: list[int] = []
    begins = [r[0] for r in runs]

    def at(i: int) -> int:
        begin, place = runs[bisect_right(begins, i + skipped) - 1]
        return place + i + skipped - begin

    def up(s: int, e: int) -> tuple[int, int]:
        if not text.isascii():
            offsets[:] = offsets or accumulate(map(_width, text), initial=0)
            s, e = offsets[s], offsets[e]
        return layer.outer(at(s // 3 * 4 + s % 3), at(min((e - 1) // 3 * 4 + (e - 1) % 3 + 2, size) - 1) + 1)

    return up


def _base64_tokens(text: str) -> Iterator[list[tuple[int, str]]]:
    """(place, characters) of the parts of each token: runs, then runs that line ends part, all together and those of lines of one length."""
    for m in BASE64_TOKEN.finditer(text):
        yield [(m.start(), m[0].rstrip("="))]
    if "\n" not in text:
        return
    for m in BASE64_LINES.finditer(text):
        runs = [(r.start(), r[0]) for r in BASE64_RUN.finditer(text, *m.span())]
        yield runs
        group: list[tuple[int, str]] = []
        for run in runs:
            if group and (len(run[1]) > len(group[0][1]) or len(group[-1][1]) < len(group[0][1])):
                if len(group) > 1:
                    yield group
                group = []
            group.append(run)
        if 1 < len(group) < len(runs):
            yield group


def _base64(layer: Layer, raw: bytes | None, search: Search) -> Iterator[Layer]:
    raw = layer.text.encode("utf-8", "surrogatepass") if raw is None else raw
    if b"1" * 16 not in raw.translate(_B64_MAP):
        return
    for parts in _base64_tokens(layer.text):
        whole = "".join(x[1] for x in parts)
        token = (whole, layer.place(parts[0][0], parts[0][0] + 1)[0], layer.place(parts[-1][0], parts[-1][0] + len(parts[-1][1]))[1])
        if token in layer.tokens:
            continue
        layer.tokens.add(token)
        runs = list(zip(accumulate((len(x[1]) for x in parts), initial=0), (x[0] for x in parts)))
        coded = whole.translate(_B64_PLAIN)
        for skipped in range(4):  # what stands before may be of base64's characters, too
            body = coded[skipped:]
            body = body[:-1] if len(body) % 4 == 1 else body
            if skipped and len(body) < 16:
                break
            try:
                data = base64.b64decode(body + "=" * (-len(body) % 4))
            except binascii.Error:
                continue
            place = _base64_place(layer, runs, skipped, len(body), text := _text(data))
            out = Layer(text, layer.named("base64"), place)
            yield out
            span, view, headers, pos = layer.outer(_at(runs, skipped), parts[-1][0] + len(parts[-1][1])), memoryview(data), _Headers(data), 0
            while m := MAGIC.search(data, pos):
                pos = m.start() + 1
                if headers.whole(m.start()) and (got := unpack(view[m.start() :])):
                    pos += got[1] - 1
                    yield from _zips(view[m.start() : m.start() + got[0]], span, out.named("zip"), search)


def _at(runs: list[tuple[int, int]], i: int) -> int:
    """Where a token's character stands in the layer."""
    begin, place = runs[bisect_right([r[0] for r in runs], i) - 1]
    return place + i - begin


def _family(first: Layer, search: Search, raw: bytes | None) -> Iterator[Layer]:
    """Scan a layer and its copies, those with fewer decodings first; yields the layers that begin other families."""
    todo = deque([first])
    while todo:
        layer = todo.popleft()
        own = raw if not layer.name else None
        if layer.name:
            key = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), *layer.outer(0, len(layer.text)), hash(tuple(layer.at)), hash(tuple(layer.starts)))
            if key in search.seen:
                continue
            search.seen.add(key)
        for kind, s, e in layer.found(own):
            if (place := (kind, *layer.place(s, e))) not in layer.spans:
                layer.spans.add(place)
                if layer.name:
                    search.found.add((f"{kind}@{layer.name}", *layer.outer(s, e)))
        yield from _base64(layer, own, search)
        yield from _packed(layer, search)
        todo += [x for x in _copies(layer) if x.text]


def layered_spans(text: str, raw: bytes | None = None) -> list[Span]:
    """Spans found in decoded layers, at their place in the text. The worklist is a stack of families, so what unpacking gives is held a window at a time."""
    search = Search()
    todo = [_family(Layer(text), search, raw)]
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
        elif layer.text:
            todo.append(_family(layer, search, None))
    return list(search.found)


def _order(span: Span) -> tuple:
    kind = span[0].split("@")[0]
    return span[1], (*KINDS, "bomb").index(kind), span[0], span[2]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=_order))


def scan(text: str, raw: bytes | None = None) -> tuple[list[Span], list[Span]]:
    """Base spans, and those of decoded layers that aren't a base span of that kind already."""
    base = base_spans(text, raw)
    had = set(base)
    return base, [x for x in layered_spans(text, raw) if (x[0].split("@")[0], *x[1:]) not in had]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    frame = texts(docs, "doc_id")
    schema = with_fields(frame, ["doc_id"], "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for (raw,) in zip(*columns(batch, "text")):
                base, more = scan(raw.decode("utf-8", "replace"), raw)
                for n, kind in zip(counts, KINDS):
                    n.append(sum(x[0] == kind for x in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + more))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    return frame.mapInArrow(run, schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return scan_secrets(table(spark, sf_dir, "documents"))
