"""Secret scan by a recursive decoding worklist.

A text is the first layer. Every layer is scanned for secrets, then unwrapped in all ways that apply, and what comes out is
a layer again, until nothing new appears:

* URL escapes (%XX) and Unicode escapes (\\uXXXX, \\u{X}, \\UXXXXXXXX, \\xXX, &#N; &#xN;) are replaced in place, so that a
  secret that is escaped only in part, or whose keyword stands outside the escapes, is whole in the new layer;
* a run of base64 (both alphabets, with or without padding, also wrapped over lines) that decodes to text is a layer;
* zlib, gzip, bz2, xz and zstandard data, as what base64 or escapes decode to, unpack to a layer.

Layers that were seen before at the same place are not scanned again, which ends cycles such as an archive that unpacks to
itself. Every layer knows which piece of its parent each of its characters came from, so a find is mapped layer by layer to
the span of the whole text that encodes it. Unpacked data map to the whole packed run.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmart.llm.common import need

KINDS = ("assign", "access", "hex")
LEAST_VALUE = 6
# What may be unpacked from one text, in characters: MOST_UNPACKED, or so many times its length if that is more. Layers
# beyond it (archives made to burst) are counted in `unread`, and not scanned.
MOST_UNPACKED, TIMES_UNPACKED = 64 << 20, 200
# Texts of a batch are handed out in parts of about so many characters.
BATCH_ROWS = 500

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Runs that are too short are dropped; as the run of a match ends only where its letters end, the length can be asked for here.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_URL = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_URL_ONE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_PERCENT = re.compile("%([0-9A-Fa-f]{2})")
_PERCENT_OR_CHAR = re.compile("%([0-9A-Fa-f]{2})|[\0-\x7f]")
# Where packed data may begin in URL escapes: x stands for itself, the other first bytes are escaped, or begin with B or (.
_URL_RUN = re.compile(r"(?:x(?=%|\^)|%1[fF]|%78|BZh|%[fF][dD]|\((?=%))\S*")
_UNICODE = re.compile(r"(?:\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
_BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]{40,}\r?\n)+[A-Za-z0-9+/_-]+={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAKS = re.compile(r"[\r\n]")
# So many bytes mostly tell whether data that begin like packed ones are.
PROBE = 64
# First bytes of packed data, as characters up to 255.
_PACKED = re.compile("\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY|\xfd7zXZ\0|\\(\xb5/\xfd")
_LATIN_RUN = re.compile("[\0-\xff]+")
# Control characters that no text has: what a wrong base64 run decodes to is told from text by them.
_BINARY = re.compile("[\0-\x08\x0e-\x1a\x1c-\x1f]")


@dataclass
class Layer:
    """A text, and where its characters come from.

    ``cuts`` are (first, last + 1, from, to): characters [first, last + 1) of this layer stand for [from, to) of the
    parent; what lies between cuts was copied. Instead of cuts, ``whole`` is the span of the parent that all of it stands
    for, or ``places`` are the positions of the signs of a base64 run there.
    """

    text: str
    parent: Layer | None = None
    cuts: list[tuple[int, int, int, int]] = field(default_factory=list)
    whole: tuple[int, int] | None = None
    places: list[int] | None = None
    via: str = ""

    def up(self, start: int, stop: int) -> tuple[int, int]:
        """The span of the parent that encodes [start, stop)."""
        if self.whole is not None and self.places is None:
            return self.whole
        if self.places is not None:
            # The k-th byte of a base64 run is held by its characters 4k/3 to 4k/3 + 1 and their like, rounded outwards.
            first = len(self.text[:start].encode())
            last = first + len(self.text[start:stop].encode()) - 1
            return self.places[first * 8 // 6], self.places[min((last * 8 + 7) // 6, len(self.places) - 1)] + 1
        return self._before(start)[0], self._before(stop - 1)[1]

    def _before(self, at: int) -> tuple[int, int]:
        k = bisect_right(self.cuts, at, key=lambda c: c[0]) - 1
        if k < 0:
            return at, at + 1
        first, end, a, b = self.cuts[k]
        return (a, b) if at < end else (b + at - end, b + at - end + 1)

    def origin(self, start: int, stop: int) -> tuple[int, int]:
        layer: Layer = self
        while layer.parent is not None:
            start, stop = layer.up(start, stop)
            layer = layer.parent
        return start, stop


def finds(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the secrets that stand in a text as it is."""
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_VALUE:
            yield m.start(), 0, m.end()
    for kind, pattern in ((1, _ACCESS), (2, _HEX)):
        for m in pattern.finditer(text):
            yield m.start(), kind, m.end()


def _code_point(escape: str) -> str | None:
    digits = escape[2:].strip("{};")
    if escape.startswith("&#"):
        value = int(digits[1:], 16) if digits[0] in "xX" else int(digits)
    elif len(escape) == 12 and escape[1] == "u":
        return chr(0x10000 + ((int(escape[2:6], 16) - 0xD800) << 10) + int(escape[8:12], 16) - 0xDC00)
    else:
        value = int(digits, 16)
    return None if value > 0x10FFFF or 0xD800 <= value < 0xE000 else chr(value)


def _replaced(layer: Layer, pieces: Iterator[tuple[int, int, str]], via: str) -> Layer | None:
    """A layer with spans of the text replaced; ``pieces`` are (start, stop, replacement), ascending."""
    out, cuts, at, size = [], [], 0, 0
    for a, b, new in pieces:
        out += (layer.text[at:a], new)
        size += a - at
        cuts.append((size, size + len(new), a, b))
        size += len(new)
        at = b
    if not cuts:
        return None
    out.append(layer.text[at:])
    return Layer("".join(out), layer, cuts, via=via)


def _url_pieces(text: str) -> Iterator[tuple[int, int, str]]:
    for run in _URL.finditer(text):
        ones = [(m.start(), m.end(), int(m[1], 16)) for m in _URL_ONE.finditer(run[0])]
        raw = bytes(b for _, _, b in ones)
        try:
            chars = raw.decode()
        except UnicodeDecodeError:
            chars = raw.decode("latin-1")
        at = 0
        for c in chars:
            n = len(c.encode()) if len(chars) != len(raw) else 1
            yield run.start() + ones[at][0], run.start() + ones[at + n - 1][1], c
            at += n


def _unicode_pieces(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _UNICODE.finditer(text):
        new = _code_point(m[0])
        if new is not None:
            yield m.start(), m.end(), new


def _unpack(raw: bytes | memoryview, most: int) -> tuple[bytes, int, bool] | None:
    """What packed data hold, at most ``most`` bytes, how many bytes of ``raw`` they take, and whether that is all.

    None: not packed, or broken. Zstandard does not tell where its data end; they take all of ``raw``.
    """
    head = bytes(raw[:6])
    try:
        if head[:3] == b"\x1f\x8b\x08" or (head[:1] == b"x" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0):
            zlib.decompressobj(47).decompress(raw[:PROBE], PROBE)  # false beginnings mostly fail here
            tool = zlib.decompressobj(47)
        elif head[:3] == b"BZh":
            tool = bz2.BZ2Decompressor()
        elif head == b"\xfd7zXZ\0":
            tool = lzma.LZMADecompressor(memlimit=256 << 20)
        elif head[:4] == b"(\xb5/\xfd":
            import zstandard

            try:
                with zstandard.ZstdDecompressor(max_window_size=64 << 20).stream_reader(bytes(raw)) as reader:
                    out = reader.read(most + 1)
            except zstandard.ZstdError:
                return None
            return (out[:most], len(raw), len(out) <= most) if out else None
        else:
            return None
        out = tool.decompress(raw, most + 1)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return None
    return (out[:most], len(raw) - len(tool.unused_data), len(out) <= most) if out else None


def _as_text(raw: bytes) -> str | None:
    """Bytes as text: UTF-8, or UTF-16 as some shells encode it. None for anything else."""
    if len(raw) > 3 and len(raw) % 2 == 0 and raw[1::2].count(0) * 2 > len(raw) // 2:
        try:
            text = raw.decode("utf-16-le")
            return None if _BINARY.search(text) else text
        except UnicodeDecodeError:
            return None
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return None if _BINARY.search(text) else text


class Scan:
    """One text's worklist: finds in the text itself, finds in all layers, and layers that were not read."""

    def __init__(self, text: str) -> None:
        self.base = sorted(set(finds(text)))
        self.found: dict[tuple[int, int, int], str] = {(a, k, b): "" for a, k, b in self.base}
        self.unread = self.layers = 0
        self.left = max(MOST_UNPACKED, TIMES_UNPACKED * len(text))
        self.seen: set[tuple[bytes, tuple[int, int]]] = set()
        self.work: deque[Layer] = deque()
        self.unwrap(Layer(text))
        while self.work:
            layer = self.work.popleft()
            self.layers += 1
            for start, kind, stop in finds(layer.text):
                a, b = layer.origin(start, stop)
                self.found.setdefault((a, kind, b), layer.via)
            self.unwrap(layer)

    def add(self, layer: Layer | None) -> None:
        """Queue a layer unless the same text was queued for the same place."""
        if layer is None or not layer.text:
            return
        key = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), layer.origin(0, len(layer.text))
        if key in self.seen:
            return
        if len(layer.text) > self.left:
            self.unread += 1
            return
        self.left -= len(layer.text)
        self.seen.add(key)
        self.work.append(layer)

    def unwrap(self, layer: Layer) -> None:
        text = layer.text
        if "%" in text:
            self.add(_replaced(layer, _url_pieces(text), layer.via + "/url"))
            for m in _URL_RUN.finditer(text):
                # Packed bytes between plain letters: only the run as a whole makes sense.
                start = _PACKED.match(_PERCENT.sub(lambda x: chr(int(x[1], 16)), m[0][:24]))
                if start and m[0].isascii():
                    bytes_of = [(x.start(), x.end(), int(x[1], 16) if x[1] else ord(x[0])) for x in _PERCENT_OR_CHAR.finditer(m[0])]
                    ends = [m.start() + e for _, e, _ in bytes_of]
                    self.packed(layer, bytes(b for _, _, b in bytes_of), m.start(), ends, layer.via + "/url")
        if "\\" in text or "&#" in text:
            self.add(_replaced(layer, _unicode_pieces(text), layer.via + "/unicode"))
        at, end, raw, first = 0, -1, memoryview(b""), 0
        while m := _PACKED.search(text, at):
            if m.start() >= end:
                run = _LATIN_RUN.match(text, m.start())
                first, end = run.span()
                raw = memoryview(run[0].encode("latin-1"))
            taken = self.packed(layer, raw[m.start() - first :], m.start(), None, layer.via)
            at = m.start() + max(1, taken)
        for m in _BASE64.finditer(text):
            if not self.base64(layer, m[0], m.start()) and "\n" in m[0]:
                # The last line need not belong to it.
                self.base64(layer, m[0][: m[0].rindex("\n")], m.start())

    def base64(self, layer: Layer, shown: str, start: int) -> bool:
        """Decode a run that begins at ``start``; False if neither text nor packed data come out."""
        run = _BREAKS.sub("", shown).rstrip("=")
        if len(run) % 4 == 1:
            run = run[:-1]
        raw = base64.urlsafe_b64decode(run.replace("+", "-").replace("/", "_") + "=" * (-len(run) % 4))
        text = _as_text(raw)
        if text is None:
            return self.packed(layer, raw, start, [start + len(shown)] * len(raw), layer.via + "/base64") > 0
        if len(text.encode()) == len(raw):
            places = [start + i for i, c in enumerate(shown) if c not in "\r\n="]
            self.add(Layer(text, layer, places=places, via=layer.via + "/base64"))
        else:
            self.add(Layer(text, layer, whole=(start, start + len(shown)), via=layer.via + "/base64"))
        return True

    def packed(self, layer: Layer, raw: bytes | memoryview, start: int, ends: list[int] | None, via: str) -> int:
        """Unpack as often as packed data come out; what is text then is a layer.

        The data begin at ``start`` of the layer, their k-th byte ends at ``ends[k]`` (None: a character per byte). Returns
        how many bytes were packed data, 0 for none.
        """
        seen: set[bytes] = set()
        span, taken = (start, start), 0
        while got := _unpack(raw, self.left):
            raw, used, complete = got
            via += "/packed"
            if not taken:
                taken = used
                span = start, start + used if ends is None else ends[used - 1]
            key = hashlib.blake2b(raw, digest_size=16).digest()
            if not complete:
                self.unread += 1
                break
            text = _as_text(raw)
            if text is not None:
                self.add(Layer(text, layer, whole=span, via=via))
                break
            if key in seen:
                break
            seen.add(key)
            self.left -= len(raw)
        return taken


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_base, base, finds, n_layers, unread) of every row of ``docs`` (doc_id, text).

    ``base`` holds the secrets of the text as it stands, ``finds`` those and the ones in its layers: kind, start and stop
    in code points (stop exclusive) and ``via``, the ways that were unwrapped, '' for the text itself. Both are sorted by
    start, kind (in the order of `KINDS`), stop; a span that several layers give counts once. Null and empty texts hold
    nothing. Repeated rows and null ids stay; other columns are left out. ``unread`` counts layers beyond `MOST_UNPACKED`.
    """
    need(docs, "doc_id", "text")
    ids = docs.select("doc_id").schema.simpleString()[7:-1]
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("via", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                base, found, layers, unread = [], [], [], []
                for text in part.column("text"):
                    scan = Scan(text.as_py() or "")
                    base.append([{"kind": KINDS[k], "start": a, "stop": b, "via": ""} for a, k, b in scan.base])
                    found.append([{"kind": KINDS[k], "start": a, "stop": b, "via": via.lstrip("/")} for (a, k, b), via in sorted(scan.found.items())])
                    layers.append(scan.layers)
                    unread.append(scan.unread)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(base, pa.list_(one)), pa.array(found, pa.list_(one)), pa.array(layers, pa.int64()), pa.array(unread, pa.int64())],
                    ["doc_id", "base", "finds", "n_layers", "unread"],
                )

    struct = "array<struct<kind:string,start:bigint,stop:bigint,via:string>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"{ids}, base {struct}, finds {struct}, n_layers bigint, unread bigint")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers, unread) from `scanned`."""
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    numbers = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *numbers, F.sha2(line("base"), 256).alias("base_sha256"), line("finds").alias("spans"), "n_layers", "unread")
