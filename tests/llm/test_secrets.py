"""Secret scan: base finds against plain expressions, planted layers, mapped spans, odd inputs in bounded time."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import lzma
import re
import time
import urllib.parse
import zlib

import pytest
import zstandard

from listingmart.llm import queries, secrets

SECRET = 'password = "hunter2secret'


def b64(x: str | bytes) -> str:
    return base64.b64encode(x.encode() if isinstance(x, str) else x).decode()


def brute(text: str | None) -> list[tuple[int, int, int]]:
    """Base finds by the plain rules: whole matches first, too short ones dropped after."""
    found = []
    pattern = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for kind, p, ok in ((0, pattern, lambda m: len(m[2]) >= 6), (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)):
        found += [(m.start(), kind, m.end()) for m in p.finditer(text or "") if ok(m)]
    return sorted(found)


def shown(rows) -> str:
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in rows)


def test_query_holds_all_base_finds(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()}
    rows = queries.op12_secrets(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 10
    for r in rows:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, kind, _ in base) for k in range(3))
        assert set(filter(None, shown(base).split(","))) <= set(r.spans.split(","))


LAYERS = {
    "base64": b64("my " + SECRET),
    "base64/packed": b64(zlib.compress(SECRET.encode())),
    "base64/packed/base64": b64(gzip.compress(b64(SECRET).encode())),
    "base64/packed/packed": b64(bz2.compress(lzma.compress(SECRET.encode()))),
    "base64/packed ": b64(zstandard.ZstdCompressor().compress(SECRET.encode())),
    "base64/base64/base64": b64(b64(b64(SECRET))),
    "base64 ": base64.urlsafe_b64encode(("é?>" + SECRET).encode()).decode().rstrip("="),
    "base64  ": b64(SECRET.encode("utf-16-le")),
    "url": urllib.parse.quote(urllib.parse.quote(SECRET, safe=""), safe=""),
    "url ": "pass%77ord=hunter2secret",
    "url/base64": "%" + "%".join(f"{c:02X}" for c in b64(SECRET).encode()),
    "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "unicode ": "".join(f"&#x{ord(c):x};" for c in SECRET),
    "unicode/packed": "".join(f"\\x{c:02x}" for c in zlib.compress(SECRET.encode())),
    "url/packed": urllib.parse.quote(zlib.compress(SECRET.encode()), safe=""),
    "base64/url/unicode": b64(urllib.parse.quote("".join(f"\\u{ord(c):04x}" for c in SECRET))),
}


@pytest.mark.parametrize("via", LAYERS)
def test_layers_are_unwrapped(via):
    text = "Grüße 日本 " + LAYERS[via] + " and more words"
    scan = secrets.Scan(text)
    first, last = 9, 9 + len(LAYERS[via])
    own = {k: v for k, v in scan.found.items() if v}
    assert len(own) == 1 and not scan.unread
    ((start, kind, stop), way), = own.items()
    assert kind == 0 and way == "/" + via.strip() and first <= start < stop <= last
    if "packed" in via:
        assert (start, stop) in {(first, last), (first, last - LAYERS[via].count("="))}


def test_spans_cover_what_encodes_the_secret():
    text = "x " + b64("some words before, token=abcdefgh and after") + " y"
    (start, kind, stop), = secrets.Scan(text).found
    part = base64.b64decode(text[2 + (start - 2) // 4 * 4 : 2 + -(-(stop - 2) // 4) * 4])
    assert b"token=abcdefgh" in part and len(part) <= len("token=abcdefgh") + 4
    wrapped = base64.encodebytes(b"lorem ipsum " * 12 + b"token=abcdefgh").decode()
    (start, _, stop), = secrets.Scan(wrapped + "Next line").found
    assert stop - start >= 18 and wrapped[start:stop].strip() and stop <= len(wrapped)
    assert list(secrets.Scan("p%61ss token%3Dabc%64efg! ").found.items()) == [((7, 0, 24), "/url")]


def test_cycles_and_bursting_archives_end():
    # A layer that decodes to itself: escapes of per cent signs that never change, and a text seen before at its place.
    assert secrets.Scan("%25%25%25 100%").layers <= 2
    scan = secrets.Scan(b64(zlib.compress(b"token=abcdefgh" + bytes(secrets.MOST_UNPACKED + 1000))))
    assert scan.unread == 1 and not scan.found


@pytest.mark.parametrize("text", ["%" + "25" * 300_000 + "41", "x^" * 200_000, "A-" * 500_000, "a%41" * 100_000, "secret" * 100_000, "secret " + " " * 500_000, "\\u0041" * 100_000, "=" * 300_000, "x%9C" * 50_000, "QUFB" * 200_000])
def test_long_texts_take_linear_time(text):
    began = time.perf_counter()
    secrets.Scan(text)
    assert time.perf_counter() - began < 20


def test_odd_rows(spark):
    rows = [(1, None, "a"), (None, "", "b"), (2, "token=abcdefgh", "c"), (2, "token=abcdefgh", "c"), (3, "token: short", "d"), (4, "toKen = abcdef api-key=abcdefg ſecret=abcdefgh", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    found = secrets.digests(secrets.scanned(docs)).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_assign, r.spans) for r in found) == [(0, 0, ""), (1, 0, ""), (2, 1, "assign:0:14"), (2, 1, "assign:0:14"), (3, 0, ""), (4, 1, "assign:0:14")]
    assert all((r.base_sha256 == none) == (r.n_assign == 0) for r in found)
    assert secrets.digests(secrets.scanned(docs.limit(0))).count() == 0
