"""Pages: captions before, after, nested and never closed; and that no text of the given pages is lost."""

import hashlib
import html
import os
import re
import struct
import zlib

import pytest

from snapspan.llm import media

D = [f"{i:064x}" for i in range(4)]
IMG = [f'<img src="sha256:{d}" alt="alt{i}">' for i, d in enumerate(D)]


def told(page):
    parts = media.parse(page)
    assert [p[0] for p in parts] == list(range(len(parts)))
    return [(p[2] if p[1] == "text" else D.index(p[3]) if p[3] else p[5], p[4]) for p in parts]


@pytest.mark.parametrize("page,want", [
    (f"<figure><figcaption>first</figcaption>{IMG[0]}</figure>tail", [(0, "first"), ("tail", None)]),
    (f"a<figure>{IMG[0]}{IMG[1]}<figcaption>two <b>of</b> them</figcaption></figure>b", [("a", None), (0, "two of them"), (1, "two of them"), ("b", None)]),
    (f"<figure>{IMG[0]}<figcaption>never closed</figure><p>later</p>", [(0, "never closed"), ("later", None)]),
    (f"<figure>{IMG[0]}<figcaption>never <p>ended</p> at all", [(0, "alt0"), ("never ended at all", None)]),
    (f"<figure>{IMG[0]}<figure>{IMG[1]}<figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>", [(0, "outer"), (1, "inner")]),
    (f"<figure><figure>{IMG[0]}</figure><figure>{IMG[1]}</figure><figcaption>both</figcaption></figure>", [(0, "both"), (1, "both")]),
    ("<figure><figcaption>of nothing</figcaption></figure>x", [("of nothing", None), ("x", None)]),
    (f"<figcaption>stray</figcaption>{IMG[2]}", [("stray", None), (2, "alt2")]),
    (f"<figure>{IMG[0]}<figcaption>one</figcaption><figcaption>two</figcaption></figure>", [(0, "one"), ("two", None)]),
    ('<p>see<img src="http://x/y.png" title="t">here', [("see", None), ("http://x/y.png", "t"), ("here", None)]),
    ("</figure></figcaption>&lt;b&gt;<script>no</script>", [("<b>", None)]),
    ("<img>", [(None, None)]),
])
def test_pages(page, want):
    assert told(page) == want


def test_no_text_of_the_given_pages_is_lost(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no pages here")
    pages = spark.read.parquet(path).select("html", media.sequence("html").alias("parts")).collect()
    for r in pages:
        bare = re.sub(r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->|<![^>]*>", " ", r["html"] or "")
        want = html.unescape(re.sub(r"(?s)<[^>]*>", " ", bare))
        got = " ".join((p["text"] if p["kind"] == "text" else p["caption"]) or "" for p in r["parts"])
        assert sorted(re.sub(r"\s", "", got)) == sorted(re.sub(r"\s", "", want)) or set(want.split()) <= set(got.split())


def test_stored_files_are_plain_png():
    for text in ("", "a", "é" * 700):
        payload = text.encode().ljust(max(576, -(-len(text.encode()) // 576) * 576), b"\xff")
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        lines = b"".join(b"\0" + payload[i : i + 24] for i in range(0, len(payload), 24))
        want = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 24, len(payload) // 24, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")
        assert hashlib.sha256(media.image(media.padded(text.encode()))).digest() == hashlib.sha256(want).digest()
