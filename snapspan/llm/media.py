"""Media columns: pages become ordered sequences of text and media, and digests join media to their payloads.

`sequence` parses HTML into an ordered array of structs: text runs, and references to media by the digest of their payload, with the caption of
their figure or their alternative text; a caption may stand before or after its media and inside a figure of figures. A caption that no media takes, or that its
page never ends, is a text run. `resolve` joins the references of all pages to a media table by digest
and puts each sequence together again; a reference without payload stays with a null payload, so positions and captions never shift.

Payloads are kept as PNG images of 8-bit grey samples, 24 wide, row after row without filters: any bytes whose number is a
multiple of 24 are stored without loss, and `samples` reads them back from the file.

Null HTML is an empty page; an empty page has an empty sequence. Text outside elements counts as text; script and style do not. Null
text is empty text. Equal texts have equal digests, files and features. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from snapspan.llm.common import utf8_views, written

WIDTH, UNIT, PAD = 24, 576, 255
PREFIX = "sha256:"
PART = StructType().add("position", IntegerType()).add("kind", StringType()).add("text", StringType()).add("digest", StringType()).add("caption", StringType()).add("source", StringType())
#: Elements that refer to media, and those that are not text.
MEDIA, SILENT = {"img", "audio", "video", "source", "embed"}, {"script", "style", "template"}
BLOCKS = {"p", "div", "article", "section", "figure", "figcaption", "h1", "h2", "h3", "h4", "li", "ul", "ol", "table", "tr", "td", "br", "pre", "blockquote"}


class _Figure:
    """The media of a figure that still lack a caption, and its caption: the part that stands where it began, and the text so far."""

    def __init__(self):
        self.media, self.place, self.words = [], None, None


class _Page(HTMLParser):
    """Collects text runs and media references in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.run, self.silent = [], [], 0
        self.figures: list[_Figure] = []
        self.caption: _Figure | None = None

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.parts.append(["text", text, None, None, None])

    def end_caption(self):
        self.caption = None

    def end_figure(self, closed: bool = True):
        """Give the caption to the media; a caption that nobody takes, or that the page never ends, is a text run where it began."""
        figure = self.figures.pop()
        open_ = self.caption is figure
        if open_:
            self.end_caption()
        if figure.place is None:
            if self.figures and self.figures[-1] is not figure:
                self.figures[-1].media += figure.media  # the caption of the figure around it
            return
        text = " ".join("".join(figure.words).split())
        if text and figure.media and (closed or not open_):
            for part in figure.media:
                part[3] = text
            figure.place[0] = None
        else:
            figure.place[:2] = ["text", text] if text else [None, None]

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        if tag in BLOCKS or tag in MEDIA:
            if self.caption is None:
                self.flush()
            else:
                self.caption.words.append(" ")
        if tag == "figure":
            self.figures.append(_Figure())
        if tag == "figcaption" and self.figures and self.figures[-1].place is None:
            figure = self.figures[-1]
            figure.place, figure.words = ["text", None, None, None, None], []
            self.parts.append(figure.place)
            self.caption = figure
        if tag in MEDIA:
            at = dict(attrs)
            source = at.get("src") or ""
            digest = source.removeprefix(PREFIX) if source.startswith(PREFIX) else None
            part = ["media", None, digest, at.get("alt") or at.get("title"), source if source and digest is None else None]
            self.parts.append(part)
            if self.figures:
                self.figures[-1].media.append(part)

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            self.end_caption()
        if tag in BLOCKS:
            if self.caption is None:
                self.flush()
            else:
                self.caption.words.append(" ")
        if tag == "figure" and self.figures:
            self.flush()
            self.end_figure()

    def handle_data(self, data):
        if not self.silent:
            (self.run if self.caption is None else self.caption.words).append(data)

    def finish(self):
        self.close()
        self.flush()
        while self.figures:
            self.end_figure(closed=False)
        return [p for p in self.parts if p[0] is not None]


def parse(page: str | None) -> list[tuple[int, str, str | None, str | None, str | None, str | None]]:
    """(position, kind, text, digest, caption, source) in document order; ``source`` is a reference that is no digest."""
    reader = _Page()
    reader.feed(page or "")
    return [(i, *p) for i, p in enumerate(reader.finish())]


def sequence(page: Column | str) -> Column:
    """The interleaved sequence of a page as array<struct<position, kind, text, digest, caption, source>>."""
    def read(pages: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(PART.fieldNames(), p)) for p in parse(x)] for x in pages], dtype=object)

    return F.pandas_udf(read, ArrayType(PART))(F.col(page) if isinstance(page, str) else page)


def resolve(pages: DataFrame, media: DataFrame, key: str = "key", parts: str = "parts") -> DataFrame:
    """(key, parts with ``payload``) by a digest join; ``media`` has one row a ``digest`` and what there is of it in ``payload``.

    References are joined as narrow rows, so a digest that very many pages show is split by adaptive joins, and sequences are put together by key.
    """
    each = pages.select(F.col(key).alias("key"), F.explode_outer(parts).alias("part"))
    joined = each.withColumn("digest", F.col("part.digest")).join(media, "digest", "left")
    whole = joined.groupBy("key").agg(F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part.position", "part.kind", "part.text", "digest", "part.caption", "part.source", "payload")))).alias("parts"))
    return whole.withColumnRenamed("key", key) if key != "key" else whole


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def image(payload: bytes) -> bytes:
    """A PNG file whose 8-bit grey samples are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    plain = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    plain[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), 1)) + _chunk(b"IEND", b"")


def samples(file: bytes) -> bytes:
    """The samples of a file written by `image`; a wrong checksum or format is an error."""
    if file[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG signature")
    at, data, width, height = 8, [], 0, 0
    while at < len(file):
        size, kind = struct.unpack(">I", file[at : at + 4])[0], file[at + 4 : at + 8]
        body = file[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", file[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def padded(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of 576."""
    return text + bytes([PAD]) * (-len(text) % UNIT or (0 if text else UNIT))


def feature(payload: bytes) -> str:
    """Mean, deviation and mean step of the samples, and how they spread over eight ranges."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x >> 5, minlength=8) / len(x)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return ",".join(f"{v:.6f}" for v in (x.mean(), x.std(), step, *share))


STORED = "digest string, n_bytes long, file binary"
MEASURED = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def _store(batches):
    """Texts to files, each text of a batch once."""
    for batch in batches:
        data, offsets = utf8_views(batch.column("text"))
        seen, rows, size = set(), [], 0
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            payload = padded(text)
            digest = hashlib.sha256(payload).hexdigest()
            if digest not in seen:
                seen.add(digest)
                rows.append((digest, len(text), image(payload)))
                size += len(rows[-1][2])
            if size > 8_000_000:
                yield _batch(rows, STORED)
                rows, size = [], 0
        yield _batch(rows, STORED)


def _measure(batches):
    """What the stored files hold, read back."""
    for batch in batches:
        rows = []
        for digest, n, file in zip(*(batch.column(c).to_pylist() for c in ("digest", "n_bytes", "file"))):
            payload = samples(file)
            rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(payload)))
        yield _batch(rows, MEASURED)


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, n_bytes, file): the texts as images in a written table; a digest may stand once for each batch that met it."""
    return written(docs.select(F.col(text).alias("text")).mapInArrow(_store, STORED), "media")


def _page_of(ids: pd.Series, texts: pd.Series) -> pd.Series:
    """A page that shows the document's image under its name, between two runs of text."""
    out = []
    for i, t in zip(ids, texts):
        digest, name = hashlib.sha256(padded((t or "").encode())).hexdigest(), html.escape(str(i))
        out.append(f'<article><p>before {name}</p><figure><img src="{PREFIX}{digest}"><figcaption>document {name}</figcaption></figure><p>after {name}</p></article>')
    return pd.Series(out, dtype=object)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document what its stored image holds, found through the sequence of a page that shows it.

    A text's padding is part of its payload, so two texts never share a digest unless they are equal or differ in trailing
    bytes 255, which UTF-8 does not have.
    """
    files = store(docs, text)
    known = files.mapInArrow(_measure, MEASURED).dropDuplicates(["digest"])
    media = known.select("digest", F.struct(*[c for c in known.columns if c != "digest"]).alias("payload"))
    pages = docs.select(F.struct(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row")).alias("key"), F.pandas_udf(_page_of, StringType())(F.col(doc_id).cast("string"), F.col(text)).alias("page"))
    pages = written(pages.select("key", sequence("page").alias("parts")), "media-pages")
    rows = resolve(pages, media).select("key.doc_id", F.filter("parts", lambda p: p["kind"] == "media")[0].alias("m"))
    return rows.select("doc_id", *[F.col(f"m.payload.{c}").alias(c) for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")],
                       F.col("m.position").alias("position"), F.col("m.caption").alias("caption"))
