"""Media columns: interleaved document sequences of text and media, payloads resolved by digest.

A page's HTML is parsed into an ordered array of items, each a stretch of text or a reference to a
media object (with its caption), so that text, media and captions keep their places. Media live
in a content-addressed store: a payload is padded to whole rows of 64 bytes and stored losslessly as
an 8-bit grey image (PNG) 64 samples wide; its key is the SHA-256 of the padded payload. The store
is written to the shared folder and read back; what later steps use comes from the stored bytes only.
References meet the store by an equi-join on the digest; both sides are narrow, and a digest that
many pages share is split by adaptive execution like any other skewed join.

Cases: null or empty HTML has an empty sequence; a null or empty payload is 64 zero bytes; references
whose digest the store does not hold stay, unresolved; broken markup is parsed as far as it
makes sense, scripts and styles are left out; equal payloads are stored once per task at most and
count once; repeated pages each keep their sequence; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import cut

#: Samples in a row of the stored image.
ROW = 64
#: Payloads that a task remembers as stored already, and bytes of one batch it sends on.
MEMO_DIGESTS, BATCH_BYTES = 100_000, 8_000_000
#: What a media reference starts with, before the digest in hex.
SCHEME = "sha256:"
#: The signature of PNG files, elements that refer to media, elements without readable text.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEDIA_TAGS = ("img", "video", "audio", "source", "embed")
SILENT_TAGS = ("script", "style", "template", "noscript")
#: Elements that do not interrupt a stretch of text.
INLINE_TAGS = ("a", "abbr", "b", "code", "em", "i", "mark", "s", "small", "span", "strong", "sub", "sup", "u")
ITEMS = "array<struct<position: int, kind: string, text: string, digest: string, caption: string, src: string>>"


class Sequence(HTMLParser):
    """Items of a page in order: (kind, text, src, caption)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.items.append(["text", text, None, None])
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in SILENT_TAGS:
            self.silent += 1
        elif tag in MEDIA_TAGS:
            found = dict(attrs)
            if src := found.get("src"):
                self.flush()
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append(["media", None, src, found.get("alt") or found.get("title")])
        elif tag == "figcaption" and self.figure is not None:
            self.flush()
            self.caption = []
        elif tag not in INLINE_TAGS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_startendtag(self, tag, attrs):
        if tag not in SILENT_TAGS:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        elif tag in ("figure", "figcaption"):
            self.flush()
            if self.caption is not None:
                text = " ".join("".join(self.caption).split())
                for i in self.figure or ():
                    self.items[i][3] = text or self.items[i][3]
                self.caption = None
            if tag == "figure":
                self.figure = None
        elif tag not in INLINE_TAGS:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse_page(html: str | None) -> list[tuple]:
    """(position, kind, text, digest, caption, src) per item; ``digest`` is null for references of other schemes."""
    page = Sequence()
    page.feed(html or "")
    page.close()
    if page.caption is not None:  # a figure that is never closed
        page.handle_endtag("figure")
    page.flush()
    out = []
    for i, (kind, text, src, caption) in enumerate(page.items):
        digest = src[len(SCHEME) :].lower() if src and src.startswith(SCHEME) else None
        out.append((i, kind, text, digest, caption, src))
    return out


def sequences(html: Column) -> Column:
    """Array of items (position, kind, text, digest, caption, src) of each page."""

    @F.arrow_udf(ITEMS)
    def parse_pages(pages: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("src", pa.string())]))
        names = ("position", "kind", "text", "digest", "caption", "src")
        return pa.array([[dict(zip(names, item)) for item in parse_page(p.as_py())] for p in pages], kind)

    return parse_pages(html)


def payload(text: Column) -> Column:
    """UTF-8 bytes of a text, with zeros up to a positive multiple of ROW."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    rows = F.greatest(F.lit(1), F.ceil(F.length(raw) / ROW)).cast("int")
    return F.rpad(raw, rows * ROW, F.lit(b"\x00"))


def chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def store(data: bytes) -> bytes:
    """``data``, whole rows of samples, as a PNG image."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # filter 0 in front of every row
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def restore(media: bytes) -> bytes:
    """The samples of an image made by :func:`store`; every checksum is verified."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a stored image")
    at, parts, width = 8, [], 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        name, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(name + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged image")
        if name == b"IHDR":
            width = struct.unpack_from(">I", data)[0]
        elif name == b"IDAT":
            parts.append(data)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)
    return lines[:, 1:].tobytes()


def features(data: bytes) -> str:
    """Size and grey statistics of the samples, in integers."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    used = np.flatnonzero(counts)
    total = int((counts * np.arange(256)).sum())
    return f"{ROW}x{len(data) // ROW} min={used[0]} max={used[-1]} mean_milli={total * 1000 // len(data)} levels={len(used)} mode={int(counts.argmax())}"


def store_media(payloads: Column, rows: DataFrame) -> DataFrame:
    """(digest, media) of the distinct payloads, written to the shared folder.

    A payload that several tasks meet may be stored by each; readers count a digest once.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        digests, media, size = [], [], 0
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()
                digest = hashlib.sha256(data).digest()
                if digest in seen:
                    continue
                if len(seen) >= MEMO_DIGESTS:
                    seen.clear()
                seen.add(digest)
                digests.append(digest.hex())
                media.append(store(data))
                size += len(media[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(media, pa.binary())], ["digest", "media"])
                    digests, media, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    return cut(rows.select(payloads.alias("payload")).mapInArrow(write, "digest string, media binary"))


READ_SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(stored: DataFrame) -> DataFrame:
    """Read every stored object back: digest, sizes and checksums of what was read, and features."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["digest", *[c.split()[0] for c in READ_SCHEMA.split(", ")]]
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column("digest"), batch.column("media")):
                media = media.as_py()
                data = restore(media)
                rows.append((digest.as_py(), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), features(data)))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    found = stored.select("digest", "media").mapInArrow(read, f"digest string, {READ_SCHEMA}")
    kept = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    return found.groupBy("digest").agg(*[F.min(c).alias(c) for c in kept])


def resolve(pages: DataFrame, media: DataFrame, id_col: str, html_col: str, only_media: bool = False) -> DataFrame:
    """A row per item of every page (id, position, kind, text, digest, caption, src), with the columns of ``media``.

    ``media`` has one row per ``digest``. Unresolved references and text have nulls there. With ``only_media``, items of text
    keep their places in the count but are not rows.
    """
    found = sequences(F.col(html_col))
    if only_media:
        found = F.filter(found, lambda i: i["kind"] == "media")
    items = pages.select(F.col(id_col), F.explode(found).alias("item")).select(id_col, "item.*")
    # a reference by address is looked up by the digest of its address
    items = items.withColumn("digest", F.coalesce("digest", F.when(F.col("src").isNotNull(), F.sha2(payload(F.col("src")), 256))))
    held = media.withColumnRenamed("digest", "__digest")
    return items.join(held, items["digest"] == held["__digest"], "left").drop("__digest")


def interleave(pages: DataFrame, media: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One row per page with items: its sequence as an ordered array, media columns included.

    Pages that repeat id and HTML are resolved once and come back as often as they were there.
    """
    page = pages.groupBy(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(html_col), F.lit("")).cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.any_value(html_col).alias("html"))
    rows = resolve(page.select(F.struct("id", "digest", "n").alias("page"), "html"), media, "page", "html")
    item = F.struct(*[F.col(c) for c in rows.columns if c != "page"])
    whole = rows.groupBy("page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return whole.withColumn("copy", F.explode(F.expr("sequence(1L, page.n)"))).select(F.col("page.id").alias(id_col), "items")


def page_payloads(pages: DataFrame, html_col: str) -> DataFrame:
    """Payloads of the media that pages refer to by digest or by address; an address stands for its own bytes, as tables hold no fetched media."""
    items = pages.select(F.explode(sequences(F.col(html_col))).alias("i")).where("i.kind = 'media'")
    return items.select(F.col("i.src").alias("src")).distinct()


def escaped(text: Column) -> Column:
    """Text that markup can't start in."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def document_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pages (doc, html): a paragraph a line, and after half of the lines a figure that shows the whole text as a media object.

    The line before the figure is its caption. ``doc`` is (doc_id, n_bytes).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.length(text.cast("binary")).cast("long").alias("n_bytes")).alias("doc"), F.sha2(payload(F.col(text_col)), 256).alias("digest"), F.split(escaped(text), "\n").alias("lines"))
    half = F.floor(F.size("lines") / 2).cast("int")
    paragraphs = lambda lines: F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    caption = F.coalesce(F.get("lines", half - 1), F.lit(""))
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.col("digest"), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    html = F.concat(F.lit("<article>"), paragraphs(F.slice("lines", F.lit(1), half)), figure, paragraphs(F.slice("lines", half + 1, F.size("lines"))), F.lit("</article>"))
    return rows.select("doc", html.alias("html"))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media, read it back, and give each document what its reference resolves to, with the reference's place and caption."""
    media = cut(read_media(store_media(payload(F.col(text_col)), docs)))
    found = resolve(document_pages(docs, id_col, text_col), media, "doc", "html", only_media=True)
    return found.select("doc.doc_id", "doc.n_bytes", *[c.split()[0] for c in READ_SCHEMA.split(", ")], "position", "caption")
