"""Media columns: interleaved document sequences.

HTML parsing yields, for each document, its items in reading order: runs of text and references to media, which name
their payload by digest and carry the caption of their figure. Payloads are stored once as binary columns of a table
in the shared folder; a join on the digest resolves each reference while position and caption stay with the item.
Payload bytes never take part in a shuffle: what is drawn from them is computed where they lie, and joined by digest.

The stored form is an 8-bit greyscale PNG of rows of WIDTH samples, without filters, so that any bytes padded to whole
rows are kept without loss.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, prepare, save

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
BLOCKS = {"p", "div", "article", "section", "li", "ul", "ol", "td", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "br", "figure", "blockquote", "pre", "header", "footer", "nav", "body", "html", "head", "title"}
SKIPPED = {"script", "style", "template", "noscript"}
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source"}
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,bytes:long>>"


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes padded with blanks to a positive multiple of WIDTH."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_media(payload: bytes) -> bytes:
    """The PNG whose samples are the payload, a positive multiple of WIDTH bytes."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_media(media: bytes) -> np.ndarray:
    """Samples (height, width) of an 8-bit greyscale PNG without filters. Damaged bytes raise ValueError."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, size, data = len(SIGNATURE), None, []
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit greyscale")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def features_of(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy in bits and mean step between neighbours."""
    counts = np.bincount(samples.ravel(), minlength=256)
    share = counts[counts > 0] / samples.size
    levels = np.arange(256)
    mean = (counts @ levels) / samples.size
    deviation = math.sqrt(max(0.0, (counts @ (levels - mean) ** 2) / samples.size))
    step = np.abs(np.diff(samples.astype(np.int16), axis=1)).mean()
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.4f} std={deviation:.4f} entropy={-(share * np.log2(share)).sum():.4f} step={step:.4f}"


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skipped = 0
        self.caption: list[str] | None = None
        self.figure: list[int] | None = None

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "bytes": None})

    def handle_starttag(self, tag, attributes):
        if tag in SKIPPED:
            self.skipped += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA:
            given = dict(attributes)
            source = given.get("src") or ""
            if source:
                self.flush()
                if self.figure is not None:
                    self.figure.append(len(self.items))
                digest = source.removeprefix("sha256:") if source.startswith("sha256:") else hashlib.sha256(source.encode("utf-8", "surrogatepass")).hexdigest()
                size = given.get("data-bytes") or ""
                self.items.append({"kind": MEDIA[tag], "text": given.get("alt"), "digest": digest, "bytes": int(size) if size.isascii() and size.isdigit() and len(size) < 19 else None})
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag in SKIPPED:
            self.skipped -= 1

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = re.sub(r"\s+", " ", "".join(self.caption)).strip()
            self.caption = None
            for i in self.figure or []:
                self.items[i]["text"] = text or self.items[i]["text"]
            if not self.figure and text:
                self.text.append(text)
                self.flush()
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.skipped:
            (self.text if self.caption is None else self.caption).append(data)


def parse_items(markup: str | None) -> list[dict]:
    """Items of a page in reading order: kind text, image, video, audio or source; text (of media: the caption of the
    figure, else alt); digest (of media: the reference's own, else that of its address); bytes as declared, or null."""
    parser = _Items()
    parser.feed(markup or "")
    parser.close()
    parser.flush()
    return [{"position": i, **x} for i, x in enumerate(parser.items)]


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, items): each page's items. Null, empty and broken markup give what can be read, at worst no item."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("bytes", pa.int64())])

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column("id"), pa.array([parse_items(x) for x in b.column("html").to_pylist()], pa.list_(item))], ["id", "items"])

    return rows.mapInArrow(run, f"id {kind}, items {ITEMS}")


def resolve(items: DataFrame, store: DataFrame, uses: str | None = None) -> DataFrame:
    """One row per item: id, position, kind, text (of media: the caption), digest, bytes and the store's other columns,
    null for text and for digests that the store lacks. The store has one row for each digest and, in the column `uses`
    if named, about how many references it has, so that those to one digest need not meet in one task."""
    rows = items.select("id", F.explode("items").alias("i")).select("id", "i.*")
    return join_hot(rows, store, ["digest"], uses) if uses else rows.join(store.hint("merge"), "digest", "left")


def written(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each document as a page with its text as a figure under its first words: (id, html, digest, media), written to the
    shared folder."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            pages, digests, media = [], [], []
            for text in b.column("text").to_pylist():
                stored = encode_media(payload_of(text))
                digest = hashlib.sha256(stored).hexdigest()
                size = len((text or "").encode("utf-8", "surrogatepass"))
                title = html.escape(" ".join((text or "").split(None, 8)[:8]))
                pages.append(f'<article><h1>{title}</h1><figure><img src="sha256:{digest}" data-bytes="{size}"><figcaption>{size} bytes as samples</figcaption></figure></article>')
                digests.append(digest)
                media.append(stored)
            yield pa.record_batch([b.column("id"), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["id", "html", "digest", "media"])

    return save(rows.mapInArrow(run, f"id {kind}, html string, digest string, media binary"), "media-store")


STORED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(store: DataFrame) -> DataFrame:
    """One row for each digest of (digest, media): what the stored bytes hold, read back, and the rows (uses)."""
    names = [x.split()[0] for x in STORED.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for digest, media in zip(b.column("digest").to_pylist(), b.column("media").to_pylist(), strict=True):
                samples = decode_media(media)
                payload = samples.tobytes()
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features_of(samples)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], pa.schema([(n, pa.int64() if x.endswith(" long") else pa.string()) for n, x in zip(names, STORED.split(", "), strict=True)]))

    rows = store.select("digest", "media").mapInArrow(run, STORED)
    return save(rows.groupBy("digest").agg(*(F.max(n).alias(n) for n in names[1:]), F.count("*").alias("uses")), "media-described")


def media_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, position, caption.

    Null counts as empty text, whose payload is one row of blanks. Equal texts share one digest and all values. Rows
    with a null or repeated id keep a row each. An empty table gives no rows.
    """
    store = written(docs, id_col, text_col)
    found = resolve(sequences(store, "id", "html"), described(store), "uses").filter("kind = 'image'")
    return found.select(
        F.col("id").alias(id_col),
        F.col("bytes").alias("n_bytes"),
        "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position",
        F.col("text").alias("caption"),
    )
