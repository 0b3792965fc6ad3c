"""Interleaved sequences of text and media: HTML to ordered structs, payloads by digest."""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import join_hot, kept

#: Samples of one image row, and the multiple of bytes to which a payload is filled up.
WIDTH = 64
#: Fixed values of the PNG format: its signature.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position: int, kind: string, text: string, digest: string, caption: string>>"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def fill(raw: bytes, unit: int = WIDTH) -> bytes:
    """raw with zeros appended up to a positive multiple of unit bytes."""
    return raw + bytes(unit - len(raw) % unit if len(raw) % unit or not raw else 0)


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG image, WIDTH samples a row, whose samples are the payload (a multiple of WIDTH bytes)."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_png(stored: bytes) -> bytes:
    """The samples of an image that encode_png wrote; ValueError for other bytes or a wrong checksum."""
    if stored[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG image")
    at, width, body = 8, 0, []
    while at < len(stored):
        (n,), kind = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        data = stored[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + data)) != stored[at + 8 + n : at + 12 + n]:
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            width = struct.unpack(">I", data[:4])[0]
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Size in samples, extremes, mean and the counts of 8 equal ranges of sample values."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x >> 5, minlength=8)
    return f"{WIDTH}x{len(x) // WIDTH};min={x.min()};max={x.max()};mean={x.sum(dtype=np.int64) / len(x):.6f};hist={','.join(map(str, counts))}"


class _Sequence(HTMLParser):
    """Text and media in document order. A figcaption captions every medium of its own figure, wherever it stands there; a
    medium without one has its alt text as caption; a caption of a figure without media is text like other text."""

    BREAKS = frozenset("p div br li h1 h2 h3 h4 h5 h6 article section tr table ul ol blockquote pre hr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []  # kind, text, digest, caption
        self.words: list[str] = []
        self.figures: list[list] = []  # open figures: number of the first item, media, captions as (place among items, text)
        self.hidden, self.caption = 0, False

    def flush(self) -> None:
        if said := " ".join("".join(self.words).split()):
            if self.caption and self.figures:
                self.figures[-1][1].append((len(self.items), said))
            else:
                self.items.append(["text", said, None, None])
        self.words = []

    def leave_figure(self) -> None:
        first, captions = self.figures.pop()
        media = [x for x in self.items[first:] if x[0] == "media" and not x[4:]]
        if media and captions:
            for x in media:
                x[3] = " ".join(c for _, c in captions)
        elif not media:
            for k, (at, said) in enumerate(captions):
                self.items.insert(at + k, ["text", said, None, None])
        for x in media:
            x.append(True)  # belongs to this figure, not to one around it

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figure":
            self.flush()
            self.figures.append([len(self.items), []])
        elif tag == "figcaption":
            self.flush()
            self.caption = True
        elif tag in ("img", "video", "audio", "source"):
            self.flush()
            got = dict(attrs)
            src = got.get("src") or ""
            self.items.append(["media", None, src.removeprefix("media:"), got.get("alt")])
        elif tag in self.BREAKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.flush()
            self.caption = False
        elif tag == "figure":
            self.flush()
            self.caption = False
            if self.figures:
                self.leave_figure()
        elif tag in self.BREAKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)

    def finish(self) -> list[list]:
        self.close()
        self.flush()
        while self.figures:
            self.leave_figure()
        return self.items


def parse(page: str | None) -> list[dict]:
    """The ordered items of one page; null or empty: none."""
    parser = _Sequence()
    parser.feed(page or "")
    return [{"position": i, "kind": k, "text": t, "digest": d, "caption": c} for i, (k, t, d, c, *_) in enumerate(parser.finish())]


def sequences(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """key and `items`, the page's text and media references in order (a null page has no items). Other columns are dropped."""
    return pages.select(key, items(F.col(page)).alias("items"))


def _items(page: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    return pa.array([parse(x.as_py()) for x in page], kind)


def items(page: Column) -> Column:
    """The ordered text and media references of each page; null: none."""
    return F.arrow_udf(_items, SEQUENCE)(page)


def references(found: DataFrame, key: str = "page_id") -> DataFrame:
    """A row for each media reference: key, position, digest, caption."""
    return found.select(key, F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("m")).select(key, "m.position", "m.digest", "m.caption")


def describe(stored: DataFrame) -> DataFrame:
    """What the stored bytes of each digest decode to; stored: digest, media. Repeats of a digest give one row, null media none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                media = media.as_py()
                payload = decode_png(media)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            if rows:
                cols = [pa.array(c, pa.int64() if isinstance(c[0], int) else pa.string()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = stored.filter("media IS NOT NULL").select("digest", "media").mapInArrow(run, FEATURES)
    return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in rows.columns if c != "digest"])


def resolve(refs: DataFrame, payloads: DataFrame) -> DataFrame:
    """refs with the columns of payloads (one row for each digest); a reference without payload keeps nulls."""
    return join_hot(refs, payloads, "digest", "left")


def publish(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as a page of its halves, with its payload's image in a figure between them and once more at the end: key, n_bytes, page, digest, media.

    The payload is the text's UTF-8 (null: empty), filled up with zeros to a positive multiple of WIDTH bytes and kept
    as PNG. media is null where the same task has already put out that digest in the same 512 rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part, seen, rows = b.slice(i, 512), set(), []
                for x in part.column(1):
                    said = x.as_py() or ""
                    raw = said.encode()
                    payload = fill(raw)
                    digest = hashlib.sha256(payload).hexdigest()
                    half = said.rfind(" ", 0, len(said) // 2 + 1) + 1
                    shown = f'<figure><img src="media:{digest}" alt="{len(raw)}"><figcaption>{len(raw)} bytes in {len(payload) // WIDTH} rows</figcaption></figure>'
                    page = f'<article><p>{html.escape(said[:half])}</p>{shown}<p>{html.escape(said[half:])}</p><p>again <img src="media:{digest}" alt="whole text"></p></article>'
                    rows.append((len(raw), page, digest, None if digest in seen else encode_png(payload)))
                    seen.add(digest)
                n, pages, digests, media = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], [key, "n_bytes", "page", "digest", "media"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_bytes long, page string, digest string, media binary")


def interleave(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's text stored as a medium, found again through its page's sequence, and read back.

    Result: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; the position and caption of the first
    reference in the page's sequence, n_items of that, and positions of all references. Equal texts give
    equal values; null counts as empty; a row is put out for every row, repeated and null keys included. Texts of any length
    are stored whole; other columns are not read; an empty table gives no row.

    Pages are parsed where they are made and only references are kept of them. Stored bytes are decoded where they lie, once for each
    copy in the store; only digests and figures are shuffled.
    """
    pages = publish(docs, key, text).withColumn("items", items(F.col("page")))
    refs = F.filter("items", lambda x: x["kind"] == "media")
    first = F.get(refs, F.lit(0))
    row = F.struct(F.col(key).alias("key"), "n_bytes", F.size("items").alias("n_items"), F.transform(refs, lambda x: x["position"]).alias("positions"), first["caption"].alias("caption")).alias("row")
    stored = kept(pages.select(row, first["digest"].alias("ref"), F.when(F.col("media").isNotNull(), F.col("digest")).alias("digest"), "media"), "media")
    out = resolve(stored.select("row", F.col("ref").alias("digest")), describe(stored))
    return out.select(
        F.col("row.key").alias(key), "row.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.element_at("row.positions", 1).alias("position"), "row.caption", "row.n_items", "row.positions"
    )
