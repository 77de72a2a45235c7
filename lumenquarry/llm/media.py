"""Operator 2, media columns: interleaved sequences of text and media references whose payloads a digest join resolves.

`interleave` parses HTML into an ordered array of (position, kind, text, ref, caption): runs of text, and references of
img, video and audio elements in their places. An element's reference is its src, data-src or the first of its srcset;
without one, that of the first source element inside it (a picture's source counts as its img's). A caption is the
figure's figcaption, else the alt text; a figcaption that isn't closed ends at the next block element, and one without
media is text. `resolve` joins references of the form sha256:<hex> with a media table by digest and puts what it found at
the same positions; segments without a digest don't take part in the join.

A media table holds each payload as an 8-bit grey PNG, 64 samples a row, with its SHA-256. `store_texts` makes one from
texts: UTF-8 and bytes 0 up to a positive multiple of 64. It is written to the shared folder where the text is read, so
payloads are never shuffled; the join moves digests and features. A payload that many rows share is stored by each task
that meets it, once a batch, and its rows of features meet in one per digest before the join.

Null or empty text: 64 bytes 0. Very long texts: whole, one image each. Repeated rows and equal texts: equal values, a
row each. Null doc_id: a row. Empty table: no rows. Extra columns are ignored; doc_id, text, lang and source are read.
Null or empty html: an empty sequence. A reference whose digest the table doesn't have resolves to null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROW = 64
PNG = b"\x89PNG\r\n\x1a\n"
LEVEL = 1
SEGMENT = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
MEDIA_TAGS = {"img", "video", "audio"}
SILENT_TAGS = {"script", "style"}
BLOCK_TAGS = {"p", "div", "article", "section", "ul", "ol", "table", "figure", "h1", "h2", "h3", "h4", "h5", "h6"}


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image of payload, ROW samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = rows
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png made; raises where a checksum or the form is wrong."""
    if data[:8] != PNG:
        raise ValueError("not a PNG image")
    at, packed, size = 8, [], None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images are read")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only filter type 0 is read")
    return lines[:, 1:].tobytes()


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % ROW or (0 if raw else ROW)), len(raw)


def feature(payload: bytes) -> str:
    """Mean of the columns against the whole, a bit each, and the counts of samples by their upper 3 bits."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sums = rows.sum(axis=0, dtype=np.int64)
    bits = "".join("1" if x * ROW >= sums.sum() else "0" for x in sums.tolist())
    return f"{int(bits, 2):016x}:" + ",".join(map(str, np.bincount(rows.ravel() >> 5, minlength=8).tolist()))


class Sequence(HTMLParser):
    """Text and media references in their order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None
        self.open: dict | None = None  # a video, audio or picture without a reference yet
        self.silent = 0

    def put(self, kind: str, text: str | None = None, ref: str | None = None, caption: str | None = None) -> None:
        self.out.append({"position": len(self.out), "kind": kind, "text": text, "ref": ref, "caption": caption})

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.put("text", text)
        self.text = []

    def end_caption(self) -> None:
        """Gives the caption to the figure's media; a caption without media is text."""
        if self.caption is None:
            return
        said, self.caption = " ".join("".join(self.caption).split()), None
        media = [x for x in self.out[self.figure if self.figure is not None else len(self.out) :] if x["kind"] != "text"]
        for x in media:
            x["caption"] = said
        if not media:
            self.text.append(f" {said} ")
            self.late = said if self.figure is not None else None

    late: str | None = None  # a caption that came before its figure's media

    def media(self, kind: str, ref: str, caption: str | None) -> None:
        self.flush()
        if self.late is not None and self.figure is not None:
            if self.out and self.out[-1]["text"] == self.late:
                self.out.pop()
            caption = self.late
        self.put(kind, ref=ref, caption=caption)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = {k: v for k, v in attrs if v}
        listed = at.get("srcset", "").split()
        ref = at.get("src") or at.get("data-src") or (listed[0].rstrip(",") if listed else None)
        if tag in BLOCK_TAGS:
            self.end_caption()
        if tag in SILENT_TAGS:
            self.silent += 1
        elif tag == "figure":
            self.flush()
            self.figure, self.late = len(self.out), None
        elif tag == "figcaption":
            self.end_caption()
            self.caption = []
        elif tag in MEDIA_TAGS and ref:
            self.media(tag, ref, at.get("alt"))
            if tag == "img":
                self.open = None
        elif tag == "img" and self.open and self.open["ref"]:
            self.media("img", self.open["ref"], at.get("alt"))
            self.open = None
        elif tag in ("video", "audio", "picture"):
            self.open = {"kind": tag, "ref": None}
        elif tag == "source":
            if self.open and ref and not self.open["ref"]:
                self.open["ref"] = ref
        elif tag not in ("b", "i", "em", "strong", "a", "span"):
            (self.text if self.caption is None else self.caption).append(" ")

    def end_open(self) -> None:
        """A video, audio or picture whose only reference is a source's."""
        if self.open and self.open["ref"]:
            self.media("img" if self.open["kind"] == "picture" else self.open["kind"], self.open["ref"], None)
        self.open = None

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag in ("video", "audio", "picture"):
            self.end_open()
        elif tag == "figure":
            self.end_caption()
            self.end_open()
            self.flush()
            self.figure, self.late = None, None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def segments(html: str | None) -> list[dict]:
    parser = Sequence()
    parser.feed(html or "")
    parser.close()
    parser.end_caption()
    parser.end_open()
    parser.flush()
    return parser.out


def interleave(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and `segments`, the page's text and media references in their order."""
    common.arrow_batches(pages.sparkSession)
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([segments(x) for x in b.column(1).to_pylist()], kind)], [key, "segments"])

    return pages.select(key, html).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, segments array<{SEGMENT}>")


def resolve(sequences: DataFrame, key: str, media: DataFrame) -> DataFrame:
    """key, position, kind, text, caption, digest of every segment with media's other columns; media is unique by digest."""
    each = sequences.select(key, F.explode("segments").alias("s")).select(key, "s.*")
    each = each.withColumn("digest", F.when(F.startswith("ref", F.lit("sha256:")), F.substring("ref", 8, 64))).drop("ref")
    without = each.where("digest is null")
    for name, kind in media.drop("digest").dtypes:
        without = without.withColumn(name, F.lit(None).cast(kind))
    found = each.where("digest is not null").join(media, "digest", "left")
    return found.unionByName(without.select(found.columns))


def store_texts(docs: DataFrame, path: str) -> None:
    """Writes the media table of the texts: digest, media."""
    common.arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[str, bytes] = {}
            for text in b.column(0):
                payload, _ = padded(text.as_py())
                if (digest := hashlib.sha256(payload).hexdigest()) not in held:
                    held[digest] = to_png(payload)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.binary())], ["digest", "media"])

    docs.select("text").mapInArrow(run, "digest string, media binary").write.option("compression", "none").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """What the stored bytes of each payload give, one row a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = media.as_py()
                payload = from_png(data)
                if (found := hashlib.sha256(payload).hexdigest()) != digest:
                    raise ValueError(f"the stored payload {digest} is damaged")
                rows.append((digest, len(payload), found, zlib.crc32(payload[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    rows = spark.read.schema("digest string, media binary").parquet(path).mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in names[1:]])


def text_pages(docs: DataFrame) -> DataFrame:
    """An HTML page for each document: its source as text and its payload as a captioned figure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html, sizes = [], []
            for lang, source, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                payload, n = padded(text.as_py())
                digest = hashlib.sha256(payload).hexdigest()
                html.append(f'<article><p>{escape(source or "")}</p><figure><img src="sha256:{digest}" alt=""><figcaption>{escape(lang or "")} {n}</figcaption></figure></article>')
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_bytes"]), pa.array(html, pa.string())], ["page", "html"])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, "page struct<doc_id:long,n_bytes:long>, html string")


def op2_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    path = common.new_folder(spark, "media")
    store_texts(docs, path)
    rows = resolve(interleave(text_pages(docs), "page"), "page", read_features(spark, path)).where("kind = 'img'")
    return rows.select("page.doc_id", "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
