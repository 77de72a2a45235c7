"""File formats of a capture: PNG of one channel, PLY, MP4 metadata. Decoding runs where Spark reads the bytes.

Each decoder takes whole bytes and raises FormatError on what it can't read exactly.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PNG_SIGN = b"\x89PNG\r\n\x1a\n"


class FormatError(ValueError):
    """A file isn't what its place in a capture asks for."""


def unfiltered(raw: np.ndarray, rows: int, stride: int, step: int) -> np.ndarray:
    """Bytes of the rows of a PNG, each behind its filter type; `step` bytes make a pixel."""
    lines = raw.reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride), np.uint8)
    for k in range(rows):
        kind, line, above = int(lines[k, 0]), lines[k, 1:], out[k]
        if kind == 0:
            out[k + 1] = line
        elif kind == 1:
            out[k + 1] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[k + 1] = line + above
        elif kind in (3, 4):
            done, up, src = bytearray(stride), above.tolist(), line.tolist()
            for i in range(stride):
                a = done[i - step] if i >= step else 0
                b = up[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[i - step] if i >= step else 0
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                done[i] = (src[i] + guess) & 255
            out[k + 1] = np.frombuffer(done, np.uint8)
        else:
            raise FormatError(f"PNG row filter {kind}")
    return out[1:]


def png_gray(data: bytes) -> np.ndarray:
    """The samples of a PNG of one channel with 8 or 16 bits, not interlaced."""
    if data[:8] != PNG_SIGN:
        raise FormatError("not a PNG")
    at, head, parts = 8, None, []
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise FormatError("damaged PNG chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise FormatError("PNG without a header")
    width, height, bits, colour, _, _, interlaced = head
    if colour != 0 or bits not in (8, 16) or interlaced:
        raise FormatError(f"PNG of colour type {colour}, {bits} bits, interlace {interlaced}")
    step = bits // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise FormatError("damaged PNG data") from e
    if len(raw) != height * (width * step + 1):
        raise FormatError("PNG of another size than its header says")
    return unfiltered(raw, height, width * step, step).reshape(-1).view(f">u{step}").astype(f"u{step}").reshape(height, width)


def png_bytes(samples: np.ndarray) -> bytes:
    """A PNG of one channel; the counterpart of png_gray."""
    step = samples.dtype.itemsize
    rows = samples.astype(f">u{step}").view(np.uint8).reshape(samples.shape[0], -1)
    packed = zlib.compress(np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", samples.shape[1], samples.shape[0], 8 * step, 0, 0, 0, 0)
    return PNG_SIGN + chunk(b"IHDR", head) + chunk(b"IDAT", packed) + chunk(b"IEND", b"")


def frame_id(path: Column) -> Column:
    """The number that names a frame's file; null for other files."""
    return F.regexp_extract(path, r"(?i)/([0-9]+)\.png$", 1).try_cast("long")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Path, length and frame of a folder's files, from names alone; files without a frame are the odd ones."""
    return spark.read.format("binaryFile").load(folder).select("path", "length", frame_id(F.col("path")).alias("frame"))


def frames(spark: SparkSession, folder: str, shape: tuple[int, int] | None, bits: int) -> DataFrame:
    """Frame, path, height, width and raw (row by row) of each PNG of a folder.

    A frame of another shape or width of samples ends the query with an error that names it.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for frame, path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    x = png_gray(content)
                except FormatError as e:
                    raise FormatError(f"frame {frame} ({path}): {e}") from e
                if x.dtype.itemsize * 8 != bits or (shape and x.shape != tuple(shape)):
                    raise FormatError(f"frame {frame} ({path}): {x.dtype} {x.shape}, not {bits} bits {shape}")
                raw = pa.array([x.reshape(-1).astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([frame], pa.int64()), pa.array([path]), pa.array([x.shape[0]], pa.int32()), pa.array([x.shape[1]], pa.int32()), raw], ["frame", "path", "height", "width", "raw"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][nN][gG]").load(folder)
    return found.select(frame_id(F.col("path")).alias("frame"), "path", "content").where("frame is not null").mapInArrow(decode, "frame long, path string, height int, width int, raw array<int>")


def pixels(images: DataFrame, value: str = "raw", stride: int = 1) -> DataFrame:
    """A row for each pixel (v, u) whose row and column the stride divides."""
    each = images.select("frame", "width", F.posexplode(value).alias("k", value))
    each = each.select("frame", F.floor(F.col("k") / F.col("width")).cast("int").alias("v"), F.pmod("k", "width").cast("int").alias("u"), value)
    return each if stride == 1 else each.where((F.pmod("v", F.lit(stride)) == 0) & (F.pmod("u", F.lit(stride)) == 0))


#: Names of PLY's scalar types and their NumPy codes.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def ply_points(data: bytes) -> np.ndarray:
    """The vertices of a binary little-endian PLY as a structured array."""
    end = data.find(b"end_header\n")
    if data[:4] != b"ply\n" or end < 0:
        raise FormatError("not a PLY")
    lines = data[:end].decode("ascii").splitlines()
    if "format binary_little_endian 1.0" not in lines:
        raise FormatError("a PLY of another format than binary little-endian")
    n, fields, inside = 0, [], False
    for words in map(str.split, lines):
        if words[:1] == ["element"]:
            inside = words[1] == "vertex"
            n = int(words[2]) if inside else n
        elif words[:1] == ["property"] and inside:
            if words[1] not in PLY_TYPES:
                raise FormatError(f"PLY property {words[1]}")
            fields.append((words[2], "<" + PLY_TYPES[words[1]]))
    kind = np.dtype(fields)
    if len(data) < end + 11 + n * kind.itemsize:
        raise FormatError("a PLY shorter than its header says")
    return np.frombuffer(data, kind, n, end + 11)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """Path, x, y, z of the vertices of all PLY files under a path."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = ply_points(content)
                for k in range(0, len(p), 1 << 16):
                    part = p[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), *(pa.array(part[a].astype("f4")) for a in "xyz")], ["path", *"xyz"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "path string, x float, y float, z float")


def write_ply(points: DataFrame, path: str) -> int:
    """One binary PLY of x, y, z and, where points has them, r, g, b. Gives the number of vertices.

    Rows reach the driver a partition at a time and are written as they come, so memory is bounded by a partition; a cloud
    too large for one file is a table: write it as Parquet.
    """
    colour = all(c in points.columns for c in "rgb")
    kind = np.dtype([(a, "<f4") for a in "xyz"] + [(a, "u1") for a in ("red", "green", "blue")] * colour)
    chosen = points.select(*"xyz", *(list("rgb") if colour else [])).persist()
    n = chosen.count()
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *[f"property float {a}" for a in "xyz"], *[f"property uchar {a}" for a in ("red", "green", "blue")] * colour, "end_header\n"]
    fs, inner = filesystem(path)
    with fs.open_output_stream(inner, compression=None) as f:
        f.write("\n".join(head).encode())
        held = []
        for row in chosen.toLocalIterator():
            held.append(tuple(row))
            if len(held) == 1 << 16:
                f.write(np.array(held, kind).tobytes())
                held = []
        f.write(np.array(held, kind).tobytes())
    chosen.unpersist()
    return n


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def boxes(data: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
    """The boxes of a part of an MP4 file: kind and body."""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        size = size or len(data) - at
        if size < head:
            raise FormatError("damaged MP4 box")
        yield kind, data[at + head : at + size]
        at += size


def video_track(moov: bytes) -> dict:
    """width, height, frame_count, duration, fps of the first video track of an MP4's moov box."""
    for kind, trak in boxes(moov):
        inner = dict(boxes(trak)) if kind == b"trak" else {}
        media = dict(boxes(inner.get(b"mdia", b"")))
        if media.get(b"hdlr", b"")[8:12] != b"vide":
            continue
        md, tk = media[b"mdhd"], inner[b"tkhd"]
        scale, length = struct.unpack(">IQ", md[20:32]) if md[0] else struct.unpack(">II", md[12:20])
        table = dict(boxes(dict(boxes(media[b"minf"]))[b"stbl"]))
        runs = np.frombuffer(table[b"stts"][8:], ">u4").reshape(-1, 2).astype(np.int64)
        n = int(runs[:, 0].sum())
        ticks = int((runs[:, 0] * runs[:, 1]).sum()) or length
        width, height = (v >> 16 for v in struct.unpack(">II", tk[-8:]))
        fps = n * scale / ticks if ticks else 0.0
        return {"width": width, "height": height, "frame_count": n, "fps": fps, "duration": n / fps if fps else 0.0}
    raise FormatError("an MP4 without a video track")


def video_metadata(path: str) -> dict:
    """Metadata of a video from its moov box; the frames' bytes are skipped, not read."""
    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as f:
        at, end = 0, f.size()
        while at + 8 <= end:
            head = f.read_at(min(16, end - at), at)
            size, kind = struct.unpack(">I4s", head[:8])
            if size == 1:
                size = struct.unpack(">Q", head[8:16])[0]
            size = size or end - at
            if size < 8:
                break
            if kind == b"moov":
                return video_track(next(boxes(f.read_at(size, at)))[1])
            at += size
    raise FormatError(f"{path}: no moov box")
