"""Operator 8, token-ID / binary output: one zstandard frame a document under a shared dictionary.

A store is a folder of shard files and the dictionary they share. A shard holds documents of one range of doc_id in
ascending order (nulls first). Rows of one doc_id that are more than a shard holds are dealt to several by a checksum of
their ids; in a shard equal doc_ids come in the order of their frames:

    magic "LQT1", 32 bytes SHA-256 of the dictionary, 1 byte width of an id (2 or 4),
    the documents' frames, one after the other,
    index: for each document 1 byte null flag, doc_id int64, frame offset int64, ids int64, all little-endian,
    int64 number of documents, int64 position of the index, magic "1TQL"

so one document is read with two small reads and one frame. The dictionary is trained on the id arrays of at most
`sample` documents, those with the smallest hash of doc_id, of which the first SAMPLE_CHARS characters each: 32 M characters at
most. It changes sizes only, never the ids that come back.

Encoding and compression happen where a document is read, so the one shuffle moves compressed frames; the range bounds
come from the doc_id column alone, the number of shards from the size of the texts; a task writes one shard. A shard is written under a draft name and renamed, so a task can run again.

Null or empty text: only the end id. Very long texts: one frame each. Repeated rows: each is stored. Null doc_id:
stored first. Empty table: a store without shards. Extra columns are ignored; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

TOKENIZER, END_ID = "word_bpe_49k.json", 1
SAMPLE, SAMPLE_CHARS, DICT_BYTES, LEVEL = 1000, 32768, 64 << 10, 3
SHARD_BYTES, LEAST = 64 << 20, -(1 << 63)
MAGIC, TAIL, HEAD = b"LQT1", b"1TQL", 4 + 32 + 1
RECORD = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("offset", "<i8"), ("n", "<i8")])


def width_of(tokenizer: str, end_id: int) -> int:
    return 2 if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def serialized(tokenizer: str, end_id: int, text: str | None, width: int) -> bytes:
    return np.append(encoder(tokenizer).ids(text), np.uint32(end_id)).astype(f"<u{width}").tobytes()


def train(docs: DataFrame, tokenizer: str, end_id: int, sample: int = SAMPLE, size: int = DICT_BYTES) -> bytes:
    """A dictionary from the `sample` documents with the smallest hash of doc_id; empty where there's too little to learn."""
    picked = docs.select("doc_id", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(sample)
    wanted = [r[0] for r in picked.select("doc_id").collect() if r[0] is not None]
    if not wanted:
        return b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = width_of(tokenizer, end_id)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"ids": pa.array([serialized(tokenizer, end_id, t, width) for t in b.column(0).to_pylist()], pa.binary())})

    rows = [bytes(r[0]) for r in docs.where(F.col("doc_id").isin(wanted)).orderBy("doc_id", F.xxhash64("text")).limit(sample).select(F.substring("text", 1, SAMPLE_CHARS)).mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:  # too few or too short
        return b""


def bounds_of(docs: DataFrame, shards: int) -> list[int]:
    """The largest doc_id of each shard but the last; a doc_id of many rows stands in it several times. Null counts as least."""
    if shards < 2:
        return []
    ids = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("doc_id"))
    return sorted(int(x) for x in ids.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.2 / shards))


def shards_for(docs: DataFrame) -> int:
    """At least one for each shuffle partition, and one for each SHARD_BYTES of text, by the size that the plan tells or, where it tells none, counted."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))


def write_store(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, shards: int | None = None, sample: int = SAMPLE, level: int = LEVEL) -> list[dict]:
    """Writes a store; gives a row for each shard, in the order of doc_id."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    docs = docs.select("doc_id", "text")
    shards = shards or shards_for(docs)
    learnt = train(docs, tokenizer, end_id, sample)
    common.write_file(f"{path}/dictionary", [learnt])
    key = hashlib.sha256(learnt).digest()
    bounds = bounds_of(docs, shards)
    held = spark.sparkContext.broadcast(learnt)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = width_of(tokenizer, end_id)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(held.value) if held.value else None, write_dict_id=False)
        for b in batches:
            raws = [np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes() for ids in encoder(tokenizer).each(b.column(1).to_pylist())]
            ids = b.column(0)
            known = np.array(ids.fill_null(LEAST))
            shard, last = (np.searchsorted(np.array(bounds, dtype=np.int64), known, side=s) for s in ("left", "right"))
            for k in np.flatnonzero(last > shard).tolist():  # a doc_id of several shards: rows are dealt by their ids
                shard[k] += zlib.crc32(raws[k]) % (last[k] - shard[k] + 1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(shard, pa.int32()), pa.array([len(r) // width for r in raws], pa.int64()), pa.array([packer.compress(r) for r in raws], pa.binary())], ["doc_id", "shard", "n", "frame"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = width_of(tokenizer, end_id)
        rows = ((s, i, n, f) for b in batches for i, s, n, f in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            shard, index, at = row[0], [], HEAD

            def chunks(shard=shard, index=index) -> Iterator[bytes]:
                nonlocal row, at
                yield MAGIC + key + bytes([width])
                while row is not None and row[0] == shard:
                    index.append((row[1] is None, row[1] or 0, at, row[2]))
                    at += len(row[3])
                    yield row[3]
                    row = next(rows, None)
                yield np.array(index, dtype=RECORD).tobytes()
                yield struct.pack("<qq", len(index), at) + TAIL

            size = common.write_file(name := f"{path}/shard-{shard:06d}", chunks())
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "docs": [len(index)], "ids": [sum(x[3] for x in index)], "bytes": [size]})

    frames = docs.mapInArrow(squeeze, "doc_id long, shard int, n long, frame binary")
    done = frames.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "frame").mapInArrow(put, "shard long, path string, docs long, ids long, bytes long").collect()
    return sorted((r.asDict() for r in done), key=lambda r: r["shard"])


class Shard:
    """Reads one shard file: its index at once, frames as they are asked for."""

    def __init__(self, path: str, learnt: bytes) -> None:
        fs, inner = common.filesystem(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        head, tail = self.file.read_at(HEAD, 0), self.file.read_at(20, size - 20)
        if head[:4] != MAGIC or tail[16:] != TAIL:
            raise ValueError(f"{path} is not a token shard")
        if head[4:36] != hashlib.sha256(learnt).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.width = head[36]
        n, self.at = struct.unpack("<qq", tail[:16])
        self.index = np.frombuffer(self.file.read_at(n * RECORD.itemsize, self.at), dtype=RECORD)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(learnt) if learnt else None)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        start = int(self.index["offset"][k])
        stop = int(self.index["offset"][k + 1]) if k + 1 < len(self.index) else self.at
        n = int(self.index["n"][k])
        return np.frombuffer(self.unpacker.decompress(self.file.read_at(stop - start, start), max_output_size=n * self.width), dtype=f"<u{self.width}")


def read_store(spark: SparkSession, path: str, shards: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files."""
    starts, total = [], 0
    for s in shards:
        starts.append((s["path"], total))
        total += s["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = common.filesystem(f"{path}/dictionary")
        with fs.open_input_file(inner) as f:
            learnt = f.read()
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(name, learnt)
                n = shard.index["n"]
                start = first + np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
                for k in range(0, len(n), 4096):
                    part = range(k, min(k + 4096, len(n)))
                    crc = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in part]
                    doc_id = pa.array(shard.index["doc_id"][part.start : part.stop], pa.int64(), mask=shard.index["null"][part.start : part.stop].astype(bool))
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(start[part.start : part.stop], pa.int64()), pa.array(n[part.start : part.stop], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    names = spark.createDataFrame(starts, "path string, start long").repartition(max(1, len(starts)))
    return names.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_folder(spark, "tokens")
    return read_store(spark, path, write_store(common.table(spark, sf_dir, "documents"), path))
