"""Shared plumbing of the training-data operators: tables, checkpoints, files, streaming groups."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python; bounds a worker's memory for long texts.
BATCH_ROWS = 1024
#: A side is broadcast only when its counted rows, at their fixed width, stay under this many bytes.
BROADCAST_BYTES = 8 << 20
#: Bits of a sieve at most; its broadcast is an eighth of that in bytes.
SIEVE_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with signs added until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def arrow_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Returns what this process has freed to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, without what earlier tasks of a reused worker hold: token tables of other operators and freed pools."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokens := sys.modules.get(f"{__package__}.tokens"):
            tokens.forget()
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or where that is unset and all runs on this machine, one here."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="lumenquarry-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder.

    The files go when nothing refers to them any more where spark.cleaner.referenceTracking.cleanCheckpoints is set, and
    otherwise at the end of the driver's process.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        atexit.register(remove, file.get())
    return out


def freed(spark: SparkSession) -> None:
    """Has the driver collect its garbage, for only then Spark deletes the shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(path: str) -> None:
    try:
        fs, inner = filesystem(path)
        fs.delete_dir(inner)
    except (OSError, pa.ArrowException):
        pass


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name under the shared folder, removed at the end of the driver's process."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(remove, path)
    return path


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def write_file(path: str, chunks: Iterable[bytes]) -> int:
    """Writes a file under another name and renames it, so that a lost or doubled task leaves no half file."""
    fs, inner = filesystem(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    draft, n = f"{inner}.{uuid.uuid4().hex}.draft", 0
    with fs.open_output_stream(draft, compression=None) as f:
        for c in chunks:
            n += len(c)
            f.write(c)
    fs.move(draft, inner)
    return n


def small_or_shuffled(left: DataFrame, right: DataFrame, on, how: str, right_rows: int, row_bytes: int) -> DataFrame:
    """Joins by broadcasting right when its counted size is under BROADCAST_BYTES, by a shuffle beyond that."""
    return left.join(F.broadcast(right) if right_rows * row_bytes <= BROADCAST_BYTES else right, on, how)


def sieved(rows: DataFrame, key: Column, keys: DataFrame, n_keys: int) -> tuple[DataFrame, DataFrame]:
    """rows whose key (a 64-bit hash) may be in keys' column h, and those whose key isn't: no row of keys is in the second.

    A bitmap of 16 bits a key, SIEVE_BITS at most, is broadcast in pieces of 4 kB; where it is full, all rows are in the
    first.
    """
    bits = min(SIEVE_BITS, max(1 << 15, 1 << (16 * n_keys - 1).bit_length()))
    place = lambda h: F.pmod(h, F.lit(bits)) + 1
    piece, held, at = free(rows, "_piece", "_held", "_at")
    bitmap = cut(keys.groupBy(F.bitmap_bucket_number(place(F.col("h"))).alias(piece)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(F.col("h")))).alias(held)))
    asked = rows.withColumn(at, place(key)).join(F.broadcast(bitmap), F.bitmap_bucket_number(F.col(at)) == F.col(piece), "left")
    bit = F.bitmap_bit_position(F.col(at)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(held), (F.shiftright(bit, 3) + 1), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, bit % 8).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return asked.where(hit).drop(piece, held, at), asked.where(~hit).drop(piece, held, at)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], give: Callable[[pa.Table], Iterable[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls give for each run of equal keys (integers) of a partition that is sorted by them; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        starts = np.flatnonzero(new).tolist()
        for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(int(c[s]) for c in cols)
            if held and key != last:
                yield from give(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield from give(pa.Table.from_batches(held))
