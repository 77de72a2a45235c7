"""Operator 3, packing: order-preserving dynamic programming over window cuts.

The token ids of documents, each with an end id, form one stream in the order of the rows. It is cut into windows of at
most `length` ids. A cut may stand at the end of a document (no penalty), at the end of a sentence, or, inside a
sentence longer than `step` ids, every `step` ids. The programme finds the cuts with the least sum of padding and
truncation penalties:

    best[i] = penalty[i] + min over j with pos[i] - pos[j] <= length of best[j] + length - (pos[i] - pos[j])

The minimum of best[j] + pos[j] over a sliding window is kept in a monotone queue, so each cut enters and leaves it once.

Rows are packed where they are read: nothing is shuffled. A task solves a chunk of about `chunk` ids at a time, so
memory doesn't grow with the partition; a chunk's last window may be short. Sequence ids hold the partition's number in
the upper bits, so a task that runs again gives the same ids.

Null or empty text: only the end id. Very long texts: cut at the places named above; no id is lost. Repeated rows and
ties in doc_id: each row is packed for itself. Null doc_id: packed, with a null doc_id. Empty table: no rows. Extra
columns are ignored; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common
from .tokens import encoder

LENGTH, END_ID = 1024, 0
SENTENCE_PENALTY, INNER_PENALTY, STEP, CHUNK = 6.0, 40.0, 128, 1 << 19
TOKENIZER = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"


def sentence_ends(name: str) -> np.ndarray:
    """For each id, whether its token ends a sentence or line."""
    tok = encoder(name).tokenizer
    size = tok.get_vocab_size()
    texts = tok.decode_batch([[i] for i in range(size)], skip_special_tokens=False)
    return np.array([t.rstrip(" ")[-1:] in tuple(".!?\n") and t != "" for t in texts])


def cuts(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, step: int, sentence: float, inner: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window may end, ascending, and their penalties; 0 comes first."""
    n = len(ids)
    price = np.full(n + 1, np.inf)
    price[1:][ends[np.minimum(ids, len(ends) - 1)]] = sentence
    price[doc_ends] = 0.0
    price[0] = 0.0
    at = np.flatnonzero(np.isfinite(price))
    gaps = np.diff(at)
    for k in np.flatnonzero(gaps > step):
        price[at[k] + step : at[k + 1] : step] = inner
    at = np.flatnonzero(np.isfinite(price))
    return at, price[at]


def best_cuts(at: np.ndarray, price: np.ndarray, length: int) -> list[int]:
    """The positions of the cheapest cuts from the first position to the last."""
    pos, cost = at.tolist(), price.tolist()
    best, back = [0.0] * len(pos), [0] * len(pos)
    queue: deque[tuple[float, int]] = deque([(float(pos[0]), 0)])
    for i in range(1, len(pos)):
        p = pos[i]
        while pos[queue[0][1]] < p - length:
            queue.popleft()
        value, j = queue[0]
        best[i] = b = cost[i] + length - p + value
        back[i] = j
        key = b + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    out, i = [pos[-1]], len(pos) - 1
    while i:
        i = back[i]
        out.append(pos[i])
    return out[::-1]


def pieces_of(doc_ids: list, texts: list[np.ndarray], first: int, length: int, ends: np.ndarray, step: int, sentence: float, inner: float) -> Iterator[tuple]:
    """Rows of SCHEMA for some documents, whose windows get ids from `first` on."""
    doc_ends = np.cumsum([len(x) for x in texts])
    ids = np.concatenate(texts)
    at, price = cuts(ids, doc_ends, ends, step, sentence, inner)
    windows = best_cuts(at, price, length)
    marks = np.union1d(windows, np.concatenate([[0], doc_ends]))
    starts, stops = marks[:-1], marks[1:]
    window = np.searchsorted(windows, starts, side="right") - 1
    doc = np.searchsorted(doc_ends, starts, side="right")
    doc_start = np.concatenate([[0], doc_ends[:-1]])
    raw = memoryview(ids.astype("<u4").tobytes())
    for s, e, w, d in zip(starts.tolist(), stops.tolist(), window.tolist(), doc.tolist(), strict=True):
        yield doc_ids[d], s - int(doc_start[d]), e - s, zlib.crc32(raw[4 * s : 4 * e]), len(texts[d]), first + w, s - windows[w], length - (windows[w + 1] - windows[w])


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end_id: int = END_ID, step: int = STEP, sentence: float = SENTENCE_PENALTY, inner: float = INNER_PENALTY, chunk: int = CHUNK) -> DataFrame:
    """Pieces of documents: their place in the document, checksum, sequence and place there, and the sequence's padding."""
    common.arrow_batches(docs.sparkSession)
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ends = encoder(tokenizer), None
        next_id, held_ids, held, n = TaskContext.get().partitionId() << 40, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id, held_ids, held, n, ends
            ends = sentence_ends(tokenizer) if ends is None else ends
            rows = list(pieces_of(held_ids, held, next_id, length, ends, step, sentence, inner))
            next_id, held_ids, held, n = rows[-1][5] + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        end = np.array([end_id], dtype="<u4")
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.each(b.column(1).to_pylist()), strict=True):
                ids = np.concatenate([ids, end])
                held_ids.append(doc_id)
                held.append(ids)
                n += len(ids)
                if n >= chunk:
                    yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op3_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
