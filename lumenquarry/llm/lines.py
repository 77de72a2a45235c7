"""Operator 9, line dedup: fuzzy lines by MinHash bands over character grams and edit similarity.

A line is what stands between line feeds. It is normalised: lower case, without ASCII punctuation, its words joined by
one space. Lines with fewer than `min_chars` normalised characters are left alone. Two lines are linked when their
normalised forms are equal, or when they share a band key and the forms' edit similarity, 1 - distance / longer
length, is at least `similarity`. Of each connected group of lines over the whole corpus the first occurrence, by
(doc_id, line number), stays; the others are dropped.

1. Occurrences with a 128-bit key of the normalised form, kept in the shared folder; equal forms meet by a
   pre-aggregated minimum, so a very common line is one row for each task.
2. BANDS keys of a form, each of ROWS minima over its GRAM-byte grams: two forms whose grams have Jaccard similarity J
   share one with probability about 1 - (1 - J ** ROWS) ** BANDS. So the search is not exact: pairs at the least
   similarity whose edits are scattered over all words can be missed (figures, also of the SimHash blocks that these keys
   stand in for: README). Different lines that share a key form candidate clusters through star edges; no pairs are
   listed.
3. In a cluster the lines' texts are fetched and the pairs that share a key and aren't yet connected are verified, many
   pairs' tables by antidiagonals at once. A cluster of more than TASK_LINES lines, which chance keys make out of smaller
   ones as the corpus grows, is taken apart into the sets of its lines that share a key: a line goes to BANDS sets at
   most. Only a set that is larger still is cut into blocks.

Joins of keys with keys, which are narrow, are shuffled. The lines to fetch and the decisions, lists of line numbers for the documents concerned, are joined with the texts: by
broadcast while their counted size is small; beyond that a sieve of bounded size passes the documents concerned (and a
few others), and only those are shuffled.

Null text: stays null, no lines. Empty text: one line that is left alone. Very long texts and lines: whole. A document is
known by doc_id and a 64-bit hash of its text, so rows that share a doc_id, or have none, are told apart. Null doc_id:
comes first in the order. Repeated rows, alike in doc_id and text: as one document, each gets the same decisions. Ties:
broken by (doc_id, line number, hash). Empty table: no rows. Extra columns are returned as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

MIN_CHARS, SIMILARITY = 20, 0.9
#: Bytes of a gram, minima of a key, keys of a line.
GRAM, ROWS, BANDS = 6, 5, 20
BINS, EMPTY, TRIES = ROWS * BANDS, np.uint32(0xFFFFFFFF), 64
#: For each try the bin that an empty bin takes its minimum from.
DONORS = (graph.mixed(np.arange(1, TRIES * BINS + 1)) % np.uint64(BINS)).astype(np.int64).reshape(TRIES, BINS)
#: Cells of the pairs of characters that are compared before a distance is computed.
PLACES = 512
#: Lines that one task verifies at once; a larger cluster is taken apart by keys.
TASK_LINES = 2048
#: Lines and pairs that are verified together, characters of a line up to which they are, and pairs from which that pays.
AT_ONCE, PAIRS, LONGEST, FEWEST = 4096, 512, 4096, 12
#: ASCII punctuation, which goes (1), and white space (2).
CLASS = np.zeros(256, np.uint8)
CLASS[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = 1
CLASS[np.frombuffer(b" \t\n\v\f\r", np.uint8)] = 2
GRAMS_AT_ONCE = 1 << 17
#: Buckets of band keys for each shuffle partition, 40 bits of a line's key, and a pair of a 32- and a 40-bit number.
BUCKETS, LINE = 16, np.uint64((1 << 40) - 1)
PAIR = np.dtype([("x", "<u4"), ("y", "<u4"), ("y_top", "u1")])


def normal_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For all lines of the texts: the row, the line number, the normalised form."""
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    at = split.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    return row, np.arange(len(row)) - at[row], normalised(pc.utf8_lower(split.flatten()))


def normalised(lines: pa.Array) -> pa.Array:
    """The lines without punctuation, each run of white space one space, none at the ends. Bytes of a character outside
    ASCII are in no class, so all of it works on bytes."""
    if not len(lines):
        return lines
    at = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    kind = CLASS[data]
    stay = np.flatnonzero(kind != 1)
    data, space = data[stay], kind[stay] == 2
    at = np.searchsorted(stay, at)
    before = np.empty_like(space)  # whether a space, or the line's start, comes before
    before[1:] = space[:-1]
    before[at[:-1][at[:-1] < len(space)]] = True
    stay = np.flatnonzero(~(space & before))
    data, space = data[stay], space[stay]
    at = np.searchsorted(stay, at)
    data = np.where(space, np.uint8(32), data)
    last = at[1:][at[1:] > at[:-1]] - 1  # a line's last character, where it is a space, goes as well
    gone = last[space[last]]
    at = at - np.searchsorted(gone, at)
    data = np.delete(data, gone)
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def line_keys(normal: pa.Array) -> np.ndarray:
    """A row of two integers, 128 bits, for each form."""
    if not len(normal):
        return np.empty((0, 2), np.int64)
    at = np.frombuffer(normal.buffers()[1], np.int32)[normal.offset : normal.offset + len(normal) + 1].tolist()
    data = memoryview(normal.buffers()[2] or b"")
    joined = b"".join([xxhash.xxh3_128_digest(data[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)])
    return np.frombuffer(joined, ">i8").reshape(-1, 2).astype(np.int64)


def distance(a: str, b: str, most: int | None = None) -> int:
    """The least number of inserted, deleted or replaced characters, a column of the table in one integer's bits.

    With most, a distance beyond it may be told as most + 1.
    """
    s = 0
    while s < min(len(a), len(b)) and a[s] == b[s]:
        s += 1
    a, b = a[s:], b[s:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top, up, down, score = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    end = len(b) + (len(a) + len(b) if most is None else most)  # each column that is left takes off one at most
    for k, c in enumerate(b, 1):
        eq = at.get(c, 0)
        vertical = eq | down
        level = (((eq & up) + up) ^ up) | eq
        more = down | ~(level | up) & full
        less = up & level
        if more & top:
            score += 1
            if score + k > end:
                return most + 1
        elif less & top:
            score -= 1
        elif score + k > end:
            return most + 1
        more = (more << 1 | 1) & full
        up = (less << 1) & full | ~(vertical | more) & full
        down = more & vertical
    return score


def similar(a: str, b: str, least: float) -> bool:
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q) <= most:
        return True  # words replaced in their places
    return not apart(cells_of(a), cells_of(b), most) and distance(a, b, most) <= most


@lru_cache(maxsize=4096)
def cells_of(line: str) -> np.ndarray:
    """The cell, of PLACES, of each pair of characters that follow one another."""
    c = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    return mixed32(c[:-1] * np.uint32(0x01000193) + c[1:]) % np.uint32(PLACES)


def apart(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether two lines, by their cells, surely differ by more than `most` edits.

    An edit changes at most two pairs of a, and a pair that none changes stands in b at most `most` places away. So at most
    2 * most pairs of a's halves can be absent from what of b lies that near to the half.
    """
    half = len(a) // 2
    absent = 0
    for mine, other in ((a[:half], b[: half + most]), (a[half:], b[max(half - most, 0) :])):
        absent += np.maximum(np.bincount(mine, minlength=PLACES) - np.bincount(other, minlength=PLACES), 0).sum()
    return bool(absent > 2 * most)


def mixed32(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 32-bit integers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def band_keys(normal: pa.Array) -> np.ndarray:
    """A row of BANDS keys for each form, from one pass over its grams: a gram falls into one of ROWS * BANDS bins by its
    hash, and the least hash of a bin is that bin's minimum. A bin without a gram takes the minimum of another bin, the
    first filled one of a sequence that is the same for all forms.

    A form is followed by zeros, so it has as many grams as bytes.
    """
    big = pa.large_binary()
    padded = pc.binary_join_element_wise(normal.cast(big), pa.scalar(b"\0" * GRAM, big), pa.scalar(b"", big))
    at = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset : padded.offset + len(padded) + 1]
    data = np.frombuffer(padded.buffers()[2], np.uint8)
    out = np.empty((len(padded), BANDS), np.uint64)
    start = 0
    while start < len(padded):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + GRAMS_AT_ONCE, side="right")) - 1)
        part = data[at[start] : at[stop]].astype(np.uint32)
        grams = np.zeros(len(part) - GRAM + 1, np.uint32)
        for j in range(GRAM):
            grams = grams * np.uint32(0x01000193) + part[j : j + len(grams)]
        size = np.diff(at[start : stop + 1])
        own = np.ones(len(part), bool)  # not the grams that begin in the zeros
        own[(np.cumsum(size)[:, None] - np.arange(1, GRAM + 1)).ravel()] = False
        h = mixed32(grams[own[: len(grams)]])
        line = np.repeat(np.arange(stop - start, dtype=np.int64) * BINS, size - GRAM)
        least = np.full((stop - start) * BINS, EMPTY, np.uint32)
        np.minimum.at(least, line + (h.astype(np.int64) * BINS >> 32), h)
        out[start:stop] = folded(filled(least.reshape(-1, BINS)))
        start = stop
    return out


def filled(least: np.ndarray) -> np.ndarray:
    """The minima, with those of other bins in the empty ones. What TRIES bins don't give, the least of all does."""
    out = least.copy()
    row, col = np.nonzero(least == EMPTY)
    for donor in DONORS:
        if not len(row):
            return out
        value = least[row, donor[col]]
        out[row, col] = value
        none = value == EMPTY
        row, col = row[none], col[none]
    out[row, col] = least[row].min(axis=1)
    return out


def folded(minima: np.ndarray) -> np.ndarray:
    """A key of each band's minima and the band's number."""
    each = minima.reshape(len(minima), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), each.shape[:2])
    for k in range(ROWS):
        key = graph.mixed(key * graph.MIX + each[:, :, k])
    return key


def long_lines(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """normal_lines without those that are left alone."""
    row, number, normal = normal_lines(texts)
    take = np.flatnonzero(pc.greater_equal(pc.utf8_length(normal), min_chars).to_numpy(zero_copy_only=False))
    return row[take], number[take], normal.take(pa.array(take))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, line, hash (of the document's text), k1, k2 of every line that isn't left alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, number, normal = long_lines(b.column(1), min_chars)
            if len(row):
                k, row = line_keys(normal), pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), pa.array(number, pa.int32()), b.column(2).take(row), *[pa.array(k[:, j]) for j in (0, 1)]], ["doc_id", "line", "hash", "k1", "k2"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(common.lean(run), "doc_id long, line int, hash long, k1 long, k2 long")


def packed(kind: int, bucket: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket, in which bucket is sorted, of the lower 32 bits of x and 40 of y, 9 bytes a pair."""
    pairs = np.empty(len(x), PAIR)
    pairs["x"], pairs["y"], pairs["y_top"] = x & np.uint64(0xFFFFFFFF), y & np.uint64(0xFFFFFFFF), y >> np.uint64(32) & np.uint64(0xFF)
    found, first = np.unique(bucket, return_index=True)
    at = np.append(first, len(x)).astype(np.int32) * PAIR.itemsize
    data = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(at), pa.py_buffer(pairs.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(np.full(len(found), kind, np.int64)), data], ["bucket", "kind", "data"])


def unpacked(data: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(data.to_pylist()), PAIR)
    return pairs["x"], pairs["y_top"].astype(np.int64) << 32 | pairs["y"]


def band_edges(docs: DataFrame, min_chars: int) -> DataFrame:
    """Edges (a, b) that connect all lines of a band key; a line is known by the lower 40 bits of its k1.

    What is shuffled are packed pairs of a key and a line, in buckets by the upper bits of the key. A key that lines of a
    batch share leaves with one of them; the others leave as pairs under a key of that line, so they meet there.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(12, (n * BUCKETS - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            normal = long_lines(b.column(0), min_chars)[2].unique()
            if not len(normal):
                continue
            key, v = band_keys(normal).ravel(), np.repeat(line_keys(normal)[:, 0].view(np.uint64) & LINE, BANDS)
            order = np.argsort(key)
            key, v = key[order], v[order]
            new = np.append(True, key[1:] != key[:-1])
            lead = v[new][np.cumsum(new) - 1][~new]
            a, c = graph.pairs_once(lead, v[~new])
            yield packed(0, key[new] >> np.uint64(64 - bits), key[new], v[new])
            if len(a):  # a key of the lead's own, under which both stand
                own = graph.mixed(np.concatenate([a, a]) ^ graph.MIX)
                order = np.argsort(own)
                yield packed(1, own[order] >> np.uint64(64 - bits), own[order], np.concatenate([a, c])[order])

    def give(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, v = unpacked(table["data"])
        order = np.argsort(key, kind="stable")
        key, v = key[order], v[order]
        new = np.append(True, key[1:] != key[:-1])
        a, b = graph.pairs_once(v[new][np.cumsum(new) - 1][~new], v[~new])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = docs.select("text").mapInArrow(common.lean(run), "bucket long, kind long, data binary").repartition(n, "bucket", "kind").sortWithinPartitions("bucket", "kind")
    return rows.mapInArrow(common.lean(lambda batches: common.by_group(batches, ["bucket", "kind"], give)), "a long, b long").distinct()


def within(left: list[str], right: list[str], most: np.ndarray) -> np.ndarray:
    """Whether each pair's distance is at most `most`, for lines of up to LONGEST characters.

    A row stands for a diagonal, a column for a pair; cells of one antidiagonal, which lie on every other diagonal, follow
    from the two antidiagonals before. Only the diagonals that `most` edits can reach and come back from are held: from `low`,
    which is even, in `even` and `odd`. Pairs that end, or have no cell within `most`, go.
    """
    out = np.zeros(len(left), bool)
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(left, right, strict=True)]
    n, m = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    at = np.flatnonzero(m - n <= most)
    at = at[np.argsort((n + m)[at], kind="stable")]
    if not len(at):
        return out
    n, m, most = n[at], m[at], most[at]
    low = -((most - (m - n)) // 2)
    low -= low & 1
    half, ends = -low // 2, n + m
    u, last = int(((most + m - n) // 2 - low + 1).max()) // 2, int(ends[-1])
    chars = [[np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in pairs[p]] for p in at.tolist()]
    wide = np.uint16 if max(int(x.max(initial=0)) for p in chars for x in p) < 0xFFFE else np.uint32
    up = np.full((last // 2 + u + 2, len(at)), np.iinfo(wide).max, wide)  # the shorter lines, from their ends
    down = np.full(((last + 1) // 2 + u + 2, len(at)), np.iinfo(wide).max - 1, wide)
    for k, (a, b) in enumerate(chars):
        h = half[k]
        up[last // 2 + h - len(a) + 1 : last // 2 + h + 1, k] = a[::-1]
        down[h : h + len(b), k] = b
    even, odd = np.full((u + 1, len(at)), 16384, np.uint16), np.full((u + 2, len(at)), 16384, np.uint16)
    even[half, np.arange(len(at))] = 0
    goal, most = m - n - low, most.astype(np.uint16)
    done = int(np.searchsorted(ends, 0, side="right"))
    out[at[:done]] = True  # empty lines
    differ, unlike, step = np.empty(even.shape, wide), np.empty(even.shape, np.uint16), np.empty(even.shape, np.uint16)
    for s in range(1, last + 1):
        rows = u + 1 - (s & 1)
        r, y = last // 2 - (s >> 1) + 1, (s + 1 >> 1) - 1
        from_, cells = (even, odd[1:-1]) if s & 1 else (odd, even)
        np.bitwise_xor(up[r : r + rows], down[y : y + rows], out=differ[:rows])
        cells += np.minimum(differ[:rows], 1, out=unlike[:rows], casting="unsafe")
        np.minimum(from_[:-1], from_[1:], out=step[:rows])
        step[:rows] += 1
        np.minimum(cells, step[:rows], out=cells)
        if done < len(at) and ends[done] == s:
            new = int(np.searchsorted(ends, s, side="right"))
            k = np.arange(done, new)
            out[at[k]] = cells[goal[k] // 2, k] <= most[k]
            done = new
        if not s & 31:
            live = np.minimum(even.min(axis=0), odd.min(axis=0)) <= most
            live[:done] = False
            if not live.any():
                break
            if live.sum() <= 0.8 * len(at):
                at, ends, goal, most, done = at[live], ends[live], goal[live], most[live], 0
                up, down, even, odd = up[:, live], down[:, live], even[:, live], odd[:, live]
                differ, unlike, step = np.empty(even.shape, wide), np.empty(even.shape, np.uint16), np.empty(even.shape, np.uint16)
    return out


def verified(line: list[str], size: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """similar() of the pairs (i, j) of lines."""
    longer = np.maximum(size[i], size[j])
    order = np.argsort(longer, kind="stable")
    order, few = order[: np.searchsorted(longer[order], LONGEST, side="right")], order[np.searchsorted(longer[order], LONGEST, side="right") :]
    out = np.zeros(len(i), bool)
    for k in range(0, len(order), PAIRS):
        part = order[k : k + PAIRS]
        if len(part) < FEWEST:
            few = np.concatenate([few, part])
        else:
            out[part] = within([line[x] for x in i[part]], [line[x] for x in j[part]], ((1 - similarity) * longer[part] + 1e-9).astype(np.int64))
    for k in few.tolist():
        out[k] = similar(line[i[k]], line[j[k]], similarity)
    return out


def link(similarity: float):
    """Verifies the pairs of lines of a cluster that share a band key and aren't connected yet.

    Lines of a key are met at growing distances in its list; a key whose lines are all connected leaves.
    """

    def run(table: pa.Table, labels: np.ndarray, of: np.ndarray) -> np.ndarray:
        label = labels.astype(np.int64)
        line, n = table["text"].to_pylist(), table.num_rows
        size = np.array([len(x) for x in line])
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), "<u4").reshape(n, BANDS).astype(np.uint64)
        code = ((of[:, None] * BANDS + np.arange(BANDS)).astype(np.uint64) << np.uint64(32) | keys).ravel()
        order = np.argsort(code, kind="stable")
        x, key = order // BANDS, np.cumsum(np.append(True, code[order][1:] != code[order][:-1]))
        tested, held = np.zeros(n * n, bool), []

        def flush() -> None:
            nonlocal label
            pair = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
            held.clear()
            i, j = pair // n, pair % n
            differ = label[i] != label[j]
            i, j = i[differ], j[differ]
            same = verified(line, size, i, j, similarity)
            if same.any():
                items, root = graph.joined(label[i[same]], label[j[same]])
                new = np.arange(n)
                new[items] = root
                label = new[label]

        far, waiting = 0, 0
        while True:
            if not far & (far + 1):  # before distances 1, 2, 4, ...
                flush()
                waiting = 0
                start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
                if len(start):
                    lo, hi = np.minimum.reduceat(label[x], start), np.maximum.reduceat(label[x], start)
                    count = np.diff(np.append(start, len(x)))
                    stay = np.repeat((lo < hi) & (count > far + 1), count)
                    x, key = x[stay], key[stay]
            far += 1
            if len(x) <= far:
                break
            near = key[far:] == key[:-far]
            i, j = x[:-far][near], x[far:][near]
            pair = i * n + j
            take = (label[i] != label[j]) & ~tested[pair] & (np.abs(size[i] - size[j]) <= (1 - similarity) * np.maximum(size[i], size[j]) + 1e-6)
            tested[pair[take]] = True
            held.append(pair[take])
            waiting += int(take.sum())
            if waiting >= 4 * PAIRS:
                flush()
                waiting = 0
        flush()
        return label

    return run


def by_keys(found: DataFrame) -> tuple[DataFrame, bool]:
    """found, with each cluster of more than TASK_LINES lines replaced by the sets of its lines that share a key, equal sets
    once; and whether there is such a cluster. A set's number is below 0, and a line may be in many of them."""
    large = common.cut(found.groupBy("comp").count().where(F.col("count") > TASK_LINES).select("comp"))
    if not (n := large.count()):
        return found, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u4").reshape(-1, BANDS) | np.arange(BANDS) << 32
                of = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(key.ravel())], ["comp", "u", "key"])

    part = common.small_or_shuffled(found, large, "comp", "left_semi", n, 16)
    keys = part.select("comp", "u", "keys").mapInArrow(common.lean(run), "comp long, u long, key long")
    sets = keys.groupBy("comp", "key").agg(F.array_sort(F.collect_list("u")).alias("us")).where(F.size("us") > 1).select("us").distinct()
    sets = common.cut(sets.select((-1 - F.monotonically_increasing_id()).alias("comp"), "us")).select("comp", F.explode("us").alias("u"))
    common.freed(found.sparkSession)
    rest = common.small_or_shuffled(found, large, "comp", "left_anti", n, 16)
    return rest.unionByName(part.drop("comp").join(sets, "u")), True


def fetched(docs: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """u, comp, weight, text, keys: the members' normalised lines and band keys, from the documents that wanted lists."""
    # a text that only shares the hash with the one that was asked for gives lines of other keys
    texts = with_lines(docs.select("doc_id", "text"), "doc_id", "text", wanted, "lines", exact=False).where("lines is not null")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The normalised lines that were asked for and their keys; a line of another text with the same hash has other keys."""
        for b in batches:
            row, _, normal = normal_lines(b.column(0))
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            asked = b.column(1)
            of = np.repeat(np.arange(b.num_rows), np.diff(asked.offsets.to_numpy()))
            place = at[of] + asked.flatten().to_numpy()
            normal = normal.take(pa.array(place[place < at[of + 1]]))
            if len(normal):
                k, bands = line_keys(normal), band_keys(normal).astype("<u4").view(f"V{4 * BANDS}").ravel()
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), normal, pa.array(bands.tolist(), pa.binary())], ["k1", "k2", "text", "keys"])

    lines = texts.select("text", "lines").mapInArrow(common.lean(fetch), "k1 long, k2 long, text string, keys binary").dropDuplicates(["k1", "k2"])
    return common.cut(lines.join(members.select("k1", "k2", "u", "comp"), ["k1", "k2"]).select("u", "comp", F.lit(1).cast("long").alias("weight"), "text", "keys"))


def dropped(docs: DataFrame, min_chars: int = MIN_CHARS, similarity: float = SIMILARITY) -> DataFrame:
    """drop_doc, drop_hash and drop_lines, the numbers of the lines that the document loses; documents that lose none are absent."""
    common.arrow_batches(docs.sparkSession)
    seen = common.cut(occurrences(docs, min_chars))
    unique = common.cut(seen.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line", "hash")).alias("at"), F.count("*").alias("n")))
    clusters = common.cut(graph.components(band_edges(docs, min_chars)))
    common.freed(docs.sparkSession)  # the band keys' shuffle is the largest
    met = unique.join(clusters, F.col("k1").bitwiseAND(F.lit(int(LINE))) == F.col("v"))
    members = common.cut(met.select("k1", "k2", "at", "comp", F.monotonically_increasing_id().alias("u")))
    wanted = common.cut(members.groupBy(F.col("at.doc_id").alias("_doc"), F.col("at.hash").alias("_hash")).agg(F.collect_list("at.line").alias("lines")))
    found = fetched(docs, members, wanted)
    parts, overlap = by_keys(found)
    links = common.cut(graph.linked(parts, link(similarity), TASK_LINES, AT_ONCE, overlap))
    del found, parts
    common.freed(docs.sparkSession)
    grouped = members.join(links, "u").select("k1", "k2", "root", "at")
    first = grouped.groupBy("root").agg(F.min("at").alias("first"))
    named = common.cut(grouped.join(first, "root").select("k1", "k2", "first"))
    known = unique.join(named, ["k1", "k2"], "left")
    decided = common.cut(known.where("n > 1 or first is not null").select("k1", "k2", F.coalesce("first", "at").alias("first")))
    lost = seen.join(decided, ["k1", "k2"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line") == F.col("first.line")) & (F.col("hash") == F.col("first.hash"))))
    return lost.groupBy(F.col("doc_id").alias("drop_doc"), F.col("hash").alias("drop_hash")).agg(F.array_sort(F.collect_set("line")).alias("drop_lines"))


def with_lines(docs: DataFrame, doc_id: str, text: str, side: DataFrame, lines: str, exact: bool = True) -> DataFrame:
    """docs with the line numbers that side (a doc_id, a hash of the text, lines) has for them, null where it has none.

    Documents meet by one 64-bit hash; with exact doc_id and the text's hash are compared as well. While side's counted
    size is small it is broadcast. Beyond that a sieve of bounded size tells apart the documents that side can't have; the
    others meet it by a shuffle.
    """
    names = side.columns
    own, key = common.free(docs, "_own", "_key")
    side = side.withColumn(key, F.xxhash64(names[0], names[1]))
    on = F.col(own) == F.col(key)
    if exact:
        on = on & F.col(doc_id).eqNullSafe(F.col(names[0])) & (F.xxhash64(text) == F.col(names[1]))
    else:
        side = side.select(key, lines)
    extra = [own, *(c for c in side.columns if c != lines)]
    size = side.agg(F.coalesce(F.sum((96 if exact else 64) + 4 * F.size(lines)), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    keyed = docs.withColumn(own, F.xxhash64(F.col(doc_id), F.xxhash64(text)))
    if size.bytes <= 2 * common.BROADCAST_BYTES:
        return keyed.join(F.broadcast(side), on, "left").drop(*extra)
    maybe, other = common.sieved(keyed, F.col(own), side.select(F.col(key).alias("h")), size.n)
    met = maybe.join(side.hint("shuffle_merge"), on, "left").drop(*extra)
    return met.unionByName(other.drop(own).withColumn(lines, F.lit(None).cast("array<int>")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, similarity: float = SIMILARITY) -> DataFrame:
    """doc = the row as it was, text = what its lines keep, n_lines and n_dropped."""
    gone = common.cut(dropped(docs, min_chars, similarity))
    common.freed(docs.sparkSession)
    rows = with_lines(docs.select(F.struct("*").alias("doc")), "doc.doc_id", "doc.text", gone, "drop_lines")
    lines = F.split("doc.text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop_lines", i)), "\n")
    text = F.when(F.col("drop_lines").isNull(), F.col("doc.text")).otherwise(kept)
    return rows.select("doc", text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("drop_lines").isNull() | F.col("doc.text").isNull(), 0).otherwise(F.size("drop_lines")).cast("long").alias("n_dropped"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(common.table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc.doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
