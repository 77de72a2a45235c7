"""Operator 1, n-gram Jaccard join: signature trees over shingle sets.

A document's set holds its distinct shingles of `words` words (lower-cased A-Z; shorter texts: the whole sequence as
one; without words: empty, linked with nothing). Two documents link when den * intersection >= num * union.

1. Equal sets are one class, known by a 128-bit digest of the set.
2. Classes are dealt to trees. With at most D differing shingles allowed, a set cut by hash into D + 1 + e parts agrees
   with a linked one in at least 1 + e parts. Each part's content is a key; classes that share a key are in the same
   candidate cluster. Parts that are empty count only in sets with more than e of them, so no link is lost. Sizes fall
   into classes of ratio 1.25, and a set takes part in all that a linked set may belong to.
3. In a cluster a signature tree is built: a leaf holds up to 8 sets, each node the OR of its sets' token bitmaps, the
   range of their sizes and the largest number of tokens that share a bit. Two trees' nodes are compared from the root
   down. A pair of nodes is pruned when the largest overlap that bitmaps and sizes allow is too small for the smallest
   sets, or when all their sets are connected already. What remains is decided on the exact sets.

Clusters beyond a task's bound come from single shingles that many unlike texts share. They are first narrowed by trees
over token bitmaps alone, of 2 to 4 bits a shingle: only sets whose largest possible overlap is enough stay together, and
texts are sent for those only. What is too large still is cut into blocks (see graph.linked). Links are never collected.

Null or empty text: n_shingles 0, its own component. Very long texts: whole. Repeated rows and ties: equal sets are one
class, each row is returned. Null doc_id: a row; it never names a component unless all of a component's ids are null.
Rows that share a doc_id, or have none, are told apart by a 64-bit hash of the text.
Empty table: no rows. Extra columns are ignored by `components`; `one_of_each` returns them as they were.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

LEAF, FAN = 8, 8
#: Shingles of the sets that one task holds at once, about; a larger cluster is cut into blocks.
TASK_SHINGLES = 1_500_000
#: Bytes of text whose words are held at once, about; a longer text is taken alone.
TEXT_BYTES = 2 << 20
#: Bytes of the bitmaps that one task holds at once, about, where large clusters are narrowed.
TASK_BYTES = 24 << 20
SIZE_RATIO = 1.25
STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and where each text's words begin and the last ends."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets, flat = words.offsets.to_numpy().astype(np.int64), words.flatten()
    offsets = offsets - offsets[0]
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    coded = flat.dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    return (hashes[coded.indices.to_numpy()] if len(hashes) else np.empty(0, np.uint64))[real], before[offsets]


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's set as sorted 64-bit hashes, TEXT_BYTES of texts at a time."""
    block = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // TEXT_BYTES
    starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    return [u for s, e in zip(starts[:-1], starts[1:], strict=True) for u in sets_of(texts.slice(s, e - s), words)]


def sets_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    h, at = word_hashes(texts)
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        rolled = rolled * STEP + h[j : j + len(rolled)]
    rolled = graph.mixed(rolled)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= words:
            out.append(np.unique(rolled[s : e - words + 1]))
        elif e > s:
            x = np.full(1, e - s, np.uint64)
            for j in range(s, e):
                x = x * STEP + h[j]
            out.append(graph.mixed(x))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest(u: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


@lru_cache(maxsize=4096)
def size_class(n: int) -> tuple[int, int]:
    """The number of n's class of sizes, and the largest size in it."""
    low, k = 1, 0
    while True:
        high = max(low + 1, int(low * SIZE_RATIO))
        if n < high:
            return k, high - 1
        low, k = high, k + 1


@lru_cache(maxsize=4096)
def cutting(n: int, num: int, den: int) -> tuple[tuple[int, int, int], ...]:
    """For each class of sizes that a set of n shingles takes part in: its number, the parts, the spare parts."""
    out, k = [], size_class(n)[0]
    top = size_class(n * den // num)[0]
    size = n
    while k <= top:
        k, high = size_class(size)
        differ = (den - num) * 2 * high // (den + num)
        spare = 2 + differ // 12
        out.append((k, differ + 1 + spare, spare))
        size, k = high + 1, k + 1
    return tuple(out)


def part_keys(u: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys of a set's parts."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(graph.mixed(u + STEP), dtype=np.uint64)])
    keys = []
    for k, parts, spare in cutting(len(u), num, den):
        if parts <= 1 + spare:  # nothing may differ: equal sets are one class already
            continue
        bounds = np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)
        at = np.concatenate([[0], np.searchsorted(u, bounds), [len(u)]])
        content = sums[at[1:]] - sums[at[:-1]]
        tag = np.arange(parts, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k * 7919 + 1)
        key = graph.mixed(content + graph.mixed(tag))
        filled = at[1:] > at[:-1]
        keys.append(key if (~filled).sum() > spare else key[filled])
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


class Tree:
    """A signature tree over sets: levels of nodes, leaves first; a node covers `reach` sets at consecutive places."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(u) for u in sets])
        bits = 1 << int(np.clip(4 * self.size.mean(), 512, 1 << 17) - 1).bit_length()
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for k, u in enumerate(sets):
            place = (u >> np.uint64(40)) & np.uint64(bits - 1)
            np.bitwise_or.at(maps[k], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        self.build(maps, LEAF)

    @classmethod
    def over(cls, maps: np.ndarray, size: np.ndarray, leaf: int) -> Tree:
        """A tree over bitmaps of one width whose sets are elsewhere."""
        tree = cls.__new__(cls)
        tree.size = size
        tree.build(maps, leaf)
        return tree

    def build(self, maps: np.ndarray, width: int) -> None:
        excess = self.size - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, self.size, self.size, excess)]
        self.reach = [1]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, excess = self.levels[-1]
            at = np.arange(0, len(low), width)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))
            self.reach.append(self.reach[-1] * width)
            width = FAN

    def open(self, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which pairs of nodes may hold a link: row for a, column for b."""
        maps, low, high, excess = self.levels[level]
        shared = np.bitwise_count(maps[a][:, None, :] & maps[b][None, :, :]).sum(axis=2).astype(np.int64)
        most = shared + np.minimum(excess[a][:, None], excess[b][None, :])
        most = np.minimum(most, np.minimum(high[a][:, None], high[b][None, :]))
        return most * (num + den) >= num * (low[a][:, None] + low[b][None, :])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def tree_join(sets: list[np.ndarray], labels: np.ndarray, num: int, den: int) -> np.ndarray:
    """Labels that are equal for connected sets, by dual traversal of the sets' tree with itself."""
    lows = np.array([u[0] if len(u) else 0 for u in sets], dtype=np.uint64)
    order = np.lexsort(([len(u) for u in sets], lows))
    sets, label = [sets[k] for k in order], labels[order].astype(np.int64)
    tree = Tree(sets)
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        r, n = tree.reach[level], len(sets)
        one, two = label[i * r : (i + 1) * r], label[j * r : (j + 1) * r]
        if one[0] == two[0] and (one == one[0]).all() and (two == one[0]).all():
            continue
        if level == 0:
            a, b = sets[i], sets[j]
            same = overlap(a, b)
            if len(a) and len(b) and den * same >= num * (len(a) + len(b) - same):
                label[label == label[j]] = label[i]
            continue
        inner = tree.reach[level - 1]
        step = r // inner
        a = np.arange(i * step, min((i + 1) * step, -(-n // inner)))
        b = np.arange(j * step, min((j + 1) * step, -(-n // inner)))
        keep = tree.open(level - 1, a, b, num, den)
        if i == j:
            keep &= a[:, None] < b[None, :] if level == 1 else a[:, None] <= b[None, :]
        for x, y in sorted(zip(*(z.tolist() for z in np.nonzero(keep)), strict=True), key=lambda p: p[0] == p[1] and i == j):
            stack.append((level - 1, int(a[x]), int(b[y])))  # a node with itself is taken first
    out = np.empty_like(label)
    out[order] = label
    return out


def bitmap(u: np.ndarray) -> np.ndarray:
    """A set's token bitmap: as many bits as the power of two from twice its size on, 64 at least."""
    bits = max(64, 1 << (2 * len(u) - 1).bit_length())
    place = np.unique((u >> np.uint64(40)) & np.uint64(bits - 1))
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def narrowed(maps: list[np.ndarray], size: np.ndarray, labels: np.ndarray, num: int, den: int) -> np.ndarray:
    """Labels that are equal for sets connected by pairs whose bitmaps and sizes allow a link.

    For each width of bitmaps a tree is traversed against itself, its sets ordered by size: those of this width and those
    of wider bitmaps, folded, that are small enough to be linked with one of them.
    """
    label = labels.astype(np.int64)
    width = np.array([len(m) for m in maps])
    for w in np.unique(width).tolist():
        most = size[width == w].max()
        at = np.flatnonzero((width == w) | ((width > w) & (size * num <= most * den)))
        at = at[np.argsort(size[at], kind="stable")]
        folded = np.stack([np.bitwise_or.reduce(maps[k].reshape(-1, w)) for k in at])
        tree = Tree.over(folded, size[at], int(np.clip((1 << 15) // w, 8, 64)))
        stack = [(len(tree.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            r = tree.reach[level]
            one, two = label[at[i * r : (i + 1) * r]], label[at[j * r : (j + 1) * r]]
            if one[0] == two[0] and (one == one[0]).all() and (two == one[0]).all():
                continue
            if level == 0:
                label[label == two[0]] = one[0]
                continue
            inner = tree.reach[level - 1]
            a = np.arange(i * r // inner, min((i + 1) * r // inner, -(-len(at) // inner)))
            b = np.arange(j * r // inner, min((j + 1) * r // inner, -(-len(at) // inner)))
            keep = tree.open(level - 1, a, b, num, den)
            if i == j:
                keep &= a[:, None] < b[None, :] if level == 1 else a[:, None] <= b[None, :]
            x, y = np.nonzero(keep)
            if level > 1:
                stack.extend((level - 1, int(p), int(q)) for p, q in zip(a[x], b[y], strict=True))
                continue
            x, y = at[a[x]], at[b[y]]
            while len(differ := np.flatnonzero(label[x] != label[y])):
                x, y = x[differ], y[differ]
                label[label == label[y[0]]] = label[x[0]]
    return label


def classes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, hash (of the text), d1, d2 (the set's digest), n and uid of every row, kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1), words)
            d = [digest(u) for u in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array([len(u) for u in sets], pa.int64())], ["doc_id", "hash", "d1", "d2", "n"])

    rows = docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(common.lean(run), "doc_id long, hash long, d1 long, d2 long, n long")
    return common.cut(rows.withColumn("uid", F.monotonically_increasing_id()))


def candidate_clusters(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """v (a class's d1) and comp for classes that share a key with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = [], []
            seen = set()
            for u in shingle_sets(b.column(0), words):
                d = digest(u)[0]
                if len(u) and d not in seen:
                    seen.add(d)
                    keys.append(part_keys(u, num, den))
                    ids.append(np.full(len(keys[-1]), d, np.int64))
            if keys:
                yield graph.local_star(np.concatenate(keys).view(np.int64), np.concatenate(ids))

    rows = docs.select("text").mapInArrow(common.lean(run), graph.STAR)
    return common.cut(graph.components(graph.star_edges(rows)))


def components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, d1, d2, hash (of the text) and group of every row of docs.

    Rows of a component, and no others, have the same group; it is null for rows without words.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    rows = classes(docs, words)
    each = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "hash")).alias("at"), F.min("uid").alias("u"), F.min("n").alias("n"))
    clusters = candidate_clusters(docs, words, num, den)
    wanted = common.cut(each.join(clusters, F.col("d1") == F.col("v")).select("d1", "d2", F.col("at.doc_id").alias("_first"), F.col("at.hash").alias("_hash"), "u", F.col("n").alias("weight"), "comp"))

    def texts_of(asked: DataFrame) -> DataFrame:
        return common.small_or_shuffled(docs.select("doc_id", "text"), asked, F.col("doc_id").eqNullSafe(F.col("_first")) & (F.xxhash64("text") == F.col("_hash")), "inner", asked.count(), 72).select("text", "d1", "d2", "u", "weight", "comp")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose text has the digest that was asked for: two texts can share a hash."""
        for b in batches:
            d = [digest(u) for u in shingle_sets(b.column(0), words)]
            want = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            keep = pa.array([x == y for x, y in zip(d, want, strict=True)], pa.bool_())
            yield b.select(["u", "weight", "comp", "text"]).filter(keep)

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(0), words)
            want = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            keep = [k for k, (u, w) in enumerate(zip(sets, want, strict=True)) if digest(u) == w]
            maps = [bitmap(sets[k]).tobytes() for k in keep]
            of = b.select(["u", "comp"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*of.columns, pa.array([len(m) + 64 for m in maps], pa.int64()), pa.array([len(sets[k]) for k in keep], pa.int64()), pa.array(maps, pa.binary())], ["u", "comp", "weight", "n", "bits"])

    def narrow(table: pa.Table, labels: np.ndarray) -> np.ndarray:
        return narrowed([np.frombuffer(x, np.uint64) for x in table["bits"].to_pylist()], table["n"].to_numpy(), labels, num, den)

    large = common.cut(wanted.groupBy("comp").agg(F.sum("weight").alias("w")).where(F.col("w") > TASK_SHINGLES).select("comp"))
    if n_large := large.count():
        asked = common.cut(common.small_or_shuffled(wanted, large, "comp", "left_semi", n_large, 16))
        maps = texts_of(asked).mapInArrow(common.lean(bitmaps), "u long, comp long, weight long, n long, bits binary").dropDuplicates(["u"])
        closer = asked.drop("comp").join(graph.linked(common.cut(maps), narrow, TASK_BYTES).withColumnRenamed("root", "comp"), "u")
        wanted = common.cut(common.small_or_shuffled(wanted, large, "comp", "left_anti", n_large, 16).unionByName(closer))
    found = texts_of(wanted).mapInArrow(common.lean(checked), "u long, weight long, comp long, text string").dropDuplicates(["u"])

    def link(table: pa.Table, labels: np.ndarray) -> np.ndarray:
        return tree_join(shingle_sets(table["text"].combine_chunks(), words), labels, num, den)

    links = graph.linked(common.cut(found), link, TASK_SHINGLES)
    # classes that are linked get their group's least doc_id; the others their own
    grouped = each.join(links, "u").select("d1", "d2", "root", "first")
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    named = each.join(grouped.join(least, "root").select("d1", "d2", "root", "least"), ["d1", "d2"], "left").select("d1", "d2", F.coalesce("least", "first").alias("component_id"), F.coalesce("root", "u").alias("group"))
    out = rows.join(named, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "d1", "d2", "hash", "group")


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs for each component, that with the least doc_id (null last), with all its columns.

    Rows are known by doc_id and a hash of the text. Of rows alike in both one stays; all others without words stay.
    """
    keep_id, keep_hash, own = common.free(docs, "_keep", "_keep_hash", "_own")
    rows = components(docs, words, num, den).select("doc_id", "hash", "group")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("at")
    chosen = rows.where("group is not null").groupBy("group").agg(first).select("at.doc_id", "at.hash")
    wordless = rows.where("group is null").select("doc_id", "hash").distinct()
    keep = common.cut(chosen.unionByName(wordless).select(F.col("doc_id").alias(keep_id), F.col("hash").alias(keep_hash)))
    same = F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(own) == F.col(keep_hash))
    keyed = docs.withColumn(own, F.xxhash64("text"))
    kept = common.small_or_shuffled(keyed, keep, same, "left_semi", keep.count(), 24)
    again = common.cut(keyed.groupBy("doc_id", own).count().where("count > 1").select(F.col("doc_id").alias(keep_id), F.col(own).alias(keep_hash)))
    if not (n_again := again.count()):
        return kept.drop(own)
    single = common.small_or_shuffled(kept, again, same, "left_anti", n_again, 24)
    several = common.small_or_shuffled(kept, again, same, "left_semi", n_again, 24)
    return single.unionByName(several.dropDuplicates(["doc_id", own])).drop(own)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, case when len(w) >= 3 then list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end s from d),
c as (select s, min(doc_id) rep from s where len(s) > 0 group by s),
t as (select rep, len(s) n, unnest(s) g from c),
pf as (select rep, n, g, row_number() over (partition by rep order by hash(g), g) r from t),
cand as (select distinct a.rep x, b.rep y from pf a join pf b on a.g = b.g and a.rep < b.rep
    where a.r <= a.n - (9 * a.n + 9) // 10 + 1 and b.r <= b.n - (9 * b.n + 9) // 10 + 1 and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
l as (select x, y from cand join c cx on cx.rep = x join c cy on cy.rep = y
    where 100 * len(list_intersect(cx.s, cy.s)) >= 90 * (len(cx.s) + len(cy.s) - len(list_intersect(cx.s, cy.s)))),
e as (select x a, y b from l union select y, x from l),
r(v, o) as (select rep, rep from c union select r.v, e.b from r join e on e.a = r.o),
m as (select v, min(o) component_id from r group by v)
select doc_id, len(s.s)::bigint n_shingles, coalesce(component_id, doc_id) component_id from s left join c on c.s = s.s left join m on m.v = c.rep
"""
