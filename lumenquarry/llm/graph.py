"""Connected groups of items that share keys: star edges, distributed components, and exact linking inside candidates.

Nothing here is collected: edges and labels stay distributed, loops cut their lineage in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

STAR = "key long, v long, w long, edge boolean"
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Edges that one task connects at once; more of them take distributed steps.
TASK_EDGES = 1 << 20
#: Bytes of the clusters that are linked in one call, but for a cluster that is larger by itself.
AT_ONCE_BYTES = 8 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pairs_once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different pair of unequal items once."""
    keep = a != b
    if not keep.any():
        return a[:0], b[:0]
    both = np.unique(np.stack([np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def local_star(key: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """One row for each key of a batch, and edges from its first item to its others: a hot key leaves as one row."""
    order = np.argsort(key, kind="stable")
    key, v = key[order], v[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = v[np.flatnonzero(new)]
    a, b = pairs_once(first[np.cumsum(new) - 1][~new], v[~new])
    keys = np.concatenate([key[new], mixed(b.view(np.uint64)).view(np.int64)])
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(np.concatenate([first, a])), pa.array(np.concatenate([np.zeros(len(first), np.int64), b])), pa.array(np.concatenate([np.zeros(len(first), bool), np.ones(len(a), bool)]))],
        ["key", "v", "w", "edge"],
    )


def star_edges(rows: DataFrame) -> DataFrame:
    """rows: local_star's. Edges (a, b) that connect all items of a key, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_v = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, v, w = (batch.column(k).to_numpy() for k in range(3))
            edge = batch.column(3).to_numpy(zero_copy_only=False)
            a0, b0 = v[edge], w[edge]
            key, v = key[~edge], v[~edge]
            if len(key):
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                lead = v[np.flatnonzero(new)]
                if last_key is not None and key[0] == last_key:
                    lead[0] = last_v
                star = lead[np.cumsum(new) - 1]
                last_key, last_v = key[-1], star[-1]
                a0, b0 = np.concatenate([a0, star]), np.concatenate([b0, v])
            a, b = pairs_once(a0, b0)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(common.lean(run), "a long, b long").distinct()


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of the edges (a, b), and for each the least item that it is connected with."""
    items, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(items))
    while True:
        x, y = root[i], root[j]
        if (x == y).all():
            return items, items[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame) -> DataFrame:
    """v and comp, the least item that v is connected with, for every item of the edges (a, b).

    Large-star and small-star steps until nothing changes, or until the counted edges are few enough for one task. An item
    with very many neighbours is a skewed key of a join, which is split, and of a pre-aggregated minimum.
    """

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            e = pa.Table.from_batches(held)
            v, comp = joined(e["p"].to_numpy(), e["v"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(comp)], ["v", "comp"])

    e = common.cut(edges.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("v")).where("p < v").distinct())
    last = None
    while True:
        sign = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("p", "v").cast("decimal(38,0)"))).first())
        if sign == last:
            break
        if sign[0] <= TASK_EDGES:
            return e.coalesce(1).mapInArrow(common.lean(rest), "v long, comp long")
        last = sign
        near = e.select(F.col("v").alias("u"), F.col("p").alias("n")).unionByName(e.select(F.col("p").alias("u"), F.col("v").alias("n")))
        low = near.groupBy("u").agg(F.min("n").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = near.join(low, "u").where("n > u").select(F.col("n").alias("v"), F.col("m").alias("p")).distinct()
        low = large.groupBy("v").agg(F.min("p").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("p")), F.struct(F.col("p").alias("v"), F.col("m").alias("p")))).alias("x")).select("x.*").where("p < v")
        e = common.cut(small.distinct())
        del near, low, large, small
        common.freed(e.sparkSession)  # each step's shuffles are several times its edges
    roots = e.select(F.col("p").alias("v")).distinct().select("v", F.col("v").alias("comp"))
    return e.select("v", F.col("p").alias("comp")).unionByName(roots)


def linked(members: DataFrame, link: Callable[..., np.ndarray], most: int, at_once: int = 0, overlap: bool = False) -> DataFrame:
    """u and root for members that `link` connects with another one.

    members, which is read more than once: comp (the candidate cluster), u (unique), weight, and what link reads. link(rows, labels) gives labels that
    are equal for connected rows; rows whose labels were equal before need no test. A cluster of a weight over `most` is
    cut into blocks by a hash. First every block is linked in one task with block 0, so what a cluster has in common
    joins at a cost in proportion to it; then pairs of blocks that still hold different labels are linked.

    With at_once, clusters of so many rows together go to link(rows, labels, of) in one call, of being the cluster's number
    for each row. With overlap, a u may stand in more than one cluster.
    """
    spark = members.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [c for c in members.columns]
    sizes = members.groupBy("comp").agg(F.ceil(F.sum("weight") / most).cast("int").alias("blocks")).where("blocks > 1")
    sizes = common.cut(sizes)
    n_large = sizes.count()
    common.freed(spark)  # the shuffles that made the members, held until another query has run

    def run(rows: DataFrame) -> DataFrame:
        def stars(table: pa.Table, *of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if table.num_rows < 2:
                return
            table = table.combine_chunks()
            u, label = table["u"].to_numpy(), table["label"].to_numpy()
            if len(u) == 2 and not of:
                out = link(table, np.array([0, int(label[0] != label[1])]))
                if out[0] == out[1]:
                    yield u.max(keepdims=True), u.min(keepdims=True)
                return
            out = link(table, np.unique(label, return_inverse=True)[1], *of)
            order = np.lexsort((u, out))
            s_out, s_u = out[order], u[order]
            new = np.ones(len(s_out), bool)
            new[1:] = s_out[1:] != s_out[:-1]
            root = s_u[np.flatnonzero(new)][np.cumsum(new) - 1]
            multi = s_u != root
            if multi.any():
                yield s_u[multi], root[multi]

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held, n, size = [], 0, 0
            for table in common.by_group(batches, ["comp", "task"], lambda t: [t] if t.num_rows > 1 else []):
                if held and (n + table.num_rows > at_once or size + table.nbytes > AT_ONCE_BYTES):
                    yield from stars(pa.concat_tables(held), np.repeat(np.arange(len(held)), [t.num_rows for t in held]))
                    held, n, size = [], 0, 0
                held.append(table)
                n, size = n + table.num_rows, size + table.nbytes
            if held:
                yield from stars(pa.concat_tables(held), np.repeat(np.arange(len(held)), [t.num_rows for t in held]))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The stars of many small clusters leave together."""
            held, n = [], 0
            for b, a in together(batches) if at_once else common.by_group(batches, ["comp", "task"], stars):
                held.append((b, a))
                n += len(b)
                if n >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["b", "a"])
                    held, n = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["b", "a"])

        placed = rows.repartition(n, "comp", "task").sortWithinPartitions("comp", "task", "u")
        return placed.select("comp", "task", "label", *[c for c in cols if c != "comp"]).mapInArrow(common.lean(task), "b long, a long")

    if n_large == 0:
        edges = common.cut(run(members.withColumns({"task": F.lit(0).cast("long"), "label": F.col("u")})))
        if overlap:
            return components(edges).select(F.col("v").alias("u"), F.col("comp").alias("root"))
        # one task saw the whole cluster, so its stars are the components
        return edges.select(F.col("b").alias("u"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("u"), F.col("a").alias("root")).distinct())
    blocked = common.small_or_shuffled(members, sizes, "comp", "left", n_large, 24)
    blocked = blocked.withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("u"), F.col("blocks"))).cast("int"))
    tasks = F.when(F.col("blocks").isNotNull() & (F.col("block") == 0), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    edges = common.cut(run(blocked.withColumn("label", F.col("u")).withColumn("task", F.explode(tasks.cast("array<long>")))))
    found = common.cut(components(edges))
    labelled = blocked.where("blocks > 1").join(found.withColumnsRenamed({"v": "u", "comp": "label"}), "u", "left").withColumn("label", F.coalesce("label", "u"))
    labelled = common.cut(labelled)
    blocks = labelled.groupBy("comp", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    other = blocks.select("comp", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    open_pairs = blocks.join(other, "comp").where("block > 0 and block < block2 and not (lo = hi and lo2 = hi2 and lo = lo2)")
    pairs = open_pairs.select("comp", F.explode(F.array("block", "block2")).alias("block"), (F.col("block") * F.lit(1 << 32) + F.col("block2")).cast("long").alias("task"))
    more = run(labelled.join(pairs, ["comp", "block"]))
    every = edges.unionByName(more).unionByName(found.select(F.col("v").alias("b"), F.col("comp").alias("a")))
    return components(every).select(F.col("v").alias("u"), F.col("comp").alias("root"))


def first_of(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Of the rows with the same value of `by`, the first."""
    (k,) = common.free(rows, "_k")
    return rows.withColumn(k, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(k) == 1).drop(k)
