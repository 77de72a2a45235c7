"""Operator 10, sharding: a k-d tree over metadata whose leaves hold nearly equal bytes.

Every row is a point: a coordinate in 0 to CELLS - 1 for each metadata dimension (numbers by their place between the
least and the largest value, strings likewise by their first PREFIX bytes, null as the least). A node is split at the weighted median, by bytes,
along its widest dimension; rows of the median's cell are parted by a hash, so a value that a third of the rows share
still splits evenly. Given target_bytes, every node of more bytes is split, for as long as its rows can be parted; without
it splitting goes on to 2 ** levels leaves, as op10 asks (16).

The medians are distributed: bytes are summed by (node, dimension, cell), pre-aggregated before the shuffle, and the
driver gets those sums, at most nodes * dimensions * CELLS of them whatever the input, for NODES_AT_ONCE nodes at a time
where a target is given. A level takes two such sums.
Texts are read once, for their size and checksum; the tree works on a narrow table in the shared folder. Slots are
gapless in a shard: a row's number within (shard, part) plus the rows of earlier parts.

Law: bytes (sizes nearly equal); grown_shard is null. Null or empty text: size 1, checksum 0. Very long texts: one row;
a shard can exceed its share by no more than the rows that meet at a median's hash cell. Ties and repeated rows: parted
by a row number taken when the narrow table is written. Null doc_id: a point like others. Empty table: no rows. Extra
columns are ignored by op10; `shard_rows` takes any, also where their names are those used here inside. Equal texts aren't
kept together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CELLS, LEVELS, NODES_AT_ONCE, PREFIX = 4096, 4, 64, 6
DIMENSIONS = ("source", "lang", "size", "doc_id")


def coordinates(rows: DataFrame, dimensions: tuple[str, ...]) -> list[Column]:
    kinds = dict(rows.dtypes)
    place = {d: F.conv(F.rpad(F.hex(F.substring(F.col(d).cast("binary"), 1, PREFIX)), 2 * PREFIX, "0"), 16, 10).cast("double") if kinds[d] == "string" else F.col(d).cast("double") for d in dimensions}
    ends = rows.agg(*[f(place[d]).alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for d in dimensions:
        if ends[f"lo_{d}"] is None:
            out.append(F.lit(0))
            continue
        span = (ends[f"hi_{d}"] - ends[f"lo_{d}"]) or 1.0
        cell = F.least(F.floor((place[d] - ends[f"lo_{d}"]) / span * CELLS), F.lit(CELLS - 1))
        out.append(F.when(F.col(d).isNull(), 0).otherwise(cell).cast("int"))
    return out


def middle(sums: np.ndarray, cells: np.ndarray) -> tuple[int, float]:
    """The cell in which half of the whole is reached, and the sum before it."""
    order = np.argsort(cells)
    reach = np.cumsum(sums[order])
    k = min(int(np.searchsorted(reach, reach[-1] / 2)), len(order) - 1)
    return int(cells[order][k]), float(reach[k] - sums[order][k])


def last_left(sums: np.ndarray, ties: np.ndarray, before: float, whole: float) -> int:
    """The tie after which the sum is nearest to half of the whole; -1: before the first."""
    order = np.argsort(ties)
    reach = np.concatenate([[before], before + np.cumsum(sums[order])])
    k = int(np.argmin(np.abs(reach - whole / 2)))
    return int(ties[order][k - 1]) if k else -1


def splits(at: DataFrame, n_dims: int, part: bool = False) -> dict[int, tuple[int, int, int]]:
    """For each node of the points: the dimension, the median's cell and the tie after which its rows go right.

    With part, a node whose rows would all go left is cut before its last cell, or in its only cell before the last tie.
    """
    each = at.select("node", "size", F.posexplode(F.array(*[F.col(f"c{d}") for d in range(n_dims)])).alias("dim", "cell"))
    sums = each.groupBy("node", "dim", "cell").agg(F.sum("size").alias("w")).toPandas()
    if not len(sums):
        return {}
    picked: dict[int, tuple[int, int, float, float]] = {}
    last = sums.groupby(["node", "dim"])["cell"].max()
    for n, of_node in sums.groupby("node"):
        width = of_node.groupby("dim")["cell"].agg(lambda x: x.max() - x.min())
        dim = int(width.idxmax())
        mine = of_node[of_node["dim"] == dim]
        whole = float(mine["w"].sum())
        picked[int(n)] = (dim, *middle(mine["w"].to_numpy(float), mine["cell"].to_numpy()), whole)

    def of(k: int) -> Column:
        """What was picked for the row's node."""
        return F.element_at(F.create_map(*[F.lit(x) for n, p in picked.items() for x in (n, p[k])]), F.col("node").cast("long"))

    own = F.get(F.array(*[F.col(f"c{d}") for d in range(n_dims)]), of(0))
    inner = at.withColumns({"own": own, "median": of(1)}).where("own = median").groupBy("node", "tie").agg(F.sum("size").alias("w")).toPandas()
    out = {}
    for n, (dim, median, before, whole) in picked.items():
        mine = inner[inner["node"] == n]
        ties = np.sort(mine["tie"].to_numpy())
        tie = last_left(mine["w"].to_numpy(float), mine["tie"].to_numpy(), before, whole)
        if part and median == last[n, dim] and tie == ties[-1]:
            tie = -1 if before else int(ties[max(len(ties) - 2, 0)])
        out[n] = (dim, median, tie)
    return out


def leaves(points: DataFrame, n_dims: int, levels: int) -> DataFrame:
    """points (c0, c1, ..., tie, size) with shard, the leaf, 0 to 2 ** levels - 1; each level's nodes are kept as a column."""
    at = points.withColumn("node", F.lit(1).cast("long"))
    for level in range(levels):
        picked: dict[int, tuple[int, int, int]] = {}
        for k in range(0, 1 << level, NODES_AT_ONCE):
            picked |= splits(at.where(F.col("node").between((1 << level) + k, (1 << level) + k + NODES_AT_ONCE - 1)) if level > 6 else at, n_dims)
            if level <= 6:
                break
        at = common.cut(stepped(at, picked, n_dims))
    return at.withColumn("shard", (F.col("node") - 2**levels).cast("int")).drop("node")


def stepped(at: DataFrame, picked: dict[int, tuple[int, int, int]], n_dims: int) -> DataFrame:
    """at with the rows of the picked nodes moved to the children."""
    side = at.sparkSession.createDataFrame([(n, *p) for n, p in picked.items()], "node long, _dim int, _median int, _tie int")
    own = F.get(F.array(*[F.col(f"c{d}") for d in range(n_dims)]), F.col("_dim"))
    right = (own > F.col("_median")) | ((own == F.col("_median")) & (F.col("tie") > F.col("_tie")))
    joined = common.small_or_shuffled(at, side, "node", "left", len(picked), 40)
    node = F.when(F.col("_dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right.cast("long"))
    return joined.withColumn("node", node).drop("_dim", "_median", "_tie")


def grown(points: DataFrame, n_dims: int, target_bytes: int) -> DataFrame:
    """points with shard: nodes of more than the target are split while that parts their rows."""
    spark = points.sparkSession
    at, whole = points.withColumn("node", F.lit(1).cast("long")), set()
    before: dict[int, int] = {}
    while True:
        sizes = at.groupBy("node").agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()
        whole |= {r.node for r in sizes if r.n == 1 or before.get(r.node // 2) == r.n or r.node >= 1 << 61}
        split = sorted(r.node for r in sizes if r.w > target_bytes and r.node not in whole)
        if not split:
            break
        before = {r.node: r.n for r in sizes if r.node in set(split)}
        picked: dict[int, tuple[int, int, int]] = {}
        for k in range(0, len(split), NODES_AT_ONCE):
            picked |= splits(at.where(F.col("node").isin(split[k : k + NODES_AT_ONCE])), n_dims, part=True)
        at = common.cut(stepped(at, picked, n_dims))
    order = sorted((r.node for r in sizes), key=lambda n: n / (1 << n.bit_length()))
    shards = spark.createDataFrame([(n, k) for k, n in enumerate(order)], "node long, shard int")
    return common.small_or_shuffled(at, shards, "node", "inner", len(order), 24).drop("node")


def shard_rows(rows: DataFrame, dimensions: tuple[str, ...], levels: int = LEVELS, target_bytes: int | None = None) -> DataFrame:
    """rows, which have a column size, with shard and slot (with signs added where rows has such columns); one row out for each row in.

    With target_bytes a shard has more bytes only where its rows can't be parted; levels is then ignored.

    The columns of rows are kept in the shared folder while the tree is built, so give narrow rows.
    """
    spark = rows.sparkSession
    shard, slot = common.free(rows, "shard", "slot")
    places = [c.alias(f"c{k}") for k, c in enumerate(coordinates(rows, dimensions))]
    points = rows.select(F.struct("*").alias("row"), F.col("size").cast("long").alias("size"), *places, F.monotonically_increasing_id().alias("at"))
    points = points.withColumn("hash", F.xxhash64("row", "at")).withColumn("tie", F.pmod("hash", F.lit(CELLS)).cast("int"))
    points = common.cut(points)
    placed = leaves(points, len(dimensions), levels) if target_bytes is None else grown(points, len(dimensions), target_bytes)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = placed.withColumn("part", F.pmod(F.shiftright("hash", 20), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = common.cut(counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("hash", "at")) - 1
    out = common.small_or_shuffled(placed.withColumn("within", within), before, ["shard", "part"], "inner", before.count(), 64)
    return out.select("row.*", F.col("shard").alias(shard), (F.col("before") + F.col("within")).cast("long").alias(slot))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(rows, DIMENSIONS, LEVELS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
