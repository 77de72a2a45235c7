"""Ordered operators (A5, W2 to W7, W9, W11, W15, A13, A14, O4): windows, islands and folds over one group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoints

#: A histogram of more bins is a mistake of units.
MOST_BINS = 1 << 24


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """A5: counts of all bins from the least to the largest value; the last edge belongs to the last bin.

    The number of bins follows the range of the values, not the rows; more than MOST_BINS of them are an error.
    """
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).withColumn("bins", F.greatest(F.ceil((F.col("hi") - F.col("lo")) / width), F.lit(1)).cast("long"))
    ends = ends.withColumn("bins", F.when(F.col("bins") > MOST_BINS, F.raise_error(F.lit("too many bins: check the unit of the values or the width")).cast("long")).otherwise(F.col("bins")))
    bin_ = F.least(F.floor((F.col(value) - F.col("lo")) / width).cast("long"), F.col("bins") - 1)
    counted = df.join(F.broadcast(ends)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.where("lo is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"), "lo")
    return every.join(counted, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") + 0.5) * width).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))


def smoothed(hist: DataFrame) -> DataFrame:
    """Hist with sm, the box mean of three bins, 0 outside."""
    w = Window.orderBy("bin")
    return hist.withColumn("sm", (F.coalesce(F.lag("n").over(w), F.lit(0)) + F.col("n") + F.coalesce(F.lead("n").over(w), F.lit(0))) / 3)


def peaks(hist: DataFrame, least_share: float) -> DataFrame:
    """Bins whose box mean of three (0 outside) is a local maximum and reaches a share of the largest.

    A histogram is bounded by its bins, so one ordered window is enough.
    """
    w = Window.orderBy("bin")
    s = smoothed(hist).withColumns({"_l": F.lag("sm").over(w), "_r": F.lead("sm").over(w), "_top": F.max("sm").over(Window.partitionBy())})
    keep = (F.col("sm") >= F.coalesce("_l", F.lit(0.0))) & (F.col("sm") >= F.coalesce("_r", F.lit(0.0))) & (F.col("sm") >= least_share * F.col("_top")) & (F.col("sm") > 0)
    return s.where(keep).drop("_l", "_r", "_top")


def merged(found: DataFrame, apart: int = 5) -> DataFrame:
    """Of peaks in the order of their bins, one less than `apart` bins after the last one taken replaces it where it is
    larger and goes otherwise. A fold over the peaks of one histogram."""
    packed = found.agg(F.array_sort(F.collect_list(F.struct("bin", "sm", "centre"))).alias("p"))
    kind = "array<struct<bin:bigint,sm:double,centre:double>>"

    def step(s: Column, x: Column) -> Column:
        last = F.get(s, F.size(s) - 1)
        near = (F.size(s) > 0) & (x["bin"] - last["bin"] < apart)
        return F.when(near & (x["sm"] > last["sm"]), F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(x))).when(near, s).otherwise(F.concat(s, F.array(x)))

    return packed.select(F.explode(F.aggregate(F.col("p").cast(kind), F.array().cast(kind), step)).alias("x")).select("x.*")


def prominence(found: DataFrame, hist: DataFrame, near: int = 8, far: int = 20) -> DataFrame:
    """Peaks with their sm over the median sm of the bins from near to far on both sides (1 at least)."""
    sides = F.array(*[F.lit(k).cast("long") for k in [*range(-far, -near), *range(near, far)]])
    around = found.select("bin", F.explode(sides).alias("k")).withColumn("at", F.col("bin") + F.col("k"))
    beside = around.join(smoothed(hist).select(F.col("bin").alias("at"), F.col("sm").alias("_s")), "at").groupBy("bin").agg(F.median("_s").alias("_m"))
    return found.join(beside, "bin", "left").withColumn("prominence", F.col("sm") / F.greatest(F.coalesce("_m", F.lit(0.0)), F.lit(1.0))).drop("_m")


def islands(df: DataFrame, by: list[str], value: str, gap: float, order: list[str] | None = None) -> DataFrame:
    """Df with the number of the run that the row is in; a step over gap starts a new run."""
    w = Window.partitionBy(*by).orderBy(value, *(order or []))
    return df.withColumn("_new", (F.col(value) - F.lag(value).over(w) > gap).cast("int")).withColumn("island", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(df: DataFrame, by: list[str], value: str, gap: float, order: list[str] | None = None) -> DataFrame:
    """The runs themselves: first, last, rows."""
    return islands(df, by, value, gap, order).groupBy(*by, "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n"))


def dense_runs(df: DataFrame, by: list[str], value: str, gap: float, width: float, least_span: float, least_fill: float) -> DataFrame:
    """Runs of enough span in which enough bins of the given width are occupied."""
    r = islands(df, by, value, gap).groupBy(*by, "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.countDistinct(F.floor(F.col(value) / width)).alias("filled"), F.count("*").alias("n"))
    return r.where((F.col("last") - F.col("first") >= least_span) & (F.col("filled") * width >= least_fill * (F.col("last") - F.col("first"))))


def dense_or_largest(df: DataFrame, by: list[str], value: str, gap: float, width: float, least_span: float, least_fill: float) -> DataFrame:
    """Runs of enough span of whose bins, from the run's start, enough are occupied; where a group has none, its run of
    most rows (the first on ties)."""
    i = islands(df, by, value, gap)
    lo = F.min(value).over(Window.partitionBy(*by, "island"))
    r = i.withColumn("_lo", lo).groupBy(*by, "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.countDistinct(F.floor((F.col(value) - F.col("_lo")) / width)).alias("filled"), F.count("*").alias("n"))
    span = F.col("last") - F.col("first")
    dense = (span >= least_span) & (F.col("filled") / F.greatest(F.ceil(span / width), F.lit(1)) >= least_fill)
    g = Window.partitionBy(*by)
    r = r.withColumn("dense", dense).withColumns({"_any": F.bool_or("dense").over(g), "_k": F.row_number().over(g.orderBy(F.desc("n"), "first"))})
    return r.where("dense or (not _any and _k = 1)").drop("_any", "_k")


def bearing_runs(bins: DataFrame, by: list[str], step: int = 3, least: int = 2) -> DataFrame:
    """Runs of bearing bins, parted where the next bin is more than `step` away; runs of fewer than `least` bins go.
    The circle isn't closed."""
    return runs(bins, by, "bin", step).where(F.col("n") >= least)


def thin_runs(df: DataFrame, by: list[str], value: str, width: float, share: float) -> DataFrame:
    """Runs of bins with under `share` of the median of the occupied ones, between the least and the largest value."""
    b = df.withColumn("bin", F.floor(F.col(value) / width).cast("long"))
    counts = b.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    ends = counts.groupBy(*by).agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"), F.median("n").alias("typical"))
    every = ends.select(*by, "typical", F.explode(F.sequence("_lo", "_hi")).alias("bin"))
    full = every.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    thin = full.where(F.col("n") < share * F.col("typical"))
    return islands(thin, by, "bin", 1).groupBy(*by, "island").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.sum("n").cast("long").alias("n"))


def spaced(df: DataFrame, by: list[str], time: str, key: str, least: int) -> DataFrame:
    """Greedy keyframes by time: a row is kept when it is at least `least` after the last kept one. The sorted rows pass
    through a batch at a time with the last kept one in mind, so no group is held as a whole."""
    narrow = df.select(*by, time, key)

    def rule(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last = None, None
        for rows in batches:
            of = rows[by].astype(object)
            kept = []
            for k, (g, t) in enumerate(zip(of.where(of.notna(), None).itertuples(index=False, name=None), rows[time].tolist(), strict=True)):
                if last is None or g != group or t - last >= least:
                    kept.append(k)
                    group, last = g, t
            yield rows.iloc[kept][[*by, key]]

    return narrow.repartition(*by).sortWithinPartitions(*by, time, key).mapInPandas(rule, narrow.drop(time).schema)


def keyframes(df: DataFrame, by: list[str], order: str, position: list[str], rotation: list[str], least_rows: int = 10, least_move: float = 0.05, least_turn: float = 3.0, most: int = 300) -> DataFrame:
    """W2 by motion: the first row of a group; then a row at least least_rows after the last kept one that has moved by
    least_move or turned by least_turn degrees. Of more than `most` kept ones, evenly spaced ones stay."""
    narrow = df.select(*by, order, *position, *rotation)

    def rule(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        p, q = rows[position].to_numpy(float), rows[rotation].to_numpy(float)
        kept = [0]
        for k in range(1, len(rows)):
            if k - kept[-1] < least_rows:
                continue
            turn = math.degrees(2 * math.acos(min(abs(float(q[k] @ q[kept[-1]])), 1.0)))
            if float(np.linalg.norm(p[k] - p[kept[-1]])) >= least_move or turn >= least_turn:
                kept.append(k)
        if len(kept) > most:
            kept = [kept[int(k)] for k in np.unique(np.rint(np.linspace(0, len(kept) - 1, most)))]
        return rows.iloc[kept][[*by, order]]

    return narrow.groupBy(*by).applyInPandas(rule, narrow.select(*by, order).schema)


def extent(df: DataFrame, by: list[str], value: str, tail: float) -> DataFrame:
    """Exact quantiles tail and 1 - tail by linear interpolation, and the median."""
    return df.groupBy(*by).agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"), F.median(value).alias("middle"), F.count("*").alias("n"))


def conformal(df: DataFrame, by: list[str], residual: Column, alpha: float) -> DataFrame:
    """The k-th least residual, k = least(ceil((n + 1)(1 - alpha)), n), of each group.

    Found by rank over (group, value) counts, so a large group isn't collected.
    """
    counts = df.select(*by, residual.alias("r")).groupBy(*by, "r").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumns({"reach": F.sum("c").over(w.orderBy("r")), "n": F.sum("c").over(w)})
    k = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)), F.col("n"))
    return ranked.where(F.col("reach") >= k).groupBy(*by).agg(F.min("r").alias("quantile"), F.first("n").alias("n"))


def evenly(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """N rows at evenly spaced ranks, half ranks to even. A rank is the row's place in its sorted partition and the rows
    of the partitions before it; the sorted rows are kept in the shared folder, so both come from one sort."""
    spark = df.sparkSession
    checkpoints(spark)
    at = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    at = at.withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = [(r[0], r[1]) for r in at.groupBy("_part").count().orderBy("_part").collect()]
    before, parts = 0, []
    for part, size in sizes:
        parts.append((part, before))
        before += size
    ranks = sorted({int(np.rint(k * (before - 1) / max(1, n - 1))) for k in range(n)}) if before else []
    ranked = at.join(F.broadcast(spark.createDataFrame(parts, "_part long, _before long")), "_part")
    return ranked.where((F.col("_before") + F.col("_in")).isin(ranks)).select(*df.columns)


def share_of_best(df: DataFrame, by: list[str], score: str, share: float) -> DataFrame:
    """Rows with at least a share of their group's best score."""
    return df.withColumn("_best", F.max(score).over(Window.partitionBy(*by))).where(F.col(score) >= share * F.col("_best")).drop("_best")
