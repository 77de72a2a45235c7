"""Lines, rays and directions (A6, A8 to A12, J7, J11, J12, M3, G14, G15): column arithmetic and pre-aggregated sums."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bearing_bin


def principal_angle(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The direction of the least squares line through a group's points, from the covariance in closed form."""
    sxx, syy, sxy = F.var_samp(x), F.var_samp(y), F.covar_samp(x, y)
    return df.groupBy(*by).agg((0.5 * F.atan2(2 * sxy, sxx - syy)).alias("angle"), F.count("*").alias("n"))


def circular_mean(df: DataFrame, by: list[str], angle: Column, weight: Column, fold: int = 4) -> DataFrame:
    """The weighted mean of angles that count alike every 360 / fold degrees."""
    return df.groupBy(*by).agg((F.atan2(F.sum(weight * F.sin(angle * fold)), F.sum(weight * F.cos(angle * fold))) / fold).alias("angle"))


def axis_scores(cells: DataFrame, x: str, y: str, angles: list[float], width: float) -> DataFrame:
    """For each angle the sum of squared counts of offset bins, over two directions and two bin phases.

    Angles are a literal array unfolded in the row; counts are pre-aggregated, so what is shuffled follows the bins.
    """
    tried = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.cos(a)).alias("c"), F.lit(math.sin(a)).alias("s")) for k, a in enumerate(angles)])
    each = cells.select(F.col(x).alias("x"), F.col(y).alias("y"), F.explode(tried).alias("t"))
    along = F.array(F.struct(F.lit(0).alias("d"), (F.col("x") * F.col("t.c") + F.col("y") * F.col("t.s")).alias("u")), F.struct(F.lit(1).alias("d"), (F.col("y") * F.col("t.c") - F.col("x") * F.col("t.s")).alias("u")))
    each = each.select("t.k", F.explode(along).alias("a")).select("k", "a.*", F.explode(F.array(F.lit(0.0), F.lit(0.5))).alias("phase"))
    counts = each.groupBy("k", "d", "phase", F.floor(F.col("u") / width + F.col("phase")).alias("bin")).agg(F.count("*").alias("n"))
    return counts.groupBy("k").agg(F.sum(F.col("n") * F.col("n")).cast("long").alias("score"))


def first_hits(origins: DataFrame, walls: DataFrame, n_rays: int) -> DataFrame:
    """For each origin and ray the nearest wall it meets; the lower wall number wins ties.

    walls (wall, ax, ay, bx, by) are a scene's few walls and are broadcast; the minimum is pre-aggregated.
    """
    rays = origins.withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(n_rays - 1))))
    turn = 2 * math.pi / n_rays
    rays = rays.withColumns({"dx": F.cos(F.col("ray") * turn), "dy": F.sin(F.col("ray") * turn)})
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    det = F.col("dx") * ey - F.col("dy") * ex
    wx, wy = F.col("ax") - F.col("ox"), F.col("ay") - F.col("oy")
    met = rays.join(F.broadcast(walls)).withColumns({"det": det, "t": F.try_divide(wx * ey - wy * ex, det), "u": F.try_divide(wx * F.col("dy") - wy * F.col("dx"), det)})
    met = met.where("abs(det) > 1e-9 and t > 1e-9 and u between 0 and 1")
    return met.groupBy("origin", "ray").agg(F.min(F.struct(F.round("t", 9).alias("t"), "wall")).alias("x")).select("origin", "ray", "x.wall", "x.t")


def crossings(path: DataFrame, by: list[str], order: list[str], walls: DataFrame) -> DataFrame:
    """How often a path's segments cross each wall, ends included. path has x and y."""
    w = Window.partitionBy(*by).orderBy(*order)
    seg = path.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).where("x2 is not null")
    rx, ry, sx, sy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    det = rx * sy - ry * sx
    wx, wy = F.col("ax") - F.col("x"), F.col("ay") - F.col("y")
    met = seg.join(F.broadcast(walls)).withColumns({"det": det, "t": F.try_divide(wx * sy - wy * sx, det), "u": F.try_divide(wx * ry - wy * rx, det)})
    return met.where("abs(det) > 1e-12 and t between 0 and 1 and u between 0 and 1").groupBy("wall").agg(F.count("*").alias("n"))


def visible_range(points: DataFrame, by: list[str], x: str, y: str, bins: int, near: float, far: float, least: int, margin: float) -> DataFrame:
    """For each bearing bin with enough points the tenth percentile of the range less a margin, not below 0."""
    r = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    seen = points.select(*by, bearing_bin(F.col(y), F.col(x), bins).alias("bin"), r.alias("r")).where((F.col("r") > near) & (F.col("r") <= far))
    return seen.groupBy(*by, "bin").agg(F.percentile("r", F.lit(0.1)).alias("p"), F.count("*").alias("n")).where(F.col("n") >= least).select(*by, "bin", F.greatest(F.col("p") - margin, F.lit(0.0)).alias("reach"), "n")


def resultant(df: DataFrame, by: list[str], vector: tuple[Column, Column, Column]) -> DataFrame:
    """The mean of a group's vectors, its length, and its direction, null where it has none (under 1e-9)."""
    g = df.groupBy(*by).agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(vector)], F.count("*").alias("n"))
    size = F.sqrt(F.col("m0") ** 2 + F.col("m1") ** 2 + F.col("m2") ** 2)
    return g.withColumn("length", size).withColumns({a: F.when(F.col("length") > 1e-9, F.col(f"m{k}") / F.col("length")) for k, a in enumerate(("ux", "uy", "uz"))}).drop("m0", "m1", "m2")


def axis_mappings() -> list[list[list[int]]]:
    """The 24 rotations that map axes to axes: signed permutations of determinant 1."""
    out = []
    for order in itertools.permutations(range(3)):
        odd = sum(order[a] > order[b] for a in range(3) for b in range(a + 1, 3)) % 2
        for signs in itertools.product((1, -1), repeat=3):
            if math.prod(signs) * (-1) ** odd == 1:
                out.append([[signs[r] if c == order[r] else 0 for c in range(3)] for r in range(3)])
    return out


def gravity_mapping(samples: DataFrame, by: list[str], reading: list[str], rotation: list[list[Column]], least: float = 0.85, margin: float = 0.10, least_rows: int = 50) -> DataFrame:
    """M3, A10: for each group the axis mapping (its number in axis_mappings) under which the readings, turned by their
    rows' rotations, agree best: the resultant's length, the margin to the next one and whether both and the number of
    rows suffice. Readings are scaled to length 1."""
    size = F.sqrt(sum((F.col(c) ** 2 for c in reading[1:]), F.col(reading[0]) ** 2))
    rows = samples.where(size > 1e-9)
    unit = [F.col(c) / size for c in reading]
    tried = []
    for k, m in enumerate(axis_mappings()):
        v = [sum((unit[c] * m[r][c] for c in range(3) if m[r][c]), F.lit(0.0)) for r in range(3)]
        world = [sum((rotation[r][c] * v[c] for c in range(3)), F.lit(0.0)) for r in range(3)]
        tried.append(F.struct(F.lit(k).alias("k"), *[w.alias(a) for w, a in zip(world, "xyz", strict=True)]))
    each = rows.select(*by, F.explode(F.array(*tried)).alias("t")).groupBy(*by, F.col("t.k").alias("mapping")).agg(*[F.avg(f"t.{a}").alias(f"u{a}") for a in "xyz"], F.count("*").alias("n"))
    each = each.withColumn("length", F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2))
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("length", 9)), "mapping")
    top = each.withColumns({"_k": F.row_number().over(w), "margin": F.col("length") - F.lead("length").over(w)}).where("_k = 1").drop("_k")
    return top.withColumn("reliable", (F.col("length") >= least) & (F.col("margin") >= margin) & (F.col("n") >= least_rows))
