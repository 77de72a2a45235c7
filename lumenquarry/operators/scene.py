"""Fits of a whole capture (M2, M4, M7, M14 to M17): compositions of the histogram, wall, grid and plane operators.

What reaches the driver is a fit's few numbers: peaks of one histogram, planes, the ends of a scene's walls.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quaternion_matrix
from ..session import checkpoints
from . import grid, project, series, walls


class UpError(RuntimeError):
    """The floor or the up direction can't be found; evidence says what was seen."""

    def __init__(self, message: str, evidence: dict):
        super().__init__(message)
        self.evidence = evidence


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v)


def camera_up(poses: DataFrame, axes: str = "arkit") -> np.ndarray:
    """M4: the mean world direction of the images' up, a weak hint; an error where the cameras' ups cancel out."""
    r = quaternion_matrix(tuple(F.col(c) for c in project.Q))
    sign = 1.0 if axes == "arkit" else -1.0
    mean = np.array(poses.agg(*[F.avg(r[k][1] * sign) for k in range(3)]).first(), float)
    if not np.linalg.norm(mean) >= 1e-6:
        raise ValueError("the cameras' up directions have no mean")
    return unit(mean)


def path_up(poses: DataFrame, sign: np.ndarray | None = None, axes: str = "arkit") -> np.ndarray:
    """M4: the direction in which the cameras' positions vary least, turned to the side of `sign` (gravity, or the cameras'
    own up)."""
    at = poses.select(F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    normal, _ = project.fitted_plane(at)
    return normal if normal @ (camera_up(poses, axes) if sign is None else sign) >= 0 else -normal


def levels(peaks: list[tuple[float, float, float]], camera: float | None, floor_gap: float = 0.3, above: float = 0.15, least_height: float = 1.8, least_prominence: float = 2.0) -> tuple[float | None, float | None]:
    """M2: the heights of floor and ceiling among peaks (height, count, prominence) in rising order; None: not seen.

    Floor: the lowest one far enough under the cameras. Ceiling: high enough above it, prominent, above the cameras, of
    these the strongest; without cameras the highest.
    """
    under = [p for p in peaks if camera is None or p[0] <= camera - floor_gap]
    if not under:
        return None, None
    floor = under[0][0]
    over = [p for p in peaks if p[0] - floor >= least_height and p[2] >= least_prominence and (camera is None or p[0] >= camera + above)]
    if not over:
        return floor, None
    return floor, over[-1][0] if camera is None else max(over, key=lambda p: p[1])[0]


def floor_ceiling(points: DataFrame, hint: np.ndarray, cameras: DataFrame | None = None, within: float = 0.02, most_degrees: float = 20.0, width: float = 0.02, least_share: float = 0.15, floor_gap: float = 0.3) -> dict:
    """M2: up, floor and ceiling planes (ceiling None where it isn't seen), ceiling height and tilt, warnings.

    The dominant plane near the hint gives up, fitted twice more within 8 degrees; peaks of the heights along it give the
    levels, at which planes are fitted to the points within 6 cm. cameras: x, y, z. UpError where no floor fits, or the
    cameras stand oddly over it.
    """
    first = project.ransac_plane(points, within, hint, most_degrees)
    if first is None:
        raise UpError("no plane near the hint", {"hint": hint.tolist()})
    up = first["normal"]
    for _ in range(2):
        if (again := project.ransac_plane(points, within, up, 8.0)) is None:
            break
        up = again["normal"]
    height = project.plane_distance(up, 0.0)
    hist = series.histogram(points.select(height.alias("h")).where("h is not null"), "h", width)
    found = series.prominence(series.merged(series.peaks(hist, least_share)), hist, round(0.16 / width), round(0.40 / width))
    peaks = [(r["centre"], r["sm"], r["prominence"]) for r in found.orderBy("bin").collect()]
    camera = None if cameras is None else cameras.agg(F.median(height)).first()[0]
    evidence = {"up": up.tolist(), "peaks": peaks, "camera": camera}
    floor_at, ceiling_at = levels(peaks, camera, floor_gap)
    if floor_at is None:
        raise UpError("no surface under the cameras", evidence)
    plane = lambda at: project.ransac_plane(points.where(F.abs(height - at) < 0.06), within, up, 10.0)
    if (floor := plane(floor_at)) is None:
        raise UpError("no plane at the floor's height", evidence)
    ceiling = plane(ceiling_at) if ceiling_at is not None else None
    warnings = ["no plane at the ceiling's height: taken as unobserved"] if ceiling_at is not None and ceiling is None else []
    over = lambda p: project.plane_distance(p["normal"], p["d"])
    if cameras is not None:
        c = cameras.agg(F.median(over(floor)).alias("m"), (F.max(over(floor)) - F.min(over(floor))).alias("spread")).first()
        evidence |= {"camera_over_floor": c["m"], "camera_spread": c["spread"]}
        if not (floor_gap <= c["m"] <= 2.6 and c["spread"] <= 1.2):
            raise UpError(f"cameras are {c['m']:.2f} m over the floor, within {c['spread']:.2f} m", evidence)
        if ceiling is not None and cameras.agg(F.median(over(ceiling))).first()[0] > 0:
            warnings.append("cameras are above the ceiling")
    out = {"up": up, "floor": floor, "ceiling": ceiling, "evidence": evidence, "warnings": warnings, "height": None, "tilt": None}
    if ceiling is not None:
        mean = points.where(F.abs(over(ceiling)) <= within).agg(F.avg(over(floor))).first()[0]
        out |= {"height": abs(mean), "tilt": math.degrees(math.acos(min(abs(float(floor["normal"] @ ceiling["normal"])), 1.0)))}
    return out


def axis_walls(cells: DataFrame, axes: DataFrame, cell: float = 0.02, capture: float = 0.05, tolerance: float = 6.0, shortest: float = 0.6, apart: float = 0.15, most: int = 16, trim: float = 0.005, gap: float = 1.5, run: float = 0.4, filled: float = 0.5, share: float = 0.10) -> DataFrame:
    """M7: walls of cells (scene, x, y) along each scene's two axes (scene, phi), and why candidates were rejected.

    Candidates are peaks of the offsets' histograms, moved twice to the median offset of the cells within `capture`. Their
    free direction must lie within the tolerance of the axis, their extent (tails trimmed, dense runs, quantiles) be long
    enough and their cells a share of the scene's best. wall numbers those kept, by falling n_cells; null with a reason.
    """
    checkpoints(cells.sparkSession)  # three cuts: what several branches read is made once
    least = int(shortest / cell * 0.6)
    at = cells.select("scene", "x", "y").join(axes.select("scene", "phi"), "scene")
    top = walls.pick_peaks(walls.offset_histogram(at, F.col("phi"), cell, max(round(capture / cell), 1)), least, max(round(apart / cell), 1), most).checkpoint()
    key = ["scene", "axis", "place"]
    met = at.withColumn("axis", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("a", F.col("phi") + F.col("axis") * (math.pi / 2))
    met = met.withColumns({"u": F.col("y") * F.cos("a") - F.col("x") * F.sin("a"), "s": F.col("x") * F.cos("a") + F.col("y") * F.sin("a")})
    met = met.join(top.select(*key, F.col("offset").alias("u0")), ["scene", "axis"]).where(F.abs(F.col("u") - F.col("u0")) < 3 * capture)
    for _ in range(2):
        middle = met.where(F.abs(F.col("u") - F.col("u0")) < capture).groupBy(*key).agg(F.median("u").alias("_m"))
        met = met.join(middle, key).withColumn("u0", F.col("_m")).drop("_m")
    met = met.where(F.abs(F.col("u") - F.col("u0")) < capture).checkpoint()
    angle = 0.5 * F.atan2(2 * F.covar_samp("x", "y"), F.var_samp("x") - F.var_samp("y"))
    fits = met.groupBy(*key, "a", "u0").agg(F.count("*").alias("n_cells"), F.avg("s").alias("_s"), angle.alias("raw_angle"), F.stddev_pop("u").alias("residual_std")).where(F.col("n_cells") >= least)
    fits = fits.withColumn("snapped_deg", F.degrees(F.acos(F.least(F.abs(F.cos(F.col("raw_angle") - F.col("a"))), F.lit(1.0)))))
    along = met.select(*key, "s").join(fits.where(F.col("snapped_deg") <= tolerance).select(*key, "_s"), key).withColumn("s", F.col("s") - F.col("_s")).drop("_s")
    solid = walls.trim_tails(along, key, "s").checkpoint()
    kept = series.dense_or_largest(solid, key, "s", gap, 0.1, run, filled).select(*key, "island")
    ends = series.extent(series.islands(solid, key, "s", gap).join(kept, [*key, "island"], "left_semi"), key, "s", trim).select(*key, F.col("low").alias("s_min"), F.col("high").alias("s_max"))
    w = fits.join(ends, key, "left").withColumns({"tx": F.cos("a"), "ty": F.sin("a"), "nx": -F.sin("a"), "ny": F.cos("a"), "d": -F.col("u0")})
    w = w.withColumns({"cx": F.col("_s") * F.col("tx") + F.col("u0") * F.col("nx"), "cy": F.col("_s") * F.col("ty") + F.col("u0") * F.col("ny")})
    w = w.withColumn("reason", F.when(F.col("snapped_deg") > tolerance, "non_conforming_angle").when(F.col("s_max") - F.col("s_min") < shortest, "too_short"))
    best = F.max(F.when(F.col("reason").isNull(), F.col("n_cells"))).over(Window.partitionBy("scene"))
    w = w.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("n_cells") < share * best), "weak_vs_best").otherwise(F.col("reason")))
    order = Window.partitionBy("scene", F.col("reason").isNull()).orderBy(F.desc("n_cells"), "axis", "place")
    w = w.withColumn("wall", F.when(F.col("reason").isNull(), F.row_number().over(order) - 1))
    return w.select("scene", "wall", *walls.WALL, "n_cells", "axis", "raw_angle", "snapped_deg", "residual_std", "reason")


def room_walls(cells: DataFrame, axes: DataFrame, path: DataFrame, order: list[str], band: DataFrame | None = None, origins: int = 40) -> DataFrame:
    """A scene's walls, ends moved to the corners: axis_walls of the cells; those with too little support in the high
    band (scene, x, y), those the camera's path (scene, x, y and its order) crosses on material and those its rays seldom
    meet first go; ends snap, close and are cut where they overshoot. Each step is cut, for the next reads it several times.

    axes: scenes whose axes are reliable; others have no walls here, as there is no fit of free lines.
    """
    checkpoints(cells.sparkSession)
    base = ["scene", "wall", *walls.WALL, "n_cells"]
    cut = lambda df: df.select(*base).checkpoint()
    w = cut(axis_walls(cells, axes).where("reason is null"))
    if band is not None:
        w = cut(walls.filter_by_band(w, band))
    path = path.select("scene", *order, "x", "y")
    crossed = walls.camera_crossed(w, path, cells, order).where("on_material > 0")
    w = cut(w.join(crossed.select("scene", "wall"), ["scene", "wall"], "left_anti"))
    by = Window.partitionBy("scene")
    ranked = path.withColumns({"origin": F.row_number().over(by.orderBy(*order)) - 1, "_n": F.count("*").over(by)})
    ranks = F.transform(F.sequence(F.lit(0), F.lit(origins - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / max(origins - 1, 1)))
    eyes = ranked.where((F.col("_n") <= origins) | F.array_contains(ranks, F.col("origin").cast("long"))).select("scene", "origin", F.col("x").alias("ox"), F.col("y").alias("oy"))
    w = cut(walls.prune_non_boundary(w, eyes))
    inside = path.groupBy("scene").agg(F.avg("x").alias("px"), F.avg("y").alias("py"))
    w = cut(walls.close_corners(cut(walls.snap_corners(w))))
    return cut(walls.trim_overshoot(w, inside.select("scene", "px", "py")).unionByName(w.join(inside, "scene", "left_anti"), allowMissingColumns=True))


def openings(points: DataFrame, found: DataFrame, inside: DataFrame, top: Column | float, band: float = 0.05, middle: tuple[float, float] = (0.9, 1.5), low: tuple[float, float] = (0.1, 0.5), width: float = 0.02, narrowest: float = 0.45, thin: float = 0.15, margin: float = 0.10, beyond: float = 0.15, least_seen: int = 30, least_points: int = 50) -> DataFrame:
    """Openings of walls: gaps in the points (scene, x, y, h) of a wall's middle heights, seen through where enough
    points lie beyond it; doors have little low down, windows much. inside: scene, px, py. top: the highest height used.

    Walls with few points have none; gaps at a wall's ends are left out. What isn't seen through is unknown, unobserved.
    """
    key = ["scene", "wall"]
    w = found.join(inside, "scene").withColumn("side", F.when(F.col("nx") * F.col("px") + F.col("ny") * F.col("py") + F.col("d") < 0, -1.0).otherwise(1.0))
    met = points.join(w.select(*key, *walls.WALL, "side"), "scene").withColumns({"off": F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("d"), "s": (F.col("x") - F.col("cx")) * F.col("tx") + (F.col("y") - F.col("cy")) * F.col("ty")})
    on = met.where((F.abs(F.col("off")) <= band) & F.col("s").between(F.col("s_min") - 0.05, F.col("s_max") + 0.05)).select(*key, "s", "h", "s_min", "s_max")
    mid = on.where(F.col("h").between(middle[0], F.least(F.lit(middle[1]), F.lit(top) if isinstance(top, int | float) else top)))
    many = mid.groupBy(*key, "s_min", "s_max").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_points).drop("_n")
    bins = F.greatest(F.ceil(F.round((F.col("s_max") - F.col("s_min")) / width, 6)), F.lit(1)).cast("long")
    counts = mid.withColumn("bin", F.floor((F.col("s") - F.col("s_min")) / width).cast("long")).groupBy(*key, "bin").agg(F.count("*").alias("n"))
    every = many.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), bins - 1)))
    full = every.join(counts, [*key, "bin"], "left").withColumn("_typical", F.median("n").over(Window.partitionBy(*key)))
    empty = full.where(F.coalesce("n", F.lit(0)) < thin * F.col("_typical"))
    runs = series.islands(empty, key, "bin", 1).groupBy(*key, "s_min", "s_max", "island").agg(F.min("bin").alias("a"), F.max("bin").alias("z"))
    gaps = runs.select(*key, "s_min", "s_max", (F.col("s_min") + F.col("a") * width).alias("first"), (F.col("s_min") + (F.col("z") + 1) * width).alias("last"))
    # a few parts in a billion, so that a bound given in whole bins holds for its sum too
    gaps = gaps.where((F.col("last") - F.col("first") >= narrowest - 1e-9) & (F.col("first") - F.col("s_min") >= margin - 1e-9) & (F.col("s_max") - F.col("last") >= margin - 1e-9))
    sides = walls.gap_edges(gaps.select(*key, "first", "last"), mid, key, "first", "last", "s").where("left is not null and right is not null").select(*key, F.col("left").alias("start"), F.col("right").alias("end"), (F.col("right") - F.col("left")).alias("width"))
    through = met.where((-F.col("side") * F.col("off") > beyond) & F.col("h").between(*middle)).select(*key, "s").join(sides, key).where("s > start and s < end").groupBy(*key, "start").agg(F.count("*").alias("seen"))
    parts = F.greatest(F.floor(F.col("width") / width), F.lit(1))
    lower = on.where(F.col("h").between(*low)).select(*key, "s").join(sides, key).where("s > start and s < end").groupBy(*key, "start", "width").agg(F.countDistinct(F.least(F.floor((F.col("s") - F.col("start")) / (F.col("width") / parts)), parts - 1)).alias("_f")).select(*key, "start", (F.col("_f") / parts).alias("low_fill"))
    out = sides.join(through, [*key, "start"], "left").join(lower, [*key, "start"], "left").fillna({"seen": 0, "low_fill": 0.0})
    kind = F.when(F.col("seen") < least_seen, "unknown").when(F.col("low_fill") < 0.2, "door").when(F.col("low_fill") > 0.6, "window").otherwise("unknown")
    out = out.withColumns({"kind": kind, "observed": F.col("seen") >= least_seen})
    return out.withColumn("opening", F.row_number().over(Window.partitionBy("scene").orderBy("wall", "start")) - 1)


def enclosed(found: DataFrame, cameras: DataFrame | None = None, size: float = 0.02, least_cells: int = 4) -> dict | None:
    """The region that one scene's walls enclose, to the walls' middle lines: cells (i, j) from `origin` on, area,
    the number of regions, the share of the cameras (x, y) inside. With cameras the region that holds most of them, else
    or where none holds any the largest. None: fewer than 3 walls, or nothing is enclosed."""
    checkpoints(found.sparkSession)
    rows = found.select(*walls.WALL).collect()  # a scene has few walls
    if len(rows) < 3:
        return None
    ends = np.array([[(r.cx + s * r.tx, r.cy + s * r.ty) for s in (r.s_min, r.s_max)] for r in rows])
    lo, hi = ends.reshape(-1, 2).min(axis=0) - 0.3, ends.reshape(-1, 2).max(axis=0) + 0.3
    wide, high = (int(k) for k in np.ceil((hi - lo) / size))
    spark = found.sparkSession
    at = [tuple(int(k) for k in np.rint((e - lo) / size).ravel()) for e in ends]
    barrier = grid.segment_cells(spark.createDataFrame(at, "i long, j long, i2 long, j2 long")).checkpoint()
    free = spark.range(wide).select(F.col("id").alias("i")).select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(high - 1).cast("long"))).alias("j")).join(barrier, ["i", "j"], "left_anti")
    parts = grid.components(free, eight=False)
    frame = F.col("i").isin(0, wide - 1) | F.col("j").isin(0, high - 1)
    regions = parts.groupBy("ci", "cj").agg(F.count("*").alias("n"), F.bool_or(frame).alias("_open")).where(~F.col("_open") & (F.col("n") >= least_cells)).drop("_open")
    seen = None
    if cameras is not None:
        cell = lambda c, k: F.rint((F.col(c) - float(lo[k])) / size).cast("long")
        where = cameras.select(cell("x", 0).alias("i"), cell("y", 1).alias("j"))
        seen = where.count()
        inside = where.groupBy("i", "j").agg(F.count("*").alias("c")).join(parts, ["i", "j"]).groupBy("ci", "cj").agg(F.sum("c").alias("c"))
        regions = regions.join(inside, ["ci", "cj"], "left")
    regions = regions.withColumn("c", F.coalesce("c", F.lit(0))) if seen is not None else regions.withColumn("c", F.lit(0).cast("long"))
    best = regions.agg(F.max(F.struct("c", "n", (-F.col("ci")).alias("a"), (-F.col("cj")).alias("b"))).alias("m"), F.count("*").alias("k")).first()
    if best["m"] is None:
        return None
    region = parts.where((F.col("ci") == -best["m"]["a"]) & (F.col("cj") == -best["m"]["b"])).select("i", "j")
    grown = grid.dilate(region).join(region.unionByName(barrier).distinct(), ["i", "j"], "left_semi")
    filled = grid.fill_holes(grown).checkpoint()
    return {"cells": filled, "origin": lo, "size": size, "area": grid.centre_area(filled) * size * size, "regions": best["k"], "cameras_inside": best["m"]["c"] / seen if seen else None}


def footprint(points: DataFrame, found: DataFrame, cameras: DataFrame | None = None, size: float = 0.02, band: float = 0.04, closing: float = 0.10, least_coverage: float = 0.5, least_inside: float = 0.5, most_outside: float = 0.5) -> dict:
    """One scene's floor: its evidence (points x, y, h near the floor, closed and filled, the largest piece), the region
    its walls enclose, the area (the enclosed one where there is one), and whether that is reliable, with the reasons.

    Sparse floor alone makes no area unreliable, only beside another reason. Evidence is not clipped to the walls' hull.
    """
    floor = points.where(F.abs("h") < band)
    reach = max(round(closing / size), 1)

    def evidence(lo: np.ndarray) -> DataFrame:
        at = floor.select(*[F.floor((F.col(c) - float(v)) / size).cast("long").alias(k) for c, k, v in (("x", "i", lo[0]), ("y", "j", lo[1]))]).distinct()
        return grid.close(at, "disc", reach)

    ring = enclosed(found, cameras, size)
    lo = ring["origin"] if ring else np.zeros(2)
    seen = evidence(lo).checkpoint()
    parts = grid.components(grid.fill_holes(seen))
    largest = parts.groupBy("ci", "cj").count().agg(F.max("count")).first()[0] or 0
    out = {"evidence_area": largest * size * size, "enclosed": ring, "coverage": None, "outside_area": None}
    reasons, sparse = [], None
    if ring is None:
        if not largest:
            raise ValueError("no floor points and no enclosing walls")
        reasons.append("walls enclose nothing")
        out["area"] = out["evidence_area"]
    else:
        n, total, both = ring["cells"].count(), seen.count(), seen.join(ring["cells"], ["i", "j"], "left_semi").count()
        out |= {"area": ring["area"], "coverage": both / max(n, 1), "outside_area": (total - both) * size * size}
        if out["coverage"] < least_coverage:
            sparse = f"floor points back {out['coverage']:.0%} of the region"
        if ring["cameras_inside"] is not None and ring["cameras_inside"] < least_inside:
            reasons.append(f"{ring['cameras_inside']:.0%} of the cameras are inside")
        if out["outside_area"] > most_outside * max(out["area"], 1e-6):
            reasons.append(f"{out['outside_area']:.1f} m2 of floor lie outside")
    out["reasons"] = [sparse, *reasons] if sparse and reasons else reasons
    return out | {"reliable": not reasons, "warnings": [sparse] if sparse else []}
