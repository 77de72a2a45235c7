"""Cameras, poses and planes (C15 to C23, J5, A8, A9, M1): column arithmetic; only 3 x 3 sums reach the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quaternion_angle, quaternion_matrix

Q = ("qx", "qy", "qz", "qw")


def depth_intrinsics(poses: DataFrame, rgb: tuple[int, int], depth: tuple[int, int], mode: str = "scaled_rgb_intrinsics") -> DataFrame:
    """Fx, fy, cx, cy for the depth grid; sizes are (width, height). `direct` takes them as they are."""
    if mode == "direct":
        return poses
    if mode != "scaled_rgb_intrinsics":
        raise NotImplementedError(f"intrinsics mode {mode}")
    sx, sy = depth[0] / rgb[0], depth[1] / rgb[1]
    return poses.withColumns({"fx": F.col("fx") * sx, "cx": F.col("cx") * sx, "fy": F.col("fy") * sy, "cy": F.col("cy") * sy})


def back_projected(pixels: DataFrame, scale: float, near: float, far: float, least_confidence: int = 0) -> DataFrame:
    """Camera coordinates x, y, z of pixels (v, u, raw, fx, fy, cx, cy and confidence where it is tested).

    Kept: finite depths from near to far, both included; confidence from least_confidence on, 0 tests nothing.
    """
    z = F.col("raw") * F.lit(float(scale))
    kept = pixels.withColumn("z", z).where((F.col("z") >= near) & (F.col("z") <= far))
    if least_confidence:
        kept = kept.where(F.col("confidence") >= least_confidence)
    return kept.withColumns({"x": (F.col("u") - F.col("cx")) * F.col("z") / F.col("fx"), "y": (F.col("v") - F.col("cy")) * F.col("z") / F.col("fy")})


def transformed(df: DataFrame, rotation: list[list[Column]], shift: list[Column], back: bool = False) -> DataFrame:
    """X, y, z as R p + t, or with back as the inverse, R'(p - t)."""
    p = [F.col(a) for a in "xyz"]
    if back:
        p = [a - t for a, t in zip(p, shift, strict=True)]
        rotation = [[rotation[j][i] for j in range(3)] for i in range(3)]
        shift = [F.lit(0.0)] * 3
    return df.withColumns({a: r[0] * p[0] + r[1] * p[1] + r[2] * p[2] + t for a, r, t in zip("xyz", rotation, shift, strict=True)})


def to_world(points: DataFrame, convention: str = "camera_to_world", axes: str = "arkit") -> DataFrame:
    """Points in camera axes (x right, y down, z forward) beside their pose (px, py, pz, qx, qy, qz, qw), to world.

    axes arkit: the pose is that of a camera whose y is up and z backward. world_to_camera: the pose is inverted.
    """
    if convention not in ("camera_to_world", "world_to_camera") or axes not in ("arkit", "opencv"):
        raise ValueError(f"convention {convention}, axes {axes}")
    p = points.withColumns({"y": -F.col("y"), "z": -F.col("z")}) if axes == "arkit" else points
    return transformed(p, quaternion_matrix(tuple(F.col(c) for c in Q)), [F.col("px"), F.col("py"), F.col("pz")], convention == "world_to_camera")


def relative_motion(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Metres and degrees between two poses, structs with px, py, pz, qx, qy, qz, qw."""
    part = lambda s: tuple(F.col(f"{s}.{c}") for c in Q)
    apart = F.sqrt(sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) ** 2 for c in ("px", "py", "pz")), F.lit(0.0)))
    return pairs.withColumns({"distance": apart, "angle": quaternion_angle(part(a), part(b))})


def basis(normal: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Two directions in the plane of a unit normal; the reference is x, or y where the normal is near x."""
    n = np.asarray(normal, float)
    u = np.cross(n, [0.0, 1.0, 0.0] if abs(n[0]) >= 0.9 else [1.0, 0.0, 0.0])
    u /= np.linalg.norm(u)
    return u, np.cross(n, u)


def to_local(points: DataFrame, origin: tuple[float, float, float], normal: tuple[float, float, float]) -> DataFrame:
    """U, v along the floor and h above it."""
    rel = [F.col(a) - float(o) for a, o in zip("xyz", origin, strict=True)]
    dot = lambda d: rel[0] * float(d[0]) + rel[1] * float(d[1]) + rel[2] * float(d[2])
    u, v = basis(normal)
    return points.withColumns({"u": dot(u), "v": dot(v), "h": dot(normal)})


def to_scene(points: DataFrame, origin: tuple[float, float, float], normal: tuple[float, float, float]) -> DataFrame:
    """The counterpart of to_local."""
    u, v = basis(normal)
    return points.withColumns({a: float(origin[k]) + F.col("u") * float(u[k]) + F.col("v") * float(v[k]) + F.col("h") * float(normal[k]) for k, a in enumerate("xyz")})


def pixel_lookup(points: DataFrame, other: DataFrame, frame: str, height: int, width: int) -> DataFrame:
    """Points in the camera axes of `frame` (with fx, fy, cx, cy), beside the raw value that this frame has there.

    The pixel is the nearest, halves to even; the join is an equi-join on frame and pixel, and other is (frame, v, u, raw).
    """
    at = lambda f, a, c: F.rint(F.col(f) * F.col(a) / F.col("z") + F.col(c)).cast("int")
    seen = points.where("z > 0").withColumns({"u": at("fx", "x", "cx"), "v": at("fy", "y", "cy")})
    seen = seen.where(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1))
    return seen.join(other.withColumnRenamed("frame", frame), [frame, "v", "u"])


def covariance(points: DataFrame, by: list[str]) -> DataFrame:
    """The six covariances (n - 1) and the mean of each group's points."""
    pairs = [(a, b) for k, a in enumerate("xyz") for b in "xyz"[k:]]
    return points.groupBy(*by).agg(*[F.covar_samp(a, b).alias(f"s_{a}{b}") for a, b in pairs], *[F.avg(a).alias(f"m_{a}") for a in "xyz"], F.count("*").alias("n"))


def fitted_plane(points: DataFrame) -> tuple[np.ndarray, float]:
    """Normal n and d of the total least squares plane n p + d = 0; ten sums reach the driver."""
    r = covariance(points, []).first()
    if r["n"] < 3:
        raise ValueError(f"a plane through {r['n']} points")
    m = np.array([[r["s_" + "".join(sorted(a + b))] for b in "xyz"] for a in "xyz"])
    normal = np.linalg.eigh(m)[1][:, 0]
    return normal, -float(normal @ [r[f"m_{a}"] for a in "xyz"])


def plane_distance(normal: np.ndarray, d: float) -> Column:
    """The signed distance of x, y, z."""
    return sum((F.col(a) * float(n) for a, n in zip("xyz", normal, strict=True)), F.lit(float(d)))


def ransac_plane(points: DataFrame, within: float, up: np.ndarray | None = None, most_degrees: float = 15.0, tries: int = 1500, seeds: int = 4096, least: int = 50, seed: int = 0, refits: int = 2) -> dict | None:
    """M1: the plane with the most points within a distance, refitted to them; none under `least` points.

    Planes are drawn from a sample of `seeds` points, those with the smallest hash, a documented bound. Every point of the
    table votes: counts are summed in each batch, so a task hands on `tries` numbers. Ties: the earlier draw.
    Null coordinates are left out.
    """
    clean = points.select(*[F.col(a).cast("double").alias(a) for a in "xyz"]).where("x is not null and y is not null and z is not null")
    few = np.array([tuple(r) for r in clean.orderBy(F.xxhash64(*"xyz", F.lit(seed)), *"xyz").limit(seeds).collect()])
    if len(few) < 3:
        return None
    rng = np.random.default_rng(seed)
    three = few[rng.integers(0, len(few), (tries, 3))]
    normals = np.cross(three[:, 1] - three[:, 0], three[:, 2] - three[:, 0])
    size = np.linalg.norm(normals, axis=1)
    ok = size > 1e-12
    normals, at = normals[ok] / size[ok, None], three[ok, 0]
    if up is not None:
        near = np.abs(normals @ up) >= math.cos(math.radians(most_degrees))
        normals, at = normals[near], at[near]
    if not len(normals):
        return None
    shift = -np.einsum("ij,ij->i", normals, at)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(normals), np.int64)
        for b in batches:
            p = np.column_stack([c.to_numpy() for c in b.columns])
            for k in range(0, len(p), 2048):
                total += (np.abs(p[k : k + 2048] @ normals.T + shift) <= within).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "n"])

    best = clean.mapInArrow(votes, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").first()
    if best["n"] < least:
        return None
    normal, d = normals[best["k"]], float(shift[best["k"]])
    for _ in range(refits):
        fit, e = fitted_plane(clean.where(F.abs(plane_distance(normal, d)) <= within))
        normal, d = (fit, e) if fit @ normal >= 0 else (-fit, -e)
    if up is not None and normal @ up < 0:
        normal, d = -normal, -d
    r = clean.where(F.abs(plane_distance(normal, d)) <= within).agg(F.count("*").alias("n"), F.stddev_pop(plane_distance(normal, d)).alias("s")).first()
    return {"normal": normal, "d": d, "support": r["n"], "residual_std": r["s"]}
