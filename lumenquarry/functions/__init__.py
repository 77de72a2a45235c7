"""Column functions: exact rounding, angles, quaternions, grid cells. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def cell(x: Column, size: float, origin: Column | float = 0.0) -> Column:
    """The number of the grid cell of a coordinate."""
    return F.floor((x - origin) / size).cast("long")


def finite(x: Column) -> Column:
    """C4: neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def bearing_bin(y: Column, x: Column, bins: int) -> Column:
    """The bin of a direction on the circle, 0 at -180 degrees, without an open end."""
    return F.pmod(F.floor((F.atan2(y, x) + F.lit(3.141592653589793)) / F.lit(6.283185307179586) * bins), F.lit(bins)).cast("long")


def quaternion_matrix(q: tuple[Column, Column, Column, Column]) -> list[list[Column]]:
    """C17: the rotation of a unit quaternion (x, y, z, w)."""
    x, y, z, w = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def quaternion_angle(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """C20: degrees between two unit quaternions, whichever of their two signs they have."""
    dot = F.abs(a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3])
    return F.degrees(2 * F.acos(F.least(dot, F.lit(1.0))))


def interval_half_width(value: Column, sigma: Column, absolute: float, relative: float, z: float, is_area: Column, support: Column, least_support: int = 200) -> Column:
    """Absolute + relative * |value| (twice for areas) + z * sigma, doubled where support is low."""
    base = absolute + F.when(is_area, 2 * relative).otherwise(relative) * F.abs(value) + z * sigma
    return F.when(support < least_support, base * 2).otherwise(base)


def det2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The determinant of the rows (a, b), (c, d)."""
    return a * d - b * c


def solve2(a: Column, b: Column, c: Column, d: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """x and y of a x + b y = u, c x + d y = v; null where the determinant is 0 (under 1e-12)."""
    det = det2(a, b, c, d)
    return F.when(F.abs(det) > 1e-12, det2(u, b, v, d) / det), F.when(F.abs(det) > 1e-12, det2(a, u, c, v) / det)
