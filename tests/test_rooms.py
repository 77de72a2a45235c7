"""Fits of a whole capture: made rooms, and brute force where there is one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquarry.operators import grid, scene, walls


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cut")))
    return spark


def box(spark, tilt=0.0):
    """Cells of the walls of a 4 by 3 room, turned by tilt degrees, a slanted line, and a stray cell outside at either corner."""
    c, s = math.cos(math.radians(tilt)), math.sin(math.radians(tilt))
    xy = [(x, y) for x in np.arange(0, 4.001, 0.02) for y in (0.0, 3.0)] + [(x, y) for y in np.arange(0.02, 2.99, 0.02) for x in (0.0, 4.0)]
    xy += [(1.0 + k * 0.02, 1.2 + 0.004 * k) for k in range(60)] + [(-0.31, -0.31), (4.29, 3.33)]
    return spark.createDataFrame([("a", float(x * c - y * s), float(x * s + y * c)) for x, y in xy], "scene string, x double, y double")


@pytest.mark.parametrize("tilt", [0.0, 17.0])
def test_walls_along_the_axes(spark, tilt):
    axes = spark.createDataFrame([("a", math.radians(tilt))], "scene string, phi double")
    got = scene.axis_walls(box(spark, tilt), axes).collect()
    kept = sorted((r for r in got if r.reason is None), key=lambda r: r.wall)
    assert [r.wall for r in kept] == list(range(len(kept)))
    long = [r for r in kept if r.s_max - r.s_min > 2.5]
    assert sorted(round(r.s_max - r.s_min, 1) for r in long) == [3.0, 3.0, 4.0, 4.0]
    assert sorted(round(abs(r.d), 2) for r in long) == [0.0, 0.0, 3.0, 4.0]
    assert all(r.snapped_deg < 2 for r in long)
    assert all(r.wall is None for r in got if r.reason)


def test_no_cells_no_walls(spark):
    axes = spark.createDataFrame([("a", 0.0)], "scene string, phi double")
    assert scene.axis_walls(box(spark).where("x < -1"), axes).count() == 0


def test_a_room_from_its_cells(shared):
    inner = shared.createDataFrame([("a", 2.0, 0.02 * k) for k in range(10, 130)], "scene string, x double, y double")
    path = shared.createDataFrame([("a", k, 1.0 + 0.05 * k, 1.5) for k in range(41)], "scene string, t int, x double, y double")
    axes = shared.createDataFrame([("a", 0.0)], "scene string, phi double")
    got = scene.room_walls(box(shared).union(inner), axes, path, ["t"]).collect()
    assert sorted(round(r.s_max - r.s_min, 2) for r in got) == [3.0, 3.0, 4.0, 4.0]
    assert sorted(round(abs(r.d), 2) for r in got) == [0.0, 0.0, 3.0, 4.0]  # the inner wall at x = 2 is crossed, so it is gone


def room(spark):
    rows = [("a", 0, 0.0, 0.0, 4.0, 0.0), ("a", 1, 4.0, 0.0, 4.0, 3.0), ("a", 2, 4.0, 3.0, 0.0, 3.0), ("a", 3, 0.0, 3.0, 0.0, 0.0)]
    return walls.from_segments(spark.createDataFrame(rows, "scene string, wall int, ax double, ay double, bx double, by double"))


def test_door_window_and_unseen_gap(spark):
    xs = np.arange(0, 4, 0.01)
    gaps = [(0.5, 1.3), (1.8, 2.6), (3.0, 3.6)]
    solid = [x for x in xs if not any(a < x < b for a, b in gaps)]
    rows = [("a", float(x), 0.0, h) for x in solid for h in (0.3, 1.0, 1.2)]
    rows += [("a", float(x), 0.0, 0.3) for x in xs if 1.8 < x < 2.6]  # a window's sill
    rows += [("a", float(x), -1.0, 1.2) for x in xs if 0.5 < x < 1.3 or 1.8 < x < 2.6]  # seen through two of them
    p = spark.createDataFrame(rows, "scene string, x double, y double, h double")
    inside = spark.createDataFrame([("a", 2.0, 1.5)], "scene string, px double, py double")
    got = scene.openings(p, room(spark), inside, 2.4).orderBy("opening").collect()
    assert [(r.opening, r.wall, r.kind, r.observed) for r in got] == [(0, 0, "door", True), (1, 0, "window", True), (2, 0, "unknown", False)]
    assert [round(r.width, 1) for r in got] == [0.8, 0.8, 0.6]


def test_region_that_walls_enclose(shared):
    cams = shared.createDataFrame([(2.0, 1.5), (1.0, 1.0), (9.0, 9.0)], "x double, y double")
    got = scene.enclosed(room(shared), cams, 0.1)
    assert got["area"] == pytest.approx(12.0) and got["regions"] == 1 and got["cameras_inside"] == pytest.approx(2 / 3)
    assert scene.enclosed(room(shared).where("wall < 3"), None, 0.1) is None
    assert scene.enclosed(room(shared).where("wall < 2"), None, 0.1) is None


def test_footprint_and_reliability(shared):
    floor = [(float(x), float(y), 0.0) for x in np.arange(0.05, 4, 0.1) for y in np.arange(0.05, 3, 0.1)]
    p = shared.createDataFrame(floor, "x double, y double, h double")
    cams = shared.createDataFrame([(2.0, 1.5)], "x double, y double")
    got = scene.footprint(p, room(shared), cams, 0.1)
    assert got["reliable"] and got["area"] == pytest.approx(12.0) and got["coverage"] > 0.9
    few = scene.footprint(p.where("x < 1"), room(shared), cams, 0.1)
    assert few["reliable"] and few["warnings"] and few["coverage"] < 0.5
    away = scene.footprint(p.where("x < 1"), room(shared), shared.createDataFrame([(9.0, 9.0)], "x double, y double"), 0.1)
    assert not away["reliable"] and len(away["reasons"]) == 2
    loose = scene.footprint(p, room(shared).where("wall < 2"), cams, 0.1)
    assert not loose["reliable"] and loose["area"] == loose["evidence_area"] == pytest.approx(12.0, abs=0.1)


def test_levels():
    peaks = [(-0.5, 900.0, 5.0), (0.0, 800.0, 5.0), (2.0, 300.0, 3.0), (2.5, 500.0, 1.0), (2.7, 200.0, 2.5)]
    assert scene.levels(peaks, 1.2) == (-0.5, 2.0)
    assert scene.levels(peaks, None) == (-0.5, 2.7)
    assert scene.levels(peaks[:2], 1.2) == (-0.5, None)
    assert scene.levels(peaks, -0.4) == (None, None)


def test_floor_ceiling_and_up(spark):
    rng = np.random.default_rng(2)
    n = 1500
    flat = lambda z: np.column_stack([rng.uniform(0, 4, n), rng.uniform(0, 3, n), z + rng.normal(0, 0.002, n)])
    wall = np.column_stack([np.zeros(600), rng.uniform(0, 3, 600), rng.uniform(0, 2.5, 600)])
    p = spark.createDataFrame(np.vstack([flat(0.0), flat(2.5), wall]).tolist(), "x double, y double, z double")
    path = [(float(x), float(y), 1.4 + 0.01 * math.sin(5 * x), 0.7071068, 0.0, 0.0, 0.7071068) for x, y in rng.uniform(0.5, 2.5, (40, 2))]
    poses = spark.createDataFrame(path, "px double, py double, pz double, qx double, qy double, qz double, qw double")
    up = scene.path_up(poses)
    assert scene.camera_up(poses)[2] == pytest.approx(1.0, abs=1e-6) and up[2] > 0.99
    cams = poses.select(F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    got = scene.floor_ceiling(p, up, cams)
    assert got["height"] == pytest.approx(2.5, abs=0.01) and got["tilt"] < 1 and not got["warnings"]
    with pytest.raises(scene.UpError, match="no surface under") as e:
        scene.floor_ceiling(p, up, cams.withColumn("z", F.lit(-1.0)))
    assert e.value.evidence["peaks"]


def flooded(level, least):
    """Peaks by a plain flood: for each cell, the highest level from which a greater cell is reached."""
    cells = sorted(np.ndindex(level.shape), key=lambda c: (level[c], c), reverse=True)
    out = set()
    for k, c in enumerate(cells):
        greater = set(cells[:k])
        low = -np.inf
        for stop in sorted(set(level.ravel()), reverse=True):
            if stop > level[c]:
                continue
            seen, todo = {c}, [c]
            while todo:
                a = todo.pop()
                for d in grid.RING:
                    b = (a[0] + d[0], a[1] + d[1])
                    if b not in seen and 0 <= b[0] < level.shape[0] and 0 <= b[1] < level.shape[1] and level[b] >= stop:
                        seen.add(b)
                        todo.append(b)
            if seen & greater:
                low = stop
                break
        if low == -np.inf or level[c] - low >= least:
            out.add(c)
    return out


@pytest.mark.parametrize("least", [1.0, 3.0])
def test_basins_have_the_peaks_of_a_flood(shared, least):
    level = np.random.default_rng(5).integers(0, 9, (7, 8)).astype(float)
    df = shared.createDataFrame([(i, j, float(level[i, j])) for i, j in np.ndindex(level.shape)], "i long, j long, level double")
    got = grid.basins(df, least).collect()
    assert len(got) == level.size and {(r.pi, r.pj) for r in got} == flooded(level, least)
    assert all((r.pi, r.pj) == (r.i, r.j) for r in got if (r.i, r.j) in flooded(level, least))
    assert grid.basins(df.where("i < 0"), least).count() == 0


def test_outlines(shared):
    cells = [("a", i, j) for i in range(10) for j in range(6)] + [("b", i + 20, j) for i in range(8) for j in range(8) if i < 4 or j < 4] + [("c", 40, 1)]
    df = shared.createDataFrame(cells, "label string, i long, j long")
    got = {}
    for r in grid.outlines(df, 0.5).orderBy("label", "corner").collect():
        got.setdefault(r.label, []).append((r.i, r.j))
    assert set(got["a"]) == {(0, 0), (0, 5), (9, 5), (9, 0)} and got["c"] == [(40, 1)]
    assert {(20, 0), (20, 7), (23, 7), (27, 3), (27, 0)} <= set(got["b"]) and len(got["b"]) <= 7
    assert grid.centre_area(df.where("label = 'a'")) == 9 * 5
