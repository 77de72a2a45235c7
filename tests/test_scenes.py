"""Scene operators against hand values and brute force."""

import itertools
import json
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenquarry.functions import quaternion_matrix
from lumenquarry.operators import grid, measure, rays, series, timejoin, walls
from lumenquarry.plans import scene_queries
from lumenquarry.sources import reports


def room(spark, extra=()):
    """A 4 by 3 room whose walls end 0.2 short of the corners, and what extra adds."""
    rows = [("a", 0, 0.2, 0.0, 3.8, 0.0), ("a", 1, 4.0, 0.2, 4.0, 2.8), ("a", 2, 3.8, 3.0, 0.2, 3.0), ("a", 3, 0.0, 2.8, 0.0, 0.2), *extra]
    return walls.from_segments(spark.createDataFrame(rows, "scene string, wall int, ax double, ay double, bx double, by double"))


def sizes(df):
    return {r.wall: round(r.s_max - r.s_min, 6) for r in df.collect()}


def test_corners_snap_and_close(spark):
    assert sizes(walls.snap_corners(room(spark), 0.3)) == {0: 4.0, 1: 3.0, 2: 4.0, 3: 3.0}
    assert sizes(walls.snap_corners(room(spark), 0.1)) == {0: 3.6, 1: 2.6, 2: 3.6, 3: 2.6}
    closed = walls.close_corners(room(spark), 1.0)
    assert sizes(closed) == {0: 4.0, 1: 3.0, 2: 4.0, 3: 3.0}
    assert all(round(r.far_min, 6) == 0.2 for r in closed.collect())


def test_overshoot_is_cut_at_a_wall_that_reaches_inside(spark):
    long = room(spark, [("a", 4, 0.0, 1.5, 4.5, 1.5)])
    inside = spark.createDataFrame([("a", 2.0, 0.5)], "scene string, px double, py double")
    assert sizes(walls.trim_overshoot(long, inside))[4] == 4.0
    assert sizes(walls.trim_overshoot(long, inside, most=0.3))[4] == 4.5


def test_duplicates_and_weak_walls_go(spark):
    w = room(spark, [("a", 5, 0.5, 0.05, 3.5, 0.05), ("a", 6, 1.0, 1.0, 2.0, 1.0)]).withColumn("n_cells", F.when(F.col("wall") == 6, 5).when(F.col("wall") == 5, 60).otherwise(100))
    assert {r.wall: r.reason for r in walls.dedupe(w).collect() if r.reason} == {5: "duplicate_of_0", 6: "weak_vs_best"}


def test_walls_off_the_axes_are_not_regularized(spark):
    tilted = room(spark, [("a", 7, 1.0, 1.0, 2.0, 1.05), ("a", 8, 1.0, 2.0, 1.7, 2.7)])
    got = {r.wall: r for r in walls.manhattan(tilted).collect()}
    assert got[7].regularized and abs(got[7].ty) < 0.01 and not got[8].regularized


def test_inner_wall_is_crossed_and_hidden_walls_are_pruned(spark):
    w = room(spark, [("a", 9, 2.0, 0.0, 2.0, 3.0), ("a", 10, 9.0, 0.0, 9.0, 0.1)])
    path = spark.createDataFrame([("a", 0, 1.0, 1.0), ("a", 1, 3.0, 1.0)], "scene string, t int, x double, y double")
    cells = spark.createDataFrame([("a", 2.0, 0.9 + 0.02 * k) for k in range(10)], "scene string, x double, y double")
    assert [(r.wall, r.on_material, r.in_gaps) for r in walls.camera_crossed(w, path, cells, ["t"]).collect()] == [(9, 1, 0)]
    assert [(r.wall, r.on_material, r.in_gaps) for r in walls.camera_crossed(w, path, cells.where("y < 0.95"), ["t"]).collect()] == [(9, 0, 1)]
    eye = spark.createDataFrame([("a", 0, 1.0, 1.5)], "scene string, origin int, ox double, oy double")
    assert {r.wall for r in walls.prune_non_boundary(w, eye).collect()} == {0, 2, 3, 9}


@pytest.mark.parametrize("seed", range(6))
def test_matching_has_the_least_total(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 20, int(rng.integers(0, 5))).tolist(), rng.integers(0, 20, int(rng.integers(0, 6))).tolist()
    pairs = measure.best_pairs(a, b)
    assert len(pairs) == min(len(a), len(b)) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
    few, many = sorted((a, b), key=len)
    best = min((sum(abs(x - y) for x, y in zip(few, p, strict=True)) for p in itertools.permutations(many, len(few))), default=0)
    assert sum(abs(a[i] - b[j]) for i, j in pairs) == best


def test_unmatched_values_of_both_sides_are_told(spark):
    a = spark.createDataFrame([("s", 1, 10.0), ("t", 1, 1.0), ("t", 2, 5.0), ("u", 1, 3.0)], "scene string, k int, v double")
    b = spark.createDataFrame([("s", 1, 0.0), ("s", 2, 10.0), ("t", 9, 5.0), ("w", 1, 2.0)], "scene string, k int, v double")
    m = measure.assignment(a, b, "scene", "v", "k")
    got = {(r.scene, r.left_key, r.right_key) for r in m.collect()}
    assert got == {("s", 1, 2), ("s", None, 1), ("t", 2, 9), ("t", 1, None), ("u", 1, None), ("w", None, 1)}
    gates = {r.scene: (r.unmatched, r["pass"]) for r in measure.wall_gate(m, F.lit("lidar")).collect()}
    assert gates == {"s": (1, False), "t": (0, True), "w": (1, False)}
    assert {r.scene: (r.n_ok, r.extra, r["pass"]) for r in measure.opening_gate(m).collect()}["t"] == (1, 1, True)


def test_hull_against_brute_force(spark):
    rng = np.random.default_rng(4)
    p = rng.integers(0, 12, (40, 2)).astype(float)
    got = grid.hull(spark.createDataFrame([("g", float(x), float(y)) for x, y in p] + [("h", 1.0, 1.0)], "g string, x double, y double"), "g", "x", "y")
    got = {r.g: r.area for r in got.collect()}
    grid_points = {(x, y) for x, y in p}
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    edges = [(a, b) for a in grid_points for b in grid_points if a != b and all(side(a, b, c) >= 0 for c in grid_points)]
    far = [e for e in edges if not any(f[0] == e[0] and math.dist(*f) > math.dist(*e) for f in edges)]
    longest = [e for e in far if not any(f != e and f[1] == e[1] and math.dist(*f) > math.dist(*e) for f in edges)]
    assert got["g"] == pytest.approx(abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in longest)) / 2) and got["h"] == 0


def test_holes_fill_and_open_shapes_do_not(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    ring = [(i, j) for i in range(5) for j in range(5) if i in (0, 4) or j in (0, 4)]
    df = lambda cells: spark.createDataFrame(cells, "i long, j long")
    assert grid.fill_holes(df(ring)).count() == 25
    assert grid.fill_holes(df([c for c in ring if c != (2, 0)])).count() == 15


def test_keyframes_by_motion_and_thinning(spark):
    rows = [("a", k, 0.01 * k, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for k in range(40)] + [("b", k, 0.0, 0.0, 0.0, 0.0, 0.0, math.sin(math.radians(k / 2)), math.cos(math.radians(k / 2))) for k in range(12)]
    df = spark.createDataFrame(rows, "g string, t int, x double, y double, z double, qx double, qy double, qz double, qw double")
    run = lambda **k: {(r.g, r.t) for r in series.keyframes(df, ["g"], "t", ["x", "y", "z"], ["qx", "qy", "qz", "qw"], **k).collect()}
    assert run() == {("a", 0), ("a", 10), ("a", 20), ("a", 30), ("b", 0), ("b", 10)}
    assert run(most=2) == {("a", 0), ("a", 30), ("b", 0), ("b", 10)}
    assert run(least_rows=1) >= {("a", 0), ("a", 5), ("b", 3), ("b", 6)}


def test_gravity_mapping_is_found(spark):
    rng = np.random.default_rng(1)
    true = rays.axis_mappings()[13]
    rows = []
    for k in range(80):
        q = rng.normal(size=4)
        q /= np.linalg.norm(q)
        x, y, z, w = q
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        a = np.linalg.inv(np.array(true)) @ np.linalg.inv(r) @ np.array([0.0, 0.0, 9.8])
        rows.append(("s", *map(float, a), *map(float, q)))
    df = spark.createDataFrame(rows, "scene string, a double, b double, c double, x double, y double, z double, w double")
    got = rays.gravity_mapping(df, ["scene"], ["a", "b", "c"], quaternion_matrix(tuple(F.col(k) for k in "xyzw"))).first()
    assert len(rays.axis_mappings()) == 24 and got.mapping == 13 and got.reliable and got.uz == pytest.approx(1.0)


def test_best_ahead_with_limits(spark):
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate([0, 5, 9, 5, 30])], "g int, k long, v double")
    score = F.abs(F.col("b.v") - F.col("a.v"))
    got = {(r.k, r.other) for r in timejoin.best_ahead(df, ["g"], ["k"], 3, score, "k", fits=score <= 9).collect()}
    assert got == {(0, 2), (1, 2), (2, 3)}


def test_evenly_over_partitions(spark):
    df = spark.range(1000).repartition(7)
    assert sorted(r.id for r in series.evenly(df, ["id"], 5).collect()) == [0, 250, 500, 749, 999]
    assert series.evenly(df.where("id < 0"), ["id"], 5).count() == 0


def test_scene_files(spark, tmp_path):
    (tmp_path / "gt.yaml").write_text("ceiling_height_m: 2.6\nwall_lengths_m: [4.0, 3]\n")
    assert {tuple(r) for r in reports.ground_truth(spark, str(tmp_path / "gt.yaml")).collect()} == {("ceiling_height_m", 0, 2.6), ("wall_lengths_m", 0, 4.0), ("wall_lengths_m", 1, 3.0)}
    m = {"value": 1.0, "unit": "m", "status": "observed", "method": "x", "confidence_interval": {"lower": 2.0, "upper": 3.0}}
    path = reports.write_report({"rooms": [{"h": m, "_private": 1}], "n": np.int64(3)}, str(tmp_path / "scene.json"))
    assert "_private" not in json.loads(open(path).read())["rooms"][0]
    (row,) = measure.problems(reports.measurements_of(spark, path)).collect()
    assert (row.path, row.problem) == ("scene.rooms[0].h", "value outside its interval")
    table = spark.createDataFrame([("lidar", "wall_length", 0.5, 7)], "tier string, kind string, quantile double, n long")
    path = reports.write_report(reports.calibration_report(table), str(tmp_path / "c.json"))
    assert reports.calibration(spark, path).collect() == table.collect()
    svg = open(reports.plan_svg(room(spark), str(tmp_path / "p.svg"), unreliable=True)).read()
    assert svg.count("<line") == 4 and "3.60 m" in svg and "area unreliable" in svg
    cells = grid.cells(spark.range(9).select((F.col("id") / 3).alias("x"), F.col("id").cast("double").alias("y")), "x", "y", 1.0)
    assert open(reports.cells_svg(cells, str(tmp_path / "q.svg"), 1.0)).read().count("<circle") == 9


def test_a_file_that_cannot_be_written_gets_a_sibling(tmp_path):
    (tmp_path / "r.json").mkdir()
    with pytest.warns(UserWarning, match="can't be written"):
        assert reports.write_report({}, str(tmp_path / "r.json")).startswith(str(tmp_path / "r_"))


def by_table(left, right):
    """The table of all prefixes: what best_pairs did before, with the same choice among equals."""
    if len(left) > len(right):
        return [(a, b) for b, a in by_table(right, left)]
    i_of, j_of = sorted(range(len(left)), key=left.__getitem__), sorted(range(len(right)), key=right.__getitem__)
    n, m = len(left), len(right)
    cost = [[0.0] * (m + 1)] + [[float("inf")] * (m + 1) for _ in range(n)]
    for i in range(1, n + 1):
        for j in range(i, m + 1):
            cost[i][j] = min(cost[i][j - 1], cost[i - 1][j - 1] + abs(left[i_of[i - 1]] - right[j_of[j - 1]]))
    out, i, j = [], n, m
    while i:
        if j > i and cost[i][j] == cost[i][j - 1]:
            j -= 1
        else:
            out.append((i_of[i - 1], j_of[j - 1]))
            i, j = i - 1, j - 1
    return out[::-1]


def test_best_pairs_as_by_the_table_of_all_prefixes():
    rng = random.Random(3)
    for k in range(3000):
        most = rng.choice([3, 10, 1000])
        left, right = ([float(rng.randint(-most, most)) for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert sorted(measure.best_pairs(left, right)) == sorted(by_table(left, right)), (k, left, right)


def test_best_pairs_hold_no_table():
    rng = random.Random(4)
    left, right = [rng.random() for _ in range(1500)], [rng.random() for _ in range(3000)]
    tracemalloc.start()
    assert len(measure.best_pairs(left, right)) == 1500
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6  # the table has 4.5 million cells


def test_null_values_match_nothing(spark):
    left = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("b", 3, 5.0)], "scene string, k long, v double")
    right = spark.createDataFrame([("a", 7, 2.0), ("a", 8, 9.0), ("c", 9, None)], "scene string, k long, v double")
    got = sorted(map(tuple, measure.assignment(left, right, "scene", "v", "k").collect()), key=repr)
    assert got == sorted([("a", 1, 7, 1.0, 2.0), ("a", 2, None, None, None), ("a", None, 8, None, 9.0), ("b", 3, None, 5.0, None), ("c", None, 9, None, None)], key=repr)


def test_crossings_in_blocks_as_by_pairs(spark):
    rng = random.Random(5)
    at = [(round(rng.random(), 2), round(rng.random(), 2)) for _ in range(60)]
    p = spark.createDataFrame([(s, k, *xy) for s in ("a", "b") for k, xy in enumerate(at[: 60 if s == "a" else 30])], "scene string, k long, x double, y double")
    lead = Window.partitionBy("scene").orderBy("k")
    w = walls.from_segments(p.select("scene", F.col("k").alias("wall"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(lead).alias("bx"), F.lead("y").over(lead).alias("by")))
    got = {(r.scene, r.wall): (r.on_material, r.in_gaps) for r in walls.camera_crossed(w, p, p, ["k"], 0.2, 0.1, 3, block=7).collect()}
    true = {}
    for r in w.collect():
        n = at[: 60 if r.scene == "a" else 30]
        for (ax, ay), (qx, qy) in zip(n, n[1:], strict=False):
            dx, dy, size = qx - ax, qy - ay, r.s_max - r.s_min
            wx, wy, ex, ey = r.cx + r.s_min * r.tx - ax, r.cy + r.s_min * r.ty - ay, size * r.tx, size * r.ty
            det = dx * ey - dy * ex
            if abs(det) > 1e-12 and 0 <= (t := (wx * ey - wy * ex) / det) <= 1 and 0 <= (wx * dy - wy * dx) / det <= 1:
                px, py = ax + t * dx, ay + t * dy
                k = sum(abs(x * r.nx + y * r.ny + r.d) < 0.1 and math.sqrt((x - px) * (x - px) + (y - py) * (y - py)) < 0.2 for x, y in n)
                on, gaps = true.get((r.scene, r.wall), (0, 0))
                true[r.scene, r.wall] = (on + (k >= 3), gaps + (k < 3))
    assert got == true and any(x[0] and x[1] for x in true.values())


def test_gap_edges_without_pairs(spark):
    rng = random.Random(6)
    of = {g: [rng.randint(0, 300) for _ in range(n)] for g, n in (("a", 200), ("b", 3), ("c", 0))}
    gaps = [(g, lo, lo + rng.randint(0, 40)) for g in of for lo in rng.sample(range(-10, 310), 60)] + [(None, 1, 2), ("a", None, 5), ("a", 5, None)]
    samples = spark.createDataFrame([(g, v) for g, x in of.items() for v in x] + [("a", None), (None, 3)], "g string, v long")
    out = walls.gap_edges(spark.createDataFrame(gaps, "g string, lo long, hi long"), samples, ["g"], "lo", "hi", "v", parts=8)
    assert out.columns == ["g", "lo", "hi", "left", "right"]
    true = {(g, lo, hi, max((v for v in of.get(g, []) if lo is not None and v < lo), default=None), min((v for v in of.get(g, []) if hi is not None and v > hi), default=None)) for g, lo, hi in gaps}
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == true
    assert "Window" in out._jdf.queryExecution().toString()  # each gap met each sample of its group before


def test_both_gates_in_one_pass(spark, sf_dir):
    """Before, the query made its matching once for each gate."""
    rows = [("a", 1.0, 1.05), ("a", 2.0, 2.0), ("a", None, 3.0), ("a", 9.0, None), ("b", 5.0, 5.01), ("c", 4.0, None), ("d", None, 2.0)]
    m = spark.createDataFrame(rows, "scene string, left_value double, right_value double")
    got = {r.scene: r for r in measure.gates(m, F.lit("photo")).collect()}
    walls_of = {r.scene: r for r in measure.wall_gate(m, F.lit("photo")).collect()}
    openings_of = {r.scene: r for r in measure.opening_gate(m).collect()}
    assert got.keys() == openings_of.keys() and walls_of.keys() == {s for s, r in got.items() if r.n_true}
    assert all((got[s].worst, got[s].unmatched, got[s].bound, got[s].walls_pass) == tuple(r)[1:] for s, r in walls_of.items())
    assert all((got[s].n_true, got[s].n_ok, got[s].extra, got[s].openings_pass) == tuple(r)[1:] for s, r in openings_of.items())
    assert [(got[s].walls_pass, got[s].openings_pass) for s in "abcd"] == [(False, False), (True, True), (False, None), (False, False)]
    out = scene_queries.scene_gates(spark, sf_dir)
    assert out.columns == ["scene", "gate", "actual", "pass"] and out.count() == 10
    assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroups") == 1
