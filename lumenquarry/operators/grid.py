"""Grid operators (A1 to A4, A18, A19, C24, G1 to G11, J13, J17, J18): cells are rows, neighbourhoods are equi-joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cell


def voxel_mean(points: DataFrame, axes: list[str], size: float, from_least: bool = False) -> DataFrame:
    """A1: mean and count of the points of each cell; with from_least cells start at the least coordinates."""
    if from_least:
        lo = points.agg(*[F.min(a).alias(f"_lo_{a}") for a in axes])
        points = points.join(F.broadcast(lo))
    ids = [cell(F.col(a), size, F.col(f"_lo_{a}") if from_least else 0.0).alias(f"i_{a}") for a in axes]
    return points.groupBy(*ids).agg(*[F.avg(a).alias(a) for a in axes], F.count("*").alias("n"))


def cells(points: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """The occupied cells (i, j)."""
    return points.select(cell(F.col(x), size).alias("i"), cell(F.col(y), size).alias("j")).distinct()


def tall_columns(df: DataFrame, by: list[str], height: str, least_range: float, least_count: int) -> DataFrame:
    """Rows of the groups whose range and count reach the least values."""
    tall = df.groupBy(*by).agg(F.max(height).alias("_hi"), F.min(height).alias("_lo"), F.count("*").alias("_n")).where((F.col("_hi") - F.col("_lo") >= least_range) & (F.col("_n") >= least_count))
    return df.join(tall.select(*by), by, "left_semi")


def offsets(shape: str, reach: int) -> list[tuple[int, int]]:
    """Structuring elements: a square or a disc of the given reach."""
    span = range(-reach, reach + 1)
    return [(a, b) for a in span for b in span if shape == "square" or a * a + b * b <= reach * reach]


def moved(grid: DataFrame, by: list[tuple[int, int]]) -> DataFrame:
    """Each cell at all offsets, unfolded in the row."""
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in by])
    return grid.select("i", "j", F.explode(steps).alias("s")).select((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"))


def dilate(grid: DataFrame, shape: str = "square", reach: int = 1) -> DataFrame:
    """All cells that the element covers."""
    return moved(grid, offsets(shape, reach)).distinct()


def erode(grid: DataFrame, shape: str = "square", reach: int = 1) -> DataFrame:
    """Cells around which the element lies inside; counted, so one pre-aggregated shuffle."""
    by = offsets(shape, reach)
    return moved(grid, by).groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") == len(by)).select("i", "j")


def close(grid: DataFrame, shape: str = "square", reach: int = 1) -> DataFrame:
    """Dilate, then erode."""
    return erode(dilate(grid, shape, reach), shape, reach)


def adjacency(labelled: DataFrame) -> DataFrame:
    """Pairs of different labels of cells side by side, and how often they meet."""
    here = labelled.select("i", "j", F.col("label").alias("l1"))
    steps = [(1, 0), (0, 1)]
    there = moved_labels(labelled, [(-a, -b) for a, b in steps])
    met = here.join(there, ["i", "j"]).where("l1 <> l2")
    return met.groupBy(F.least("l1", "l2").alias("a"), F.greatest("l1", "l2").alias("b")).agg(F.count("*").alias("contact"))


def moved_labels(labelled: DataFrame, by: list[tuple[int, int]]) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in by])
    return labelled.select("i", "j", F.col("label").alias("l2"), F.explode(steps).alias("s")).select((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), "l2")


def components(grid: DataFrame, eight: bool = True) -> DataFrame:
    """Cells with the component's least cell (ci, cj).

    Labels fall to the least of the neighbourhood, then jump to the label of that cell, so rounds grow with the logarithm
    of a component's length. Lineage is cut at a checkpoint in each round.
    """
    around = [(a, b) for a, b in offsets("square", 1) if (a, b) != (0, 0) and (eight or a * b == 0)]
    state = grid.select("i", "j", F.struct(F.col("i").alias("ci"), F.col("j").alias("cj")).alias("c")).checkpoint()
    while True:
        steps = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in [*around, (0, 0)]])
        told = state.select("c", F.explode(steps).alias("s"), "i", "j").select((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), "c")
        low = told.groupBy("i", "j").agg(F.min("c").alias("m")).join(state, ["i", "j"])
        target = state.select(F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("c").alias("t"))
        jumped = low.join(target, (F.col("m.ci") == F.col("ti")) & (F.col("m.cj") == F.col("tj")))
        new = jumped.select("i", "j", F.least("m", "t").alias("c"), F.col("c").alias("was")).checkpoint()
        state = new.drop("was")
        if new.where("c <> was").isEmpty():
            return state.select("i", "j", "c.ci", "c.cj")


def cloud_statistics(points: DataFrame, by: list[str], axes: list[str], size: float) -> DataFrame:
    """A2, A3: per group the points, the occupied cells and the bounds of each axis; cells are distinct before they meet."""
    ids = [cell(F.col(a), size).alias(f"i_{a}") for a in axes]
    ends = [f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]
    each = points.groupBy(*by, *ids).agg(F.count("*").alias("_n"), *ends)
    whole = [f(f"{n}_{a}").alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]
    return each.groupBy(*by).agg(F.sum("_n").alias("raw"), F.count("*").alias("cells"), *whole)


def voted(cells_of: DataFrame, voter: str, least: int = 2) -> DataFrame:
    """Cells (i, j) that at least `least` voters cover."""
    return cells_of.select("i", "j", voter).distinct().groupBy("i", "j").agg(F.count("*").alias("votes")).where(F.col("votes") >= least)


def regions(labelled: DataFrame, size: float) -> DataFrame:
    """Area and centre of each label's cells."""
    return labelled.groupBy("label").agg((F.count("*") * size * size).alias("area"), (F.avg(F.col("i") + 0.5) * size).alias("x"), (F.avg(F.col("j") + 0.5) * size).alias("y"))


def segment_cells(segments: DataFrame) -> DataFrame:
    """The 8-connected cells of segments (i, j) to (i2, j2): a cell for each step of the longer axis, rounded half to even."""
    steps = F.greatest(F.abs(F.col("i2") - F.col("i")), F.abs(F.col("j2") - F.col("j")))
    s = segments.withColumn("_n", steps).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long"))))
    at = lambda a, b: F.rint(F.col(a) + F.when(F.col("_n") > 0, F.col("_k") * (F.col(b) - F.col(a)) / F.col("_n")).otherwise(0.0)).cast("long")
    return s.select(at("i", "i2").alias("i"), at("j", "j2").alias("j")).distinct()


def polygon_cells(corners: DataFrame, by: str, order: str, size: float) -> DataFrame:
    """The cells whose centres lie inside each polygon (even-odd), corners x, y in their order. A row of cells gets the
    places where edges cross it, in order; every second stretch between them is inside."""
    w = Window.partitionBy(by)
    e = corners.withColumns({"x2": F.coalesce(F.lead("x").over(w.orderBy(order)), F.first("x").over(w.orderBy(order))), "y2": F.coalesce(F.lead("y").over(w.orderBy(order)), F.first("y").over(w.orderBy(order)))}).where("y <> y2")
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    # centres (j + 0.5) * size with low <= centre < high
    first, last = F.ceil(low / size - 0.5).cast("long"), F.ceil(high / size - 0.5).cast("long") - 1
    rows = e.where(first <= last).withColumn("j", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("at", F.col("x") + ((F.col("j") + 0.5) * size - F.col("y")) / (F.col("y2") - F.col("y")) * (F.col("x2") - F.col("x")))
    each = rows.groupBy(by, "j").agg(F.array_sort(F.collect_list("at")).alias("at"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("at") / 2).cast("int") - 1), lambda k: F.struct(F.ceil(F.get("at", 2 * k) / size - 0.5).cast("long").alias("a"), (F.ceil(F.get("at", 2 * k + 1) / size - 0.5).cast("long") - 1).alias("b")))
    stretches = each.select(by, "j", F.explode(F.filter(pairs, lambda p: p["a"] <= p["b"])).alias("p"))
    return stretches.select(by, F.explode(F.sequence(F.col("p.a"), F.col("p.b"))).alias("i"), "j")


def fill_holes(grid: DataFrame) -> DataFrame:
    """Grid with the cells that it encloses: parts of its complement, joined at the sides, that don't reach the frame of
    one cell around its box."""
    box = grid.agg(F.min("i").alias("a"), F.max("i").alias("b"), F.min("j").alias("c"), F.max("j").alias("d")).where("a is not null")
    every = box.select("*", F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1)).alias("i")).select("*", F.explode(F.sequence(F.col("c") - 1, F.col("d") + 1)).alias("j"))
    outside = every.join(grid.select("i", "j").distinct(), ["i", "j"], "left_anti")
    parts = components(outside.select("i", "j"), eight=False)
    corner = box.select((F.col("a") - 1).alias("ci"), (F.col("c") - 1).alias("cj"))  # the frame's least cell names its part
    holes = parts.join(F.broadcast(corner), ["ci", "cj"], "left_anti").select("i", "j")
    return grid.select("i", "j").unionByName(holes).distinct()


def hull(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Corners and area of each group's convex hull. Of the points of one x only the least and the largest y can be
    corners, so what meets in a task is bounded by the distinct x."""
    ends = points.groupBy(by, F.col(x).cast("double").alias("x")).agg(F.min(F.col(y).cast("double")).alias("lo"), F.max(F.col(y).cast("double")).alias("hi"))

    def rule(rows: pd.DataFrame) -> pd.DataFrame:
        p = sorted({(r.x, v) for r in rows.itertuples() for v in (r.lo, r.hi)})
        chains = []
        for part in (p, p[::-1]):
            chain: list[tuple[float, float]] = []
            for q in part:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]):
                    chain.pop()
                chain.append(q)
            chains += chain[:-1]
        c = np.array(chains or p[:1])
        area = abs(float(c[:, 0] @ np.roll(c[:, 1], -1) - c[:, 1] @ np.roll(c[:, 0], -1))) / 2
        return pd.DataFrame({by: [rows[by].iloc[0]], "corners": [len(c)], "area": [area]})

    return ends.groupBy(by).applyInPandas(rule, f"{by} {dict(points.dtypes)[by]}, corners int, area double")


def within(grid: DataFrame, reach: int, *columns: str) -> DataFrame:
    """All cells up to `reach` away (d2, the squared distance in cells) from each cell, unfolded in the row."""
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(a * a + b * b).alias("d2")) for a, b in offsets("disc", reach)])
    s = grid.select("i", "j", *columns, F.explode(steps).alias("s"))
    return s.select((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), F.col("s.d2").alias("d2"), *columns)


def fill_labels(free: DataFrame, labelled: DataFrame, reach: int) -> DataFrame:
    """Each free cell without a label gets that of the nearest labelled cell within reach (the least label on ties);
    pre-aggregated minima, no cell meets all others."""
    near = within(labelled, reach, "label").groupBy("i", "j").agg(F.min(F.struct("d2", "label")).alias("x"))
    wanted = free.select("i", "j").join(labelled.select("i", "j"), ["i", "j"], "left_anti")
    return wanted.join(near, ["i", "j"]).select("i", "j", F.col("x.label").alias("label"))


def clearance(free: DataFrame, obstacles: DataFrame, reach: int) -> DataFrame:
    """The exact distance, in cells, of each free cell to the nearest obstacle, `reach` where none is that near."""
    near = within(obstacles.select("i", "j").distinct(), reach).groupBy("i", "j").agg(F.min("d2").alias("d2"))
    return free.select("i", "j").join(near, ["i", "j"], "left").select("i", "j", F.least(F.coalesce(F.sqrt("d2"), F.lit(float(reach))), F.lit(float(reach))).alias("distance"))


def edge(region: DataFrame) -> DataFrame:
    """The cells of a region that have a side on the outside."""
    return region.select("i", "j").join(erode(region, "disc", 1), ["i", "j"], "left_anti")


def centre_area(region: DataFrame) -> float:
    """The area, in cells, inside the line through the centres of a filled region's outer cells: a polygon on lattice
    points, so n - edge / 2 - 1 (Pick). Counts only; exact where the region is nowhere thinner than 2 cells."""
    return max(region.count() - edge(region).count() / 2 - 1, 0.0)


RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def trace(cells: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The outer edge cells of the piece that holds the least cell, in order: around each cell the next one after the
    outside, until the first step comes again."""
    at = start = min(cells)
    out, back, first = [start], 0, None
    while True:
        turns = [(back + k) % 8 for k in range(1, 9)]
        d = next((d for d in turns if (at[0] + RING[d][0], at[1] + RING[d][1]) in cells), None)
        if d is None:
            return out
        if (at, d) == first:
            return out[:-1]
        first = first or (at, d)
        before = RING[d - 1]
        at = (at[0] + RING[d][0], at[1] + RING[d][1])
        back = RING.index((before[0] - RING[d][0], before[1] - RING[d][1]))
        out.append(at)


def simplified(line: np.ndarray, most: float) -> np.ndarray:
    """The corners of a closed line: split at the two places far from one another, then wherever a place is further than
    `most` from the chord (Douglas-Peucker)."""
    if len(line) < 4:
        return line
    half = int(np.argmax(((line - line[0]) ** 2).sum(axis=1)))
    keep, ring = {0, half}, np.vstack([line, line[:1]])
    todo = [(0, half), (half, len(line))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q = ring[a], ring[b]
        rel, chord = ring[a + 1 : b] - p, q - p
        size = float(np.hypot(*chord))
        far = np.abs(rel[:, 0] * chord[1] - rel[:, 1] * chord[0]) / size if size else np.hypot(rel[:, 0], rel[:, 1])
        k = int(np.argmax(far))
        if far[k] > most:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[sorted(k % len(line) for k in keep)]


def outlines(labelled: DataFrame, most: float) -> DataFrame:
    """The corners (label, corner, i, j) of each label's outer edge, simplified by `most` cells. Only edge cells are
    shuffled; the walk along one region's edge is one task."""
    own = moved_labels(labelled, offsets("disc", 1)).groupBy("i", "j", F.col("l2").alias("label")).agg(F.count("*").alias("_n")).where("_n = 5").drop("_n")
    rim = labelled.select("i", "j", "label").join(own, ["i", "j", "label"], "left_anti")

    def rule(rows: pd.DataFrame) -> pd.DataFrame:
        line = simplified(np.array(trace(set(zip(rows["i"].tolist(), rows["j"].tolist(), strict=True)))), most)
        return pd.DataFrame({"label": rows["label"].iloc[0], "corner": np.arange(len(line)), "i": line[:, 0], "j": line[:, 1]})

    return rim.groupBy("label").applyInPandas(rule, f"label {dict(labelled.dtypes)['label']}, corner long, i long, j long")


def merged_basins(tops: dict, saddles: list[tuple], least: float) -> dict:
    """Which basin each basin belongs to, of tops (basin: height) and saddles (height, basin, basin). From the highest
    saddle down two parts meet; the lower part's top stays a peak where it is `least` above the saddle, else its basin joins
    the one it meets there."""
    part, room = {b: b for b in tops}, {b: b for b in tops}

    def root(of: dict, b):
        while of[b] != b:
            of[b] = of[of[b]]
            b = of[b]
        return b

    for height, a, b in sorted(saddles, key=lambda s: (-s[0], s[1], s[2])):
        pa, pb = root(part, a), root(part, b)
        if pa == pb:
            continue
        low, high, beside = (pa, pb, b) if (tops[pa], pa) < (tops[pb], pb) else (pb, pa, a)
        if tops[low] - height < least:
            room[root(room, low)] = root(room, beside)
        part[low] = high
    return {b: root(room, b) for b in tops}


def basins(depth: DataFrame, least: float) -> DataFrame:
    """Cells (i, j, level) with the peak (pi, pj) of their basin; peaks are those that stand `least` above the
    saddle to a higher one, or are their component's highest (8 neighbours).

    A cell points to the highest of its neighbourhood (ties: the greatest cell); pointers double until they rest, with a
    checkpoint each round. Only the basins' tops and saddles meet in one task. Cells go by steepest ascent, not in the order
    of a flood, so cells between two rooms may fall to the other side; the peaks are the same.
    """
    here = depth.select("i", "j", "level").where("level is not null")
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in offsets("square", 1)])
    told = here.select(F.explode(steps).alias("s"), F.struct("level", "i", "j").alias("t")).select((F.col("t.i") + F.col("s.a")).alias("i"), (F.col("t.j") + F.col("s.b")).alias("j"), "t")
    best = told.groupBy("i", "j").agg(F.max("t").alias("t"))
    state = here.join(best, ["i", "j"]).select("i", "j", "level", F.col("t.i").alias("pi"), F.col("t.j").alias("pj")).checkpoint()
    while True:
        next_ = state.select(F.col("i").alias("pi"), F.col("j").alias("pj"), F.col("pi").alias("ni"), F.col("pj").alias("nj"))
        new = state.join(next_, ["pi", "pj"]).select("i", "j", "level", F.col("ni").alias("pi"), F.col("nj").alias("pj"), ((F.col("ni") != F.col("pi")) | (F.col("nj") != F.col("pj"))).alias("_moved")).checkpoint()
        state = new.drop("_moved")
        if new.where("_moved").isEmpty():
            break
    half = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    beside = state.select(F.explode(half).alias("s"), "i", "j", F.col("level").alias("l2"), F.col("pi").alias("qi"), F.col("pj").alias("qj")).select((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), "l2", "qi", "qj")
    met = state.join(beside, ["i", "j"]).where("pi <> qi or pj <> qj")
    a, b = F.struct("pi", "pj"), F.struct(F.col("qi").alias("pi"), F.col("qj").alias("pj"))
    saddles = met.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(F.least("level", "l2")).alias("level"))
    tops = state.where("i = pi and j = pj").select("pi", "pj", F.lit(None).cast("long").alias("qi"), F.lit(None).cast("long").alias("qj"), F.col("level").cast("double").alias("level"))
    rows = tops.unionByName(saddles.select("a.pi", "a.pj", F.col("b.pi").alias("qi"), F.col("b.pj").alias("qj"), F.col("level").cast("double").alias("level")))

    def rule(rows: pd.DataFrame) -> pd.DataFrame:
        top = rows["qi"].isna()
        high = {(r.pi, r.pj): r.level for r in rows[top].itertuples()}
        of = merged_basins(high, [(r.level, (r.pi, r.pj), (int(r.qi), int(r.qj))) for r in rows[~top].itertuples()], least)
        return pd.DataFrame([(*b, *r) for b, r in of.items()], columns=["pi", "pj", "ri", "rj"])

    rooms = rows.groupBy().applyInPandas(rule, "pi long, pj long, ri long, rj long")
    return state.join(rooms, ["pi", "pj"]).select("i", "j", F.col("ri").alias("pi"), F.col("rj").alias("pj"))
