"""Queries of the scene operators (walls, measurements, rasters, ordered series) over the driver's tables, with their SQL.

Points of the table embeddings are a scene for each label; steps between them, in the order of vec_id, are its walls.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grid, measure, rays, scene, series, walls
from .table_queries import CELLS, HIST, HOUR, E, P, events, points, query, table

G = f"{P}, g as (select label scene, vec_id wall, x ax, y ay, lead(x) over v bx, lead(y) over v by_ from p window v as (partition by label order by vec_id))"
W = f"""{G}, l as (select *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) len from g where bx is not null),
w as (select scene, wall, (bx - ax) / len tx, (by_ - ay) / len ty, -(by_ - ay) / len nx, (bx - ax) / len ny, (ax + bx) / 2 cx, (ay + by_) / 2 cy, -len / 2 s_min, len / 2 s_max,
    -(-(by_ - ay) / len * (ax + bx) / 2 + (bx - ax) / len * (ay + by_) / 2) d from l where len > 0)"""
M = f"""{W}, j as (select a.*, b.wall other, b.tx otx, b.ty oty, b.nx onx, b.ny ony, b.d od, b.cx ocx, b.cy ocy, b.s_min o0, b.s_max o1, a.nx * b.ny - a.ny * b.nx det
    from w a join w b on a.scene = b.scene and a.wall <> b.wall and abs(a.tx * b.tx + a.ty * b.ty) <= 0.5),
k as (select *, (od * ny - d * ony) / det x, (onx * d - nx * od) / det y from j),
m as (select *, (x - cx) * tx + (y - cy) * ty sx, (x - ocx) * otx + (y - ocy) * oty so from k)"""


def scene_walls(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    p = points(spark, d)
    return walls.from_segments(p.select(F.col("label").alias("scene"), F.col("vec_id").alias("wall"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")))


def scene_points(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select(F.col("label").alias("scene"), "vec_id", "x", "y")


def ends(w: DataFrame) -> DataFrame:
    return w.select("scene", "wall", *[F.round(c, 6).alias(c) for c in ("s_min", "s_max", "far_min", "far_max")])


def moved_sql(low: str, high: str) -> str:
    """Ends moved to the nearest of what fits; low and high: (condition, distance)."""
    part = lambda name, c: f"{name} as (select scene, wall, sx s, far from (select scene, wall, sx, {c[1]} far, row_number() over (partition by scene, wall order by {c[1]}, other) r from mm where {c[0]}) where r = 1)"
    return f"""{part("lo", low)}, {part("hi", high)}
select w.scene, w.wall, round(coalesce(lo.s, w.s_min), 6) s_min, round(coalesce(hi.s, w.s_max), 6) s_max, round(coalesce(lo.far, 0.0), 6) far_min, round(coalesce(hi.far, 0.0), 6) far_max
from w left join lo on lo.scene = w.scene and lo.wall = w.wall left join hi on hi.scene = w.scene and hi.wall = w.wall"""


@query(f"with {M}, mm as (select * from m), " + moved_sql(("abs(sx - s_min) <= 0.05", "abs(sx - s_min)"), ("abs(sx - s_max) <= 0.05", "abs(sx - s_max)")))
def corner_snap(spark: SparkSession, d: str) -> DataFrame:
    """J8, M13"""
    return ends(walls.snap_corners(scene_walls(spark, d), 0.05))


@query(f"with {M}, mm as (select * from m where so between o0 - 0.1 and o1 + 0.1), " + moved_sql(("s_min - sx > 1e-6 and s_min - sx <= 0.1", "s_min - sx"), ("sx - s_max > 1e-6 and sx - s_max <= 0.1", "sx - s_max")))
def corner_close(spark: SparkSession, d: str) -> DataFrame:
    """J8, M13"""
    return ends(walls.close_corners(scene_walls(spark, d), 0.1))


@query(
    f"""with {M}, inside as (select label scene, avg(x) px, avg(y) py from p group by 1),
e as (select m.*, case when nx * px + ny * py + d < 0 then -1 else 1 end side, nx * (ocx + o0 * otx) + ny * (ocy + o0 * oty) + d e0, nx * (ocx + o1 * otx) + ny * (ocy + o1 * oty) + d e1 from m join inside using (scene)),
mm as (select * from e where so between o0 - 0.02 and o1 + 0.02 and greatest(side * e0, side * e1) >= 0.02), """
    + moved_sql(
        ("sx - s_min between 0.01 and 0.2 and s_max - sx >= greatest(sx - s_min, 0.05)", "sx - s_min"),
        ("s_max - sx between 0.01 and 0.2 and sx - s_min >= greatest(s_max - sx, 0.05)", "s_max - sx"),
    )
)
def overshoot_trim(spark: SparkSession, d: str) -> DataFrame:
    """J8, M13"""
    inside = scene_points(spark, d).groupBy("scene").agg(F.avg("x").alias("px"), F.avg("y").alias("py"))
    return ends(walls.trim_overshoot(scene_walls(spark, d), inside, 0.01, 0.2, 0.02, 0.02, 0.05))


@query(
    f"""with {W}, t as (select *, atan2(ty, tx) a, ((atan2(ty, tx) % pi()) + pi()) % pi() b from w),
f as (select scene, atan2(sum((s_max - s_min) * sin(4 * a)), sum((s_max - s_min) * cos(4 * a))) / 4 phi from t group by 1),
v as (select t.*, phi, phi + round_even((b - phi) / (pi() / 2), 0) * (pi() / 2) target from t join f using (scene))
select scene, wall, round(degrees(abs(b - target)), 5) deviation, degrees(abs(b - target)) <= 6 regularized, round(case when degrees(abs(b - target)) <= 6 then cos(target) else tx end, 6) tx from v"""
)
def manhattan_frame(spark: SparkSession, d: str) -> DataFrame:
    """M9, A12"""
    return walls.manhattan(scene_walls(spark, d)).select("scene", "wall", F.round("deviation", 5).alias("deviation"), "regularized", F.round("tx", 6).alias("tx"))


SUPPORT = f"""{W}, c as (select w.*, (x - cx) * tx + (y - cy) * ty s, abs(x * nx + y * ny + d) far from w join p on p.label = w.scene),
f as (select scene, wall, count(distinct least(floor((s - s_min) / 0.05), greatest(ceil((s_max - s_min) / 0.05), 1) - 1)) n from c where far <= 0.03 and s between s_min and s_max group by 1, 2),
u as (select w.scene, w.wall, w.s_max - w.s_min size, coalesce(n / greatest(ceil((s_max - s_min) / 0.05), 1), 0.0) support from w left join f using (scene, wall))"""


@query(f"with {SUPPORT} select scene, wall, round(support, 9) support from (select *, sum((support >= 0.35)::int) over (partition by scene) k from u) where support >= 0.35 or k < 2")
def high_band(spark: SparkSession, d: str) -> DataFrame:
    """J10, A16, M10"""
    return walls.filter_by_band(scene_walls(spark, d), scene_points(spark, d), 0.03, 0.35, 0.05).select("scene", "wall", F.round("support", 9).alias("support"))


@query(
    f"""with {W}, s as (select label scene, row_number() over v step, x ax, y ay, lead(x) over v qx, lead(y) over v qy from p window v as (partition by label order by z, vec_id)),
a as (select w.*, step, ax, ay, qx - ax dx, qy - ay dy, cx + s_min * tx - ax wx, cy + s_min * ty - ay wy, (s_max - s_min) * tx ex, (s_max - s_min) * ty ey from w join s using (scene) where qx is not null),
h as (select *, (wx * ey - wy * ex) / (dx * ey - dy * ex) t, (wx * dy - wy * dx) / (dx * ey - dy * ex) u from a where abs(dx * ey - dy * ex) > 1e-12),
x as (select h.*, ax + t * dx px, ay + t * dy py from h where t between 0 and 1 and u between 0 and 1),
n as (select x.scene, wall, step, count(*) filter (abs(p.x * nx + p.y * ny + d) < 0.05 and sqrt((p.x - px) * (p.x - px) + (p.y - py) * (p.y - py)) < 0.1) n from x join p on p.label = x.scene group by 1, 2, 3)
select scene, wall, sum((n >= 2)::int)::bigint on_material, sum((n < 2)::int)::bigint in_gaps from n group by 1, 2"""
)
def camera_support(spark: SparkSession, d: str) -> DataFrame:
    """A path through the scene's points in the order of z"""
    path = points(spark, d).select(F.col("label").alias("scene"), "z", "vec_id", "x", "y")
    return walls.camera_crossed(scene_walls(spark, d), path, scene_points(spark, d).select("scene", "x", "y"), ["z", "vec_id"], 0.1, 0.05, 2)


@query(
    f"""with {W}, o as (select label scene, avg(x) ox, avg(y) oy from p group by 1),
r as (select scene, ox, oy, ray, cos(ray * {2 * math.pi / 360!r}) dx, sin(ray * {2 * math.pi / 360!r}) dy from o, (select unnest(range(360)) ray)),
a as (select r.*, wall, cx + s_min * tx - ox px, cy + s_min * ty - oy py, (s_max - s_min) * tx ex, (s_max - s_min) * ty ey from r join w using (scene)),
h as (select *, (px * ey - py * ex) / (dx * ey - dy * ex) t, (px * dy - py * dx) / (dx * ey - dy * ex) u from a where abs(dx * ey - dy * ex) > 1e-9),
f as (select scene, wall, row_number() over (partition by scene, ray order by round(t, 9), wall) k from h where t > 0 and u between -0.02 and 1.02),
n as (select scene, wall, count(*) n from f where k = 1 group by 1, 2), c as (select scene, count(*) k from w group by 1)
select w.scene, w.wall, round(coalesce(n, 0) / 360, 9) share from w join c using (scene) left join n using (scene, wall) where coalesce(n, 0) / 360 >= 0.02 or k < 3"""
)
def boundary_walls(spark: SparkSession, d: str) -> DataFrame:
    """Rays from each scene's centre"""
    centre = scene_points(spark, d).groupBy("scene").agg(F.avg("x").alias("ox"), F.avg("y").alias("oy")).withColumn("origin", F.lit(0))
    return walls.prune_non_boundary(scene_walls(spark, d), centre).select("scene", "wall", F.round("share", 9).alias("share"))


OFFSETS = f"""{P}, a as (select label scene, ax_ axis, y * cos(0.3 + ax_ * pi() / 2) - x * sin(0.3 + ax_ * pi() / 2) u from p, (select unnest([0, 1]) ax_)),
e as (select scene, axis, min(u) lo, max(u) hi from a group by 1, 2), b as (select a.scene, a.axis, floor((u - lo) / 0.02)::bigint bin, count(*) n from a join e using (scene, axis) group by 1, 2, 3),
r as (select scene, axis, lo, unnest(range(ceil((hi - lo) / 0.02)::bigint + 1)) bin from e),
f as (select r.scene, r.axis, r.bin, lo + (r.bin + 0.5) * 0.02 off, coalesce(n, 0) n from r left join b using (scene, axis, bin)),
s as (select *, sum(n) over (partition by scene, axis order by bin rows between 2 preceding and 2 following)::bigint sm from f)"""


@query(f'with {OFFSETS} select scene, axis, bin, round(off, 9) "offset", n, sm from s')
def offset_bins(spark: SparkSession, d: str) -> DataFrame:
    """A7"""
    return walls.offset_histogram(scene_points(spark, d), F.lit(0.3), 0.02, 2).select("scene", "axis", "bin", F.round("offset", 9).alias("offset"), "n", "sm")


@query(
    f"""with recursive {OFFSETS}, o as (select scene, axis, bin, sm, row_number() over (partition by scene, axis order by sm desc, bin) k from s where sm >= 3),
t as (select scene, axis, k, [bin] taken, bin, sm, true yes from o where k = 1
    union all select o.scene, o.axis, o.k, case when q then list_append(t.taken, o.bin) else t.taken end, o.bin, o.sm, q
    from t join (select * from o) o on o.scene = t.scene and o.axis = t.axis and o.k = t.k + 1, lateral (select len(list_filter(t.taken, lambda x: abs(x - o.bin) <= 7)) = 0 q))
select scene, axis, bin, sm, (row_number() over (partition by scene, axis order by k) - 1)::int place from t where yes qualify place < 16"""
)
def offset_peaks(spark: SparkSession, d: str) -> DataFrame:
    """W12"""
    return walls.pick_peaks(walls.offset_histogram(scene_points(spark, d), F.lit(0.3), 0.02, 2), 3, 7).drop("offset")


@query(
    f"""with {P}, a as (select k, radians(0.25 * k) a from (select unnest(range(360)) k)), q as (select label scene, k, cos(a) c, sin(a) s, x, y from p, a),
u as (select scene, k, 0 d, x * c + y * s u from q union all select scene, k, 1, y * c - x * s from q),
b as (select scene, k, d, ph, floor(u / 0.05 + ph) bin, count(*) n from u, (select unnest([0.0, 0.5]) ph) group by all), z as (select scene, k, sum(n * n)::bigint score from b group by 1, 2),
n as (select label scene, count(*) cells from p group by 1),
r as (select *, row_number() over (partition by scene order by score desc, k) i, median(score) over (partition by scene) mid from z)
select scene, round(radians(0.25 * k), 9) angle, round(score / mid, 9) contrast, score / mid >= 1.5 and cells >= 20 reliable from r join n using (scene) where i = 1"""
)
def dominant_axis(spark: SparkSession, d: str) -> DataFrame:
    """The 0.25 degree grid over 0 to 90, contrast to the median"""
    p = scene_points(spark, d)
    tried = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.cos(math.radians(0.25 * k))).alias("c"), F.lit(math.sin(math.radians(0.25 * k))).alias("s")) for k in range(360)])
    e = p.select("scene", "x", "y", F.explode(tried).alias("t"))
    u = F.array(F.struct(F.lit(0).alias("d"), (F.col("x") * F.col("t.c") + F.col("y") * F.col("t.s")).alias("u")), F.struct(F.lit(1).alias("d"), (F.col("y") * F.col("t.c") - F.col("x") * F.col("t.s")).alias("u")))
    e = e.select("scene", "t.k", F.explode(u).alias("a")).select("scene", "k", "a.*", F.explode(F.array(F.lit(0.0), F.lit(0.5))).alias("phase"))
    n = e.groupBy("scene", "k", "d", "phase", F.floor(F.col("u") / 0.05 + F.col("phase")).alias("bin")).agg(F.count("*").alias("n"))
    scores = n.groupBy("scene", "k").agg(F.sum(F.col("n") * F.col("n")).cast("long").alias("score")).withColumn("angle", F.radians(F.col("k") * 0.25))
    best = walls.dominant_axes(scores.join(p.groupBy("scene").agg(F.count("*").alias("cells")), "scene"))
    return best.withColumns({"angle": F.round("angle", 9), "contrast": F.round("contrast", 9)})


@query(
    f"""with {E}, b as (select *, floor((us - min(us) over (partition by user_id)) / {6 * HOUR})::bigint bin from e), u as (select distinct user_id, bin from b),
s as (select user_id, unnest(range(greatest(bin - 2, 0), bin + 1)) st from u), t as (select user_id, max(bin) top from u group by 1),
f as (select user_id, min(st) a, max(st) + 2 z from (select user_id, st, count(*) n from s group by 1, 2) join t using (user_id) where n >= 2 and st + 2 <= top group by 1)
select event_id, user_id from b left join f using (user_id) where a is null or bin between a and z"""
)
def tail_trim(spark: SparkSession, d: str) -> DataFrame:
    """W8"""
    return walls.trim_tails(events(spark, d), ["user_id"], "us", 6 * HOUR, 3, 2).select("event_id", "user_id")


@query(
    f"""with {E}, g as (select event_type, us first_, us + {HOUR} last_ from e where event_type = 'purchase')
select first_ "first", last_ "last", max(case when e.us < first_ then e.us end) "left", min(case when e.us > last_ then e.us end) "right" from g join e on e.event_type = g.event_type group by 1, 2"""
)
def gap_sides(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of one hour after each purchase"""
    e = events(spark, d)
    gaps = e.where("event_type = 'purchase'").select("event_type", F.col("us").alias("first"), (F.col("us") + HOUR).alias("last")).distinct()
    return walls.gap_edges(gaps, e, ["event_type"], "first", "last", "us").drop("event_type")


SM = f"{HIST}, s as (select *, (coalesce(lag(n) over w, 0) + n + coalesce(lead(n) over w, 0)) / 3 sm from h window w as (order by bin))"
PK = f"""{SM}, t as (select *, coalesce(lag(sm) over w, 0) l, coalesce(lead(sm) over w, 0) r, max(sm) over () top from s window w as (order by bin)),
pk as (select bin, centre, sm, row_number() over (order by bin) i from t where sm >= l and sm >= r and sm >= 0.15 * top and sm > 0),
f as (select i, [(bin, sm)] a from pk where i = 1 union all
    select pk.i, case when pk.bin - f.a[len(f.a)][1] < 5 then case when pk.sm > f.a[len(f.a)][2] then list_append(f.a[1:len(f.a)-1], (pk.bin, pk.sm)) else f.a end else list_append(f.a, (pk.bin, pk.sm)) end from f join pk on pk.i = f.i + 1),
z as (select unnest(a) x from f where i = (select max(i) from pk)), mg as (select x[1] bin, x[2] sm from z)"""


@query(f"with recursive {PK} select bin, round(sm, 6) sm from mg")
def merged_peaks(spark: SparkSession, d: str) -> DataFrame:
    """W3, W4"""
    h = series.histogram(events(spark, d), "value", 0.5)
    return series.merged(series.peaks(h, 0.15)).select("bin", F.round("sm", 6).alias("sm"))


@query(f"""with recursive {PK}, o as (select unnest(range(-20, -8)) k union all select unnest(range(8, 20))),
md as (select mg.bin, median(s.sm) m from mg, o join s on s.bin = mg.bin + k group by 1)
select mg.bin, round(sm / greatest(coalesce(m, 0), 1), 6) prominence from mg left join md using (bin)""")
def peak_prominence(spark: SparkSession, d: str) -> DataFrame:
    """W5"""
    h = series.histogram(events(spark, d), "value", 0.5)
    return series.prominence(series.merged(series.peaks(h, 0.15)), h).select("bin", F.round("prominence", 6).alias("prominence"))


@query(
    f"""with {E}, g as (select *, case when us - lag(us) over w > {12 * HOUR} then 1 else 0 end f from e window w as (partition by user_id order by us)),
s as (select *, sum(f) over (partition by user_id order by us rows unbounded preceding) island from g), a as (select *, min(us) over (partition by user_id, island) lo from s),
r as (select user_id, island::bigint island, min(us) first_, max(us) last_, count(distinct floor((us - lo) / {HOUR})) filled, count(*) n from a group by 1, 2),
q as (select *, last_ - first_ >= {12 * HOUR} and filled / greatest(ceil((last_ - first_) / {HOUR}), 1) >= 0.2 dense from r),
z as (select *, bool_or(dense) over (partition by user_id) any_, row_number() over (partition by user_id order by n desc, first_) k from q)
select user_id, first_ "first", last_ "last", n, dense from z where dense or (not any_ and k = 1)"""
)
def dense_or_largest(spark: SparkSession, d: str) -> DataFrame:
    """W7 with its fallback"""
    return series.dense_or_largest(events(spark, d), ["user_id"], "us", 12 * HOUR, HOUR, 12 * HOUR, 0.2).select("user_id", "first", "last", "n", "dense")


@query(
    f"""with {P}, b as (select label, ((floor((atan2(y, x) + pi()) / (2 * pi()) * 90)::bigint % 90) + 90) % 90 bin from p group by 1, 2),
g as (select *, case when bin - lag(bin) over w > 3 then 1 else 0 end f from b window w as (partition by label order by bin)),
s as (select *, sum(f) over (partition by label order by bin) island from g)
select label, min(bin) "first", max(bin) "last", count(*) n from s group by label, island having count(*) >= 2"""
)
def visible_runs(spark: SparkSession, d: str) -> DataFrame:
    """W11"""
    from ..functions import bearing_bin

    bins = points(spark, d).select("label", bearing_bin(F.col("y"), F.col("x"), 90).alias("bin")).distinct()
    return series.bearing_runs(bins, ["label"]).drop("island")


@query(f"""with {P}, c as (select label, floor(x / 0.05) i, floor(y / 0.05) j, count(*) n from p group by 1, 2, 3), m as (select label, min(x) lo_x, max(x) hi_x, min(y) lo_y, max(y) hi_y from p group by 1)
select label, sum(n)::bigint raw, count(*) cells, lo_x, hi_x, lo_y, hi_y from c join m using (label) group by all""")
def cloud_statistics(spark: SparkSession, d: str) -> DataFrame:
    """A2, A3"""
    return grid.cloud_statistics(points(spark, d), ["label"], ["x", "y"], 0.05)


@query(f"with {P}, v as (select floor(x / 0.05)::bigint i, floor(y / 0.05)::bigint j, count(distinct label) votes from p group by 1, 2) select i, j, votes from v where votes >= 2")
def voted_cells(spark: SparkSession, d: str) -> DataFrame:
    """A18"""
    p = points(spark, d).select("label", F.floor(F.col("x") / 0.05).cast("long").alias("i"), F.floor(F.col("y") / 0.05).cast("long").alias("j"))
    return grid.voted(p, "label")


LABELLED = f"{P}, l as (select floor(x / 0.05)::bigint i, floor(y / 0.05)::bigint j, min(label) label from p group by 1, 2)"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy(F.floor(F.col("x") / 0.05).cast("long").alias("i"), F.floor(F.col("y") / 0.05).cast("long").alias("j")).agg(F.min("label").alias("label"))


@query(f"with {LABELLED} select label, round(count(*) * 0.0025, 9) area, round(avg(i + 0.5) * 0.05, 9) x, round(avg(j + 0.5) * 0.05, 9) y from l group by 1")
def region_areas(spark: SparkSession, d: str) -> DataFrame:
    """A19"""
    return grid.regions(labelled(spark, d), 0.05).select("label", *[F.round(c, 9).alias(c) for c in ("area", "x", "y")])


@query(f"""with {LABELLED}, f as (select distinct i + a i, j + b j from l, (select unnest(range(-2, 3)) a) s, (select unnest(range(-2, 3)) b) t),
w as (select f.* from f anti join l on l.i = f.i and l.j = f.j),
c as (select w.i, w.j, l.label, row_number() over (partition by w.i, w.j order by (w.i - l.i) * (w.i - l.i) + (w.j - l.j) * (w.j - l.j), l.label) k from w join l on (w.i - l.i) * (w.i - l.i) + (w.j - l.j) * (w.j - l.j) <= 4)
select i, j, label from c where k = 1""")
def label_fill(spark: SparkSession, d: str) -> DataFrame:
    """J17"""
    have = labelled(spark, d)
    return grid.fill_labels(grid.dilate(have, reach=2), have, 2)


@query(f"""with {CELLS}, f as (select distinct i + a i, j + b j from c, (select unnest(range(-3, 4)) a) s, (select unnest(range(-3, 4)) b) t)
select f.i, f.j, round(least(min(sqrt((f.i - c.i) * (f.i - c.i) + (f.j - c.j) * (f.j - c.j))), 3.0), 9) distance from f, c group by 1, 2""")
def free_distance(spark: SparkSession, d: str) -> DataFrame:
    """G9"""
    c = grid.cells(points(spark, d), "x", "y", 0.05)
    return grid.clearance(grid.dilate(c, reach=3), c, 3).withColumn("distance", F.round("distance", 9))


@query(f"""with {G}, s as (select floor(ax / 0.01)::bigint i, floor(ay / 0.01)::bigint j, floor(bx / 0.01)::bigint i2, floor(by_ / 0.01)::bigint j2 from g where bx is not null),
n as (select *, greatest(abs(i2 - i), abs(j2 - j)) n from s), k as (select *, unnest(range(n + 1)) k from n)
select distinct round_even(i + case when n > 0 then k * (i2 - i) / n else 0 end, 0)::bigint i, round_even(j + case when n > 0 then k * (j2 - j) / n else 0 end, 0)::bigint j from k""")
def segment_raster(spark: SparkSession, d: str) -> DataFrame:
    """G2"""
    w = Window.partitionBy("label").orderBy("vec_id")
    at = lambda c: F.floor(F.col(c) / 0.01).cast("long")
    c = points(spark, d).select("label", "vec_id", at("x").alias("i"), at("y").alias("j"))
    return grid.segment_cells(c.select("i", "j", F.lead("i").over(w).alias("i2"), F.lead("j").over(w).alias("j2")).where("i2 is not null"))


@query(f"""with {P}, c as (select label, vec_id, x, y, coalesce(lead(x) over v, first(x) over v) x2, coalesce(lead(y) over v, first(y) over v) y2 from p window v as (partition by label order by vec_id)),
b as (select label, floor(min(x) / 0.02)::bigint - 1 a, ceil(max(x) / 0.02)::bigint + 1 z, floor(min(y) / 0.02)::bigint - 1 e, ceil(max(y) / 0.02)::bigint + 1 f from p group by 1),
q as (select label, i, unnest(range(e, f + 1)) j from (select *, unnest(range(a, z + 1)) i from b)),
h as (select q.label, i, j, count(*) n from q join c on c.label = q.label and least(y, y2) <= (j + 0.5) * 0.02 and (j + 0.5) * 0.02 < greatest(y, y2) and x + ((j + 0.5) * 0.02 - y) / (y2 - y) * (x2 - x) <= (i + 0.5) * 0.02 group by 1, 2, 3)
select label, i, j from h where n % 2 = 1""")
def polygon_raster(spark: SparkSession, d: str) -> DataFrame:
    """G3"""
    return grid.polygon_cells(points(spark, d), "label", "vec_id", 0.02)


@query(f"""with recursive {CELLS}, b as (select min(i) - 1 a, max(i) + 1 z, min(j) - 1 e, max(j) + 1 f from c),
o as (select i, j from (select i, unnest(range(e, f + 1)) j from (select *, unnest(range(a, z + 1)) i from b)) q anti join c using (i, j)),
r as (select a i, e j from b union select o.i, o.j from r join o on abs(o.i - r.i) + abs(o.j - r.j) = 1)
select i, j from c union select i, j from o anti join r using (i, j)""")
def filled_holes(spark: SparkSession, d: str) -> DataFrame:
    """G5"""
    from ..session import checkpoints

    checkpoints(spark)
    return grid.fill_holes(grid.cells(points(spark, d), "x", "y", 0.05))


def hull_area(spark: SparkSession, d: str) -> DataFrame:
    """G7; no SQL: tested against a brute-force hull"""
    return grid.hull(points(spark, d), "label", "x", "y").withColumn("area", F.round("area", 9))


@query(f"""with {P}, m as (select label, avg(x) a, avg(y) b, avg(z) c, count(*) n from p group by 1), s as (select *, sqrt(a * a + b * b + c * c) len from m)
select label, n, round(len, 9) length, round(a / len, 6) ux, round(b / len, 6) uy, round(c / len, 6) uz from s""")
def mean_direction(spark: SparkSession, d: str) -> DataFrame:
    """A10, A11"""
    r = rays.resultant(points(spark, d), ["label"], (F.col("x"), F.col("y"), F.col("z")))
    return r.select("label", "n", F.round("length", 9).alias("length"), *[F.round(c, 6).alias(c) for c in ("ux", "uy", "uz")])


@query("""with o as (select o_orderkey, o_totalprice v, case when o_orderkey % 3 = 0 then 'floor_area' else 'wall_length' end kind, case when o_orderstatus = 'F' then 'lidar' else 'video' end tier, o_orderkey % 400 support from orders),
c as (select * from (values ('lidar', 'wall_length', 12.5, 10), ('video', 'floor_area', 30.0, 50)) t(tier, kind, quantile, n)),
h as (select o.*, (case when quantile is null then 0.02 + (case when kind like '%area' then 0.02 else 0.01 end) * abs(v) + 2 * 0.5 else quantile * (case when n < 20 then 2 else 1 end) end) * (case when support < 200 then 2 else 1 end) h from o left join c using (tier, kind)),
m as (select o_orderkey, case when o_orderkey % 11 = 0 then null else v end value, case when o_orderkey % 7 = 0 then 100000 end lo, case when o_orderkey % 7 = 0 then 200000 end hi, h from h)
select o_orderkey, case when value is null then 'unobserved' when lo is not null then 'estimated' else 'observed' end status,
round(case when value is null then null when lo is not null then least(lo, value) else value - h end, 4) lower, round(case when value is null then null when lo is not null then greatest(hi, value) else value + h end, 4) upper from m""")
def measurement_intervals(spark: SparkSession, d: str) -> DataFrame:
    """J20, S12's table, M18 with all its branches"""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "floor_area").otherwise("wall_length")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"), kind.alias("kind"), F.when(F.col("o_orderstatus") == "F", "lidar").otherwise("video").alias("tier"))
    known = spark.createDataFrame([("lidar", "wall_length", 12.5, 10), ("video", "floor_area", 30.0, 50)], "tier string, kind string, quantile double, n long")
    rows = measure.calibrated(o, known).withColumn("half", measure.half_width(F.col("v"), F.col("kind"), F.lit(0.5), F.col("o_orderkey") % 400, 0.02, 0.01, 2.0))
    bound = lambda x: F.when(F.col("o_orderkey") % 7 == 0, F.lit(x))
    rows = rows.withColumns({"value": F.when(F.col("o_orderkey") % 11 != 0, F.col("v")), "bound_low": bound(100000.0), "bound_high": bound(200000.0)})
    return measure.measurements(rows, F.col("half")).select("o_orderkey", "status", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@query("""with m as (select l_orderkey, l_linenumber, case when l_linenumber % 5 = 0 then null else l_quantity end v, case l_returnflag when 'A' then 'observed' when 'N' then 'unobserved' else 'guessed' end st,
case when l_linenumber % 4 = 0 then null else l_quantity - l_linenumber % 3 + 0.5 end lo, l_quantity + 1 hi from lineitem)
select l_orderkey, l_linenumber, case when st not in ('observed', 'estimated', 'unobserved') then 'bad status' when st = 'unobserved' and v is not null then 'unobserved measurement must not carry a value' when st = 'unobserved' then null
when lo is null or hi is null then 'missing confidence interval' when not coalesce(v between lo and hi, false) then 'value outside its interval' end problem from m""")
def scene_problems(spark: SparkSession, d: str) -> DataFrame:
    """Lines as measurements"""
    li = table(spark, d, "lineitem")
    rows = li.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity")).alias("value"),
        F.when(F.col("l_returnflag") == "A", "observed").when(F.col("l_returnflag") == "N", "unobserved").otherwise("guessed").alias("status"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity") - F.col("l_linenumber") % 3 + 0.5).alias("lower"), (F.col("l_quantity") + 1).alias("upper"),
    )
    return measure.problems(rows).select("l_orderkey", "l_linenumber", "problem")


@query("""with m as (select s_nationkey g, s_suppkey, s_acctbal a, s_acctbal + s_suppkey % 7 - 3 b from supplier)
select s_suppkey, round(abs(a - b) / b * 100, 4) percent, round(abs(a - b) * 100, 4) cm, round(abs(a - b), 4) apart, round(abs(a - b) / ((a + b) / 2) * 100, 4) apart_percent from m""")
def measure_errors(spark: SparkSession, d: str) -> DataFrame:
    """M21"""
    m = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), (F.col("s_acctbal") + F.col("s_suppkey") % 7 - 3).alias("b"))
    apart, percent = measure.spread(F.col("a"), F.col("b"))
    cols = {"percent": measure.percent_error(F.col("a"), F.col("b")), "cm": measure.error_cm(F.col("a"), F.col("b")), "apart": apart, "apart_percent": percent}
    return m.select("s_suppkey", *[F.round(c, 4).alias(n) for n, c in cols.items()])


def matched_balances(spark: SparkSession, d: str) -> DataFrame:
    nation = F.broadcast(table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("scene")))
    s = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("scene", F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("scene", F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return measure.assignment(s, c, "scene", "v", "k")


def assignment_least(spark: SparkSession, d: str) -> DataFrame:
    """Sets of unlike sizes, unmatched values of both sides; no SQL: tested against all matchings of small sets"""
    return matched_balances(spark, d)


def scene_gates(spark: SparkSession, d: str) -> DataFrame:
    """Wall and opening gates over the matching of J16; no SQL for the matching: the gates are tested by hand"""
    g = measure.gates(matched_balances(spark, d), F.lit("photo"))
    w = F.struct(F.lit("walls").alias("gate"), F.col("worst").alias("actual"), F.col("walls_pass").alias("pass"))
    o = F.struct(F.lit("openings").alias("gate"), (F.col("n_ok") / F.col("n_true")).alias("actual"), F.col("openings_pass").alias("pass"))
    # scenes without a true value have no wall gate
    return g.select("scene", F.explode(F.when(F.col("n_true") > 0, F.array(w, o)).otherwise(F.array(o))).alias("x")).select("scene", "x.*")


@query("""with c as (select p_brand, s, median(abs(p_retailprice * s - 1000)) / 1000 err, count(*) pairs from part, (select unnest([0.5, 0.75, 1.0]) s) group by 1, 2),
r as (select *, row_number() over (partition by p_brand order by err, s) k, lead(err) over (partition by p_brand order by err, s) nxt from c)
select p_brand, s::double candidate, round(nxt / err, 6) margin, case when err > 0.3 or pairs < 4 then 'poor' when coalesce(nxt / err, 'inf'::double) < 1.5 then 'ambiguous' else 'selected' end verdict from r where k = 1""")
def convention_verdict(spark: SparkSession, d: str) -> DataFrame:
    """J6, O1, M5"""
    tried = table(spark, d, "part").select("p_brand", "p_retailprice", F.explode(F.array(F.lit(0.5), F.lit(0.75), F.lit(1.0))).alias("candidate"))
    c = tried.groupBy("p_brand", "candidate").agg((F.median(F.abs(F.col("p_retailprice") * F.col("candidate") - 1000)) / 1000).alias("err"), F.count("*").alias("pairs"))
    return measure.verdict(c, ["p_brand"], largest=0.3).select("p_brand", "candidate", F.round("margin", 6).alias("margin"), "verdict")


@query("""with v as (select unnest(['raw', 'tax', 'discount', 'both']) variant), e as (select variant, l_suppkey scene, sum(l_extendedprice) base,
sum(l_extendedprice * case variant when 'tax' then 1 + l_tax when 'discount' then 1 - l_discount when 'both' then (1 - l_discount) * (1 + l_tax) else 1 end) x from lineitem, v group by 1, 2)
select variant, round(median(abs(x - base) / base * 100), 6) median_error, round(max(abs(x - base) / base * 100), 6) worst_error from e group by 1""")
def ablation(spark: SparkSession, d: str) -> DataFrame:
    """Variants unfolded in the row, errors a scene, then the middle and the worst of each variant"""
    one = F.lit(1.0)
    how = {"raw": one, "tax": 1 + F.col("l_tax"), "discount": 1 - F.col("l_discount"), "both": (1 - F.col("l_discount")) * (1 + F.col("l_tax"))}
    sums = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("base"), *[F.sum(F.col("l_extendedprice") * f).alias(v) for v, f in how.items()])
    each = sums.select("base", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("x")) for v in how])).alias("e")).select("e.variant", measure.percent_error(F.col("e.x"), F.col("base")).alias("err"))
    return each.groupBy("variant").agg(F.round(F.median("err"), 6).alias("median_error"), F.round(F.max("err"), 6).alias("worst_error"))


@query("""select event_type, arg_max(event_id, (value, -event_id)) strongest, arg_min(event_id, (value, event_id)) weakest from events group by 1""")
def strongest_pick(spark: SparkSession, d: str) -> DataFrame:
    """O3"""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("strongest"), F.min_by("event_id", F.struct("value", "event_id")).alias("weakest"))


@query("""with s as (select l_suppkey k, var_samp(l_quantity) a, covar_samp(l_quantity, l_discount) b, var_samp(l_discount) c, avg(l_quantity) u, avg(l_discount) v from lineitem group by 1)
select k l_suppkey, round(a * c - b * b, 6) det, round((u * c - b * v) / (a * c - b * b), 5) x, round((a * v - b * u) / (a * c - b * b), 3) y from s where abs(a * c - b * b) > 1e-12""")
def solved_pairs(spark: SparkSession, d: str) -> DataFrame:
    """F linear algebra: determinants and 2 x 2 systems"""
    from ..functions import det2, solve2

    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.var_samp("l_quantity").alias("a"), F.covar_samp("l_quantity", "l_discount").alias("b"), F.var_samp("l_discount").alias("c"), F.avg("l_quantity").alias("u"), F.avg("l_discount").alias("v"))
    x, y = solve2(*[F.col(k) for k in ("a", "b", "b", "c", "u", "v")])
    s = s.select("l_suppkey", det2(*[F.col(k) for k in ("a", "b", "b", "c")]).alias("det"), x.alias("x"), y.alias("y")).where("x is not null")
    return s.select("l_suppkey", F.round("det", 6).alias("det"), F.round("x", 5).alias("x"), F.round("y", 3).alias("y"))


@query("""select event_type, list_sort(list(distinct k)) keys, count(*) n from (select event_type, unnest(json_keys(props)) k from events where json_valid(props)) group by 1""")
def props_keys(spark: SparkSession, d: str) -> DataFrame:
    """F JSON: the keys of the rows' objects"""
    e = table(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("k"))
    return e.groupBy("event_type").agg(F.array_sort(F.collect_set("k")).alias("keys"), F.count("*").alias("n"))


@query("""select l_returnflag, map_from_entries(list((l_linestatus, n) order by l_linestatus))['F'] n_f, map_from_entries(list((l_linestatus, n) order by l_linestatus))['O'] n_o
from (select l_returnflag, l_linestatus, count(*) n from lineitem group by 1, 2) group by 1""")
def status_map(spark: SparkSession, d: str) -> DataFrame:
    """F map: a dictionary by key, looked up"""
    n = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    m = n.groupBy("l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "n"))).alias("m"))
    return m.select("l_returnflag", F.try_element_at("m", F.lit("F")).alias("n_f"), F.try_element_at("m", F.lit("O")).alias("n_o"))


@query(f"with {CELLS} select i, j from c where (select count(*) from c n where abs(n.i - c.i) + abs(n.j - c.j) = 1) < 4")
def edge_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cells from which outlines and their areas are made"""
    return grid.edge(grid.cells(points(spark, d), "x", "y", 0.05))


@query(f"""with recursive {P}, c as (select floor(x / 0.05)::bigint i, floor(y / 0.05)::bigint j, count(*) n from p group by 1, 2),
b as (select c.i, c.j, arg_max(t.i, (t.n, t.i, t.j)) pi, arg_max(t.j, (t.n, t.i, t.j)) pj from c join c t on abs(t.i - c.i) <= 1 and abs(t.j - c.j) <= 1 group by 1, 2),
r as (select i, j, pi, pj from b union all select r.i, r.j, b.pi, b.pj from r join b on b.i = r.pi and b.j = r.pj where b.pi <> r.pi or b.pj <> r.pj)
select r.i, r.j, r.pi, r.pj from r join b on b.i = r.pi and b.j = r.pj and b.pi = r.pi and b.pj = r.pj""")
def ascent_basins(spark: SparkSession, d: str) -> DataFrame:
    """Basins of all peaks (G10 with 0; larger bounds are tested against a flood)"""
    from ..session import checkpoints

    checkpoints(spark)
    n = points(spark, d).groupBy(F.floor(F.col("x") / 0.05).cast("long").alias("i"), F.floor(F.col("y") / 0.05).cast("long").alias("j")).agg(F.count("*").alias("level"))
    return grid.basins(n, 0.0)


def axis_walls(spark: SparkSession, d: str) -> DataFrame:
    """M7; no SQL: tested on made rooms"""
    p = scene_points(spark, d)
    axes = p.select("scene").distinct().withColumn("phi", F.lit(0.3))
    return scene.axis_walls(p, axes, shortest=0.1).select("scene", "wall", "axis", "n_cells", *[F.round(c, 6).alias(c) for c in ("d", "s_min", "s_max", "snapped_deg")], "reason")


UNCHECKED = {f.__name__: f for f in (hull_area, assignment_least, scene_gates, axis_walls)}
