"""Queries of the operators over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import interval_half_width, micros
from ..operators import clean, grid, project, rays, series, timejoin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3_600_000_000


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"), F.get("embedding", F.lit(2)).cast("double").alias("z"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", micros(F.col("ts")).alias("us"))


P = "p as (select vec_id, label, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z from embeddings)"
E = "e as (select event_id, user_id, event_type, value, epoch_us(ts) us from events)"
CELLS = f"{P}, c as (select distinct floor(x / 0.05)::bigint i, floor(y / 0.05)::bigint j from p)"


@query(f"with {P} select floor(x / 0.05)::bigint i_x, floor(y / 0.05)::bigint i_y, floor(z / 0.05)::bigint i_z, round(avg(x), 9) x, round(avg(y), 9) y, round(avg(z), 9) z, count(*) n from p group by 1, 2, 3")
def voxel_downsample(spark: SparkSession, d: str) -> DataFrame:
    """A1, C24"""
    v = grid.voxel_mean(points(spark, d), ["x", "y", "z"], 0.05)
    return v.withColumns({a: F.round(a, 9) for a in "xyz"})


@query(f"""with {P}, b as (select min(x) lx, min(y) ly from p)
select floor((x - lx) / 0.1)::bigint i_x, floor((y - ly) / 0.1)::bigint i_y, round(avg(x), 9) x, round(avg(y), 9) y, count(*) n from p, b group by 1, 2""")
def voxel_from_least(spark: SparkSession, d: str) -> DataFrame:
    """A1: cells that start at the least coordinates"""
    v = grid.voxel_mean(points(spark, d), ["x", "y"], 0.1, from_least=True)
    return v.withColumns({a: F.round(a, 9) for a in "xy"})


@query(f"""with {E}, g as (select *, case when us - lag(us) over w > {HOUR} then 1 else 0 end f from e window w as (partition by user_id order by us, event_id)),
s as (select *, sum(f) over (partition by user_id order by us, event_id rows unbounded preceding) island from g)
select user_id, island::bigint island, min(us) first, max(us) last, count(*) n from s group by 1, 2""")
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    """W6"""
    return series.runs(events(spark, d), ["user_id"], "us", HOUR, ["event_id"])


@query(f"""with {E}, g as (select *, case when us - lag(us) over w > {12 * HOUR} then 1 else 0 end f from e window w as (partition by user_id order by us)),
s as (select *, sum(f) over (partition by user_id order by us rows unbounded preceding) island from g),
r as (select user_id, island::bigint island, min(us) first, max(us) last, count(distinct us // {HOUR}) filled, count(*) n from s group by 1, 2)
select * from r where last - first >= {2 * HOUR} and filled * {HOUR} >= 0.1 * (last - first)""")
def dense_runs(spark: SparkSession, d: str) -> DataFrame:
    """W7"""
    return series.dense_runs(events(spark, d), ["user_id"], "us", 12 * HOUR, HOUR, 2 * HOUR, 0.1)


@query(f"""with {E}, b as (select event_type, floor(value / 5)::bigint bin, count(*) n from e group by 1, 2),
s as (select event_type, min(bin) lo, max(bin) hi, median(n) typical from b group by 1),
a as (select event_type, typical, unnest(range(lo, hi + 1)) bin from s),
f as (select a.event_type, a.bin, coalesce(n, 0) n from a left join b using (event_type, bin) where coalesce(n, 0) < 0.5 * typical),
g as (select *, case when bin - lag(bin) over w > 1 then 1 else 0 end x from f window w as (partition by event_type order by bin)),
h as (select *, sum(x) over (partition by event_type order by bin) island from g)
select event_type, island::bigint island, min(bin) first_bin, max(bin) last_bin, sum(n)::bigint n from h group by 1, 2""")
def thin_runs(spark: SparkSession, d: str) -> DataFrame:
    """W9"""
    return series.thin_runs(events(spark, d), ["event_type"], "value", 5.0, 0.5)


@query(f"with {E} select user_id, round(quantile_cont(value, 0.005), 9) low, round(quantile_cont(value, 0.995), 9) high, round(median(value), 9) middle, count(*) n from e group by 1")
def extent_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """A13"""
    r = series.extent(events(spark, d), ["user_id"], "value", 0.005)
    return r.withColumns({c: F.round(c, 9) for c in ("low", "high", "middle")})


@query(f"with {E} select user_id, min(value) least, max(value) largest, round(avg(value), 8) mean, round(median(value), 9) middle, round(stddev_pop(value), 8) deviation from e group by 1")
def intrinsics_spread(spark: SparkSession, d: str) -> DataFrame:
    """C13"""
    r = clean.spread(events(spark, d), "value", ["user_id"])
    return r.withColumns({"mean": F.round("mean", 8), "middle": F.round("middle", 9), "deviation": F.round("deviation", 8)})


HIST = f"""{E}, m as (select min(value) lo, max(value) hi, greatest(ceil((max(value) - min(value)) / 0.5), 1)::bigint bins from e),
k as (select least(floor((value - lo) / 0.5)::bigint, bins - 1) bin, count(*) n from e, m group by 1),
h as (select r.bin, lo + (r.bin + 0.5) * 0.5 centre, coalesce(n, 0) n from (select unnest(range(bins)) bin, lo from m) r left join k using (bin))"""


@query(f"with {HIST} select bin, round(centre, 9) centre, n from h")
def height_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A5"""
    return series.histogram(events(spark, d), "value", 0.5).withColumn("centre", F.round("centre", 9))


@query(f"""with {HIST}, s as (select *, (coalesce(lag(n) over w, 0) + n + coalesce(lead(n) over w, 0)) / 3 sm from h window w as (order by bin)),
t as (select *, coalesce(lag(sm) over w, 0) l, coalesce(lead(sm) over w, 0) r, max(sm) over () top from s window w as (order by bin))
select bin, round(centre, 9) centre, n, round(sm, 6) sm from t where sm >= l and sm >= r and sm >= 0.15 * top and sm > 0""")
def histogram_peaks(spark: SparkSession, d: str) -> DataFrame:
    """W3, O3"""
    return series.peaks(series.histogram(events(spark, d), "value", 0.5), 0.15).withColumns({"centre": F.round("centre", 9), "sm": F.round("sm", 6)})


@query(f"""with {E} select event_id, count(*) over w near, round(avg(value) over w, 6) near_mean from e
window w as (partition by user_id order by us range between {6 * HOUR} preceding and {6 * HOUR} following)""")
def imu_window(spark: SparkSession, d: str) -> DataFrame:
    """J2 within one table"""
    return timejoin.window_counts(events(spark, d), ["user_id"], "us", 6 * HOUR, "value").select("event_id", "near", F.round("near_mean", 6).alias("near_mean"))


@query(f"""with {E} select a.event_id, count(*) n, max(b.us - a.us) last from e a join e b on a.user_id = b.user_id and abs(a.us - b.us) <= {3 * HOUR}
where a.event_type = 'purchase' and b.event_type = 'click' group by 1""")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """J2 of two streams, by buckets"""
    e = events(spark, d)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("us").alias("at"))
    right = e.where("event_type = 'click'").select("user_id", F.col("us").alias("time"))
    return timejoin.interval_join(left, right, "at", "time", 3 * HOUR, ["user_id"]).groupBy("event_id").agg(F.count("*").alias("n"), F.max(F.col("time") - F.col("at")).alias("last"))


@query(f"""with {E}, j as (select a.event_id, a.user_id, b.event_id click_id, abs(a.us - b.us) gap, row_number() over (partition by a.event_id order by abs(a.us - b.us), b.us, b.event_id) r
from e a join e b on a.user_id = b.user_id where a.event_type = 'purchase' and b.event_type = 'click') select event_id, user_id, click_id, gap from j where r = 1""")
def nearest_asof(spark: SparkSession, d: str) -> DataFrame:
    """J3"""
    e = events(spark, d)
    return timejoin.nearest(e.where("event_type = 'purchase'"), e.where("event_type = 'click'").withColumnRenamed("event_id", "click_id"), ["user_id"], "us", "event_id", "click_id")


@query(f"""with {E}, o as (select *, row_number() over (partition by user_id order by us, event_id) k from e),
j as (select a.event_id, b.event_id other, abs(b.value - a.value) score, row_number() over (partition by a.event_id order by abs(b.value - a.value) desc, b.k) r
from o a join o b on a.user_id = b.user_id and b.k between a.k + 1 and a.k + 5) select event_id, other, round(score, 6) score from j where r = 1""")
def pair_theta_join(spark: SparkSession, d: str) -> DataFrame:
    """J4"""
    r = timejoin.best_ahead(events(spark, d), ["user_id"], ["us", "event_id"], 5, F.abs(F.col("b.value") - F.col("a.value")), "event_id")
    return r.withColumn("score", F.round("score", 6))


@query(f"""with recursive {E}, o as (select user_id, us, event_id, row_number() over (partition by user_id order by us, event_id) k from e),
s as (select user_id, us, event_id, k, us last, true keep from o where k = 1 union all
select o.user_id, o.us, o.event_id, o.k, case when o.us - s.last >= {10 * HOUR} then o.us else s.last end, o.us - s.last >= {10 * HOUR} from s join o on o.user_id = s.user_id and o.k = s.k + 1)
select user_id, event_id from s where keep""")
def greedy_keyframes(spark: SparkSession, d: str) -> DataFrame:
    """W2, by time"""
    return series.spaced(events(spark, d), ["user_id"], "us", "event_id", 10 * HOUR)


@query("""select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in
(select l_partkey from lineitem group by 1 having max(l_quantity) - min(l_quantity) >= 45 and count(*) >= 25)""")
def tall_column_filter(spark: SparkSession, d: str) -> DataFrame:
    """A4, J13"""
    return grid.tall_columns(table(spark, d, "lineitem"), ["l_partkey"], "l_quantity", 45, 25).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"with {E} select user_id, round(0.5 * atan2(2 * covar_samp(us / 1e12, value / 100), var_samp(us / 1e12) - var_samp(value / 100)), 6) angle, count(*) n from e group by 1")
def pca_angle(spark: SparkSession, d: str) -> DataFrame:
    """A8, A9"""
    e = events(spark, d).withColumns({"x": F.col("us") / 1e12, "y": F.col("value") / 100})
    return rays.principal_angle(e, ["user_id"], "x", "y").withColumn("angle", F.round("angle", 6))


@query(f"""with {E}, s as (select user_id, us - lag(us) over (partition by user_id order by us, event_id) d from e)
select user_id, count(*) n, median(d) middle_step, round(avg(d), 3) mean_step, max(d) largest_step, coalesce(bool_and(d > 0), true) monotonic from s group by 1""")
def odometry_summary(spark: SparkSession, d: str) -> DataFrame:
    """C14, W1"""
    return clean.steps(events(spark, d), ["user_id"], ["us", "event_id"], "us").withColumn("mean_step", F.round("mean_step", 3))


@query("""with k as (select o_orderkey k from orders where o_orderstatus <> 'P'), b as (select min(k) lo, max(k) hi from k), r as (select unnest(range(lo, hi + 1)) k from b)
select r.k o_orderkey from r anti join k on k.k = r.k""")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    """Keys from the least to the largest that no order has that isn't pending"""
    return clean.missing_keys(table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey"), "o_orderkey", None)


def missing_ids_whole(spark: SparkSession, d: str) -> DataFrame:
    """C7, J14, U2 from the least to the largest key; no SQL, for the test tables have no gaps"""
    return clean.missing_keys(table(spark, d, "orders"), "o_orderkey", None)


@query("""with b as (select min(doc_id) lo, max(doc_id) hi from labels), r as (select unnest(range(lo, hi + 1)) doc_id from b)
select r.doc_id from r anti join labels l on l.doc_id = r.doc_id""")
def missing_from_first(spark: SparkSession, d: str) -> DataFrame:
    """C7 from the least id"""
    return clean.missing_keys(table(spark, d, "labels"), "doc_id", None)


@query(f"with {E} select user_id, us // {HOUR} as hour, count(*) n from e group by 1, 2 having count(*) > 1")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    """C6"""
    return clean.duplicate_keys(events(spark, d).withColumn("hour", F.floor(F.col("us") / HOUR).cast("long")), ["user_id", "hour"])


@query(f"with {E} select event_type, round(atan2(sum(sin(4 * value)), sum(cos(4 * value))) / 4, 6) angle from e group by 1")
def circular_mean(spark: SparkSession, d: str) -> DataFrame:
    """A12"""
    return rays.circular_mean(events(spark, d), ["event_type"], F.col("value"), F.lit(1.0)).withColumn("angle", F.round("angle", 6))


@query("""with r as (select l_returnflag, abs(l_quantity - 25) r from lineitem), k as (select *, row_number() over (partition by l_returnflag order by r) i, count(*) over (partition by l_returnflag) n from r)
select l_returnflag, r quantile, n from k where i = least(ceil((n + 1) * 0.9)::bigint, n)""")
def conformal_quantile(spark: SparkSession, d: str) -> DataFrame:
    """A14, A15"""
    return series.conformal(table(spark, d, "lineitem"), ["l_returnflag"], F.abs(F.col("l_quantity") - 25), 0.1)


@query("""with a as (select o_orderpriority gate, avg(o_totalprice) > 100000 pass from orders where o_orderstatus = 'F' group by 1),
b as (select o_orderpriority gate, avg(o_totalprice) > 101000 pass from orders where o_orderstatus = 'O' group by 1)
select coalesce(a.gate, b.gate) gate, case when a.pass is null or b.pass is null then 'n/a' when a.pass and b.pass then 'unchanged-pass' when a.pass then 'pass->fail' when b.pass then 'fail->pass' else 'unchanged-fail' end movement
from a full join b using (gate)""")
def gate_compare(spark: SparkSession, d: str) -> DataFrame:
    """J15, M22, U4"""
    o = table(spark, d, "orders")
    side = lambda s, least, name: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("gate")).agg((F.avg("o_totalprice") > least).alias(name))
    both = side("F", 100000, "before").join(side("O", 101000, "after"), "gate", "full_outer")
    move = F.when(F.col("before").isNull() | F.col("after").isNull(), "n/a").when(F.col("before") & F.col("after"), "unchanged-pass").when(F.col("before"), "pass->fail").when(F.col("after"), "fail->pass").otherwise("unchanged-fail")
    return both.select("gate", move.alias("movement"))


@query(f"""with {P}, r as (select label, ((floor((atan2(y, x) + pi()) / (2 * pi()) * 36)::bigint % 36) + 36) % 36 bin, sqrt(x * x + y * y) r from p)
select label, bin, round(greatest(quantile_cont(r, 0.1) - 0.01, 0), 9) reach, count(*) n from r where r > 0.02 and r <= 6 group by 1, 2 having count(*) >= 3""")
def visibility_bins(spark: SparkSession, d: str) -> DataFrame:
    """G14"""
    return rays.visible_range(points(spark, d), ["label"], "x", "y", 36, 0.02, 6.0, 3, 0.01).withColumn("reach", F.round("reach", 9))


AROUND = "(select unnest([-1, 0, 1]) a) s, (select unnest([-1, 0, 1]) b) t"


@query(f"with {CELLS} select distinct i + a i, j + b j from c, {AROUND}")
def raster_dilate(spark: SparkSession, d: str) -> DataFrame:
    """G1, G4"""
    return grid.dilate(grid.cells(points(spark, d), "x", "y", 0.05))


@query(f"with {CELLS}, w as (select distinct i + a i, j + b j from c, {AROUND}) select i + a i, j + b j from w, {AROUND} group by 1, 2 having count(*) = 9")
def raster_close(spark: SparkSession, d: str) -> DataFrame:
    """G4"""
    return grid.close(grid.cells(points(spark, d), "x", "y", 0.05))


@query(f"""with recursive {CELLS}, r(i, j, ci, cj) as (select i, j, i, j from c union select r.i, r.j, c.i, c.j from r join c on abs(c.i - r.ci) <= 1 and abs(c.j - r.cj) <= 1)
select i, j, min((ci, cj))[1] ci, min((ci, cj))[2] cj from r group by 1, 2""")
def components(spark: SparkSession, d: str) -> DataFrame:
    """G6"""
    from ..session import checkpoints

    checkpoints(spark)
    return grid.components(grid.cells(points(spark, d), "x", "y", 0.05))


@query(f"""with {P}, l as (select floor(x / 0.05)::bigint i, floor(y / 0.05)::bigint j, min(label) label from p group by 1, 2),
m as (select a.label l1, b.label l2 from l a join l b on (b.i = a.i + 1 and b.j = a.j) or (b.i = a.i and b.j = a.j + 1) where a.label <> b.label)
select least(l1, l2) a, greatest(l1, l2) b, count(*) contact from m group by 1, 2""")
def raster_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """J18"""
    labelled = points(spark, d).groupBy(F.floor(F.col("x") / 0.05).cast("long").alias("i"), F.floor(F.col("y") / 0.05).cast("long").alias("j")).agg(F.min("label").alias("label"))
    return grid.adjacency(labelled)


ANGLES = [math.radians(5 * k) for k in range(18)]


@query(f"""with {P}, t as (select * from (values {", ".join(f"({k}, {math.cos(a)!r}::double, {math.sin(a)!r}::double)" for k, a in enumerate(ANGLES))}) v(k, c, s)),
u as (select k, 0 d, x * c + y * s u from p, t union all select k, 1, y * c - x * s from p, t),
b as (select k, d, ph, floor(u / 0.02 + ph) bin, count(*) n from u, (select unnest([0.0, 0.5]) ph) group by all) select k, sum(n * n)::bigint score from b group by 1""")
def axis_score(spark: SparkSession, d: str) -> DataFrame:
    """A6"""
    return rays.axis_scores(points(spark, d), "x", "y", ANGLES, 0.02)


WALLS = "m as (select label, round(avg(x), 6) x, round(avg(y), 6) y from p group by 1), w as (select label wall, x ax, y ay, lead(x) over (order by label) bx, lead(y) over (order by label) by_ from m)"


def walls(spark: SparkSession, d: str) -> DataFrame:
    """The polyline through the labels' mean points, as a scene's walls; the labels are few at every scale."""
    from pyspark.sql import Window

    w = Window.orderBy("label")
    m = points(spark, d).groupBy("label").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))
    return m.select(F.col("label").alias("wall"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")


@query(f"""with {P}, {WALLS}, r as (select vec_id origin, x ox, y oy, ray, cos(ray * {2 * math.pi / 72!r}) dx, sin(ray * {2 * math.pi / 72!r}) dy from p, (select unnest(range(72)) ray)),
d as (select *, dx * (by_ - ay) - dy * (bx - ax) det from r, w where bx is not null),
h as (select *, ((ax - ox) * (by_ - ay) - (ay - oy) * (bx - ax)) / det t, ((ax - ox) * dy - (ay - oy) * dx) / det u from d where abs(det) > 1e-9),
k as (select *, row_number() over (partition by origin, ray order by round(t, 9), wall) q from h where t > 1e-9 and u between 0 and 1)
select origin, ray::int ray, wall, round(t, 9) t from k where q = 1""")
def ray_first_hit(spark: SparkSession, d: str) -> DataFrame:
    """J12, G15"""
    origins = points(spark, d).select(F.col("vec_id").alias("origin"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return rays.first_hits(origins, walls(spark, d), 72)


@query(f"""with {P}, {WALLS}, g as (select x, y, lead(x) over v x2, lead(y) over v y2 from p window v as (partition by label order by vec_id)),
d as (select *, (x2 - x) * (by_ - ay) - (y2 - y) * (bx - ax) det from g, w where x2 is not null and bx is not null),
h as (select wall, ((ax - x) * (by_ - ay) - (ay - y) * (bx - ax)) / det t, ((ax - x) * (y2 - y) - (ay - y) * (x2 - x)) / det u from d where abs(det) > 1e-12)
select wall, count(*) n from h where t between 0 and 1 and u between 0 and 1 group by 1""")
def camera_crossing(spark: SparkSession, d: str) -> DataFrame:
    """J11, W13"""
    return rays.crossings(points(spark, d), ["label"], ["vec_id"], walls(spark, d))


@query("""with s as (select doc_id, trim(split_part(text, ' ', 1)) a, source b, substr(source, 4) c from documents)
select doc_id, try_cast(c as double) c from s where try_cast(c as double) is not null and isfinite(try_cast(c as double))""")
def malformed_filter(spark: SparkSession, d: str) -> DataFrame:
    """C1 to C4"""
    raw = table(spark, d, "documents").select(F.col("doc_id").alias(" doc_id "), F.expr("substr(source, 4)").alias(" c"))
    return clean.well_formed(clean.numbers(clean.require(clean.trimmed(raw), ["doc_id", "c"]), ["c"]), ["c"])


@query("select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l using (doc_id)")
def frame_bundle_join(spark: SparkSession, d: str) -> DataFrame:
    """J1"""
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")


@query("""with c as (select p_brand, s, median(abs(p_retailprice * s - 1000)) err from part, (select unnest([0.5, 0.75, 1.0]) s) group by 1, 2),
r as (select *, row_number() over (partition by p_brand order by round(err, 6), s) k, lead(err) over (partition by p_brand order by round(err, 6), s) nxt from c)
select p_brand, s::double scale, round(err, 6) err, round(nxt / err, 6) margin from r where k = 1""")
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """J6, O1"""
    from pyspark.sql import Window

    tried = table(spark, d, "part").select("p_brand", "p_retailprice", F.explode(F.array(F.lit(0.5), F.lit(0.75), F.lit(1.0))).alias("scale"))
    c = tried.groupBy("p_brand", "scale").agg(F.median(F.abs(F.col("p_retailprice") * F.col("scale") - 1000)).alias("err"))
    w = Window.partitionBy("p_brand").orderBy(F.round("err", 6), "scale")
    best = c.withColumns({"k": F.row_number().over(w), "next": F.lead("err").over(w)}).where("k = 1")
    return best.select("p_brand", "scale", F.round("err", 6).alias("err"), F.round(F.col("next") / F.col("err"), 6).alias("margin"))


@query("""select o_orderkey, round(o_totalprice - h, 6) lower, round(o_totalprice + h, 6) upper from (select o_orderkey, o_totalprice,
(0.01 + (case when o_orderpriority like '1%' then 0.02 else 0.01 end) * abs(o_totalprice) + 2 * 0.5) * (case when o_orderkey % 400 < 200 then 2 else 1 end) h from orders)""")
def interval_measurement(spark: SparkSession, d: str) -> DataFrame:
    """M18"""
    o = table(spark, d, "orders")
    h = interval_half_width(F.col("o_totalprice"), F.lit(0.5), 0.01, 0.01, 2.0, F.startswith("o_orderpriority", F.lit("1")), F.col("o_orderkey") % 400)
    return o.select("o_orderkey", F.round(F.col("o_totalprice") - h, 6).alias("lower"), F.round(F.col("o_totalprice") + h, 6).alias("upper"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def topk_stable(spark: SparkSession, d: str) -> DataFrame:
    """O1 to O3: a report of the first hundred"""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("select o_orderkey, o_custkey from orders where o_orderkey % 6 = 0")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    """O7"""
    return table(spark, d, "orders").where(F.pmod("o_orderkey", F.lit(6)) == 0).select("o_orderkey", "o_custkey")


@query("""with r as (select s_suppkey, row_number() over (order by s_suppkey) - 1 k, count(*) over () n from supplier),
w as (select distinct round_even(i * ((select count(*) from supplier) - 1) / 16.0, 0)::bigint k from (select unnest(range(17)) i)) select s_suppkey from r semi join w on w.k = r.k""")
def evenly_spaced(spark: SparkSession, d: str) -> DataFrame:
    """O4, W14, C11"""
    return series.evenly(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], 17)


@query("select l_orderkey, l_linenumber from lineitem l join (select l_orderkey k, max(l_extendedprice) m from lineitem group by 1) on k = l_orderkey where l_extendedprice >= 0.9 * m")
def share_of_best(spark: SparkSession, d: str) -> DataFrame:
    """W15"""
    return series.share_of_best(table(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice", 0.9).select("l_orderkey", "l_linenumber")


@query("""select k, 'union' op from (select c_nationkey k from customer union select s_nationkey from supplier) union all
select * from (select k, 'intersect' op from (select c_nationkey k from customer intersect select s_nationkey from supplier)) union all
select * from (select k, 'except' op from (select n_nationkey k from nation except select s_nationkey from supplier))""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """U1 to U4"""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    named = lambda x, op: x.withColumn("op", F.lit(op))
    return named(c.union(s).distinct(), "union").union(named(c.intersect(s), "intersect")).union(named(n.exceptAll(s.distinct()), "except"))


@query("""with p as (select o_orderkey, (o_orderkey % 256)::int u, (o_custkey % 192)::int v, o_totalprice * 0.00005::double z, (o_orderkey % 3)::int c from orders)
select o_orderkey, round((u - 128) * z / 212.5, 9) x, round((v - 96) * z / 212.5, 9) y, round(z, 9) z from p where z between 0.1 and 6 and c >= 1""")
def back_projection(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pixels of a depth grid, with intrinsics scaled from a larger image"""
    o = table(spark, d, "orders")
    px = o.select("o_orderkey", F.pmod("o_orderkey", F.lit(256)).cast("int").alias("u"), F.pmod("o_custkey", F.lit(192)).cast("int").alias("v"), F.col("o_totalprice").alias("raw"), F.pmod("o_orderkey", F.lit(3)).alias("confidence"))
    px = px.withColumns({"fx": F.lit(1593.75), "fy": F.lit(1593.75), "cx": F.lit(960.0), "cy": F.lit(720.0)})
    seen = project.back_projected(project.depth_intrinsics(px, (1920, 1440), (256, 192)), 0.00005, 0.1, 6.0, 1)
    return seen.select("o_orderkey", *[F.round(a, 9).alias(a) for a in "xyz"])


@query(f"with {P} select vec_id, round(1 - z, 9) x, round(2 + x, 9) y, round(3 - y, 9) z from p")
def pose_transform(spark: SparkSession, d: str) -> DataFrame:
    """A pose whose rotation turns x to y, y to z and z to x, of a camera whose y is up"""
    posed = points(spark, d).withColumns({"px": F.lit(1.0), "py": F.lit(2.0), "pz": F.lit(3.0), **{q: F.lit(0.5) for q in project.Q}})
    return project.to_world(posed).select("vec_id", *[F.round(a, 9).alias(a) for a in "xyz"])


@query(f"with {P} select vec_id, round(0.6 * (x - 1) + 0.8 * (z - 1), 9) h from p where 0.6 * (x - 1) + 0.8 * (z - 1) between -1.4 and -1.2")
def height_band(spark: SparkSession, d: str) -> DataFrame:
    """Heights over a floor, in a closed band"""
    local = project.to_local(points(spark, d), (1.0, 1.0, 1.0), (0.6, 0.0, 0.8))
    return local.where(F.col("h").between(-1.4, -1.2)).select("vec_id", F.round("h", 9).alias("h"))


@query(f"""with {P} select label, round(covar_samp(x, x), 9) s_xx, round(covar_samp(x, y), 9) s_xy, round(covar_samp(x, z), 9) s_xz, round(covar_samp(y, y), 9) s_yy,
round(covar_samp(y, z), 9) s_yz, round(covar_samp(z, z), 9) s_zz, round(avg(x), 9) m_x, round(avg(y), 9) m_y, round(avg(z), 9) m_z, count(*) n from p group by 1""")
def covariance(spark: SparkSession, d: str) -> DataFrame:
    """Covariances of each group's points, the sums of a plane's fit"""
    c = project.covariance(points(spark, d), ["label"])
    return c.withColumns({k: F.round(k, 9) for k in c.columns if k[:2] in ("s_", "m_")})
