import pytest
from pyspark.sql import functions as F

from lumenquarry.functions import quaternion_angle
from lumenquarry.operators import clean, grid, series, timejoin


def test_malformed_rows_are_dropped_and_optional_ones_kept(spark):
    df = spark.createDataFrame([("1", "2"), ("abc", "3"), ("inf", "4"), ("5", "x"), (None, "6")], [" a", "b "])
    out = clean.well_formed(clean.numbers(clean.require(clean.trimmed(df), ["a"]), ["a", "b"]), ["a"])
    assert sorted((r.a, r.b) for r in out.collect() if r.b) == [(1.0, 2.0)]
    assert out.count() == 2
    with pytest.raises(ValueError, match="missing"):
        clean.require(df, ["c"])


def test_quaternions_all_divided_or_none(spark):
    rows = [(0.0, 0.0, 0.0, 2.0), (1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, ["x", "y", "z", "w"])
    assert {tuple(r) for r in clean.unit_quaternions(df, ("x", "y", "z", "w"), 1e-3).collect()} == {(0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 0.0)}
    with pytest.raises(ValueError):
        clean.unit_quaternions(spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)], ["x", "y", "z", "w"]), ("x", "y", "z", "w"), 1e-3)


def test_quaternion_angle_ignores_sign(spark):
    q, r = [F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)], [F.lit(x) for x in (0.0, 0.0, -1.0, 0.0)]
    assert spark.range(1).select(quaternion_angle(q, r).alias("d")).first().d == pytest.approx(180.0)


def test_nearest_takes_the_earlier_on_a_tie(spark):
    left = spark.createDataFrame([(1, 1, 10), (2, 1, 100), (3, 2, 5)], "id long, g long, t long")
    right = spark.createDataFrame([(7, 1, 8), (8, 1, 12), (9, 1, 90)], "rid long, g long, t long")
    got = {(r.id, r.rid, r.gap) for r in timejoin.nearest(left, right, ["g"], "t", "id", "rid").collect()}
    assert got == {(1, 7, 2), (2, 9, 10)}


def test_histogram_puts_the_largest_in_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], ["v"])
    assert [r.n for r in series.histogram(df, "v", 0.5).orderBy("bin").collect()] == [1, 2]
    assert series.histogram(df.where("v > 5"), "v", 0.5).count() == 0


def test_conformal_rank(spark):
    df = spark.createDataFrame([(1, float(k)) for k in range(1, 11)], ["g", "r"])
    assert series.conformal(df, ["g"], F.col("r"), 0.1).first().quantile == 10.0
    assert series.conformal(df, ["g"], F.col("r"), 0.5).first().quantile == 6.0


def test_components_four_and_eight(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    g = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (5, 5)], "i long, j long")
    assert grid.components(g, eight=True).select("ci", "cj").distinct().count() == 2
    assert grid.components(g, eight=False).select("ci", "cj").distinct().count() == 3


def test_close_fills_a_gap(spark):
    g = spark.createDataFrame([(0, 0), (2, 0)], "i long, j long")
    assert (1, 0) in {(r.i, r.j) for r in grid.close(g).collect()}


def test_missing_keys_between_the_ends(spark):
    df = spark.createDataFrame([(3,), (6,)], "k long")
    assert sorted(r.k for r in clean.missing_keys(df, "k", None).collect()) == [4, 5]
    assert sorted(r.k for r in clean.missing_keys(df, "k", 2, 6).collect()) == [2, 4, 5]


def test_missing_ids_of_the_whole_table(spark, tmp_path):
    import __spark_entry__

    spark.range(10, 60000).where("id % 25000 != 0").withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    got = __spark_entry__.queries()["missing_ids_whole"](spark, str(tmp_path))
    assert sorted(r[0] for r in got.collect()) == [25000, 50000]
