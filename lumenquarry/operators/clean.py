"""Cleaning and validation (C1 to C14, U2): everything is an expression or a pre-aggregated group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite


def trimmed(df: DataFrame) -> DataFrame:
    """Column names without spaces around them."""
    return df.toDF(*[c.strip() for c in df.columns])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Df, or an error that lists what is missing and what was found."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Strings to numbers; what isn't one becomes null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns})


def well_formed(df: DataFrame, required: list[str]) -> DataFrame:
    """C4: rows whose required values are all finite."""
    keep = F.lit(True)
    for c in required:
        keep = keep & finite(F.col(c))
    return df.where(keep)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their count n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_keys(df: DataFrame, key: str, first: int | None, last: int | None = None) -> DataFrame:
    """Integers from first (or the least key) to last (or the largest key) that no row has."""
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    lo = F.col("lo") if first is None else F.lit(first)
    hi = F.col("hi") if last is None else F.lit(last)
    if first is not None and last is not None:
        every = df.sparkSession.range(first, last + 1).withColumnRenamed("id", key)
    else:
        step = 1 << 16  # the range is unfolded in two steps, so that no row holds all of it
        starts = ends.select(F.explode(F.sequence(lo, hi, F.lit(step))).alias("s"), hi.alias("hi"))
        every = starts.select(F.explode(F.sequence("s", F.least(F.col("s") + step - 1, "hi"))).alias(key))
    return every.join(df.select(key).distinct(), key, "left_anti")


def unit_quaternions(df: DataFrame, columns: tuple[str, str, str, str], tolerance: float) -> DataFrame:
    """If any norm is off by more than tolerance, all rows are divided by their own norm; a norm near 0 is an error."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0])))
    state = df.agg(F.min(norm).alias("least"), F.max(F.abs(norm - 1)).alias("off")).first()
    if state["least"] is not None and state["least"] < 1e-8:
        raise ValueError("a quaternion has no length")
    if state["off"] is None or state["off"] <= tolerance:
        return df
    return df.withColumn("_norm", norm).withColumns({c: F.col(c) / F.col("_norm") for c in columns}).drop("_norm")


def spread(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Least, largest, mean, median and population deviation of a group."""
    c = F.col(column)
    return df.groupBy(*by).agg(F.min(c).alias("least"), F.max(c).alias("largest"), F.avg(c).alias("mean"), F.median(c).alias("middle"), F.stddev_pop(c).alias("deviation"))


def steps(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Count, median, mean and largest step of an ordered series, and whether all steps are positive."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    return d.groupBy(*by).agg(
        F.count("*").alias("n"), F.median("_d").alias("middle_step"), F.avg("_d").alias("mean_step"), F.max("_d").alias("largest_step"), F.coalesce(F.bool_and(F.col("_d") > 0), F.lit(True)).alias("monotonic")
    )
